import json

import pytest
from pyspark.sql import functions as F

from shotstream.functions.validity import last_per_name
from shotstream.operators import ingest, points, resample
from shotstream.schema import CHANNELS, POINT

GOOD = [("ip", 1.0, "good")]


def reasons(df):
    return [r.reason for r in df.orderBy("i").collect()]


def test_first_broken_rule_wins(spark):
    rows = [
        (0, "s", 5, GOOD),
        (1, "", 0, []),
        (2, None, 5, GOOD),
        (3, "s", 0, []),
        (4, "s", 0, GOOD),
        (5, "s", -1, GOOD),
        (6, "s", 5, [("ip", 1.0, "good"), ("spare", 1.0, "good")]),
        (7, "s", 5, [(None, 1.0, "good")]),
        (8, "s", 5, None),
    ]
    schema = f"i int, {POINT.simpleString()[7:-1]}"
    df = ingest.validate(spark.createDataFrame(rows, schema))
    assert reasons(df) == [
        None,
        "missing shot_id",
        "missing shot_id",
        "no channels",
        "invalid timestamp",
        "invalid timestamp",
        "channel not allowed",
        "channel not allowed",
        "no channels",
    ]


def test_channel_limit(spark):
    rows = [(0, "s", 5, [("ip", float(i), "good") for i in range(3)])]
    df = spark.createDataFrame(rows, f"i int, {POINT.simpleString()[7:-1]}")
    assert reasons(ingest.validate(df, max_channels=2)) == ["too many channels"]
    assert reasons(ingest.validate(df, max_channels=None)) == [None]


def test_malformed_payloads(spark):
    good = json.dumps({"shot_id": "s", "ts_unix_ns": 5, "channels": [{"name": "ip", "value": 1.0}]})
    texts = [good, "{" + good, "[1]", '{"shot_id":"s","ts_unix_ns":"x","channels":[]}', "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    got = reasons(ingest.validate(ingest.decode(df)))
    assert got[0] is None and got[1] == "invalid payload" and got[3] == "invalid payload"
    assert all(g is not None for g in got[1:])


@pytest.mark.parametrize("seed", [1, 2])
def test_monotonic_equals_arrival_loop(spark, limits, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for arrival in range(300):
        shot = "hot" if rng.random() < 0.7 else rng.choice("ab")
        rows.append((arrival, shot, arrival + rng.randint(-9, 9) + 20, rng.choice([None, None, "x"])))
    last, want = {}, []
    for arrival, shot, ts, reason in rows:
        if reason is None:
            if ts > last.get(shot, 0):
                last[shot] = ts
                want.append(arrival)
    df = spark.createDataFrame(rows, "arrival bigint, shot_id string, ts_unix_ns bigint, reason string")
    got = ingest.monotonic(df.repartition(3), limits=limits).filter("reason is null")
    assert sorted(r.arrival for r in got.collect()) == want


def test_monotonic_continues_from_state(spark):
    df = spark.createDataFrame(
        [(0, "s", 10, None), (1, "s", 11, None)],
        "arrival bigint, shot_id string, ts_unix_ns bigint, reason string",
    )
    state = spark.createDataFrame([("s", 10)], "shot_id string, last_ts bigint")
    got = ingest.monotonic(df, last_accepted=state).filter("reason is null").collect()
    assert [r.ts_unix_ns for r in got] == [11]


def test_acknowledge_and_drop_rate(spark):
    df = spark.createDataFrame(
        [("s", None), ("s", None), ("s", "no channels"), ("t", None)], "shot_id string, reason string"
    )
    acks = {(r.shot_id, r.outcome): r.points for r in ingest.acknowledge(df).collect()}
    assert acks == {("s", "accepted"): 2, ("s", "no channels"): 1, ("t", "accepted"): 1}
    rates = {r.shot_id: r.drop_rate for r in ingest.drop_rate(df).collect()}
    assert rates["s"] == pytest.approx(1 / 3) and rates["t"] == 0


def test_missing_ratio(spark):
    rows = [
        ("s", 1, [(c, 1.0, "good") for c in CHANNELS]),
        ("s", 2, [("ip", 1.0, "good"), ("ne", 1.0, "good")]),
        ("s", 3, [("ip", 1.0, "good"), ("ip", 2.0, "good")]),
        ("s", 4, [(c, 1.0, "good") for c in (*CHANNELS, "extra")]),
    ]
    df = spark.createDataFrame(rows, POINT)
    got = [r.missing_ratio for r in ingest.with_missing_ratio(df).orderBy("ts_unix_ns").collect()]
    assert got == pytest.approx([0.0, 0.6, 0.8, 0.0])
    none = ingest.with_missing_ratio(df, []).select("missing_ratio").distinct().collect()
    assert [r.missing_ratio for r in none] == [0.0]
    assert ingest.quality_gate(ingest.with_missing_ratio(df)).count() == 2


def test_last_sample_of_a_name_stays(spark):
    df = spark.createDataFrame([("s", 1, [("ip", 1.0, "good"), ("ne", 2.0, "good"), ("ip", 3.0, "outlier")])], POINT)
    kept = df.select(F.explode(last_per_name("channels")).alias("c")).select("c.*").collect()
    assert [(r.name, r.value) for r in kept] == [("ne", 2.0), ("ip", 3.0)]


def test_explode_and_assemble_are_inverse(spark):
    rows = [("s", 600, [("ip", 1.0, "good"), ("ne", 2.0, "missing")]), ("s", 1200, [("ip", 3.0, "good")])]
    df = spark.createDataFrame(rows, POINT)
    again = points.assemble_points(points.explode_points(df), 600).orderBy("ts_unix_ns").collect()
    assert [(r.ts_unix_ns, [tuple(c) for c in r.channels]) for r in again] == [(r[1], r[2]) for r in rows]


def test_bucket_keeps_last_sample(spark):
    rows = [("s", 10, "ip", 1.0, "good"), ("s", 19, "ip", 2.0, "good"), ("s", 20, "ip", 3.0, "good")]
    df = spark.createDataFrame(
        rows, "shot_id string, ts_unix_ns bigint, channel_name string, value double, quality string"
    )
    got = points.assemble_points(df, 10).orderBy("ts_unix_ns").collect()
    assert [(r.ts_unix_ns, r.channels[0].value) for r in got] == [(10, 2.0), (20, 3.0)]


def test_wide_rows_drop_unreadable_cells(spark):
    rows = [("s", "1", "0.5", "oops"), ("s", "2", "bad", ""), ("t", "3", "1e2", "7")]
    df = spark.createDataFrame(rows, "shot_id string, time_ms string, ip string, ne string")
    got = {
        (r.shot_id, r.ts_unix_ns): [(c.name, c.value) for c in r.channels]
        for r in points.wide_to_points(df).collect()
    }
    assert got == {
        ("s", 1_000_000): [("ip", 0.5)],
        ("t", 3_000_000): [("ip", 100.0), ("ne", 7.0)],
    }
    assert {r.shot_id for r in points.wide_to_points(df, "x").collect()} == {"x"}


def test_wide_long_round_trip(spark):
    wide = spark.createDataFrame(
        [("s", 1, 1.0, None), ("s", 2, float("nan"), 4.0)],
        "shot_id string, time_unix_ns bigint, ip double, ne double",
    )
    long = points.wide_to_long(wide)
    assert sorted(tuple(r) for r in long.collect()) == [("s", 1, "ip", 1.0), ("s", 2, "ne", 4.0)]
    back = points.long_to_wide(long, ["ip", "ne"]).orderBy("ts_unix_ns").collect()
    assert [(r.ip, r.ne) for r in back] == [(1.0, None), (None, 4.0)]


def test_resample_fills_bounded_gaps(spark, limits):
    rows = [("s", 3, "ip", 1.0), ("s", 8, "ip", 2.0), ("s", 41, "ip", 3.0), ("s", 95, "ip", 4.0)]
    df = spark.createDataFrame(rows, "shot_id string, ts_unix_ns bigint, channel_name string, value double")
    got = resample.resample(df, 10, max_fill=3, limits=limits).orderBy("ts_unix_ns").collect()
    assert [(r.ts_unix_ns, r.value, r.filled) for r in got] == [
        (0, 2.0, False),
        (10, 2.0, True),
        (20, 2.0, True),
        (30, 2.0, True),
        (40, 3.0, False),
        (50, 3.0, True),
        (60, 3.0, True),
        (70, 3.0, True),
        (90, 4.0, False),
    ]
    assert resample.resample(df, 10).count() == 3
