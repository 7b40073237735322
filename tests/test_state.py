"""Snapshot tables, state that forgets, and Spark's keyed state."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streaming import log, plan, write_log

from shotstream.operators import ingest
from shotstream.schema import MESSAGE
from shotstream.sources import snapshots
from shotstream.sources.snapshots import Layout, SnapshotTable
from shotstream.streaming.keyed import judged_stream, start
from shotstream.streaming.pipeline import RiskStream, read_messages

LAYOUT = Layout("shot_id string, ts bigint, value double", ("shot_id", "ts"), "shot_id", buckets=4, time="ts", slice_width=10)


def frame(spark, rows):
    return spark.createDataFrame(rows, LAYOUT.schema)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_read(df):
    return len(df.inputFiles())


def test_upserts_equal_a_dictionary(spark, tmp_path):
    table, want, draw = SnapshotTable.create(spark, str(tmp_path / "t"), LAYOUT), {}, random.Random(1)
    for step in range(4):
        rows = {(f"s{draw.randint(0, 5)}", draw.randint(0, 40)): float(step) for _ in range(25)}
        want |= rows
        assert table.upsert(frame(spark, [(*k, v) for k, v in rows.items()])) == step + 1
    table = SnapshotTable.open(spark, str(tmp_path / "t"))
    assert table.layout == LAYOUT
    assert rows_of(table.read()) == sorted(((*k, v) for k, v in want.items()), key=repr)
    part = table.read("s3", low=10, high=25)
    assert rows_of(part) == sorted(((*k, v) for k, v in want.items() if k[0] == "s3" and 10 <= k[1] <= 25), key=repr)
    assert files_read(part) < files_read(table.read())
    asked = frame(spark, [("s1", 3, 0.0), ("s1", 4, 0.0), ("zz", 1, 0.0), ("s2", 33, 0.0)]).drop("value")
    assert rows_of(table.lookup(asked)) == sorted((*k, want[k]) for k in [("s1", 3), ("s1", 4), ("s2", 33)] if k in want)


def test_order_columns_decide(spark, tmp_path):
    layout = Layout("k string, v double, arrival bigint", ("k",), "k", order=("arrival",))
    table = SnapshotTable.create(spark, str(tmp_path / "t"), layout)
    for rows in ([("a", 1.0, 5), ("a", 2.0, 7)], [("a", 3.0, 6), ("b", 1.0, None)], [("b", 2.0, 1), (None, 1.0, 1)]):
        table.upsert(spark.createDataFrame(rows, layout.schema))
    assert rows_of(table.read()) == rows_of(spark.createDataFrame([("a", 2.0, 7), ("b", 2.0, 1), (None, 1.0, 1)], layout.schema))


def test_a_failed_write_leaves_the_snapshot(spark, tmp_path):
    table = SnapshotTable.create(spark, str(tmp_path / "t"), LAYOUT)
    table.upsert(frame(spark, [("a", 1, 1.0), ("b", 2, 1.0)]))
    before = rows_of(table.read())
    bad = frame(spark, [("a", 1, 2.0)]).withColumn("value", F.expr("if(ts = 1, raise_error('lost'), value)").cast("double"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(bad)
    assert rows_of(table.read()) == before and table.version() == 1
    # A version whose folder is not complete does not count either.
    (tmp_path / "t" / "log" / "version=00000002").mkdir()
    assert table.version() == 1 and rows_of(table.read()) == before
    table.upsert(frame(spark, [("a", 1, 3.0)]))
    assert rows_of(table.read("a")) == [("a", 1, 3.0)]


def test_what_is_written_follows_the_rows_written(spark, tmp_path):
    table = SnapshotTable.create(spark, str(tmp_path / "t"), LAYOUT)
    table.upsert(frame(spark, [(f"s{i}", t, 0.0) for i in range(20) for t in range(100)]))
    sizes = []
    for step in range(5):
        known = {p.name for p in (tmp_path / "t" / "data").rglob("*.parquet")}
        table.upsert(frame(spark, [("s1", 55, float(step))]))
        added = [p for p in (tmp_path / "t" / "data").rglob("*.parquet") if p.name not in known]
        sizes.append(sum(spark.read.parquet(str(p)).count() for p in added))
    assert max(sizes) <= 30  # the cell has some 50 rows, the table 2000
    assert rows_of(table.read("s1", 55, 55)) == [("s1", 55, 4.0)] and table.read().count() == 2000
    per_cell = table.cells().groupBy("_bucket", "_slice").count().agg(F.max("count")).first()[0]
    assert per_cell <= 4


def test_repeating_a_version_replaces_it(spark, tmp_path):
    table = SnapshotTable.create(spark, str(tmp_path / "t"), LAYOUT)
    for step in range(3):
        for value in (-1.0, float(step)):  # the first try is thrown away
            table.upsert(frame(spark, [("a", 1, value), ("b", step, value)]), version=step)
    assert rows_of(table.read()) == [("a", 1, 2.0)] + [("b", t, float(t)) for t in range(3)]
    assert rows_of(table.read(version=2)) == [("a", 1, 1.0)] + [("b", t, float(t)) for t in range(2)]


def test_full_lists_and_many_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FULL_EVERY", 3)
    monkeypatch.setattr(snapshots, "NAMED_CELLS", 2)
    table, want = SnapshotTable.create(spark, str(tmp_path / "t"), LAYOUT), {}
    for step in range(7):
        rows = {(f"s{i}", (7 * step) % 30 + i): float(step) for i in range(4)}
        want |= rows
        table.upsert(frame(spark, [(*k, v) for k, v in rows.items()]))
    assert rows_of(table.read()) == sorted(((*k, v) for k, v in want.items()), key=repr)


def test_events_read_only_files_that_may_hold_them(spark, tmp_path):
    layout = Layout("event_id bigint, shot_id string, ts bigint", ("event_id",), "event_id", buckets=4, bloom=True)
    table = SnapshotTable.create(spark, str(tmp_path / "e"), layout)
    batches = [[(1000 * b + i, f"s{i}", i) for i in range(40)] for b in range(4)]
    for rows in batches:
        assert table.append(spark.createDataFrame(rows + rows[:3], layout.schema)) <= 2  # new ids: nothing to read, but for chance
    live = table.cells().count()
    assert live == 16 and table.read().count() == 160
    assert table.append(spark.createDataFrame(batches[2][:1], layout.schema)) <= 2
    assert table.append(spark.createDataFrame(batches[1], layout.schema)) <= 8
    assert table.read().count() == 160 and table.cells().count() == live
    table.append(spark.createDataFrame([(5, "x", 1), (99_999, "new", 1), (99_999, "new", 1)], layout.schema))
    assert rows_of(table.read().where("shot_id in ('x', 'new')")) == [(99_999, "new", 1)]


def test_bloom_has_no_false_negatives():
    draw = np.random.default_rng(1)
    hashes, others = draw.integers(-(2**63), 2**63 - 1, (2, 5000))
    bloom = snapshots.bloom_of(hashes)
    assert snapshots.may_hold(bloom, hashes).all() and snapshots.may_hold(bloom, others).mean() < 0.02
    assert not snapshots.may_hold(snapshots.bloom_of(hashes[:0]), others).any()


def messages_at(times, first=0):
    channels = [{"name": "ip", "value": 1.0, "quality": "good"}]
    return [(first + i, json.dumps({"shot_id": s, "ts_unix_ns": t, "channels": channels})) for i, (s, t) in enumerate(times)]


def test_idle_shots_are_forgotten(spark, tmp_path):
    stream = RiskStream(plan(tmp_path, until="ingest", ttl_ns=100, state_buckets=1))
    held = []
    for batch in range(5):
        rows = messages_at([(f"shot{batch}-{i}", 1000 * (batch + 1) + i) for i in range(10)], 100 * batch)
        stream.process(spark.createDataFrame(rows, MESSAGE), batch)
        held.append(snapshots.rows_and_files(stream.memory(spark, "last_ts"))[0])
    assert max(held) <= 30  # 50 shots came by
    # A forgotten shot starts anew; one that is not forgotten goes on.
    rows = messages_at([("shot0-0", 5), ("shot4-0", 5), ("shot4-1", 9000)], 900)
    stream.process(spark.createDataFrame(rows, MESSAGE), 5)
    reasons = {r.arrival: r.reason for r in stream.table(spark, "judged").filter("arrival >= 900").collect()}
    assert reasons == {900: None, 901: ingest.LATE, 902: None}


def test_state_written_follows_the_batch(spark, tmp_path):
    stream = RiskStream(plan(tmp_path, until="features", state_buckets=4))
    stream.process(spark.createDataFrame(messages_at([(f"s{i}", 10 + t) for i in range(60) for t in range(3)]), MESSAGE), 0)
    for batch in range(1, 3):
        known = {p.name for p in (tmp_path / "state").rglob("data/**/*.parquet")}
        stream.process(spark.createDataFrame(messages_at([("s7", 100 * batch)], 1000 * batch), MESSAGE), batch)
        added = [p for p in (tmp_path / "state").rglob("data/**/*.parquet") if p.name not in known]
        assert sum(spark.read.parquet(str(p)).count() for p in added) <= 8  # 120 rows of state lie there
    tail = stream.memory(spark, "tail").read("s7").first()
    assert [s.ts_unix_ns for s in tail.samples] == [10, 11, 12, 100, 200]


def judged_by_keys(spark, tmp_path, waves, **options):
    """(arrival, reason) of all waves, and the progress of each run's batches."""
    progress = []
    for wave in waves:
        write_log(tmp_path / "log", wave)
        judged = judged_stream(read_messages(spark, str(tmp_path / "log")), **options)
        query = start(judged, str(tmp_path / "out"), str(tmp_path / "cp"), options.get("idle", "processing"))
        assert query.awaitTermination(60)
        progress.append(query.recentProgress)
    return {(r.arrival, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}, progress


@pytest.fixture
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keyed_state_equals_batch(spark, tmp_path, two_partitions):
    rows = log(4, 90)
    got, _ = judged_by_keys(spark, tmp_path, [rows[:40], rows[40:45], rows[45:]], ttl_ms=3_600_000)
    batch = ingest.monotonic(ingest.validate(ingest.decode(spark.createDataFrame(rows, MESSAGE))))
    assert got == {(r.arrival, r.reason) for r in batch.collect()} and len(got) == 90
    with pytest.raises(ValueError):
        judged_stream(spark.createDataFrame(rows, MESSAGE), 1, idle="never")


def test_keyed_state_forgets_by_event_time(spark, tmp_path, two_partitions):
    second = 1_000_000_000
    waves = [
        messages_at([(f"s{i}", (100 + i) * second) for i in range(20)]),
        messages_at([("next", 10_000 * second)], 100),
        messages_at([("next", 20_000 * second)], 200),
        messages_at([("next", 19_995 * second), ("late", 5 * second), ("fresh", 20_001 * second)], 300),
    ]
    got, progress = judged_by_keys(spark, tmp_path, waves, ttl_ms=60_000, idle="event", delay="30 seconds")
    assert {a for a, reason in got if reason is None} == {*range(20), 100, 200, 302}
    assert (300, ingest.LATE) in got and 301 not in {a for a, _ in got}
    operators = [[batch["stateOperators"][0] for batch in run if batch["stateOperators"]] for run in progress]
    held = [run[-1]["numRowsTotal"] for run in operators]
    assert max(held) >= 20 and held[-1] < 12
    assert sum(batch["numRowsDroppedByWatermark"] for run in operators for batch in run) >= 1


def test_keyed_state_forgets_by_processing_time(spark, tmp_path, two_partitions):
    got, _ = judged_by_keys(spark, tmp_path, [messages_at([("a", 50), ("b", 50)]), messages_at([("a", 40)], 10)], ttl_ms=3_600_000)
    assert (10, ingest.LATE) in got
    other = tmp_path / "short"
    other.mkdir()
    write_log(other / "log", messages_at([("a", 50)]))
    first, _ = judged_by_keys(spark, other, [messages_at([("b", 50)], 1)], ttl_ms=500)
    time.sleep(1)
    second, _ = judged_by_keys(spark, other, [messages_at([("a", 40)], 10)], ttl_ms=500)
    assert (10, None) in second
