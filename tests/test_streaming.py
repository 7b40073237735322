import json
import random

import pytest
from pyspark.sql import functions as F
from series import TINY, WHOLE

from shotstream.functions.risk import LinearModel
from shotstream.operators import features, ingest, points
from shotstream.schema import MESSAGE
from shotstream.streaming.pipeline import RiskStream, StreamPlan, read_messages

MODEL = LinearModel({"ip_last_w3": 1.0, "ne_last_w3": 0.5}, -2.0, "m")


def log(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for arrival in range(n):
        channels = [
            {"name": c, "value": round(rng.uniform(0, 5), 2), "quality": "good"}
            for c in rng.sample(["ip", "ne", "spare"], rng.choice([1, 1, 2]))
            if c != "spare" or rng.random() < 0.2
        ]
        point = {
            "shot_id": rng.choice(["hot", "hot", "hot", "b"]),
            "ts_unix_ns": 100 + arrival * 2 + rng.randint(-8, 8),
            "channels": channels,
        }
        text = json.dumps(point)
        out.append((arrival, "{" + text if rng.random() < 0.05 else text))
    return out


def plan(root, limits=WHOLE, **extra):
    return StreamPlan(root=str(root), windows=(3, 10), model=MODEL, limits=limits, **extra)


def write_log(path, rows):
    path.mkdir(exist_ok=True)
    text = "\n".join(json.dumps({"arrival": a, "payload": p}) for a, p in rows)
    (path / f"{rows[0][0]:06d}.json").write_text(text)


@pytest.mark.parametrize("limits", [WHOLE, TINY], ids=["whole", "chunked"])
def test_stream_equals_batch(spark, tmp_path, limits):
    rows = log()
    stream = RiskStream(plan(tmp_path / "run", limits))
    for wave in (rows[:50], rows[50:55], rows[55:]):
        write_log(tmp_path / "log", wave)
        stream.start(read_messages(spark, str(tmp_path / "log"))).awaitTermination()
    judged = ingest.monotonic(ingest.validate(ingest.decode(spark.createDataFrame(rows, MESSAGE))))
    want = {(r.arrival, r.reason) for r in judged.select("arrival", "reason").collect()}
    got = [(r.arrival, r.reason) for r in stream.table(spark, "judged").collect()]
    assert len(got) == len(rows) and set(got) == want
    accepted = points.explode_points(judged.filter("reason is null"))
    columns = ["shot_id", "channel_name", "ts_unix_ns"] + [
        f"{s}_w{w}" for w in (3, 10) for s in features.ONLINE_STATS
    ]
    batch = features.online_features(accepted, (3, 10)).select(*columns).collect()
    streamed = stream.table(spark, "features").select(*columns).collect()
    key = lambda r: tuple(r[:3])
    for a, b in zip(sorted(batch, key=key), sorted(streamed, key=key), strict=True):
        assert tuple(b)[:3] == tuple(a)[:3]
        assert tuple(b)[3:] == pytest.approx(tuple(a)[3:], abs=1e-9)
    accepted_points = judged.filter("reason is null").count()
    assert stream.table(spark, "risks").count() == accepted_points
    assert stream.table(spark, "alerts").count() > 0


def test_running_a_batch_again_changes_nothing(spark, tmp_path):
    rows = log(2, 60)
    stream = RiskStream(plan(tmp_path))
    first, second = (spark.createDataFrame(part, MESSAGE) for part in (rows[:30], rows[30:]))
    stream.process(first, 0)
    stream.process(second, 1)

    def snapshot():
        return {
            name: sorted(map(str, stream.table(spark, name).collect()))
            for name in ("judged", "features", "risks", "alerts")
        }

    before = snapshot()
    stream.process(second, 1)
    assert snapshot() == before


def test_tail_state_is_bounded(spark, tmp_path):
    stream = RiskStream(plan(tmp_path, until="features"))
    rows = [
        (i, json.dumps({"shot_id": "s", "ts_unix_ns": i + 1, "channels": [{"name": "ip", "value": 1.0}]}))
        for i in range(40)
    ]
    stream.process(spark.createDataFrame(rows, MESSAGE), 0)
    tail = stream.memory(spark, "tail").read().select(F.inline("samples")).collect()
    assert sorted(r.ts_unix_ns for r in tail) == list(range(32, 41))


def test_repeated_channel_in_a_point(spark, tmp_path):
    twice = [{"name": "ip", "value": 1.0}, {"name": "ip", "value": 4.0}]
    rows = [(0, json.dumps({"shot_id": "s", "ts_unix_ns": 1, "channels": twice}))]
    stream = RiskStream(plan(tmp_path))
    stream.process(spark.createDataFrame(rows, MESSAGE), 0)
    made = stream.table(spark, "features").collect()
    assert [r.value for r in made] == [4.0]
    assert stream.table(spark, "risks").select(F.size("top_features").alias("n")).first().n == 1


def test_unknown_stage():
    with pytest.raises(ValueError):
        StreamPlan(root="x", until="plots")
