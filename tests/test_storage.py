import json

import pytest
from pyspark.sql import functions as F

from shotstream.functions.risk import Calibration, LinearModel
from shotstream.functions.timebase import time_column
from shotstream.operators import points, reads, shots, upsert
from shotstream.sources import dataset, files, sinks

SAMPLES = "shot_id string, ts_unix_ns bigint, channel_name string, value double, quality string, arrival bigint"


def test_csv_time_columns(spark, tmp_path):
    for name, head, row, want in [
        ("ns", "shot_id,time_unix_ns,time_ms,ip", "s,1700000000000000001,5,1.5", 1700000000000000001),
        ("ms", "shot_id,time_ms,ip", "s,1.5,1.5", 1_500_000),
        ("big", "shot_id,time_ms,ip", "s,1706582611002,1.5", 1706582611002000000),
        ("sec", "shot_id,time,ip", "s,0.25,1.5", 250_000_000),
    ]:
        path = tmp_path / f"{name}.csv"
        path.write_text(f"{head}\n{row}\n")
        got = files.load(spark, str(path)).first()
        assert (got.time_unix_ns, got.ip) == (want, 1.5)
    with pytest.raises(ValueError):
        time_column(["shot_id", "ip"])


def test_csv_points_skip_bad_cells(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("shot_id,time_ms,ip,ne\ns,2,x,1\ns,1,3,\n")
    got = files.csv_points(spark, str(path)).orderBy("ts_unix_ns").collect()
    assert [[c.name for c in r.channels] for r in got] == [["ip"], ["ne"]]


def test_json_forms(spark, tmp_path):
    point = {"shot_id": "s", "ts_unix_ns": 7, "channels": [{"name": "ip", "value": 1.0, "quality": "good"}]}
    (tmp_path / "one.json").write_text(json.dumps(point, indent=1))
    (tmp_path / "many.json").write_text(json.dumps([point, point]))
    (tmp_path / "lines.jsonl").write_text(json.dumps(point) + "\n" + json.dumps(point))
    assert files.load(spark, str(tmp_path / "one.json"), multi_line=True).count() == 1
    assert files.load(spark, str(tmp_path / "many.json"), multi_line=True).count() == 2
    lines = files.load(spark, str(tmp_path / "lines.jsonl"), shot_id="other")
    assert {r.shot_id for r in lines.collect()} == {"other"}


def test_array_containers(spark, tmp_path):
    rows = [("a", [0.0, 0.001], [1.0, 2.0], [3.0, 4.0], 0.002)]
    df = spark.createDataFrame(rows, "shot_id string, time array<double>, ip array<double>, ne array<double>, d double")
    got = files.explode_arrays(df, disruption="d", disruption_unit_ns=1_000_000_000).orderBy("time_unix_ns").collect()
    assert [(r.time_unix_ns, r.ip, r.ne, r.time_to_disruption) for r in got] == [
        (0, 1.0, 3.0, 2.0), (1_000_000, 2.0, 4.0, 1.0)
    ]
    path = str(tmp_path / "run.parquet")
    df.drop("shot_id", "d").coalesce(1).write.parquet(path)
    named = files.load(spark, path).select("shot_id").distinct().collect()
    assert len(named) == 1 and named[0].shot_id.startswith("part-")


def test_format_dispatch():
    assert files.format_of("x/a.CSV") == "csv"
    assert files.format_of("a.bin", "json") == "json"
    for bad in [("a.bin", None), ("a.csv", "xml")]:
        with pytest.raises(ValueError):
            files.format_of(*bad)


def test_union_of_sources(spark):
    a = spark.createDataFrame([("s", 1_000_000, 5_000_000)], "shot_id string, time_unix_ns bigint, disruption_time_unix_ns bigint")
    b = spark.createDataFrame([("t", 1, 2.0)], "shot_id string, time_unix_ns bigint, ip double")
    rows = {r.shot_id: r for r in dataset.union_sources([a, b]).collect()}
    assert rows["s"].time_to_disruption == 4.0 and rows["s"].ip is None
    assert rows["t"].time_to_disruption is None
    assert dataset.union_sources([b]).first().time_to_disruption == float("inf")
    assert dataset.build_dataset(spark, frames=[b, b]).count() == 2
    with pytest.raises(ValueError):
        dataset.union_sources([])


def test_last_write_wins(spark):
    rows = [("s", 1, "ip", 1.0, "good", 1), ("s", 1, "ip", 2.0, "outlier", 3), ("s", 1, "ip", 9.0, "good", 2)]
    got = upsert.telemetry_upsert(spark.createDataFrame(rows, SAMPLES), ["arrival"]).collect()
    assert [(r.value, r.quality) for r in got] == [(2.0, "outlier")]


@pytest.mark.parametrize("buckets", [3, 64])
def test_upsert_touches_its_buckets_only(spark, tmp_path, buckets):
    old = [(f"s{i}", t, "ip", 1.0, "good", 0) for i in range(20) for t in range(5)]
    new = [("s3", 2, "ip", 7.0, "good", 1), ("s3", 2, "ip", 8.0, "good", 2)]
    path = tmp_path / "t"
    sinks.write_series(upsert.telemetry_upsert(spark.createDataFrame(old, SAMPLES), ["arrival"]), str(path), buckets)
    before = {p.name for p in path.rglob("shot_bucket=*/*.parquet")}
    incoming = spark.createDataFrame(new, SAMPLES)
    first = sorted(map(tuple, sinks.upsert_series(spark, str(path), incoming, upsert.SAMPLE_KEY, ["arrival"]).collect()))
    after = {p.name for p in path.rglob("shot_bucket=*/*.parquet")}
    shot = sinks.read_series(spark, str(path), "s3")
    assert {r.ts_unix_ns: r.value for r in shot.collect()} == {0: 1.0, 1: 1.0, 2: 8.0, 3: 1.0, 4: 1.0}
    changed = {p.parent.name for p in path.rglob("shot_bucket=*/*.parquet") if p.name not in before}
    assert len(changed) == 1 and len(before & after) > 0
    second = sorted(map(tuple, sinks.upsert_series(spark, str(path), incoming, upsert.SAMPLE_KEY, ["arrival"]).collect()))
    assert first == second and len(first) == 100
    added = spark.createDataFrame([("s99", 1, "ip", 5.0, "good", 1)], SAMPLES)
    assert sinks.upsert_series(spark, str(path), added, upsert.SAMPLE_KEY, ["arrival"]).count() == 101
    assert sinks.upsert_series(spark, str(path), added.limit(0), upsert.SAMPLE_KEY, ["arrival"]).count() == 101


def test_stored_arrival_decides(spark, tmp_path):
    rows = [("s", 1, "ip", 1.0, "good", 5)]
    made = upsert.latest_by_key(spark.createDataFrame(rows, SAMPLES), upsert.SAMPLE_KEY, ["arrival"], keep_arrival=True)
    sinks.write_series(made, str(tmp_path / "t"))
    late = spark.createDataFrame([("s", 1, "ip", 2.0, "good", 3)], SAMPLES)
    assert sinks.upsert_series(spark, str(tmp_path / "t"), late, upsert.SAMPLE_KEY, ["arrival"]).first().value == 1.0


def test_csv_files_load_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("shot_id,time_ms,ip,ne\na,1,1.5,2.5\n")
    (tmp_path / "b.csv").write_text("ne,shot_id,ip,time_ms\n4.5,b,3.5,1\n")
    (tmp_path / "c.csv").write_text("time_ms,shot_id,\"dwdt\"\n1,c,9\n")
    got = {r.shot_id: (r.ip, r.ne, r.dwdt) for r in files.load(spark, str(tmp_path / "*.csv"), "csv").collect()}
    assert got == {"a": (1.5, 2.5, None), "b": (3.5, 4.5, None), "c": (None, None, 9.0)}
    made = files.csv_points(spark, str(tmp_path / "*.csv")).collect()
    assert {(r.shot_id, c.name, c.value) for r in made for c in r.channels} == {
        ("a", "ip", 1.5), ("a", "ne", 2.5), ("b", "ip", 3.5), ("b", "ne", 4.5), ("c", "dwdt", 9.0)
    }


def test_read_of_one_shot_prunes_partitions(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("shot_id"), F.col("id").alias("ts_unix_ns"))
    sinks.write_series(df, str(tmp_path / "t"))
    one = sinks.read_series(spark, str(tmp_path / "t"), "42")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shot_bucket" in plan and "PushedFilters: [IsNotNull(shot_id)" in plan
    assert one.count() == 1


def test_events_append_once(spark, tmp_path):
    def events(*ids):
        return spark.createDataFrame([(i, "s", 1) for i in ids], "event_id string, shot_id string, ts_unix_ns bigint")

    path = str(tmp_path / "e")
    for batch in (events("a", "b", "b"), events("a", "b"), events("b", "c")):
        sinks.append_events(batch, path)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_model_round_trip(spark, tmp_path):
    path = sinks.artifact_path(str(tmp_path), "dev", 50, "v1")
    model = LinearModel({"b": 1.5, "a": -2.0}, 0.25, "v1")
    sinks.save_model(spark, model, Calibration("isotonic", 0.0, 1.0, "c", ((0.0, 0.1), (1.0, 0.9))), path)
    loaded, calibration = sinks.load_model(spark, path)
    assert loaded == model and list(loaded.coefficients) == ["b", "a"]
    assert calibration.scale == 1.0 and calibration.knots == ((0.0, 0.1), (1.0, 0.9))
    sinks.save_model(spark, LinearModel(), Calibration(), path)
    assert sinks.load_model(spark, path)[0].coefficients == {}
    assert spark.read.json(str(tmp_path)).columns  # env, horizon and version are partition columns


def test_latest_version_of_a_model(spark, tmp_path):
    root = str(tmp_path / "models")
    assert sinks.artifact_versions(spark, root, "dev", 50) == []
    for env, version in [("dev", "v2"), ("dev", "v10"), ("dev", "v1"), ("prod", "v3")]:
        sinks.save_model(spark, LinearModel({}, 0.5, version), Calibration(), sinks.artifact_path(root, env, 50, version))
    assert sinks.artifact_versions(spark, root, "dev", 50) == ["v1", "v2", "v10"]
    assert sinks.load_version(spark, root, "dev", 50)[0].version == "v10"
    assert sinks.load_version(spark, root, "dev", 50, "v2")[0].version == "v2"
    assert sinks.load_version(spark, root, "prod", 50)[0].version == "v3"
    for bad in [("prod", 50, "v1"), ("dev", 200, None)]:
        with pytest.raises(ValueError):
            sinks.load_version(spark, root, *bad)


def test_shot_dimension(spark):
    df = spark.createDataFrame([("s", 5), ("s", 1), ("t", 3)], "shot_id string, ts_unix_ns bigint")
    dim = shots.shots_dimension(df)
    merged = shots.merge_shots(dim, spark.createDataFrame([("s", 0, 2)], dim.schema))
    got = {r.shot_id: (r.started_unix_ns, r.finished_unix_ns) for r in merged.collect()}
    assert got == {"s": (0, 5), "t": (3, 3)}
    assert shots.as_timestamps(dim).dtypes[1] == ("started_at", "timestamp")
    missing = shots.orphans(df, dim.filter("shot_id = 't'")).collect()
    assert [(r.shot_id, r.points) for r in missing] == [("s", 2)]


def test_list_shots_puts_unstarted_last(spark):
    df = spark.createDataFrame(
        [("a", None, None), ("b", 1, None), ("c", 2, 3)],
        "shot_id string, started_unix_ns bigint, finished_unix_ns bigint",
    )
    assert [r.shot_id for r in reads.list_shots(df).collect()] == ["c", "b", "a"]


RISK = "shot_id string, ts_unix_ns bigint, risk_h50 double, risk_h200 double, model_version string, calibration_version string"


def test_risk_reads(spark):
    df = spark.createDataFrame(
        [("s", 3000, 0.7, 0.6, "m2", "c"), ("s", 1000, 0.5, 0.4, None, None), ("t", 5, 0.1, 0.1, "m", "c")], RISK
    )
    rows = reads.series("risk", df, "s").collect()
    assert [(r.ts_unix_ns, r.model_version) for r in rows] == [(1000, ""), (3000, "m2")]
    assert reads.series("risk", df, "s", start_ns=1000, end_ns=1000).count() == 1
    assert reads.series("risk", df, "s", start_ns=1001).count() == 1
    assert reads.series("risk", df, "s", end_ns=2999).count() == 1
    assert reads.risk_at(df, "s", 2999).first().ts_unix_ns == 1000
    assert reads.risk_at(df, "s", 999).count() == 0
    latest = {r.shot_id: (r.ts_unix_ns, r.model_version) for r in reads.latest_risk(df).collect()}
    assert latest == {"s": (3000, "m2"), "t": (5, "m")}


def test_bad_read_arguments(spark):
    df = spark.createDataFrame([], RISK)
    with pytest.raises(ValueError):
        reads.series("alerts", df)
    with pytest.raises(ValueError):
        reads.series("risk", df, "s", start_ns="soon")


def test_telemetry_reads(spark, limits):
    df = spark.createDataFrame(
        [("s", t, c, float(t)) for c in ("ne", "ip") for t in (3, 1, 2)],
        "shot_id string, ts_unix_ns bigint, channel_name string, value double",
    )
    rows = reads.series("telemetry", df, "s").collect()
    assert [(r.channel_name, r.ts_unix_ns) for r in rows] == [(c, t) for c in ("ip", "ne") for t in (1, 2, 3)]
    pages = reads.telemetry_pages(df, 2, limits).orderBy("channel_name", "page").collect()
    assert [[p.ts_unix_ns for p in r.points] for r in pages] == [[1, 2], [3], [1, 2], [3]]


def test_events_with_empty_severity(spark):
    df = spark.createDataFrame(
        [("s", 2, "alert", "High risk", ""), ("s", 1, "info", "x", None), ("t", 1, "info", "y", "low")],
        "shot_id string, ts_unix_ns bigint, kind string, message string, severity string",
    )
    rows = reads.shot_events(df, "s").collect()
    assert [(r.ts_unix_ns, r.severity) for r in rows] == [(1, None), (2, None)]


def test_channel_columns_exclude_metadata(spark):
    df = spark.createDataFrame([("s", 1, 1.0, 2.0)], "shot_id string, time_ms int, ip double, time_to_disruption double")
    assert points.channel_columns(df) == ["ip"]
