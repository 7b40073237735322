"""Stored tables and model artifacts as files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotstream.functions.risk import Calibration, LinearModel
from shotstream.operators.upsert import merge
from shotstream.session import work_dir

SHOT_BUCKETS = 64
_LAYOUT = "_layout"  # readers of the folder skip names with an underscore


def _bucket(buckets: int, shot_id: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.col("shot_id") if shot_id is None else shot_id), F.lit(buckets)).cast("int")


def stored_buckets(spark: SparkSession, path: str) -> int:
    """The number of buckets a stored series was written with; it is kept beside the data."""
    return spark.read.parquet(f"{path}/{_LAYOUT}").first()["buckets"]


def _write(df: DataFrame, path: str, buckets: int, mode: str) -> None:
    (
        df.withColumn("shot_bucket", _bucket(buckets))
        .repartitionByRange("shot_bucket", "shot_id", "ts_unix_ns")
        .sortWithinPartitions("shot_bucket", "shot_id", "ts_unix_ns")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("shot_bucket")
        .parquet(path)
    )


def write_series(df: DataFrame, path: str, buckets: int = SHOT_BUCKETS) -> None:
    """Parquet by hashed shot bucket, sorted by time inside a file for min/max skipping.

    Rows are spread by (bucket, time slice) before the sort, so a hot shot is written by many tasks.
    """
    _write(df, path, buckets, "static")
    df.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/{_LAYOUT}"
    )


def read_series(spark: SparkSession, path: str, shot_id: str | None = None) -> DataFrame:
    """Read a stored series; with a shot id only its bucket's files are listed."""
    df = spark.read.parquet(path)
    if shot_id is not None:
        bucket = _bucket(stored_buckets(spark, path), F.lit(shot_id))
        df = df.filter((F.col("shot_bucket") == bucket) & (F.col("shot_id") == shot_id))
    return df.drop("shot_bucket")


def upsert_series(spark: SparkSession, path: str, incoming: DataFrame, keys, arrival) -> DataFrame:
    """Merge newer rows into a stored series, last write wins; replaying them is harmless.

    Only the buckets that the new rows touch are read and written; the files of the others stay. The
    merged buckets are staged in the shared folder before they replace the old ones.
    """
    buckets = stored_buckets(spark, path)
    stored = spark.read.parquet(path)
    # At most one row per bucket.
    touched = [row[0] for row in incoming.select(_bucket(buckets)).distinct().collect()]
    affected = stored.filter(F.col("shot_bucket").isin(touched)).drop("shot_bucket")
    merged = merge(affected, incoming, keys, arrival).select(*[c for c in stored.columns if c != "shot_bucket"])
    stage = work_dir(spark, "merge")
    merged.write.parquet(stage)
    if touched:
        _write(spark.read.schema(merged.schema).parquet(stage), path, buckets, "dynamic")
    return read_series(spark, path)


def append_events(events: DataFrame, path: str) -> None:
    """Append the events whose ``event_id`` is not stored yet, once each; a replay adds nothing."""
    spark = events.sparkSession
    fresh = events.dropDuplicates(["event_id"])
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("event_id"), "event_id", "left_anti")
    # Staged first: an append must not read the folder it writes to.
    stage = work_dir(spark, "events")
    fresh.select(*events.columns).write.parquet(stage)
    spark.read.schema(events.schema).parquet(stage).write.mode("append").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def artifact_path(root: str, env: str, horizon: int, version: str) -> str:
    return f"{root.rstrip('/')}/env={env}/horizon={horizon}/version={version}"


def artifact_versions(spark: SparkSession, root: str, env: str, horizon: int) -> list[str]:
    """The stored versions of a model, oldest first; numbers in their names count as numbers."""
    parent = artifact_path(root, env, horizon, "").rsplit("/", 1)[0]
    if not path_exists(spark, parent):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(parent)
    listed = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    names = [status.getPath().getName() for status in listed if status.isDirectory()]
    found = [name.removeprefix("version=") for name in names if name.startswith("version=")]
    return sorted(found, key=lambda v: [(part.isdigit(), int(part) if part.isdigit() else 0, part) for part in re.split(r"(\d+)", v)])


def load_version(
    spark: SparkSession, root: str, env: str, horizon: int, version: str | None = None
) -> tuple[LinearModel, Calibration]:
    """The model of an environment and horizon: the given version, or the latest one."""
    stored = artifact_versions(spark, root, env, horizon)
    wanted = version if version is not None else (stored[-1] if stored else None)
    if wanted not in stored:
        raise ValueError(f"no version {wanted or ''} of the {env} model for {horizon} ms in {root}".replace("  ", " "))
    return load_model(spark, artifact_path(root, env, horizon, wanted))


def save_model(
    spark: SparkSession, model: LinearModel, calibration: Calibration, path: str
) -> None:
    """Coefficients with their order, and one row each of model and calibration parameters."""
    coefficients = [
        (i, name, float(coef)) for i, (name, coef) in enumerate(model.coefficients.items())
    ]
    spark.createDataFrame(coefficients, "ord int, feature string, coef double").coalesce(
        1
    ).write.mode("overwrite").json(f"{path}/coefficients")
    spark.createDataFrame(
        [(float(model.intercept), model.version)], "intercept double, version string"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/model")
    spark.createDataFrame(
        [
            (
                calibration.kind,
                float(calibration.scale),
                float(calibration.offset),
                calibration.version,
                [(float(x), float(y)) for x, y in calibration.knots],
            )
        ],
        "kind string, scale double, offset double, version string,"
        " knots array<struct<score: double, p: double>>",
    ).coalesce(1).write.mode("overwrite").json(f"{path}/calibration")


def coefficient_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ord int, feature string, coef double").json(f"{path}/coefficients")


def load_model(spark: SparkSession, path: str) -> tuple[LinearModel, Calibration]:
    """Read a saved model; a scale of 0 means 1, absent coefficients mean none.

    A model has one row per feature name, which is small by nature.
    """
    rows = coefficient_table(spark, path).orderBy("ord").collect()
    head = spark.read.schema("intercept double, version string").json(f"{path}/model").first()
    cal = (
        spark.read.schema(
            "kind string, scale double, offset double, version string,"
            " knots array<struct<score: double, p: double>>"
        )
        .json(f"{path}/calibration")
        .first()
    )
    model = LinearModel(
        {r.feature: r.coef for r in rows if r.coef is not None}, head.intercept, head.version
    )
    return model, Calibration(
        cal.kind or "platt",
        cal.scale or 1.0,
        cal.offset or 0.0,
        cal.version or "",
        tuple((k.score, k.p) for k in (cal.knots or ())),
    )


def write_report(report: DataFrame, path: str) -> None:
    """Report lines as text. A report has one line per metric and dataset fact."""
    line = F.format_string("- **%s**: %s", "name", "text")
    report.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
