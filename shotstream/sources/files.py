"""File sources: CSV, JSON points, array containers."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotstream.functions.timebase import time_column, unix_ns
from shotstream.operators.points import channel_columns, wide_to_points
from shotstream.schema import POINT

# File suffixes and the formats they stand for.
SUFFIXES = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".parquet": "arrays",
    ".h5": "hdf5",
    ".hdf5": "hdf5",
    ".nc": "netcdf",
    ".netcdf": "netcdf",
}
_TYPES = {"shot_id": "string", "time_unix_ns": "bigint", "disruption_time_unix_ns": "bigint"}


def csv_schema(header: Sequence[str]) -> T.StructType:
    """Names decide types, so no pass over the data infers them."""
    return T._parse_datatype_string(
        ", ".join(f"`{name}` {_TYPES.get(name, 'double')}" for name in header)
    )


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their header. The first line of every file is found in one distributed scan; what
    reaches the driver is one name per file, as the listing of the path does anyway."""
    listed = spark.read.text(path)
    if len(listed.inputFiles()) <= 1:
        return {tuple(csv_header(spark, path)): [path]}
    lines = listed.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
    ).filter("at = 0 AND trim(value) <> ''")
    heads = lines.groupBy("file").agg(F.min_by("value", "line").alias("head"))
    layouts = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head")
    return {tuple(next(csv.reader([row["head"].lstrip("\ufeff")]))): row["files"] for row in layouts.collect()}


def _read_by_name(
    spark: SparkSession,
    path: str,
    schema_of: Callable[[Sequence[str]], T.StructType],
    finish: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Files of every header read with their own columns, finished, and united by name."""
    frames = []
    for header, files in csv_layouts(spark, path).items():
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        frames.append(finish(reader.schema(schema_of(header)).csv(files)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Wide shot files with headers; columns go by name, their order and set may differ between files.
    Adds ``time_unix_ns`` from whichever time column wins. A ``schema`` gives the types of its columns."""
    given = {f.name: f for f in schema} if schema else {}

    def typed(header: Sequence[str]) -> T.StructType:
        return T.StructType([given.get(f.name, f) for f in csv_schema(header)])

    def timed(df: DataFrame) -> DataFrame:
        time_column(df.columns)
        return df.withColumn("time_unix_ns", unix_ns(df.columns))

    return _read_by_name(spark, path, typed, timed)


def csv_points(spark: SparkSession, path: str, shot_id: str | None = None) -> DataFrame:
    """Wide shot files as points; cells stay text so that an unreadable one drops only its channel."""
    df = _read_by_name(spark, path, lambda header: T.StructType([T.StructField(n, T.StringType()) for n in header]))
    return wide_to_points(df, shot_id)


def json_points(
    spark: SparkSession, path: str, shot_id: str | None = None, multi_line: bool = False
) -> DataFrame:
    """JSON points: one per line, or (``multi_line``) a file holding an object or an array."""
    df = spark.read.schema(POINT).option("multiLine", multi_line).json(path)
    return df.withColumn("shot_id", F.lit(shot_id)) if shot_id else df


def explode_arrays(
    shots: DataFrame,
    channels: Sequence[str] | None = None,
    time: str = "time",
    disruption: str | None = None,
    disruption_unit_ns: int = 1,
) -> DataFrame:
    """One row per sample from one row per shot holding a time array and channel arrays.

    ``time`` holds seconds unless the column is called ``time_unix_ns``. The unit of ``disruption``
    is stated by the caller and the column is not a channel. Without a shot id the file stem is used.
    """
    time = "time_unix_ns" if "time_unix_ns" in shots.columns else time
    names = list(channels or channel_columns(shots, [time, *([disruption] if disruption else [])]))
    ident = (
        F.col("shot_id").cast("string")
        if "shot_id" in shots.columns
        else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    )
    head = shots.select(
        ident.alias("shot_id"),
        *([F.col(disruption).alias("_d")] if disruption else []),
        F.explode(F.arrays_zip(F.col(time).alias("_t"), *names)).alias("_z"),
    )
    at = F.col(f"_z.{time}") if time in _zip_fields(head) else F.col("_z._t")
    ns = at.cast("bigint") if time == "time_unix_ns" else (at * 1e9).cast("bigint")
    rows = head.withColumn("time_unix_ns", ns)
    if disruption:
        rows = rows.withColumn(
            "disruption_time_unix_ns", (F.col("_d") * disruption_unit_ns).cast("bigint")
        ).withColumn(
            "time_to_disruption", (F.col("disruption_time_unix_ns") - F.col("time_unix_ns")) / 1e6
        )
    extra = ["disruption_time_unix_ns", "time_to_disruption"] if disruption else []
    return rows.select(
        "shot_id",
        "time_unix_ns",
        *[F.col(f"_z.{n}").cast("double").alias(n) for n in names],
        *extra,
    )


def _zip_fields(df: DataFrame) -> list[str]:
    return df.schema["_z"].dataType.fieldNames()


def format_of(path: str, format: str | None = None) -> str:
    if format is not None:
        if format not in {*SUFFIXES.values()}:
            raise ValueError(f"unknown format: {format}")
        return format
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"cannot tell the format of {path}")
    return SUFFIXES[suffix]


def load(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Load a file by suffix or by an explicit format."""
    kind = format_of(path, format)
    if kind == "csv":
        return load_csv(spark, path, **options)
    if kind == "json":
        return json_points(spark, path, **options)
    if kind == "arrays":
        return explode_arrays(spark.read.parquet(path), **options)
    raise ValueError(f"{kind} containers are read as array tables: convert to parquet first")
