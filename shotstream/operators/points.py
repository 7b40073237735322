"""Conversions between points, long samples and wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.functions.timebase import unix_ns
from shotstream.schema import CHANNELS, METADATA_COLUMNS


def explode_points(points: DataFrame, *keep: str) -> DataFrame:
    """One row per channel sample."""
    return points.select(
        "shot_id", "ts_unix_ns", *keep, F.explode("channels").alias("_c")
    ).select(
        "shot_id",
        "ts_unix_ns",
        *keep,
        F.col("_c.name").alias("channel_name"),
        F.col("_c.value").alias("value"),
        F.col("_c.quality").alias("quality"),
    )


def assemble_points(
    telemetry: DataFrame, bucket_ns: int, channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """One point per shot and time bucket, holding the last sample of each channel in the bucket.

    Aggregates map-side; a bucket never becomes a list of its samples.
    """
    bucket = F.expr(f"(ts_unix_ns div {bucket_ns}L) * {bucket_ns}L")
    last = []
    for name in channels:
        mine = F.col("channel_name") == name
        sample = F.struct(
            F.lit(name).alias("name"), F.col("value"), F.col("quality")
        )
        last.append(F.max_by(F.when(mine, sample), F.when(mine, F.col("ts_unix_ns"))).alias(name))
    return (
        telemetry.groupBy("shot_id", bucket.alias("ts_unix_ns"))
        .agg(*last)
        .select("shot_id", "ts_unix_ns", F.array_compact(F.array(*channels)).alias("channels"))
        .filter(F.size("channels") > 0)
    )


def channel_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every column that is not metadata is a channel."""
    skip = {*METADATA_COLUMNS, *exclude}
    return [c for c in df.columns if c not in skip]


def wide_to_points(rows: DataFrame, shot_id: str | None = None) -> DataFrame:
    """Wide rows to points. A cell that is not a number drops its channel; a row without channels
    is dropped."""
    names = channel_columns(rows)
    samples = []
    for name in names:
        value = F.col(name).try_cast("double")
        samples.append(
            F.when(
                value.isNotNull(),
                F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit("good").alias("quality")),
            )
        )
    ident = F.lit(shot_id) if shot_id else (
        F.col("shot_id").cast("string") if "shot_id" in rows.columns else F.lit("unknown")
    )
    return rows.select(
        ident.alias("shot_id"),
        unix_ns(rows.columns).alias("ts_unix_ns"),
        F.array_compact(F.array(*samples)).alias("channels"),
    ).filter(F.size("channels") > 0)


def wide_to_long(rows: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Wide rows to samples, without a quality column."""
    names = list(channels or channel_columns(rows))
    ident = F.col("shot_id").cast("string") if "shot_id" in rows.columns else F.lit("unknown")
    return rows.select(
        ident.alias("shot_id"), unix_ns(rows.columns).alias("ts_unix_ns"),
        *[F.col(n).cast("double").alias(n) for n in names],
    ).unpivot(["shot_id", "ts_unix_ns"], names, "channel_name", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def long_to_wide(telemetry: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Samples to one column per channel; the list is given, so no extra pass finds it."""
    return telemetry.groupBy("shot_id", "ts_unix_ns").pivot("channel_name", list(channels)).agg(
        F.max("value")
    )
