"""Several sources as one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotstream.sources.files import load


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a source lacks is null. Adds ``time_to_disruption`` when absent."""
    if not frames:
        raise ValueError("no data sources provided")
    result = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if "time_to_disruption" in result.columns:
        return result
    if {"disruption_time_unix_ns", "time_unix_ns"} <= set(result.columns):
        return result.withColumn(
            "time_to_disruption", (F.col("disruption_time_unix_ns") - F.col("time_unix_ns")) / 1e6
        )
    return result.withColumn("time_to_disruption", F.lit(float("inf")))


def build_dataset(
    spark: SparkSession, paths: Sequence[str] = (), frames: Sequence[DataFrame] = ()
) -> DataFrame:
    return union_sources([*(load(spark, p) for p in paths), *frames])
