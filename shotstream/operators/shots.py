"""The shot dimension and checks against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.functions.timebase import timestamp_of


def shots_dimension(samples: DataFrame) -> DataFrame:
    """One row per shot with its first and last sample time."""
    return samples.groupBy("shot_id").agg(
        F.min("ts_unix_ns").alias("started_unix_ns"), F.max("ts_unix_ns").alias("finished_unix_ns")
    )


def merge_shots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return stored.unionByName(incoming).groupBy("shot_id").agg(
        F.min("started_unix_ns").alias("started_unix_ns"),
        F.max("finished_unix_ns").alias("finished_unix_ns"),
    )


def as_timestamps(shots: DataFrame) -> DataFrame:
    return shots.select(
        "shot_id",
        timestamp_of("started_unix_ns").alias("started_at"),
        timestamp_of("finished_unix_ns").alias("finished_at"),
    )


def orphans(facts: DataFrame, shots: DataFrame) -> DataFrame:
    """Shot ids used by facts but absent from the dimension. Counts first, so the anti join sees
    one row per shot."""
    used = facts.groupBy("shot_id").agg(F.count(F.lit(1)).alias("points"))
    return used.join(shots.select("shot_id").distinct(), "shot_id", "left_anti")
