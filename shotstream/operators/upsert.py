"""Last-write-wins merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.schema import SAMPLE_KEY

RISK_KEY = ("shot_id", "ts_unix_ns")


def latest_by_key(
    df: DataFrame, keys: Sequence[str], arrival: Sequence[str], keep_arrival: bool = False
) -> DataFrame:
    """Keep, per key, the row that arrived last; with ``keep_arrival`` its arrival columns too.

    ``max_by`` combines before the shuffle, so a key written a billion times costs one row per task.
    """
    values = [c for c in df.columns if c not in keys and (keep_arrival or c not in arrival)]
    newest = F.max_by(F.struct(*values), F.struct(*arrival))
    return df.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")


def merge(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Stored rows overlaid with incoming ones. A stored table that keeps its arrival columns takes part
    with them; one that does not is older than any incoming row."""
    known = all(name in stored.columns for name in arrival)
    old = stored.withColumn("_new", F.lit(1 if known else 0))
    for name in arrival:
        if name not in stored.columns:
            old = old.withColumn(name, F.lit(None).cast(incoming.schema[name].dataType))
    new = incoming.withColumn("_new", F.lit(1))
    both = old.unionByName(new)
    return latest_by_key(both, keys, ["_new", *arrival], keep_arrival=known).drop("_new")


def telemetry_upsert(samples: DataFrame, arrival: Sequence[str]) -> DataFrame:
    return latest_by_key(samples, SAMPLE_KEY, arrival)


def risk_upsert(
    risks: DataFrame, arrival: Sequence[str], per_window: bool = False, keep_arrival: bool = False
) -> DataFrame:
    keys = (*RISK_KEY, "window_ms") if per_window else RISK_KEY
    return latest_by_key(risks, keys, arrival, keep_arrival)
