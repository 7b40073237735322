"""Train, calibration and test membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, dimension_join, with_position


def shot_bucket(seed: int = 42, buckets: int = 1000) -> Column:
    return F.pmod(F.xxhash64("shot_id", F.lit(seed)), F.lit(buckets))


def shot_split(
    df: DataFrame,
    test: float = 0.2,
    calibration: float = 0.0,
    seed: int = 42,
    bucket: Column | None = None,
    buckets: int = 1000,
) -> DataFrame:
    """Assign whole shots to ``test``, ``calibration`` or ``train`` from the id alone: no shuffle."""
    b = shot_bucket(seed, buckets) if bucket is None else bucket
    first, second = round(test * buckets), round((test + calibration) * buckets)
    return df.withColumn(
        "split", F.when(b < first, "test").when(b < second, "calibration").otherwise("train")
    )


def stratified_split(
    df: DataFrame,
    label: str,
    row_key: Sequence[str],
    test: float = 0.2,
    limits: Limits = DEFAULT_LIMITS,
    hashed: Column | None = None,
) -> DataFrame:
    """Exact per-label split of rows: the ``round(test * n)`` rows with the smallest hash are test.

    The hash is uniform, so ranking by it in slices stays balanced even with two labels.
    """
    # Non-negative, so that the span of the hash fits a bigint.
    order = F.shiftrightunsigned(F.xxhash64(*row_key), 1) if hashed is None else hashed
    ranked = df.withColumn("_h", order)
    ranked = with_position(ranked, [label], ["_h", *row_key], limits)
    # One row per label value; label values may be many.
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.floor(F.col("_n") * F.lit(float(test)) + 0.5)
    return (
        dimension_join(ranked, sizes, [label], row_key, "inner")
        .withColumn("split", F.when(F.col("pos") < quota, "test").otherwise("train"))
        .drop("_h", "_n", "pos")
    )


def split_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(label).cast("bigint").alias("positives"),
        F.count_distinct("shot_id").alias("shots"),
    )
