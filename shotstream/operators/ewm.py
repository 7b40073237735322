"""Exponentially weighted mean, deviation and z-score.

The recursion m(t) = (1-a) m(t-1) + a x(t) is a weighted sum, so a block of rows needs only running
sums with weights d^-j inside the block (d = 1-a) plus the sums of the blocks before it. Blocks are
so long that everything more than two blocks back has a weight below 1e-40, far under the precision
of a double; no carry has to travel along a whole key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotstream.functions.validity import missing_as_null
from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, dimension_join, with_position
from shotstream.schema import SERIES_KEY

EPS = 1e-9


def block_rows(alpha: float) -> int:
    """Rows after which a weight has decayed to 1e-20."""
    return max(1, math.ceil(math.log(1e-20) / math.log1p(-alpha)))


def ewm_zscore(
    telemetry: DataFrame, alpha: float = 0.01, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``ema``, ``ema_std`` and ``zscore`` to each sample; null and NaN samples are left out."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie between 0 and 1")
    d, size = 1.0 - alpha, block_rows(alpha)
    samples = telemetry.withColumn("value", missing_as_null("value")).filter(
        F.col("value").isNotNull()
    )
    # Sums of squares lose digits around a large offset, so samples are taken relative to the first
    # one of their series; a series that starts constant then has a deviation of exactly 0.
    centre = samples.groupBy(*SERIES_KEY).agg(F.min_by("value", "ts_unix_ns").alias("_c"))
    placed = with_position(samples, SERIES_KEY, ["ts_unix_ns"], limits)
    placed = dimension_join(placed, centre, SERIES_KEY, ["ts_unix_ns"]).select(
        *placed.columns,
        (F.col("value") - F.col("_c")).alias("_x"),
        F.col("_c"),
        F.expr(f"pos div {size}L").alias("_b"),
        F.expr(f"pos % {size}L").cast("double").alias("_j"),
        F.when(F.col("pos") == 0, 1.0).otherwise(alpha).alias("_w"),
    )
    # Whole-block sums, discounted to the end of the block.
    fade = F.pow(F.lit(d), F.lit(size - 1.0) - F.col("_j")) * F.col("_w")
    blocks = placed.groupBy(*SERIES_KEY, "_b").agg(
        F.sum(fade * F.col("_x")).alias("_s1"), F.sum(fade * F.col("_x") * F.col("_x")).alias("_s2")
    )
    step = d**size

    def shifted(by: int):
        return blocks.select(
            *SERIES_KEY,
            (F.col("_b") + by).alias("_b"),
            F.col("_s1").alias(f"_s1_{by}"),
            F.col("_s2").alias(f"_s2_{by}"),
        )

    parts = [*SERIES_KEY, "_b"]
    running = Window.partitionBy(*parts).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grow = F.pow(F.lit(d), -F.col("_j")) * F.col("_w")
    shrink = F.pow(F.lit(d), F.col("_j"))
    zero = F.lit(0.0)

    def moment(name: str, inside):
        carried = F.coalesce(F.col(f"{name}_1"), zero) + step * F.coalesce(F.col(f"{name}_2"), zero)
        return shrink * F.sum(grow * inside).over(running) + shrink * d * carried

    # Sum of squared weights: closed form, the first row weighs 1 and every other alpha.
    d2 = d * d
    old = F.pow(F.lit(d2), F.col("pos").cast("double"))
    weights = old + (alpha * alpha / (1.0 - d2)) * (1.0 - old)
    mean, square = F.col("_m1"), F.col("_m2")
    spread = square - mean * mean
    variance = F.when(spread > square * 1e-15, spread).otherwise(zero) / (1.0 - weights)
    std = F.when(F.col("pos") == 0, 1.0).otherwise(F.sqrt(variance))
    return (
        placed.join(shifted(1), parts, "left")
        .join(shifted(2), parts, "left")
        .withColumn("_m1", moment("_s1", F.col("_x")))
        .withColumn("_m2", moment("_s2", F.col("_x") * F.col("_x")))
        .withColumn("ema_std", std)
        .select(
            *telemetry.columns,
            (mean + F.col("_c")).alias("ema"),
            "ema_std",
            ((F.col("_x") - mean) / (F.col("ema_std") + EPS)).alias("zscore"),
        )
    )
