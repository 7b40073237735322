"""Fixed-rate resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, chunks
from shotstream.schema import SERIES_KEY


def resample(
    telemetry: DataFrame, step_ns: int, max_fill: int = 0, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Last sample per step; a gap is filled forward for at most ``max_fill`` steps.

    Filling works from each sample towards its predecessor, so nothing the length of a series is
    built: a row expands to at most ``max_fill + 1`` rows.
    """
    step = F.expr(f"ts_unix_ns div {step_ns}L")
    grid = telemetry.groupBy(*SERIES_KEY, step.alias("step")).agg(
        F.max_by("value", "ts_unix_ns").alias("value")
    )
    if max_fill <= 0:
        return grid.select(
            "shot_id", (F.col("step") * step_ns).alias("ts_unix_ns"), "channel_name", "value",
            F.lit(False).alias("filled"),
        )
    seq = chunks(grid, SERIES_KEY, ["step"], 1, limits)
    rows = seq.owned(
        seq.rows.withColumn("_prev_step", F.lag("step").over(seq.window)).withColumn(
            "_prev", F.lag("value").over(seq.window)
        )
    )
    gap_end = F.least(F.col("step") - 1, F.col("_prev_step") + max_fill)
    has_gap = gap_end > F.col("_prev_step")
    filler = F.when(has_gap, F.sequence(F.col("_prev_step") + 1, gap_end)).otherwise(
        F.array().cast("array<bigint>")
    )
    return rows.withColumn("_at", F.explode(F.concat(filler, F.array("step")))).select(
        "shot_id",
        (F.col("_at") * step_ns).alias("ts_unix_ns"),
        "channel_name",
        F.when(F.col("_at") == F.col("step"), F.col("value")).otherwise(F.col("_prev")).alias("value"),
        (F.col("_at") < F.col("step")).alias("filled"),
    )
