"""Rates and latency quantiles as dashboards show them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Histogram bucket edges in seconds.
REQUEST_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
STORAGE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
COMPUTE_BUCKETS = (0.0001, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.025, 0.05)


def rates(
    events: DataFrame, labels: Sequence[str] = (), window_s: int = 300, step_s: int = 60
) -> DataFrame:
    """Events per second over windows of ``window_s`` ending every ``step_s``.

    Counts per step come first, so the replication into overlapping windows copies counts, not rows.
    """
    if window_s % step_s:
        raise ValueError("the window must be a multiple of the step")
    step_ns = step_s * 1_000_000_000
    steps = events.groupBy(*labels, F.expr(f"ts_unix_ns div {step_ns}L").alias("_step")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ends = F.sequence(F.col("_step") + 1, F.col("_step") + window_s // step_s)
    return (
        steps.withColumn("_end", F.explode(ends))
        .groupBy(*labels, (F.col("_end") * step_ns).alias("window_end_unix_ns"))
        .agg(F.sum("_n").alias("events"), (F.sum("_n") / float(window_s)).alias("per_second"))
    )


def latency_buckets(
    latencies: DataFrame,
    by: Sequence[str] = (),
    value: str = "seconds",
    edges: Sequence[float] = REQUEST_BUCKETS,
) -> DataFrame:
    """Cumulative histogram: rows at or under each edge, the last edge is +inf."""
    counts = latencies.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= F.lit(e)).alias(f"_b{i}") for i, e in enumerate(edges)],
        F.count(value).alias(f"_b{len(edges)}"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(e)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
            for i, e in enumerate((*edges, float("inf")))
        ]
    )
    return counts.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def histogram_quantile(buckets: DataFrame, quantile: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Quantile by linear interpolation in the bucket that holds it; in the open bucket, its lower
    edge. A group has as many rows as there are buckets."""
    group = [*by] or ["_all"]
    source = buckets if by else buckets.withColumn("_all", F.lit(0))
    order = Window.partitionBy(*group).orderBy("le")
    total = F.max("cumulative").over(Window.partitionBy(*group))
    placed = source.select(
        *group,
        "le",
        "cumulative",
        total.alias("_total"),
        F.lag("le", 1, 0.0).over(order).alias("_lo"),
        F.lag("cumulative", 1, 0).over(order).alias("_below"),
    )
    rank = F.lit(quantile) * F.col("_total")
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (rank - F.col("_below")) / (
        F.col("cumulative") - F.col("_below")
    )
    estimate = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)
    return (
        placed.filter((F.col("cumulative") >= rank) & (F.col("cumulative") > F.col("_below")))
        .groupBy(*group)
        .agg(F.min_by(estimate, F.col("le")).alias("quantile"))
        .drop(*([] if by else ["_all"]))
    )


def end_to_end_latency(
    arrivals: DataFrame, risks: DataFrame, arrived: str = "arrived_unix_ns", created: str = "created_unix_ns"
) -> DataFrame:
    """Seconds from a point's arrival to its risk."""
    return arrivals.join(risks, ["shot_id", "ts_unix_ns"]).select(
        "shot_id", "ts_unix_ns", ((F.col(created) - F.col(arrived)) / 1e9).alias("seconds")
    )
