"""How stable the scores of a model are over time, and models side by side.

The scores of each time slice are counted in equal bins of [0, 1]; histograms add up, so the reference is
the sum of all slices and nothing larger than a histogram a slice is compared. The population stability
index takes shares smoothed by half a row a bin, so that empty bins have a finite weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotstream.operators import evaluate, monitoring

BINS = 10


def score_histograms(df: DataFrame, by: Sequence[str], slice_: Column, score: str = "p", bins: int = BINS) -> DataFrame:
    """by..., slice, counts: rows per bin. Null scores and those outside [0, 1] are in no bin."""
    place = F.when(F.col(score).between(0, 1), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
    counts = F.array(*[F.count_if(place == i) for i in range(bins)])
    return df.groupBy(*by, slice_.alias("slice")).agg(counts.alias("counts"))


def _share(counts: Column, smoothing: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n) + smoothing * F.size(counts)
    return F.transform(counts, lambda n: (n + smoothing) / total)


def drift(histograms: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., slice, rows, psi, ks of every slice against all slices of its group. Slices without a scored
    row have neither."""
    bins = histograms.select(*by, F.posexplode("counts").alias("bin", "n")).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    whole = bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("all"))
    # One row per slice on one side and one per group on the other.
    both = histograms.join(whole.select(*by, F.col("all.n").alias("all")), [*by])
    rows = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    both = both.withColumn("rows", rows).where("rows > 0")
    here, there = _share(F.col("counts"), 0.5), _share(F.col("all"), 0.5)
    psi = F.aggregate(F.zip_with(here, there, lambda a, e: (a - e) * F.log(a / e)), F.lit(0.0), lambda s, x: s + x)
    gaps = F.zip_with(_share(F.col("counts"), 0.0), _share(F.col("all"), 0.0), lambda a, e: a - e)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.greatest(s["most"], F.abs(s["sum"] + x)).alias("most"))
    ks = F.aggregate(gaps, start, step, lambda s: s["most"])
    return both.select(*by, "slice", "rows", psi.alias("psi"), ks.alias("ks"))


def compare_models(
    scored: DataFrame, latencies: DataFrame, slice_: Column, edges: Sequence[float], by: Sequence[str] = ("model_version",),
    threshold: float = 0.5,
) -> DataFrame:
    """One row per model: ranking metrics, mean lead time, p95 latency, and the worst drift of a slice.

    ``scored`` has p, label, shot_id, time_to_disruption; ``latencies`` has seconds. Both carry ``by``.
    """
    ranking = evaluate.ranking_metrics(evaluate.threshold_table(scored, by=by), by)
    lead = evaluate.lead_time(scored, threshold=threshold, by=by)
    p95 = monitoring.histogram_quantile(monitoring.latency_buckets(latencies, by, edges=edges), 0.95, by)
    worst = drift(score_histograms(scored, by, slice_), by).groupBy(*by).agg(
        F.count("*").alias("slices"), F.max("psi").alias("max_psi"), F.max("ks").alias("max_ks")
    )
    out = ranking.join(lead, [*by], "left").join(p95.withColumnRenamed("quantile", "p95_seconds"), [*by], "left")
    return out.join(worst, [*by], "left")
