"""Model evaluation.

Every metric takes ``by``: columns that keep models or horizons apart in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, carry_forward

BINS = 10
INF = float("inf")


def _score_cell(score: Column) -> Column:
    """A monotone grid over scores, logarithmic towards 0 and towards 1.

    There are at most 80 * 4096 cells for probabilities and a fixed number for any double, so a sum
    over cells is bounded however many rows there are; saturated scores still fall into many cells.
    """
    depth = 2.0**40

    def half(x: Column) -> Column:
        return F.signum(x) * F.floor(F.log2(F.lit(1.0) + F.abs(x) * depth) * 4096)

    top = F.lit(float(2 * 40 * 4096))
    return F.when(score <= 0.5, half(score)).otherwise(top - half(F.lit(1.0) - score))


def threshold_table(
    df: DataFrame, score: str = "p", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Per distinct score, from high to low: rows at the score and counts at or above it.

    Rows are first summed per score, then ordered inside grid cells; only cell totals are summed
    across the whole range.
    """
    group = [*by] or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    positive = (F.col(label) == 1).cast("bigint")
    at = (
        source.groupBy(*group, F.col(score).alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
        .withColumn("_cell", _score_cell(F.col("score")))
    )
    above = (
        Window.partitionBy(*group)
        .orderBy(F.col("_cell").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*group)
    cells = (
        at.groupBy(*group, "_cell")
        .agg(F.sum("pos").alias("_cp"), F.sum("neg").alias("_cn"))
        .select(
            *group,
            "_cell",
            F.coalesce(F.sum("_cp").over(above), F.lit(0)).alias("_tp0"),
            F.coalesce(F.sum("_cn").over(above), F.lit(0)).alias("_fp0"),
            F.sum("_cp").over(whole).alias("positives"),
            F.sum("_cn").over(whole).alias("negatives"),
        )
    )
    inside = (
        Window.partitionBy(*group, "_cell")
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        at.join(cells, [*group, "_cell"])
        .withColumn("tp", F.col("_tp0") + F.sum("pos").over(inside))
        .withColumn("fp", F.col("_fp0") + F.sum("neg").over(inside))
        .select(*by, "score", "pos", "neg", "tp", "fp", "positives", "negatives")
    )


def _roc_auc() -> Column:
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    total = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return F.try_divide(area, F.nullif(total, F.lit(0.0)))


def _average_precision() -> Column:
    terms = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return F.try_divide(terms, F.nullif(F.max("positives").cast("double"), F.lit(0.0)))


def _recall_at(target_fpr: float) -> Column:
    """Recall at the ROC vertex nearest the target; the strictest threshold on ties, and the empty
    vertex (nothing predicted) comes first of all."""
    fpr = F.col("fp") / F.nullif(F.col("negatives").cast("double"), F.lit(0.0))
    distance = F.abs(fpr - F.lit(target_fpr))
    recall = F.col("tp") / F.greatest(F.col("positives"), F.lit(1))
    nearest = F.min_by(F.struct(distance, recall), F.struct(distance, -F.col("score")))
    return F.when(nearest["col1"] < F.lit(target_fpr), nearest["col2"]).otherwise(F.lit(0.0))


def ranking_metrics(table: DataFrame, by: Sequence[str] = (), target_fpr: float = 0.01) -> DataFrame:
    return table.groupBy(*by).agg(
        _roc_auc().alias("roc_auc"),
        _average_precision().alias("average_precision"),
        _recall_at(target_fpr).alias("recall_at_fpr"),
    )


def roc_auc(df, score="p", label="label", by=()) -> DataFrame:
    return threshold_table(df, score, label, by).groupBy(*by).agg(_roc_auc().alias("roc_auc"))


def average_precision(df, score="p", label="label", by=()) -> DataFrame:
    return threshold_table(df, score, label, by).groupBy(*by).agg(
        _average_precision().alias("average_precision")
    )


def recall_at_fpr(df, target_fpr=0.01, score="p", label="label", by=()) -> DataFrame:
    return threshold_table(df, score, label, by).groupBy(*by).agg(
        _recall_at(target_fpr).alias("recall_at_fpr")
    )


def _brier(score: str, label: str) -> Column:
    error = F.col(score) - F.col(label)
    return F.avg(error * error)


def brier_score(df, score="p", label="label", by=()) -> DataFrame:
    return df.groupBy(*by).agg(_brier(score, label).alias("brier_score"))


def bin_of(score: Column, bins: int = BINS) -> Column:
    """1-based index of the half-open bin (lo, hi]; null for 0 and outside (0, 1]."""
    index = F.lit(1)
    for i in range(1, bins):
        index = index + (score > F.lit(i * (1.0 / bins))).cast("int")
    return F.when((score > 0) & (score <= 1), index)


def reliability_bins(df, score="p", label="label", by=(), bins: int = BINS) -> DataFrame:
    return (
        df.select(*by, F.col(score).alias("_p"), F.col(label).alias("_y"))
        .withColumn("bin", bin_of(F.col("_p"), bins))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("_p").alias("confidence"),
            F.avg(F.col("_y").cast("double")).alias("accuracy"),
        )
    )


def expected_calibration_error(df, score="p", label="label", by=(), bins: int = BINS) -> DataFrame:
    """Rows outside every bin still count in the shares."""
    index = F.coalesce(bin_of(F.col(score), bins), F.lit(0))
    sums = df.groupBy(*by, index.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(score).alias("_conf"),
        F.avg(F.col(label).cast("double")).alias("_acc"),
    )
    gap = F.when(F.col("_bin") > 0, F.abs(F.col("_conf") - F.col("_acc")) * F.col("_n"))
    return sums.groupBy(*by).agg(
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("calibration_error")
    )


def lead_time(df, score="p", threshold: float = 0.5, by=()) -> DataFrame:
    """Mean over shots of the time from the first crossing to the disruption, in ms."""
    ttd = F.col("time_to_disruption")
    crossing = (F.col(score) >= threshold) & (ttd >= 0) & (ttd < INF)
    first = df.groupBy(*by, "shot_id").agg(F.max(F.when(crossing, ttd)).alias("_lead"))
    return first.groupBy(*by).agg(
        F.coalesce(F.avg("_lead"), F.lit(0.0)).alias("mean_lead_time_ms")
    )


def lead_time_as_coded(
    df: DataFrame,
    order: Sequence[str],
    score: str = "p",
    label: str = "label",
    threshold: float = 0.5,
    keys: Sequence[str] = ("shot_id",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The literal definition: own time to disruption minus that of the nearest earlier crossing,
    where positive. Inside one shot it never is."""
    crossed = F.when(F.col(score) >= threshold, F.col("time_to_disruption"))
    rows = carry_forward(df, keys, order, {"_at_crossing": crossed}, limits)
    lead = F.col("time_to_disruption") - F.col("_at_crossing")
    counted = (F.col(label) == 1) & (F.col("time_to_disruption") < INF) & (lead > 0)
    return rows.agg(
        F.coalesce(F.avg(F.when(counted, lead)), F.lit(0.0)).alias("mean_lead_time_ms")
    )


def evaluate(
    df: DataFrame,
    score: str = "p",
    label: str = "label",
    by: Sequence[str] = (),
    target_fpr: float = 0.01,
) -> DataFrame:
    """All metrics, one row per group."""
    group = [*by] or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    result = ranking_metrics(threshold_table(source, score, label, group), group, target_fpr)
    result = result.join(brier_score(source, score, label, group), group)
    result = result.join(expected_calibration_error(source, score, label, group), group)
    if "time_to_disruption" in df.columns:
        result = result.join(lead_time(source, score, by=group), group)
    return result if by else result.drop("_all")


def metric_rows(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(metric, value) rows of a metrics frame."""
    names = [c for c in metrics.columns if c not in by]
    return metrics.select(*by, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(by), names, "metric", "value"
    )


def training_report(metrics: DataFrame, info: DataFrame) -> DataFrame:
    """Report lines (section, name, text): metrics with four decimals, then dataset facts."""
    lines = metric_rows(metrics).select(
        F.lit("metrics").alias("section"),
        F.col("metric").alias("name"),
        F.format_string("%.4f", "value").alias("text"),
    )
    names = info.columns
    facts = info.select(*[F.col(n).cast("string").alias(n) for n in names]).unpivot(
        [], names, "name", "text"
    )
    return lines.unionByName(facts.select(F.lit("dataset").alias("section"), "name", "text"))


def shot_summary(risks: DataFrame, drivers: DataFrame, shots: DataFrame, alerts: DataFrame) -> DataFrame:
    """After a shot: when it was first flagged, by what, and how early.

    Each side is one row per shot before it is joined.
    """
    first = alerts.groupBy("shot_id").agg(
        F.min("ts_unix_ns").alias("first_alert_unix_ns"), F.count(F.lit(1)).alias("alerts")
    )
    peak = risks.groupBy("shot_id").agg(F.max("risk_h50").alias("peak_risk"))
    alerted = alerts.select("shot_id", "ts_unix_ns").distinct()
    lead = (
        drivers.filter("rank = 1")
        .join(alerted, ["shot_id", "ts_unix_ns"])
        .groupBy("shot_id")
        .agg(F.min_by("feature", "ts_unix_ns").alias("first_driver"))
    )
    early = (F.col("disruption_time_unix_ns") - F.col("first_alert_unix_ns")) / 1e6
    return (
        shots.select("shot_id", "disruption_time_unix_ns")
        .join(peak, "shot_id", "left")
        .join(first, "shot_id", "left")
        .join(lead, "shot_id", "left")
        .select(
            "shot_id",
            "peak_risk",
            F.coalesce("alerts", F.lit(0)).alias("alerts"),
            "first_alert_unix_ns",
            "first_driver",
            early.alias("warning_ms"),
        )
    )
