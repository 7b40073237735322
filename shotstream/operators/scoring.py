"""Risk points, drivers, recommendations and alerts from feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotstream.functions import risk as R
from shotstream.functions.rules import Rule, recommendations
from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, carry_forward

Lookup = Callable[[str], Column | None]
TOP = 5


def lookup_for(vectors: DataFrame) -> Lookup:
    """Features come from a ``features`` map when there is one, else from the columns."""
    if "features" in vectors.columns:
        return R.map_lookup("features")
    return R.wide_lookup(vectors.columns)


def score_long(
    features: DataFrame, coefficients: DataFrame, keys: Sequence[str], intercept: float
) -> DataFrame:
    """Dot product against a coefficient table (feature, coef).

    Left join, so a vector none of whose features is in the model still scores the intercept. Which
    join runs is left to the measured size of the coefficient table.
    """
    joined = features.join(coefficients, "feature", "left")
    term = F.coalesce(F.col("value") * F.col("coef"), F.lit(0.0))
    return joined.groupBy(*keys).agg((F.sum(term) + F.lit(float(intercept))).alias("score"))


def risk_points(
    vectors: DataFrame,
    model: R.LinearModel,
    calibration: R.Calibration = R.Calibration(),
    long_model: R.LinearModel | None = None,
    long_calibration: R.Calibration | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score each vector. With one model the long-horizon risk follows from the short one."""
    lookup = lookup_for(vectors)
    short = R.calibrated(R.linear_score(model, lookup), calibration)
    scored = vectors.withColumn("risk_h50", short)
    if long_model is None:
        long = R.long_horizon_risk(F.col("risk_h50"))
    else:
        long = R.calibrated(R.linear_score(long_model, lookup), long_calibration or calibration)
    return scored.withColumn("risk_h200", long).select(
        "shot_id",
        "ts_unix_ns",
        "risk_h50",
        "risk_h200",
        F.lit(model.version).alias("model_version"),
        F.lit(calibration.version).alias("calibration_version"),
        *keep,
    )


def top_features(model: R.LinearModel, lookup: Lookup, top: int = TOP) -> Column:
    """Array of (key, value): the signed contributions of largest size, ties by name.

    Sorting structs by (-size, name) inside the row needs no shuffle.
    """
    entries = [
        F.when(term.isNotNull(), F.struct((-F.abs(term)).alias("o"), F.lit(name).alias("key"), term.alias("value")))
        for name, term in R.contributions(model, lookup)
    ]
    ordered = F.slice(F.sort_array(F.array_compact(F.array(*entries))), 1, top)
    return F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def top_drivers(vectors: DataFrame, model: R.LinearModel, top: int = TOP) -> DataFrame:
    """The strongest drivers of each vector as rows, ``rank`` from 1."""
    arr = top_features(model, lookup_for(vectors), top)
    return vectors.select("shot_id", "ts_unix_ns", F.posexplode(arr).alias("_i", "_d")).select(
        "shot_id",
        "ts_unix_ns",
        (F.col("_i") + 1).alias("rank"),
        F.col("_d.key").alias("feature"),
        F.col("_d.value").alias("contribution"),
    )


def recommend(
    vectors: DataFrame, rules: Sequence[Rule], strict_lookup: bool = False
) -> DataFrame:
    """Add ``recommendations`` to vectors that carry their risks.

    A bare field names a risk; ``missing_ratio`` is resolved from the vector unless ``strict_lookup``.
    """
    known = {"risk_h50": F.col("risk_h50"), "risk_h200": F.col("risk_h200")}
    if not strict_lookup and "missing_ratio" in vectors.columns:
        known["missing_ratio"] = F.col("missing_ratio")
    return vectors.withColumn(
        "recommendations", recommendations(rules, lookup_for(vectors), known)
    )


def recommendation_rows(recommended: DataFrame) -> DataFrame:
    return recommended.select(
        "shot_id", "ts_unix_ns", F.posexplode("recommendations").alias("_i", "_r")
    ).select("shot_id", "ts_unix_ns", (F.col("_i") + 1).alias("ord"), "_r.*")


def full_risk_points(
    vectors: DataFrame,
    model: R.LinearModel,
    calibration: R.Calibration = R.Calibration(),
    rules: Sequence[Rule] = (),
    top: int = TOP,
) -> DataFrame:
    """Risk points with their drivers and recommendations, the shape that is published."""
    lookup = lookup_for(vectors)
    short = R.calibrated(R.linear_score(model, lookup), calibration)
    scored = vectors.withColumn("risk_h50", short).withColumn(
        "risk_h200", R.long_horizon_risk(F.col("risk_h50"))
    )
    return recommend(scored, rules).select(
        "shot_id",
        "ts_unix_ns",
        "risk_h50",
        "risk_h200",
        F.lit(model.version).alias("model_version"),
        F.lit(calibration.version).alias("calibration_version"),
        top_features(model, lookup, top).alias("top_features"),
        "recommendations",
    )


def alert_events(risks: DataFrame, thresholds: R.Thresholds = R.Thresholds()) -> DataFrame:
    """One event per horizon whose risk reaches its threshold; ids repeat on replay."""
    horizons: Mapping[str, tuple[str, float]] = {
        "h50": ("risk_h50", thresholds.risk_h50),
        "h200": ("risk_h200", thresholds.risk_h200),
    }
    candidates = F.array(
        *[
            F.when(
                F.col(column) >= F.lit(limit),
                F.struct(F.lit(name).alias("horizon"), F.col(column).alias("risk")),
            )
            for name, (column, limit) in horizons.items()
        ]
    )
    hits = risks.select(
        "shot_id", "ts_unix_ns", F.explode(F.array_compact(candidates)).alias("_h")
    ).select("shot_id", "ts_unix_ns", "_h.horizon", "_h.risk")
    return hits.select(
        F.xxhash64("shot_id", "ts_unix_ns", F.lit("alert"), "horizon").alias("event_id"),
        "shot_id",
        "ts_unix_ns",
        F.lit("alert").alias("kind"),
        R.alert_message(F.col("horizon"), F.col("risk")).alias("message"),
        R.severity(F.col("risk"), thresholds).alias("severity"),
        "horizon",
    )


def as_of(
    requests: DataFrame,
    facts: DataFrame,
    values: Sequence[str],
    key: str = "shot_id",
    at: str = "at_unix_ns",
    ts: str = "ts_unix_ns",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """For each request the latest fact of its key at or before its time; no match is dropped.

    Both sides are put on one time line, so the cost is one ordering by key rather than a range join.
    """
    names = requests.columns
    left = facts.select(
        F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.struct(ts, *values).alias("_fact")
    )
    right = requests.select(
        F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_req")
    )
    line = left.unionByName(right, allowMissingColumns=True)
    matched = carry_forward(line, [key], ["_t", "_side"], {"_match": F.col("_fact")}, limits)
    found = matched.filter((F.col("_side") == 1) & F.col("_match").isNotNull())
    return found.select(
        *[F.col(f"_req.{n}").alias(n) for n in names],
        F.col(f"_match.{ts}").alias(ts),
        *[F.col(f"_match.{v}").alias(v) for v in values],
    )


def linear_shap(vectors: DataFrame, model: R.LinearModel) -> DataFrame:
    """Mean absolute Shapley value of each feature of a linear model: coef * (x - mean(x))."""
    present = [n for n in sorted(model.coefficients) if n in vectors.columns]
    means = vectors.agg(*[F.avg(n).alias(f"_m_{n}") for n in present])
    # The broadcast side is a global aggregate: one row.
    joined = vectors.select(*present).crossJoin(F.broadcast(means))
    effects = joined.agg(
        *[
            F.avg(F.abs(F.lit(float(model.coefficients[n])) * (F.col(n) - F.col(f"_m_{n}")))).alias(n)
            for n in present
        ],
        *[F.first(f"_m_{n}").alias(f"_m_{n}") for n in present],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.lit(float(model.coefficients[n])).alias("coef"),
                F.col(f"_m_{n}").alias("mean_value"),
                F.col(n).alias("mean_abs_effect"),
            )
            for n in present
        ]
    )
    return effects.select(F.explode(rows).alias("_r")).select("_r.*")


def min_max_normalized(scores: DataFrame, score: str = "score") -> DataFrame:
    """Unsupervised calibration: scale to [0, 1] unless the range is nil, then a sigmoid."""
    bounds = scores.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 1e-9, (F.col(score) - F.col("_lo")) / span).otherwise(F.col(score))
    return (
        scores.crossJoin(F.broadcast(bounds))
        .withColumn("calibrated", R.sigmoid(scaled))
        .drop("_lo", "_hi")
    )
