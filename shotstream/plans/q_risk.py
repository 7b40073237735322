"""Scoring, explanation, rule, alert and read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotstream.functions.rules import DEV_RULES
from shotstream.operators import evaluate, features, ingest, points, reads, scoring
from shotstream.plans import fixtures as fx
from shotstream.plans.catalog import query, r, rounded
from shotstream.plans.sql_views import score_sql, sigmoid_sql, stat_sql, window_sql, with_views
from shotstream.session import work_dir
from shotstream.sources import sinks

FROM_NS = 1704844800000000000


@query(
    "risk_points",
    with_views(
        "risk",
        f"SELECT shot_id, ts_unix_ns, {r('risk_h50')} AS risk_h50, {r('risk_h200')} AS risk_h200,"
        " model_version, calibration_version FROM risk",
    ),
)
def risk_points(spark, sf_dir):
    return rounded(fx.risks(spark, sf_dir))


_MODEL_ROWS = ", ".join(f"('{n}', {c!r})" for n, c in sorted(fx.demo_model().coefficients.items()))
_LONG_POINTS = (
    "(" + " UNION ALL ".join(
        f"SELECT shot_id, ts_unix_ns, channel_name || '_{s}_w{w}' AS feature, {s}_w{w} AS value"
        f" FROM (SELECT shot_id, ts_unix_ns, channel_name, value, {stat_sql()} FROM pts {window_sql()})"
        for w in (50, 200)
        for s in features.ONLINE_STATS
    ) + ")"
)


@query(
    "linear_score",
    with_views(
        "pts",
        f"SELECT shot_id, ts_unix_ns, {r('sum(coalesce(value * coef, 0.0)) - 1.0')} AS score,"
        f" {r('sum(coalesce(value * coef, 0.0)) - 1.0')} AS score_from_map"
        f" FROM {_LONG_POINTS} LEFT JOIN (VALUES {_MODEL_ROWS}) AS m(feature, coef) USING (feature) GROUP BY 1, 2",
    ),
)
def linear_score(spark, sf_dir):
    """Points hold one to five channels, so vectors lack some model features and have others the
    model does not know. Scored from the map and through a coefficient table."""
    model = fx.demo_model()
    pts = ingest.with_missing_ratio(fx.points(spark, sf_dir))
    online = features.online_features(points.explode_points(pts, "missing_ratio"))
    vectors = features.feature_vectors(online, merge_windows=True)
    key = ["shot_id", "ts_unix_ns"]
    from_map = vectors.select(
        *key,
        scoring.R.linear_score(model, scoring.lookup_for(vectors)).alias("score_from_map"),
        "features",
    )
    path = work_dir(spark, "model")
    sinks.save_model(spark, model, fx.DEMO_CALIBRATION, path)
    long = from_map.select(*key, "score_from_map", F.explode("features").alias("feature", "value"))
    scored = scoring.score_long(
        long, sinks.coefficient_table(spark, path), [*key, "score_from_map"], model.intercept
    )
    return rounded(scored)


@query(
    "top_drivers",
    with_views(
        "drivers",
        f"SELECT shot_id, ts_unix_ns, rank, feature, {r('contribution')} AS contribution FROM drivers",
    ),
)
def top_drivers(spark, sf_dir):
    return rounded(scoring.top_drivers(fx.vectors(spark, sf_dir), fx.demo_model()))


@query(
    "rule_recommend",
    with_views(
        "risk",
        f"""SELECT shot_id, ts_unix_ns, CAST(row_number() OVER (PARTITION BY shot_id, ts_unix_ns ORDER BY o)
        AS INTEGER) AS ord, rule_id, action, {r('confidence')} AS confidence, rationale FROM (
        SELECT shot_id, ts_unix_ns, 1 AS o, 'high_risk_fast' AS rule_id, 'reduce_heating_power' AS action,
        0.7 AS confidence, 'High short-horizon disruption risk' AS rationale FROM risk
        WHERE risk_h50 >= 0.85 AND missing_ratio <= 0.2 UNION ALL
        SELECT shot_id, ts_unix_ns, 2, 'radiation_spike', 'adjust_density', 0.6,
        'Radiation increase correlates with instability' FROM risk
        WHERE prad_mean_w50 >= 1.5 AND risk_h200 >= 0.75)""",
    ),
)
def rule_recommend(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    published = scoring.full_risk_points(
        vectors, fx.demo_model(), fx.DEMO_CALIBRATION, DEV_RULES
    )
    return rounded(scoring.recommendation_rows(published))


@query(
    "alert_events",
    with_views("alerts", "SELECT shot_id, ts_unix_ns, kind, message, severity, horizon FROM alerts"),
)
def alert_events(spark, sf_dir):
    return scoring.alert_events(fx.risks(spark, sf_dir)).drop("event_id")


@query(
    "risk_asof",
    with_views(
        "arr risk",
        f"""SELECT event_id, a.shot_id, a.ts_unix_ns AS at_unix_ns, k.ts_unix_ns,
        {r('risk_h50')} AS risk_h50, {r('risk_h200')} AS risk_h200
        FROM arr a
        ASOF JOIN risk k ON a.shot_id = k.shot_id AND a.ts_unix_ns >= k.ts_unix_ns""",
    ),
)
def risk_asof(spark, sf_dir):
    """For every sample the risk that was known at its time."""
    requests = fx.arrivals(spark, sf_dir).select("event_id", "shot_id", F.col("ts_unix_ns").alias("at_unix_ns"))
    return rounded(
        scoring.as_of(requests, fx.risks(spark, sf_dir), ["risk_h50", "risk_h200"])
    )


@query(
    "explain_at",
    with_views(
        "arr risk drivers",
        f"""SELECT event_id, q.shot_id, at_unix_ns, q.ts_unix_ns, {r('risk_h50')} AS risk_h50,
        rank, feature, {r('contribution')} AS contribution FROM (
        SELECT event_id, a.shot_id, a.ts_unix_ns AS at_unix_ns, k.ts_unix_ns, risk_h50
        FROM arr a
        ASOF JOIN risk k ON a.shot_id = k.shot_id AND a.ts_unix_ns >= k.ts_unix_ns) q
        JOIN drivers d ON d.shot_id = q.shot_id AND d.ts_unix_ns = q.ts_unix_ns""",
    ),
)
def explain_at(spark, sf_dir):
    """As-of risk with its drivers, for every sample."""
    requests = fx.arrivals(spark, sf_dir).select("event_id", "shot_id", F.col("ts_unix_ns").alias("at_unix_ns"))
    explained = scoring.full_risk_points(
        fx.vectors(spark, sf_dir), fx.demo_model(), fx.DEMO_CALIBRATION
    )
    found = scoring.as_of(requests, explained, ["risk_h50", "top_features"])
    rows = found.select(
        "event_id",
        "shot_id",
        "at_unix_ns",
        "ts_unix_ns",
        "risk_h50",
        F.posexplode("top_features").alias("_i", "_d"),
    )
    return rounded(
        rows.select(
            "event_id",
            "shot_id",
            "at_unix_ns",
            "ts_unix_ns",
            "risk_h50",
            (F.col("_i") + 1).alias("rank"),
            F.col("_d.key").alias("feature"),
            F.col("_d.value").alias("contribution"),
        )
    )


@query(
    "linear_shap",
    with_views(
        "contrib",
        f"""SELECT feature, {r('any_value(coef)')} AS coef, {r('any_value(m)')} AS mean_value,
        {r('avg(abs(coef * (value - m)))')} AS mean_abs_effect FROM (
          SELECT feature, value, coef, avg(value) OVER (PARTITION BY feature) AS m FROM contrib
          JOIN (VALUES {_MODEL_ROWS}) AS t(feature, coef) USING (feature)) GROUP BY feature""",
    ),
)
def linear_shap(spark, sf_dir):
    return rounded(scoring.linear_shap(fx.vectors(spark, sf_dir), fx.demo_model()))


@query(
    "platt_normalize",
    with_views(
        "vec",
        f"""SELECT shot_id, ts_unix_ns, {r('1.0 / (1.0 + exp(-((score - lo) / (hi - lo))))')} AS calibrated
        FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM (
          SELECT shot_id, ts_unix_ns, {score_sql(fx.demo_model())} AS score FROM vec))""",
    ),
)
def platt_normalize(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    scores = vectors.select(
        "shot_id",
        "ts_unix_ns",
        scoring.R.linear_score(fx.demo_model(), scoring.lookup_for(vectors)).alias("score"),
    )
    return rounded(scoring.min_max_normalized(scores).drop("score"))


@query(
    "model_roundtrip",
    with_views(
        "vec",
        f"SELECT shot_id, ts_unix_ns, {r(sigmoid_sql('1.5 * ' + score_sql(fx.demo_model()) + ' - 0.25'))}"
        " AS risk, 'demo' AS model_version FROM vec",
    ),
)
def model_roundtrip(spark, sf_dir):
    """Model and calibration saved, loaded and applied."""
    path = sinks.artifact_path(work_dir(spark, "artifacts"), "dev", 50, "demo")
    sinks.save_model(
        spark, fx.demo_model(), scoring.R.Calibration("platt", 1.5, -0.25, "demo-cal"), path
    )
    model, calibration = sinks.load_model(spark, path)
    scored = scoring.risk_points(fx.vectors(spark, sf_dir), model, calibration)
    return rounded(
        scored.select("shot_id", "ts_unix_ns", F.col("risk_h50").alias("risk"), "model_version")
    )


@query(
    "risk_series",
    with_views(
        "risk",
        f"SELECT shot_id, ts_unix_ns, {r('risk_h50')} AS risk_h50, {r('risk_h200')} AS risk_h200,"
        f" model_version, calibration_version FROM risk WHERE ts_unix_ns >= {FROM_NS}",
    ),
)
def risk_series(spark, sf_dir):
    """All shots from a time on: one bound given, the other open."""
    return rounded(reads.series("risk", fx.risks(spark, sf_dir), start_ns=FROM_NS))


@query(
    "telemetry_series",
    with_views("tel", f"SELECT shot_id, channel_name, ts_unix_ns, {r('value')} AS value FROM tel"),
)
def telemetry_series(spark, sf_dir):
    return rounded(reads.series("telemetry", fx.telemetry(spark, sf_dir)))


@query(
    "telemetry_pages",
    with_views(
        "tel",
        f"""SELECT shot_id, channel_name, pos // 40 AS page, count(*) AS samples,
        min(ts_unix_ns) AS first_ts, {r('sum(value)')} AS total, {r('arg_max(value, ts_unix_ns)')} AS last_value
        FROM (SELECT *, row_number() OVER (PARTITION BY shot_id, channel_name ORDER BY ts_unix_ns) - 1 AS pos
        FROM tel) GROUP BY 1, 2, 3""",
    ),
)
def telemetry_pages(spark, sf_dir):
    """The nested read: arrays of samples per channel in pages of 40."""
    pages = reads.telemetry_pages(fx.telemetry(spark, sf_dir), page_rows=40)
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["value"])
    return rounded(
        pages.select(
            "shot_id",
            "channel_name",
            "page",
            F.size("points").cast("bigint").alias("samples"),
            F.col("points")[0]["ts_unix_ns"].alias("first_ts"),
            total.alias("total"),
            F.element_at("points", -1)["value"].alias("last_value"),
        )
    )


@query(
    "list_shots",
    with_views("shots", "SELECT shot_id, started_unix_ns, finished_unix_ns FROM shots"),
)
def list_shots(spark, sf_dir):
    return reads.list_shots(fx.shots(spark, sf_dir))


@query(
    "shot_events",
    with_views(
        "alerts shots",
        """SELECT shot_id, ts_unix_ns, kind, message, severity FROM alerts UNION ALL
        SELECT shot_id, disruption_time_unix_ns, 'disruption', 'Disruption', 'high' FROM shots
        WHERE disruption_time_unix_ns IS NOT NULL UNION ALL
        SELECT shot_id, started_unix_ns, 'info', 'Shot started', NULL FROM shots""",
    ),
)
def shot_events(spark, sf_dir):
    """Alerts, disruptions and starts of all shots in one log, by time."""
    shots = fx.shots(spark, sf_dir)
    disruptions = shots.filter("disruption_time_unix_ns is not null").select(
        "shot_id",
        F.col("disruption_time_unix_ns").alias("ts_unix_ns"),
        F.lit("disruption").alias("kind"),
        F.lit("Disruption").alias("message"),
        F.lit("high").alias("severity"),
    )
    starts = shots.select(
        "shot_id",
        F.col("started_unix_ns").alias("ts_unix_ns"),
        F.lit("info").alias("kind"),
        F.lit("Shot started").alias("message"),
        F.lit("").alias("severity"),
    )
    alerts = scoring.alert_events(fx.risks(spark, sf_dir)).select(*starts.columns)
    return reads.shot_events(alerts.unionByName(disruptions).unionByName(starts))


@query(
    "latest_risk",
    with_views(
        "risk",
        f"""SELECT shot_id, max(ts_unix_ns) AS ts_unix_ns, {r('arg_max(risk_h50, ts_unix_ns)')} AS risk_h50,
        {r('arg_max(risk_h200, ts_unix_ns)')} AS risk_h200,
        arg_max(model_version, ts_unix_ns) AS model_version FROM risk GROUP BY 1""",
    ),
)
def latest_risk(spark, sf_dir):
    return rounded(reads.latest_risk(fx.risks(spark, sf_dir)))


@query(
    "shot_summary",
    with_views(
        "alerts shots drivers risk",
        f"""SELECT s.shot_id, {r('peak_risk')} AS peak_risk, coalesce(alerts, 0) AS alerts,
        first_alert_unix_ns, first_driver,
        {r('(disruption_time_unix_ns - first_alert_unix_ns) / 1e6')} AS warning_ms FROM shots s
        LEFT JOIN (SELECT shot_id, max(risk_h50) AS peak_risk FROM risk GROUP BY 1) USING (shot_id)
        LEFT JOIN (SELECT shot_id, count(*) AS alerts, min(ts_unix_ns) AS first_alert_unix_ns
          FROM alerts GROUP BY 1) USING (shot_id)
        LEFT JOIN (SELECT d.shot_id, arg_min(feature, d.ts_unix_ns) AS first_driver FROM drivers d
          JOIN (SELECT DISTINCT shot_id, ts_unix_ns FROM alerts) a
          ON d.shot_id = a.shot_id AND d.ts_unix_ns = a.ts_unix_ns WHERE rank = 1 GROUP BY 1)
        USING (shot_id)""",
    ),
)
def shot_summary(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    risks = scoring.risk_points(vectors, fx.demo_model(), fx.DEMO_CALIBRATION)
    return rounded(
        evaluate.shot_summary(
            risks,
            scoring.top_drivers(vectors, fx.demo_model()),
            fx.shots(spark, sf_dir),
            scoring.alert_events(risks),
        )
    )
