"""Evaluation, split and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotstream.operators import evaluate, monitoring, splits, stability
from shotstream.operators.scoring import alert_events
from shotstream.plans import fixtures as fx
from shotstream.plans.catalog import query, r, rounded
from shotstream.plans.sql_views import score_sql, sigmoid_sql, with_views

# Mann-Whitney with mid-ranks, average precision and nearest-vertex recall, each from plain windows.
CURVE = """(SELECT {g} score, pos, neg, tp, fp, sum(pos) OVER ({p}) AS positives,
sum(neg) OVER ({p}) AS negatives FROM (SELECT *, sum(pos) OVER ({p} ORDER BY score DESC) AS tp,
sum(neg) OVER ({p} ORDER BY score DESC) AS fp FROM (SELECT {g} p AS score,
count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
FROM {t} GROUP BY ALL)))"""


def curve(group: str = "", source: str = "scored") -> str:
    g = f"{group}, " if group else ""
    p = f"PARTITION BY {group}" if group else ""
    return CURVE.format(g=g, p=p, t=source)


AUC = "sum(neg * (tp - pos / 2.0)) / max(positives * negatives)"
AP = "sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(positives)"
RECALL = (
    "CASE WHEN min(abs(fp / negatives - 0.01)) < 0.01 THEN"
    " arg_min(tp / positives, (abs(fp / negatives - 0.01), -score)) ELSE 0.0 END"
)
EDGES = " + ".join(f"CASE WHEN p > {i * 0.1!r} THEN 1 ELSE 0 END" for i in range(1, 10))
BINNED = f"(SELECT *, CASE WHEN p > 0 AND p <= 1 THEN 1 + {EDGES} END AS bin FROM scored)"
ECE = (
    "SELECT sum(CASE WHEN bin IS NULL THEN 0.0 ELSE abs(c - a) * n END) / sum(n) FROM"
    f" (SELECT bin, count(*) AS n, avg(p) AS c, avg(label) AS a FROM {BINNED} GROUP BY bin)"
)
LEAD = (
    "SELECT coalesce(avg(lead), 0.0) FROM (SELECT max(time_to_disruption) FILTER (WHERE p >= 0.5 AND"
    " time_to_disruption >= 0 AND time_to_disruption < CAST('Infinity' AS DOUBLE)) AS lead"
    " FROM scored GROUP BY shot_id)"
)


@query("roc_auc", with_views("scored", f"SELECT {r(AUC)} AS roc_auc FROM {curve()}"))
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(fx.scored(spark, sf_dir)))


@query(
    "average_precision",
    with_views("scored", f"SELECT {r(AP)} AS average_precision FROM {curve()}"),
)
def average_precision(spark, sf_dir):
    return rounded(evaluate.average_precision(fx.scored(spark, sf_dir)))


@query("recall_at_fpr", with_views("scored", f"SELECT {r(RECALL)} AS recall_at_fpr FROM {curve()}"))
def recall_at_fpr(spark, sf_dir):
    return rounded(evaluate.recall_at_fpr(fx.scored(spark, sf_dir)))


@query(
    "brier_score",
    with_views("scored", f"SELECT {r('avg((p - label) * (p - label))')} AS brier_score FROM scored"),
)
def brier_score(spark, sf_dir):
    return rounded(evaluate.brier_score(fx.scored(spark, sf_dir)))


@query("ece", with_views("scored", f"SELECT {r('(' + ECE + ')')} AS calibration_error"))
def ece(spark, sf_dir):
    return rounded(evaluate.expected_calibration_error(fx.scored(spark, sf_dir)))


@query(
    "reliability_bins",
    with_views(
        "scored",
        f"SELECT bin, count(*) AS rows, {r('avg(p)')} AS confidence, {r('avg(label)')} AS accuracy"
        f" FROM {BINNED} WHERE bin IS NOT NULL GROUP BY bin",
    ),
)
def reliability_bins(spark, sf_dir):
    return rounded(evaluate.reliability_bins(fx.scored(spark, sf_dir)))


@query("lead_time", with_views("scored", f"SELECT {r('(' + LEAD + ')')} AS mean_lead_time_ms"))
def lead_time(spark, sf_dir):
    return rounded(evaluate.lead_time(fx.scored(spark, sf_dir)))


# The literal lead time runs over all rows in one order, across shots.
@query(
    "lead_time_as_coded",
    with_views(
        "scored",
        f"""SELECT {r('coalesce(avg(lead), 0.0)')} AS mean_lead_time_ms FROM (
        SELECT time_to_disruption - last_value(CASE WHEN p >= 0.5 THEN time_to_disruption END IGNORE NULLS)
          OVER (ORDER BY ts_unix_ns, shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead,
        label, time_to_disruption FROM scored)
        WHERE label = 1 AND time_to_disruption < CAST('Infinity' AS DOUBLE) AND lead > 0""",
    ),
)
def lead_time_as_coded(spark, sf_dir):
    rows = fx.scored(spark, sf_dir).withColumn("all_rows", F.lit(0))
    return rounded(
        evaluate.lead_time_as_coded(rows, ["ts_unix_ns", "shot_id"], keys=["all_rows"])
    )


@query(
    "training_report",
    with_views(
        "scored",
        " UNION ALL ".join(
            [
                f"SELECT 'metrics' AS section, '{name}' AS name, printf('%.4f', CAST(({sql}) AS DOUBLE)) AS text"
                for name, sql in {
                    "roc_auc": f"SELECT {AUC} FROM {curve()}",
                    "average_precision": f"SELECT {AP} FROM {curve()}",
                    "recall_at_fpr": f"SELECT {RECALL} FROM {curve()}",
                    "brier_score": "SELECT avg((p - label) * (p - label)) FROM scored",
                    "calibration_error": ECE,
                    "mean_lead_time_ms": LEAD,
                }.items()
            ]
            + [
                "SELECT 'dataset', 'samples', CAST(count(*) AS VARCHAR) FROM scored",
                "SELECT 'dataset', 'positives', CAST(sum(label) AS VARCHAR) FROM scored",
                "SELECT 'dataset', 'shots', CAST(count(DISTINCT shot_id) AS VARCHAR) FROM scored",
            ]
        ),
    ),
)
def training_report(spark, sf_dir):
    rows = fx.scored(spark, sf_dir)
    info = rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("label").alias("positives"),
        F.count_distinct("shot_id").alias("shots"),
    )
    return evaluate.training_report(evaluate.evaluate(rows), info)


_TILTED = fx.demo_model("tilted", 0.25)


@query(
    "model_compare",
    with_views(
        "vec scored",
        f"""SELECT model_version, {r(AUC)} AS roc_auc, {r(AP)} AS average_precision,
        {r(RECALL)} AS recall_at_fpr FROM {curve('model_version', '''(
        SELECT 'demo' AS model_version, p, label FROM scored UNION ALL
        SELECT 'tilted', TILTED, label FROM vec JOIN scored USING (shot_id, ts_unix_ns))''')}
        GROUP BY 1""".replace("TILTED", sigmoid_sql(score_sql(_TILTED))),
    ),
)
def model_compare(spark, sf_dir):
    """Two models through one pass over the vectors."""
    rows = fx.scored(spark, sf_dir, fx.demo_model(), _TILTED)
    table = evaluate.threshold_table(rows, by=["model_version"])
    return rounded(evaluate.ranking_metrics(table, ["model_version"]))


_WEEK = 7 * 86_400_000_000_000
_SECONDS = (1.0, 10.0, 60.0, 120.0, 300.0, 600.0)
_BOTH_MODELS = """(SELECT 'demo' AS model_version, shot_id, ts_unix_ns, p, label, time_to_disruption FROM scored
  UNION ALL SELECT 'tilted', shot_id, ts_unix_ns, TILTED, label, time_to_disruption
  FROM vec JOIN scored USING (shot_id, ts_unix_ns))""".replace("TILTED", sigmoid_sql(score_sql(_TILTED)))
_EDGES = ", ".join(f"({e!r})" for e in _SECONDS) + ", (CAST('Infinity' AS DOUBLE))"


@query(
    "model_stability",
    with_views(
        "tel vec scored",
        f"""SELECT model_version, {r('roc_auc')} AS roc_auc, {r('average_precision')} AS average_precision,
        {r('recall_at_fpr')} AS recall_at_fpr, {r('mean_lead_time_ms')} AS mean_lead_time_ms,
        {r('p95_seconds')} AS p95_seconds, slices, {r('max_psi')} AS max_psi, {r('max_ks')} AS max_ks
        FROM ranking JOIN leads USING (model_version) JOIN p95 USING (model_version) JOIN worst USING (model_version)""",
    ).replace(
        " SELECT model_version",
        f""", both_models AS MATERIALIZED {_BOTH_MODELS},
        ranking AS (SELECT model_version, {AUC} AS roc_auc, {AP} AS average_precision, {RECALL} AS recall_at_fpr
          FROM {curve('model_version', 'both_models')} GROUP BY 1),
        leads AS (SELECT model_version, coalesce(avg(lead), 0.0) AS mean_lead_time_ms FROM (
          SELECT model_version, shot_id, max(time_to_disruption) FILTER (WHERE p >= 0.5 AND time_to_disruption >= 0
            AND time_to_disruption < CAST('Infinity' AS DOUBLE)) AS lead FROM both_models GROUP BY 1, 2) GROUP BY 1),
        waits AS (SELECT model_version, (ts_unix_ns + {fx.BUCKET} - arrived) / 1e9 AS seconds FROM both_models JOIN
          (SELECT shot_id, ts_unix_ns // {fx.BUCKET} * {fx.BUCKET} AS ts_unix_ns, max(ts_unix_ns) AS arrived
           FROM tel GROUP BY 1, 2) USING (shot_id, ts_unix_ns)),
        steps AS (SELECT model_version, le, count(*) FILTER (WHERE seconds <= le) AS cumulative
          FROM waits, (VALUES {_EDGES}) AS b(le) GROUP BY 1, 2),
        p95 AS (SELECT model_version, arg_min(CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN lo
            ELSE lo + (le - lo) * (0.95 * total - below) / (cumulative - below) END, le) AS p95_seconds
          FROM (SELECT *, lag(le, 1, 0.0) OVER o AS lo, lag(cumulative, 1, 0) OVER o AS below,
            max(cumulative) OVER (PARTITION BY model_version) AS total FROM steps
            WINDOW o AS (PARTITION BY model_version ORDER BY le))
          WHERE cumulative >= 0.95 * total AND cumulative > below GROUP BY 1),
        bin_grid AS (SELECT DISTINCT model_version, ts_unix_ns // {_WEEK} AS slice, bin FROM both_models, range(10) AS b(bin)),
        bin_cells AS (SELECT model_version, slice, bin, coalesce(n, 0) AS n FROM bin_grid LEFT JOIN (
          SELECT model_version, ts_unix_ns // {_WEEK} AS slice, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin,
            count(*) AS n FROM both_models GROUP BY 1, 2, 3) USING (model_version, slice, bin)),
        shares AS (SELECT *, sum(n) OVER (PARTITION BY model_version, slice) AS rows_here,
          sum(n) OVER (PARTITION BY model_version, bin) AS bin_all, sum(n) OVER (PARTITION BY model_version) AS rows_all FROM bin_cells),
        gaps AS (SELECT model_version, slice, (n + 0.5) / (rows_here + 5) AS a, (bin_all + 0.5) / (rows_all + 5) AS e,
          abs(sum(n / rows_here - bin_all / rows_all) OVER (PARTITION BY model_version, slice ORDER BY bin)) AS gap FROM shares),
        worst AS (SELECT model_version, count(*) AS slices, max(psi) AS max_psi, max(ks) AS max_ks FROM (
          SELECT model_version, slice, sum((a - e) * ln(a / e)) AS psi, max(gap) AS ks FROM gaps GROUP BY 1, 2) GROUP BY 1)
        SELECT model_version""",
        1,
    ),
)
def model_stability(spark, sf_dir):
    """Two models by ranking, lead time, latency from a cell's last sample to its risk, and drift by week."""
    rows = fx.scored(spark, sf_dir, fx.demo_model(), _TILTED)
    cell = F.expr(f"(ts_unix_ns div {fx.BUCKET}L) * {fx.BUCKET}L")
    arrived = fx.telemetry(spark, sf_dir).groupBy("shot_id", cell.alias("ts_unix_ns")).agg(F.max("ts_unix_ns").alias("arrived_unix_ns"))
    made = rows.select("model_version", "shot_id", "ts_unix_ns", (F.col("ts_unix_ns") + fx.BUCKET).alias("created_unix_ns"))
    waits = arrived.join(made, ["shot_id", "ts_unix_ns"]).select(
        "model_version", ((F.col("created_unix_ns") - F.col("arrived_unix_ns")) / 1e9).alias("seconds")
    )
    week = F.expr(f"ts_unix_ns div {_WEEK}L")
    return rounded(stability.compare_models(rows, waits, week, _SECONDS))


@query(
    "shot_split",
    with_views(
        "scored",
        """SELECT shot_id, ts_unix_ns, CASE WHEN b < 200 THEN 'test' WHEN b < 400 THEN 'calibration'
        ELSE 'train' END AS split FROM (SELECT *, CAST(shot_id AS BIGINT) * 7919 % 1000 AS b FROM scored)""",
    ),
)
def shot_split(spark, sf_dir):
    """The membership number comes from the id by arithmetic, so that SQL can repeat it."""
    bucket = F.col("shot_id").cast("bigint") * 7919 % 1000
    rows = splits.shot_split(fx.scored(spark, sf_dir), 0.2, 0.2, bucket=bucket)
    return rows.select("shot_id", "ts_unix_ns", "split")


@query(
    "split_counts",
    with_views(
        "scored",
        """SELECT split, count(*) AS samples, CAST(sum(label) AS BIGINT) AS positives,
        count(DISTINCT shot_id) AS shots FROM (SELECT *, CASE WHEN CAST(shot_id AS BIGINT) * 7919 % 1000 < 200
        THEN 'test' ELSE 'train' END AS split FROM scored) GROUP BY 1""",
    ),
)
def split_counts(spark, sf_dir):
    bucket = F.col("shot_id").cast("bigint") * 7919 % 1000
    rows = splits.shot_split(fx.scored(spark, sf_dir), 0.2, bucket=bucket)
    return splits.split_counts(rows, "label")


@query(
    "stratified_split",
    """SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality
    ORDER BY (doc_id * 7919) % 1009, doc_id) AS rn FROM labels)""",
)
def stratified_split(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    hashed = (F.col("doc_id") * 7919) % 1009
    return splits.stratified_split(rows, "quality", ["doc_id"], 0.2, hashed=hashed)


@query(
    "rate_5m",
    with_views(
        "arr alerts risk",
        f"""SELECT metric, channel_name, (m + k) * 60000000000 AS window_end_unix_ns,
        CAST(count(*) AS BIGINT) AS events, {r('count(*) / 300.0')} AS per_second FROM (
          SELECT 'points' AS metric, channel_name, ts_unix_ns // 60000000000 AS m FROM arr UNION ALL
          SELECT 'predictions', 'all', ts_unix_ns // 60000000000 FROM risk UNION ALL
          SELECT 'alerts', horizon, ts_unix_ns // 60000000000 FROM alerts),
        (SELECT unnest(range(1, 6)) AS k) GROUP BY 1, 2, 3""",
    ),
)
def rate_5m(spark, sf_dir):
    """Points per channel, predictions, and alerts per horizon, over five minutes every minute."""
    risks = fx.risks(spark, sf_dir)
    streams = (
        fx.telemetry(spark, sf_dir)
        .select(F.lit("points").alias("metric"), "channel_name", "ts_unix_ns")
        .unionByName(
            risks.select(
                F.lit("predictions").alias("metric"), F.lit("all").alias("channel_name"), "ts_unix_ns"
            )
        )
        .unionByName(
            alert_events(risks).select(
                F.lit("alerts").alias("metric"), F.col("horizon").alias("channel_name"), "ts_unix_ns"
            )
        )
    )
    return rounded(monitoring.rates(streams, ["metric", "channel_name"]))


def _latencies(spark, sf_dir):
    """Sample values read as milliseconds."""
    return fx.telemetry(spark, sf_dir).select(
        "channel_name", (F.col("value") / 1000.0).alias("seconds")
    )


_BUCKETS = ", ".join(f"({e!r})" for e in monitoring.REQUEST_BUCKETS) + ", (CAST('Infinity' AS DOUBLE))"
_HISTOGRAM = (
    "(SELECT channel_name, le, count(*) FILTER (WHERE value / 1000.0 <= le) AS cumulative"
    f" FROM tel, (VALUES {_BUCKETS}) AS b(le) GROUP BY 1, 2)"
)


@query(
    "latency_buckets",
    with_views("tel", f"SELECT channel_name, {r('le')} AS le, cumulative FROM {_HISTOGRAM}"),
)
def latency_buckets(spark, sf_dir):
    return rounded(monitoring.latency_buckets(_latencies(spark, sf_dir), ["channel_name"]))


@query(
    "p95_latency",
    with_views(
        "tel",
        f"""SELECT channel_name, {r('''arg_min(CASE WHEN le = CAST('Infinity' AS DOUBLE) THEN lo
        ELSE lo + (le - lo) * (0.95 * total - below) / (cumulative - below) END, le)''')} AS quantile
        FROM (SELECT *, lag(le, 1, 0.0) OVER o AS lo, lag(cumulative, 1, 0) OVER o AS below,
          max(cumulative) OVER (PARTITION BY channel_name) AS total FROM {_HISTOGRAM}
          WINDOW o AS (PARTITION BY channel_name ORDER BY le))
        WHERE cumulative >= 0.95 * total AND cumulative > below GROUP BY 1""",
    ),
)
def p95_latency(spark, sf_dir):
    buckets = monitoring.latency_buckets(_latencies(spark, sf_dir), ["channel_name"])
    return rounded(monitoring.histogram_quantile(buckets, 0.95, ["channel_name"]))


@query(
    "e2e_latency",
    with_views(
        "tel risk",
        f"""SELECT shot_id, ts_unix_ns, {r(f"(ts_unix_ns + {fx.BUCKET} - arrived) / 1e9")} AS seconds FROM risk JOIN
        (SELECT shot_id, ts_unix_ns // {fx.BUCKET} * {fx.BUCKET} AS ts_unix_ns, max(ts_unix_ns) AS arrived
         FROM tel GROUP BY 1, 2) USING (shot_id, ts_unix_ns)""",
    ),
)
def e2e_latency(spark, sf_dir):
    """From the last sample of a grid cell to its risk, which is made when the cell ends."""
    cell = F.expr(f"(ts_unix_ns div {fx.BUCKET}L) * {fx.BUCKET}L")
    samples = fx.telemetry(spark, sf_dir)
    arrived = samples.groupBy("shot_id", cell.alias("ts_unix_ns")).agg(F.max("ts_unix_ns").alias("arrived_unix_ns"))
    made = fx.risks(spark, sf_dir).withColumn("created_unix_ns", F.col("ts_unix_ns") + fx.BUCKET)
    return rounded(monitoring.end_to_end_latency(arrived, made))
