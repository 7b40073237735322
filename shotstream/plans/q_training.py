"""Model fitting queries. SQL repeats the two calibrations; the other fits are checked by what holds for
their results: a vanishing gradient, importances that add up to one, every feature once."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotstream.functions.risk import calibrated, linear_score, wide_lookup
from shotstream.operators import labels, training, tree_shap
from shotstream.plans import fixtures as fx
from shotstream.plans.catalog import query, r, rounded
from shotstream.plans.sql_views import score_sql, wide_names, with_views
from shotstream.session import work_dir

LABEL = f"label_h{fx.HOURS[1]}"


def _table(spark, sf_dir):
    timed = labels.time_to_disruption(fx.vectors(spark, sf_dir), fx.shots(spark, sf_dir))
    return labels.label_horizons(timed, fx.HOURS)


_SCORED = (
    f"(SELECT {score_sql(fx.demo_model())} AS score, CASE WHEN coalesce((disruption_time_unix_ns - ts_unix_ns) / 1e6,"
    f" CAST('Infinity' AS DOUBLE)) <= {fx.HOURS[1]} THEN 1.0 ELSE 0.0 END AS y FROM vec JOIN shots USING (shot_id))"
)


def _scores(spark, sf_dir):
    rows = _table(spark, sf_dir)
    score = linear_score(fx.demo_model(), wide_lookup(rows.columns))
    return rows.select(score.alias("score"), F.col(LABEL).alias("label"))


@query("train_logistic")
def train_logistic(spark, sf_dir):
    model = training.fit_logistic(_table(spark, sf_dir), wide_names(), LABEL, "demo")
    rows = [("intercept", model.intercept), *model.coefficients.items()]
    return rounded(spark.createDataFrame(rows, "feature string, coef double"))


@query("train_gbt")
def train_gbt(spark, sf_dir):
    model = training.fit_gbt(_table(spark, sf_dir), wide_names(), LABEL)
    rows = training.importances(model, wide_names())
    return rounded(spark.createDataFrame(rows, "feature string, importance double"))


@query("gbt_shap")
def gbt_shap(spark, sf_dir):
    """Mean effects of the features of a boosted model on its log-odds, over all vectors."""
    rows = _table(spark, sf_dir)
    model = training.fit_gbt(rows, wide_names(), LABEL, iterations=20)
    return rounded(tree_shap.mean_effects(rows, tree_shap.leaves_of(spark, model), wide_names()))


def _newton_sql(offset_penalty: float) -> str:
    """Newton steps on slope and offset; the slope's penalty is one half of its square."""
    return with_views(
        "vec shots",
        f"""SELECT round(a, 4) AS scale, round(b, 4) AS "offset" FROM fitted ORDER BY step DESC LIMIT 1""",
    ).replace(
        " SELECT round(a, 4)",
        f""", points AS MATERIALIZED (SELECT score AS x, sum(y) AS y, count(*) AS n FROM {_SCORED} GROUP BY 1),
        fitted AS (SELECT * FROM (WITH RECURSIVE steps AS (
          SELECT 0 AS step, CAST(0.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b
          UNION ALL
          SELECT step + 1, a - (gaa * ga - gab * gb) / (gaa * hbb - gab * gab), b - (hbb * gb - gab * ga) / (gaa * hbb - gab * gab) FROM (
            SELECT step, any_value(a) AS a, any_value(b) AS b,
              sum((n * p - y) * x) + any_value(a) AS ga, sum(n * p - y) + {offset_penalty} * any_value(b) AS gb,
              sum(n * p * (1 - p)) + {offset_penalty} AS gaa, sum(n * p * (1 - p) * x) AS gab,
              sum(n * p * (1 - p) * x * x) + 1.0 AS hbb
            FROM (SELECT *, 1.0 / (1.0 + exp(-(a * x + b))) AS p FROM steps, points) GROUP BY step) WHERE step < 25)
          SELECT * FROM steps)) SELECT round(a, 4)""",
        1,
    )


@query("platt_fit", _newton_sql(0.0))
def platt_fit(spark, sf_dir):
    fitted = training.fit_platt(_scores(spark, sf_dir), "label")
    made = spark.createDataFrame([(fitted.scale, fitted.offset)], "scale double, offset double")
    return made.select(F.round("scale", 4).alias("scale"), F.round("offset", 4).alias("offset"))


@query("logistic_newton", _newton_sql(1.0))
def logistic_newton(spark, sf_dir):
    """The score's slope and offset with both penalised."""
    fitted = training.fit_newton(_scores(spark, sf_dir), ["score"], "label")
    made = spark.createDataFrame([(fitted.coefficients["score"], fitted.intercept)], "scale double, offset double")
    return made.select(F.round("scale", 4).alias("scale"), F.round("offset", 4).alias("offset"))


# Neighbours that do not rise get one value in any rising fit, so runs of them are pooled first, exactly. The
# fit of a pool is the largest, over starts up to it, of the smallest mean, over ends from it.
_ISOTONIC = with_views("vec shots", f"SELECT {r('x')} AS score, {r('p')} AS p FROM points JOIN fits USING (pool)").replace(
    f" SELECT {r('x')} AS score",
    f""", means AS (SELECT score AS x, sum(y) AS y, count(*) AS n FROM {_SCORED} GROUP BY 1),
    rises AS (SELECT *, CASE WHEN y / n > lag(y / n) OVER (ORDER BY x) THEN 1 ELSE 0 END AS rise FROM means),
    points AS MATERIALIZED (SELECT x, y, n, sum(rise) OVER (ORDER BY x) AS pool FROM rises),
    pools AS (SELECT pool, sum(y) AS y, sum(n) AS n FROM points GROUP BY 1),
    sums AS MATERIALIZED (SELECT pool, y, n, sum(y) OVER (ORDER BY pool) AS sy, sum(n) OVER (ORDER BY pool) AS sn FROM pools),
    fits AS (SELECT pool, max(low) AS p FROM (
      SELECT pool, min(mean) OVER (PARTITION BY start ORDER BY pool DESC) AS low FROM (
        SELECT a.pool AS start, b.pool, (b.sy - a.sy + a.y) / (b.sn - a.sn + a.n) AS mean
        FROM sums a JOIN sums b ON a.pool <= b.pool)) GROUP BY 1)
    SELECT {r('x')} AS score""",
    1,
)


@query("isotonic_fit", _ISOTONIC)
def isotonic_fit(spark, sf_dir):
    """The fitted value of every exact score."""
    return _isotonic(_scores(spark, sf_dir))


@query("isotonic_fit_exact", _ISOTONIC)
def isotonic_fit_exact(spark, sf_dir):
    """The same under the name it had while ``isotonic_fit`` took rounded scores."""
    return _isotonic(_scores(spark, sf_dir))


def _isotonic(scores):
    fitted = training.fit_isotonic(scores, "label")
    distinct = scores.select("score").distinct()
    return rounded(distinct.withColumn("p", calibrated(F.col("score"), fitted)))


@query("train_pipeline")
def train_pipeline(spark, sf_dir):
    """Features from raw telemetry, two horizons, artifacts and metrics."""
    table, names = training.training_table(
        fx.telemetry(spark, sf_dir), fx.shots(spark, sf_dir), fx.BUCKET, fx.HOURS
    )
    config = training.TrainConfig(horizons_ms=fx.HOURS, output=work_dir(spark, "models"))
    return rounded(training.train(table, names, config))
