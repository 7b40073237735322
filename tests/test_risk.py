import math

import pytest
from pyspark.sql import functions as F

from shotstream.functions import risk as R
from shotstream.functions import rules as RU
from shotstream.operators import scoring

VECTOR = "shot_id string, ts_unix_ns bigint, features map<string,double>, missing_ratio double"
MODEL = R.LinearModel({"a": 2.0, "b": -3.0, "absent": 9.0}, 0.5, "m1")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(
        [("s", 1, {"a": 1.0, "b": 0.5, "extra": 7.0}, 0.0), ("s", 2, {"extra": 1.0}, 0.4)], VECTOR
    )


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_score_ignores_unknown_features(vectors):
    rows = scoring.risk_points(vectors, MODEL, R.Calibration(version="c1")).orderBy("ts_unix_ns").collect()
    assert rows[0].risk_h50 == pytest.approx(sigmoid(1.0))
    assert rows[1].risk_h50 == pytest.approx(sigmoid(0.5))
    assert rows[0].risk_h200 == pytest.approx(min(1.0, sigmoid(1.0) * 0.9 + 0.05))
    assert (rows[0].model_version, rows[0].calibration_version) == ("m1", "c1")


def test_calibration_scale_zero_means_one(vectors):
    zero = R.Calibration(scale=0.0, offset=0.25)
    row = scoring.risk_points(vectors, MODEL, zero).orderBy("ts_unix_ns").first()
    assert row.risk_h50 == pytest.approx(sigmoid(1.25))


def test_isotonic_interpolates_and_clips(spark):
    knots = ((0.0, 0.1), (1.0, 0.3), (2.0, 0.9))
    df = spark.createDataFrame([(-5.0,), (0.5,), (1.5,), (7.0,)], "score double")
    got = df.select(R.calibrated(F.col("score"), R.Calibration("isotonic", knots=knots)).alias("p"))
    assert [r.p for r in got.collect()] == pytest.approx([0.1, 0.2, 0.6, 0.9])


def test_own_model_for_the_long_horizon(vectors):
    row = scoring.risk_points(vectors, MODEL, long_model=R.LinearModel({"a": 1.0}, 0.0)).orderBy("ts_unix_ns").first()
    assert row.risk_h200 == pytest.approx(sigmoid(1.0))


def test_wide_and_long_scores_agree(spark, vectors):
    wide = vectors.select("shot_id", "ts_unix_ns", *[F.try_element_at("features", F.lit(n)).alias(n) for n in ("a", "b", "extra")])
    direct = wide.select("ts_unix_ns", R.linear_score(MODEL, scoring.lookup_for(wide)).alias("s"))
    long = vectors.select("ts_unix_ns", F.explode("features").alias("feature", "value"))
    table = spark.createDataFrame(list(MODEL.coefficients.items()), "feature string, coef double")
    joined = scoring.score_long(long, table, ["ts_unix_ns"], MODEL.intercept)
    assert {r.ts_unix_ns: r.s for r in direct.collect()} == {r.ts_unix_ns: r.score for r in joined.collect()} == {1: 1.0, 2: 0.5}


def test_drivers_by_size_then_name(spark):
    features = {f"f{i}": 1.0 for i in range(8)}
    df = spark.createDataFrame([("s", 1, features, 0.0)], VECTOR)
    model = R.LinearModel({"f0": 1.0, "f1": -5.0, "f2": 2.0, "f3": -2.0, "f4": 0.5, "f5": 0.1, "gone": 100.0})
    got = scoring.top_drivers(df, model).orderBy("rank").collect()
    assert [(r.feature, r.contribution) for r in got] == [
        ("f1", -5.0), ("f2", 2.0), ("f3", -2.0), ("f0", 1.0), ("f4", 0.5)
    ]


RULE = RU.Rule(
    "test_rule",
    (RU.Condition("risk_h50", "gte", 0.8), RU.Condition("risk_h200", "lte", 0.9)),
    "reduce_heating",
    0.7,
    "High risk detected",
)


def fired(spark, rule, h50=0.85, h200=0.8, features=None, strict=False):
    df = spark.createDataFrame(
        [("s", 1, features or {}, 0.1, h50, h200)], VECTOR + ", risk_h50 double, risk_h200 double"
    )
    return len(scoring.recommend(df, [rule], strict).first().recommendations)


def test_rule_matches_all_conditions(spark):
    assert fired(spark, RULE) == 1
    assert fired(spark, RULE, h50=0.7) == 0


def test_field_lookup(spark):
    def rule(field):
        return RU.Rule("r", (RU.Condition(field, "gte", 0.0),), "a", 1.0, "")

    features = {"ip_mean_w50": 1.0}
    assert fired(spark, rule("feature.ip_mean_w50"), features=features) == 1
    assert fired(spark, rule("feature.missing"), features=features) == 0
    assert fired(spark, rule("risk_h50")) == 1
    assert fired(spark, rule("unknown")) == 0
    assert fired(spark, rule("missing_ratio")) == 1
    assert fired(spark, rule("missing_ratio"), strict=True) == 0
    assert fired(spark, RU.Rule("r", (), "a", 1.0, "")) == 1


@pytest.mark.parametrize(
    "actual, target, op, want",
    [
        (1.0, 0.5, "gte", True),
        (1.0, 0.5, "gt", True),
        (0.5, 1.0, "lte", True),
        (0.5, 1.0, "LT", True),
        (1.0, 1.0, "eq", True),
        (1.0, 2.0, "eq", False),
        (1.0, 0.5, "lte", False),
        (1.0, 1.0, "gt", False),
        (1.0, 1.0, "between", False),
        (None, 1.0, "gte", False),
    ],
)
def test_compare(spark, actual, target, op, want):
    df = spark.createDataFrame([(actual, target)], "a double, t double")
    assert df.select(RU.compare(F.col("a"), F.col("t"), op).alias("r")).first().r is want


def test_sample_rules_in_order(spark):
    features = {"prad_mean_w50": 1.6}
    df = spark.createDataFrame(
        [("s", 1, features, 0.1, 0.9, 0.86)], VECTOR + ", risk_h50 double, risk_h200 double"
    )
    rows = scoring.recommendation_rows(scoring.recommend(df, RU.DEV_RULES)).orderBy("ord").collect()
    assert [r.rule_id for r in rows] == ["high_risk_fast", "radiation_spike"]
    assert len(scoring.recommend(df, RU.PROD_RULES).first().recommendations) == 1


def test_alerts_per_horizon(spark):
    df = spark.createDataFrame(
        [("s", 1, 0.95, 0.8), ("s", 2, 0.85, 0.7), ("s", 3, 0.1, 0.1)],
        "shot_id string, ts_unix_ns bigint, risk_h50 double, risk_h200 double",
    )
    rows = scoring.alert_events(df).orderBy("ts_unix_ns", "horizon").collect()
    assert [(r.ts_unix_ns, r.horizon, r.severity, r.message) for r in rows] == [
        (1, "h200", "medium", "High disruption risk (h200=0.800)"),
        (1, "h50", "high", "High disruption risk (h50=0.950)"),
        (2, "h50", "medium", "High disruption risk (h50=0.850)"),
    ]
    again = scoring.alert_events(df.repartition(3)).select("event_id").collect()
    assert {r.event_id for r in again} == {r.event_id for r in rows}


def test_as_of_takes_the_latest_at_or_before(spark, limits):
    facts = spark.createDataFrame(
        [("s", t, t / 10) for t in range(10, 200, 10)] + [("t", 50, 9.0)],
        "shot_id string, ts_unix_ns bigint, risk double",
    )
    asks = [("s", 9), ("s", 10), ("s", 15), ("s", 19), ("s", 500), ("t", 49), ("t", 50), ("u", 5)]
    requests = spark.createDataFrame(
        [(i, s, t) for i, (s, t) in enumerate(asks)], "id int, shot_id string, at_unix_ns bigint"
    )
    got = scoring.as_of(requests, facts, ["risk"], limits=limits).collect()
    assert {(r.shot_id, r.at_unix_ns): r.ts_unix_ns for r in got} == {
        ("s", 10): 10, ("s", 15): 10, ("s", 19): 10, ("s", 500): 190, ("t", 50): 50
    }


def test_normalization_without_a_range(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "score double")
    assert [r.calibrated for r in scoring.min_max_normalized(df).collect()] == pytest.approx([sigmoid(2.0)] * 2)
    df = spark.createDataFrame([(1.0,), (3.0,)], "score double")
    got = sorted(r.calibrated for r in scoring.min_max_normalized(df).collect())
    assert got == pytest.approx([0.5, sigmoid(1.0)])


def test_linear_shap(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = {r.feature: (r.mean_value, r.mean_abs_effect) for r in scoring.linear_shap(df, MODEL).collect()}
    assert got == {"a": (2.0, 2.0), "b": (5.0, 0.0)}


def test_alert_text_rounds_the_exact_value(spark):
    import random

    random.seed(1)
    values = [0.9345, 0.8125, 0.8135, 0.9995, 0.99951, 1.0, 0.75, 0.0005, 0.0015, 2.5, 0.0] + [random.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(R.three_decimals(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.3f}" for v in values]
