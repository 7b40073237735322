import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import telemetry_pdf

from shotstream.functions.risk import calibrated, linear_score, wide_lookup
from shotstream.operators import training
from shotstream.sources import sinks


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.normal(size=(n, 2))
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.8 * x[:, 1] - 0.3)))
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (rng.random(n) < p).astype(int)})
    return spark.createDataFrame(frame)


def test_logistic_recovers_planted_coefficients(planted):
    model = training.fit_logistic(planted, ["a", "b"], "y", "v", tol=1e-8)
    assert model.coefficients["a"] == pytest.approx(1.5, abs=0.2)
    assert model.coefficients["b"] == pytest.approx(-0.8, abs=0.2)
    assert model.intercept == pytest.approx(-0.3, abs=0.15)


def scores_of(planted):
    model = training.fit_logistic(planted, ["a", "b"], "y")
    return planted.select(linear_score(model, wide_lookup(planted.columns)).alias("score"), "y")


def test_platt_of_a_calibrated_score_is_near_identity(planted):
    fitted = training.fit_platt(scores_of(planted), "y")
    assert fitted.scale == pytest.approx(1.0, abs=0.05) and fitted.offset == pytest.approx(0.0, abs=0.05)


def test_isotonic_is_monotone_and_reads_back(spark, planted):
    scores = scores_of(planted)
    fitted = training.fit_isotonic(scores, "y")
    xs, ys = zip(*fitted.knots)
    assert list(xs) == sorted(xs) and list(ys) == sorted(ys)
    p = scores.select(calibrated(F.col("score"), fitted).alias("p"), "y")
    row = p.agg(F.avg("p").alias("p"), F.avg("y").alias("y")).first()
    assert row.p == pytest.approx(row.y, abs=0.01)


def test_uncalibrated_scores_become_probabilities(planted):
    scores = scores_of(planted)
    for margin in (True, False):
        cal = training.fit_calibration("none", scores, "y", is_margin=margin)
        values = scores.select(calibrated(F.col("score"), cal).alias("p")).agg(F.min("p"), F.max("p")).first()
        assert 0 <= values[0] <= values[1] <= 1


def test_boosted_trees_separate(planted):
    trees = training.fit_gbt(planted, ["a", "b"], "y", iterations=3)
    ranked = dict(training.importances(trees, ["a", "b"]))
    assert ranked["a"] > ranked["b"]
    scored = training.gbt_scores(trees, planted, ["a", "b"])
    means = {r.y: r.m for r in scored.groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0]


@pytest.fixture(scope="module")
def table(spark):
    lengths = {(f"s{i:02d}", c): 30 for i in range(12) for c in ("ip", "prad")}
    pdf = telemetry_pdf(lengths, gaps=False)
    df = spark.createDataFrame(pdf)
    shots = spark.createDataFrame(
        [(f"s{i:02d}", 1_300 if i % 2 else None) for i in range(12)],
        "shot_id string, disruption_time_unix_ns bigint",
    )
    return training.training_table(
        df, shots, 10, horizons_ms=(0.0001,), channels=("ip", "prad"), windows_ms=(5,)
    )


def test_training_table(table):
    df, names = table
    assert len(names) == 2 * 9 + 1 and df.count() == 12 * 30
    assert df.filter(" or ".join(f"{n} is null" for n in names)).count() == 0
    positives = df.filter("`label_h0.0001` = 1").select("shot_id").distinct().count()
    assert positives == 6


@pytest.mark.parametrize("model, calibration", [("logistic", "platt"), ("gbt", "isotonic")])
def test_train_writes_artifacts(spark, table, tmp_path, model, calibration):
    df, names = table
    df = df.withColumnRenamed("label_h0.0001", "label_h7")
    config = training.TrainConfig(
        model=model,
        calibration=calibration,
        horizons_ms=(7,),
        test_split=0.3,
        calibration_split=0.3,
        output=str(tmp_path),
        iterations=2,
    )
    row = training.train(df, names, config).first()
    assert (row.horizon_ms, row.model) == (7, model) and 0 <= row.brier_score <= 1
    version = f"dev_{model}_h7"
    loaded, cal = sinks.load_model(spark, sinks.artifact_path(str(tmp_path), "dev", 7, version))
    assert loaded.version == version and cal.kind == calibration
    assert len(loaded.coefficients) == (len(names) if model == "logistic" else 0)
    report = spark.read.text(sinks.artifact_path(str(tmp_path), "dev", 7, version) + "/report")
    assert report.filter("value like '- **roc_auc**%'").count() == 1


def test_bad_options():
    with pytest.raises(ValueError):
        training.TrainConfig(model="perceptron")
    with pytest.raises(ValueError):
        training.TrainConfig(calibration="beta")


def test_registered_isotonic_fits_exact_scores(spark, monkeypatch):
    from shotstream.plans import load_all, q_training
    from shotstream.plans.catalog import QUERIES

    load_all()
    draw = np.random.default_rng(5)
    scores = np.round(draw.uniform(-1, 1, 300), 3)  # several in every step of 1/64, some repeated
    labels = (draw.uniform(-1, 1, 300) < scores).astype(float)
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in zip(scores, labels)], "score double, label double")
    monkeypatch.setattr(q_training, "_scores", lambda spark, sf_dir: rows)
    got = {r.score: r.p for r in QUERIES["isotonic_fit_exact"](spark, "").collect()}
    xs = sorted(set(scores.tolist()))
    means = {(a, b): labels[(scores >= a) & (scores <= b)].mean() for a in xs for b in xs if a <= b}
    want = {x: max(min(means[a, b] for b in xs if b >= x) for a in xs if a <= x) for x in xs}
    assert sorted(got) == pytest.approx(xs) and len({round(p, 6) for p in want.values()}) > 2
    assert [got[x] for x in sorted(got)] == pytest.approx([want[x] for x in xs], abs=2e-6)


def test_newton_ends_where_the_gradient_vanishes(spark):
    draw = np.random.default_rng(3)
    x = np.column_stack((draw.normal(size=(400, 3)), 50 * draw.normal(size=400)))
    y = (draw.uniform(size=400) < 1 / (1 + np.exp(-(x[:, 0] - 2 * x[:, 1] + 0.02 * x[:, 3] + 0.7)))).astype(float)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(3)
    model = training.fit_newton(df, ["a", "b", "c", "d"], "y", "v")
    w = np.array([*model.coefficients.values(), model.intercept])
    full = np.column_stack((x, np.ones(400)))

    def gradient(w):
        return full.T @ (1 / (1 + np.exp(-full @ w)) - y) + w

    assert np.abs(gradient(w)).max() < 1e-8
    plain = np.zeros(5)
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ plain))
        plain -= np.linalg.solve((full.T * (p * (1 - p))) @ full + np.eye(5), gradient(plain))
    assert w == pytest.approx(plain, abs=1e-9)
    # Separable data, one class and no features have a finite optimum too.
    two = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "a double, y double")
    assert training.fit_newton(two, ["a"], "y").coefficients["a"] > 0
    alone = training.fit_newton(two.withColumn("y", F.lit(1.0)), [], "y")
    assert alone.coefficients == {} and alone.intercept == pytest.approx(10 / (1 + np.exp(alone.intercept)))
