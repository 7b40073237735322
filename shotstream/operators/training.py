"""Model fitting, calibration and the training job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.functions.risk import Calibration, LinearModel, calibrated, linear_score, wide_lookup
from shotstream.operators import evaluate, features, labels
from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, carry_forward, measured
from shotstream.operators.splits import shot_split
from shotstream.schema import CHANNELS, HORIZONS_MS, SERIES_KEY, WINDOWS
from shotstream.session import work_dir
from shotstream.sources import sinks

MODELS = ("logistic", "gbt")
CALIBRATIONS = ("platt", "isotonic", "none")


def training_table(
    telemetry: DataFrame,
    shots: DataFrame,
    bucket_ns: int,
    horizons_ms: Sequence[int] = HORIZONS_MS,
    channels: Sequence[str] = CHANNELS,
    windows_ms: Sequence[int] = WINDOWS,
    rate_hz: int = 1000,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, list[str]]:
    """Offline features of all channels on a time grid with labels, and the feature names."""
    columns = [f"{s}_w{w}" for w in windows_ms for s in features.OFFLINE_STATS]
    columns += ["zscore", "anomaly"]
    known = telemetry.select(*SERIES_KEY, "ts_unix_ns", "value")
    per_sample = features.all_features(known, windows_ms, rate_hz, limits)
    grid = features.pivot_features(per_sample, bucket_ns, channels, columns)
    # The rows of the grid, counted without the features.
    steps = features.grid_steps(known, bucket_ns, channels)
    filled = carry_forward(
        grid, ["shot_id"], ["ts_unix_ns"], {c: F.col(c) for c in channels}, measured(steps, ["shot_id"], limits)
    )
    wide = features.flatten_features(filled, channels, columns)
    timed = labels.time_to_disruption(wide, shots)
    names = [c for c in wide.columns if c not in ("shot_id", "ts_unix_ns")]
    return labels.label_horizons(labels.fill_features(timed, names), horizons_ms), names


# Every iteration of a solver schedules one task per partition; below this many rows a task costs
# more to start than to run.
ROWS_PER_TASK = 20_000


@contextmanager
def _assembled(df: DataFrame, names: Sequence[str], label: str) -> Iterator[tuple[DataFrame, int]]:
    """Feature vectors and labels, cached for the passes of a solver, and their number."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="_x").transform(df)
    wanted = vectors.select("_x", F.col(label).cast("double").alias("_y")).persist()
    try:
        rows = wanted.count()
        yield wanted.coalesce(max(1, rows // ROWS_PER_TASK)), rows
    finally:
        wanted.unpersist()


def fit_logistic(
    df: DataFrame,
    names: Sequence[str],
    label: str,
    version: str = "",
    max_iter: int = 1000,
    tol: float = 1e-4,
) -> LinearModel:
    """Ridge logistic regression with unit inverse strength over unscaled features.

    The intercept is not penalised, which is the one difference to a solver that treats it as a
    feature.
    """
    with _assembled(df, names, label) as (data, rows):
        fitted = LogisticRegression(
            featuresCol="_x",
            labelCol="_y",
            regParam=1.0 / max(1, rows),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        ).fit(data)
    weights = [float(w) for w in fitted.coefficients]
    return LinearModel(dict(zip(names, weights)), float(fitted.intercept), version)


def _gram(weights: np.ndarray):
    """Loss, gradient and curvature sums of the rows of a task, one row per entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(weights)
        loss, gradient, curvature = 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k - 1)
            x = np.column_stack((x, np.ones(batch.num_rows)))
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            margin = x @ weights
            p = 0.5 * (1 + np.tanh(0.5 * margin))
            loss += (np.logaddexp(0, margin) - y * margin).sum()
            gradient += (p - y) @ x
            curvature += (x * (p * (1 - p))[:, None]).T @ x
        values = np.concatenate(([loss], gradient, curvature.ravel()))
        yield pa.record_batch([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    return sums


def fit_newton(
    df: DataFrame, names: Sequence[str], label: str, version: str = "", strength: float = 1.0,
    max_steps: int = 100, tol: float = 1e-8,
) -> LinearModel:
    """Ridge logistic regression whose intercept is penalised like a coefficient, by Newton steps.

    Every step is one pass: the tasks add up gradient and curvature (the square of the number of features,
    however many rows) and Spark adds those of all tasks. Steps that do not lower the loss are halved. Ends
    when no entry of the gradient exceeds ``tol`` or rounding allows no lower loss. Rows need non-null
    features and label.
    """
    k = len(names) + 1
    row = F.array(*[F.col(f"`{n}`").cast("double") for n in names]) if names else F.array().cast("array<double>")
    data = df.select(row.alias("_x"), F.col(label).cast("double").alias("_y")).persist()
    try:
        def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            entries = data.mapInArrow(_gram(w), "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
            values = np.zeros(1 + k + k * k)
            for position, value in entries.collect():
                values[position] = value
            return strength * values[0] + w @ w / 2, strength * values[1 : k + 1] + w, strength * values[k + 1 :].reshape(k, k) + np.eye(k)

        weights = np.zeros(k)
        loss, gradient, curvature = at(weights)
        for _ in range(max_steps):
            if np.abs(gradient).max() < tol:
                break
            step = np.linalg.solve(curvature, gradient)
            while True:
                new = at(weights - step)
                if new[0] <= loss + 1e-13 * abs(loss) or np.abs(step).max() < 1e-15:
                    break
                step = step / 2
            weights, (loss, gradient, curvature) = weights - step, new
    finally:
        data.unpersist()
    return LinearModel(dict(zip(names, map(float, weights[:-1]))), float(weights[-1]), version)


def fit_gbt(
    df: DataFrame, names: Sequence[str], label: str, iterations: int = 100, seed: int = 42
):
    """Gradient-boosted trees. Returns the fitted model; its importances are not coefficients."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        # Boosting cuts its growing lineage here.
        spark.sparkContext.setCheckpointDir(work_dir(spark, "boosting"))
    boosting = GBTClassifier(
        featuresCol="_x", labelCol="_y", maxIter=iterations, seed=seed, checkpointInterval=10
    )
    with _assembled(df, names, label) as (data, _):
        return boosting.fit(data)


def gbt_scores(model, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``score``, the probability of the positive class."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="_x").transform(df)
    return (
        model.transform(vectors)
        .withColumn("score", vector_to_array("probability")[1])
        .drop("_x", "rawPrediction", "probability", "prediction")
    )


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    return [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]


def fit_platt(scores: DataFrame, label: str, version: str = "fitted") -> Calibration:
    # Two parameters: converging to the last digits costs little.
    model = fit_logistic(scores, ["score"], label, tol=1e-12)
    return Calibration("platt", model.coefficients["score"], model.intercept, version)


def fit_isotonic(scores: DataFrame, label: str, version: str = "fitted") -> Calibration:
    """Rows of equal score are averaged first, which leaves the fit as it is."""
    per_score = scores.groupBy("score").agg(
        F.avg(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w")
    )
    fitted = IsotonicRegression(featuresCol="score", labelCol="_y", weightCol="_w").fit(per_score)
    knots = tuple(
        (float(x), float(y)) for x, y in zip(fitted.boundaries.toArray(), fitted.predictions.toArray())
    )
    return Calibration("isotonic", 1.0, 0.0, version, knots)


def fit_calibration(kind: str, scores: DataFrame, label: str, is_margin: bool) -> Calibration:
    """``none`` still maps margins through a sigmoid, so that metrics see probabilities; scores that
    are probabilities already pass through unchanged."""
    if kind == "platt":
        return fit_platt(scores, label)
    if kind == "isotonic":
        return fit_isotonic(scores, label)
    if is_margin:
        return Calibration("none", 1.0, 0.0, "none")
    return Calibration("isotonic", 1.0, 0.0, "none", ((0.0, 0.0), (1.0, 1.0)))


@dataclass(frozen=True)
class TrainConfig:
    model: str = "logistic"
    calibration: str = "platt"
    horizons_ms: Sequence[int] = HORIZONS_MS
    test_split: float = 0.2
    calibration_split: float = 0.2
    seed: int = 42
    env: str = "dev"
    output: str | None = None
    iterations: int = 100

    def __post_init__(self) -> None:
        if self.model not in MODELS:
            raise ValueError(f"model must be one of {', '.join(MODELS)}")
        if self.calibration not in CALIBRATIONS:
            raise ValueError(f"calibration must be one of {', '.join(CALIBRATIONS)}")


def _demand_all_splits(data: DataFrame, config: TrainConfig) -> None:
    """Shots are split by their hash, so few shots can leave a part empty; better to say so than to fail
    in a fit."""
    present = {row[0] for row in data.select("split").distinct().collect()}
    wanted = {"train", "test"} | ({"calibration"} if config.calibration != "none" else set())
    missing = wanted - present
    if missing:
        raise ValueError(f"no shot falls into {', '.join(sorted(missing))}: give more shots or another seed")


def train(table: DataFrame, names: Sequence[str], config: TrainConfig = TrainConfig()) -> DataFrame:
    """Fit, calibrate and evaluate one model per horizon; returns one row of metrics per horizon.

    Shots are split three ways, so the calibration sees neither training nor test shots. Artifacts
    and a report per horizon are written below ``config.output``.
    """
    spark = table.sparkSession
    split = shot_split(table, config.test_split, config.calibration_split, config.seed)
    needed = ["shot_id", "ts_unix_ns", "time_to_disruption", "split", *names]
    needed += [f"label_h{h}" for h in config.horizons_ms]
    data = split.select(*needed).persist()
    _demand_all_splits(data, config)
    evaluated = []
    for horizon in config.horizons_ms:
        label = f"label_h{horizon}"
        training = data.filter("split = 'train'")
        version = f"{config.env}_{config.model}_h{horizon}"
        if config.model == "logistic":
            fitted = fit_logistic(training, names, label, version)
            model = fitted
            scored = data.withColumn("score", linear_score(fitted, wide_lookup(data.columns)))
        else:
            trees = fit_gbt(training, names, label, config.iterations, config.seed)
            model = LinearModel({}, 0.0, version)
            scored = gbt_scores(trees, data, names)
        scored = scored.select(
            "shot_id", "ts_unix_ns", "time_to_disruption", "split", "score", F.col(label).alias("label")
        )
        calibration = fit_calibration(
            config.calibration,
            scored.filter("split = 'calibration'"),
            "label",
            is_margin=config.model == "logistic",
        )
        tested = (
            scored.filter("split = 'test'")
            .withColumn("p", calibrated(F.col("score"), calibration))
            .withColumn("horizon_ms", F.lit(horizon))
            .withColumn("model", F.lit(config.model))
        )
        evaluated.append(tested)
        if config.output:
            path = sinks.artifact_path(config.output, config.env, horizon, version)
            sinks.save_model(spark, model, replace(calibration, version=version), path)
            if config.model == "gbt":
                trees.write().overwrite().save(f"{path}/trees")
                spark.createDataFrame(
                    importances(trees, names), "feature string, importance double"
                ).coalesce(1).write.mode("overwrite").json(f"{path}/importances")
            info = data.agg(
                F.count(F.lit(1)).alias("samples"),
                F.count_if(F.col("split") == "train").alias("train_samples"),
                F.count_if(F.col("split") == "test").alias("test_samples"),
                F.lit(len(names)).alias("features"),
                F.lit(config.model).alias("model"),
                F.lit(config.calibration).alias("calibration"),
                F.lit(horizon).alias("horizon_ms"),
            )
            metrics = evaluate.evaluate(tested)
            sinks.write_report(evaluate.training_report(metrics, info), f"{path}/report")
    union = reduce(lambda a, b: a.unionByName(b), evaluated)
    metrics = evaluate.evaluate(union, by=["horizon_ms", "model"])
    # One row per horizon; computed here so that the cached feature table can be released.
    result = spark.createDataFrame(metrics.collect(), metrics.schema)
    data.unpersist()
    return result
