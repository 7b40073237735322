import random

import pytest
from pyspark.sql import functions as F

from shotstream.operators import evaluate as ev
from shotstream.operators import labels, monitoring, splits

INF = float("inf")


def scored(spark, rows):
    return spark.createDataFrame([(float(p), int(y)) for p, y in rows], "p double, label int")


def vertices(rows):
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    out = [(0.0, 0.0, INF)]
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp = sum(y for p, y in rows if p >= t)
        fp = sum(1 - y for p, y in rows if p >= t)
        out.append((fp / neg, tp / pos, t))
    return out


def slow_metrics(rows):
    pairs = [(a, b) for a, y in rows if y for b, z in rows if not z]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    curve, ap, last = vertices(rows), 0.0, 0.0
    for fpr, tpr, t in curve[1:]:
        flagged = [y for p, y in rows if p >= t]
        ap += (tpr - last) * sum(flagged) / len(flagged)
        last = tpr
    nearest = min(curve, key=lambda v: abs(v[0] - 0.1))
    return auc, ap, nearest[1]


@pytest.mark.parametrize("seed", range(4))
def test_ranking_metrics_against_pairs(spark, seed):
    rng = random.Random(seed)
    shapes = [
        lambda: rng.random(),
        lambda: round(rng.random(), 1),
        lambda: 1 - 10 ** rng.uniform(-12, -6),
        lambda: rng.gauss(0, 50),
    ]
    rows = [(shapes[seed](), int(rng.random() < 0.4)) for _ in range(80)]
    got = ev.ranking_metrics(ev.threshold_table(scored(spark, rows)), target_fpr=0.1).first()
    assert tuple(got) == pytest.approx(slow_metrics(rows))


def test_all_scores_equal(spark):
    got = ev.ranking_metrics(ev.threshold_table(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1)]))).first()
    assert tuple(got) == pytest.approx((0.5, 0.5, 0.0))


def test_single_class_has_no_auc(spark):
    assert ev.roc_auc(scored(spark, [(0.2, 1), (0.4, 1)])).first().roc_auc is None
    assert ev.roc_auc(scored(spark, [(0.2, 0), (0.4, 0)])).first().roc_auc is None


def test_score_grid_is_monotone_and_bounded(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(500)] + [1 - 10 ** -rng.uniform(1, 15) for _ in range(500)]
    values += [10 ** -rng.uniform(1, 300) for _ in range(200)] + [rng.gauss(0, 1e6) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "s double").select("s", ev._score_cell(F.col("s")).alias("c"))
    rows = sorted(tuple(r) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert all(0 <= c <= 80 * 4096 for s, c in rows if 0 <= s <= 1)


def test_groups_stay_apart(spark):
    rng = random.Random(9)
    rows = [(m, rng.random(), int(rng.random() < 0.5)) for m in "ab" for _ in range(40)]
    df = spark.createDataFrame(rows, "m string, p double, label int")
    got = {r.m: r.roc_auc for r in ev.roc_auc(df, by=["m"]).collect()}
    for m in "ab":
        assert got[m] == pytest.approx(slow_metrics([(p, y) for k, p, y in rows if k == m])[0])


def test_bins_are_open_on_the_left(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.1000001,), (1.0,), (1.5,)], "p double")
    got = [r.b for r in df.select(ev.bin_of(F.col("p")).alias("b")).collect()]
    assert got == [None, 1, 1, 2, 10, None]


def test_calibration_error_and_brier(spark):
    df = scored(spark, [(0.0, 1), (0.9, 1), (0.9, 0), (0.35, 0)])
    assert ev.expected_calibration_error(df).first()[0] == pytest.approx((2 * 0.4 + 0.35) / 4)
    assert ev.brier_score(df).first()[0] == pytest.approx((1 + 0.01 + 0.81 + 0.35**2) / 4)
    assert ev.reliability_bins(df).count() == 2


def test_lead_time_runs_from_first_crossing(spark):
    rows = [
        ("a", 1, 0.2, 300.0), ("a", 2, 0.6, 200.0), ("a", 3, 0.7, 100.0), ("a", 4, 0.9, -50.0),
        ("b", 1, 0.1, 80.0), ("c", 1, 0.9, INF), ("d", 1, 0.5, 60.0),
    ]
    df = spark.createDataFrame(rows, "shot_id string, ts bigint, p double, time_to_disruption double")
    assert ev.lead_time(df).first()[0] == pytest.approx(130.0)
    assert ev.lead_time(df, threshold=0.99).first()[0] == 0.0


def literal_lead_time(rows, threshold=0.5):
    leads = []
    for i, (p, y, ttd) in enumerate(rows):
        if y == 1 and ttd < INF:
            for j in range(i, -1, -1):
                if rows[j][0] >= threshold:
                    if ttd - rows[j][2] > 0:
                        leads.append(ttd - rows[j][2])
                    break
    return sum(leads) / len(leads) if leads else 0.0


def test_literal_lead_time(spark, limits):
    rng = random.Random(4)
    rows = [(rng.random(), rng.randint(0, 1), rng.choice([INF, rng.uniform(0, 100)])) for _ in range(60)]
    df = spark.createDataFrame(
        [("all", i, *row) for i, row in enumerate(rows)],
        "shot_id string, i bigint, p double, label int, time_to_disruption double",
    )
    got = ev.lead_time_as_coded(df, ["i"], limits=limits).first()[0]
    assert got == pytest.approx(literal_lead_time(rows))


def test_report_formats_four_decimals(spark):
    metrics = spark.createDataFrame([(0.123456, 1.0)], "roc_auc double, brier_score double")
    info = spark.createDataFrame([(10, "logistic")], "samples bigint, model string")
    got = {(r.section, r.name): r.text for r in ev.training_report(metrics, info).collect()}
    assert got == {
        ("metrics", "roc_auc"): "0.1235",
        ("metrics", "brier_score"): "1.0000",
        ("dataset", "samples"): "10",
        ("dataset", "model"): "logistic",
    }


def test_labels(spark):
    df = spark.createDataFrame(
        [(10.0,), (60.0,), (210.0,), (INF,), (float("nan"),), (None,), (-5.0,)], "time_to_disruption double"
    )
    rows = labels.label_horizons(df, [50, 200]).collect()
    assert [(r.label_h50, r.label_h200) for r in rows] == [
        (1, 1), (0, 1), (0, 0), (0, 0), (0, 0), (0, 0), (1, 1)
    ]
    assert labels.label_horizons(df, [50], drop_post=True).count() == 6


def test_time_to_disruption_of_known_and_unknown_shots(spark):
    facts = spark.createDataFrame([("a", 1_000_000), ("b", 1), ("x", 1)], "shot_id string, ts_unix_ns bigint")
    shots = spark.createDataFrame([("a", 3_000_000), ("b", None)], "shot_id string, disruption_time_unix_ns bigint")
    got = {r.shot_id: r.time_to_disruption for r in labels.time_to_disruption(facts, shots).collect()}
    assert got == {"a": 2.0, "b": INF, "x": None}


def test_fill_features(spark):
    df = spark.createDataFrame([(None, float("nan")), (1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in labels.fill_features(df, ["a", "b"]).collect()] == [(0.0, 0.0), (1.0, 2.0)]


def test_shots_are_not_split(spark):
    df = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 200).alias("shot_id"), F.lit(0).alias("label"))
    rows = splits.shot_split(df, 0.2, 0.2)
    assert rows.groupBy("shot_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    sizes = {r.split: r.shots for r in splits.split_counts(rows, "label").collect()}
    assert sum(sizes.values()) == 200 and 20 <= sizes["test"] <= 60


def test_stratified_split_is_exact(spark, limits):
    df = spark.range(500).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    rows = splits.stratified_split(df, "y", ["id"], 0.3, limits)
    got = {(r.y, r.split): r["count"] for r in rows.groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 135, (0, "train"): 315, (1, "test"): 15, (1, "train"): 35}


def test_rates_over_sliding_windows(spark):
    minute = 60_000_000_000
    df = spark.createDataFrame([("p", 0), ("p", 1), ("p", 6 * minute)], "k string, ts_unix_ns bigint")
    got = {r.window_end_unix_ns // minute: r.events for r in monitoring.rates(df, ["k"]).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1}
    with pytest.raises(ValueError):
        monitoring.rates(df, ["k"], 100, 60)


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(v,) for v in [0.5] * 50 + [1.5] * 40 + [2.5] * 10], "seconds double")
    buckets = monitoring.latency_buckets(df, edges=(1.0, 2.0, 3.0))
    assert [r.cumulative for r in buckets.orderBy("le").collect()] == [50, 90, 100, 100]
    assert monitoring.histogram_quantile(buckets, 0.95).first().quantile == pytest.approx(2.5)
    assert monitoring.histogram_quantile(buckets, 0.25).first().quantile == pytest.approx(0.5)
    late = monitoring.latency_buckets(df, edges=(1.0,))
    assert monitoring.histogram_quantile(late, 0.95).first().quantile == pytest.approx(1.0)


def test_drift_against_numpy(spark):
    import numpy as np

    from shotstream.operators import stability

    draw = np.random.default_rng(2)
    rows = [(m, int(t), float(p)) for m in ("a", "b") for t in range(3) for p in draw.beta(1 + t, 2, 200)]
    rows += [("a", 1, 1.0), ("a", 1, 0.0), ("a", 2, None), ("a", 2, 1.5), ("c", 0, None)]
    df = spark.createDataFrame(rows, "model_version string, t int, p double")
    from pyspark.sql import functions as F

    table = stability.drift(stability.score_histograms(df, ["model_version"], F.col("t")), ["model_version"])
    got = {(r.model_version, r.slice): r for r in table.collect()}
    assert len(got) == 6
    for model in ("a", "b"):
        counts = np.array([
            np.histogram([p for m, t, p in rows if m == model and t == s and p is not None and p <= 1], np.linspace(0, 1, 11))[0]
            for s in range(3)
        ])
        whole = counts.sum(0)
        for s in range(3):
            a, e = (counts[s] + 0.5) / (counts[s].sum() + 5), (whole + 0.5) / (whole.sum() + 5)
            ks = np.abs(np.cumsum(counts[s] / counts[s].sum() - whole / whole.sum())).max()
            row = got[model, s]
            assert row.rows == counts[s].sum()
            assert row.psi == pytest.approx(((a - e) * np.log(a / e)).sum()) and row.ks == pytest.approx(ks)
