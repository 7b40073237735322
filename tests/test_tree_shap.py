from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotstream.operators import training
from shotstream.operators import tree_shap as S

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.random((500, 3)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=500) * 0.1 > 0.8).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y int")


@pytest.fixture(scope="module")
def model(data):
    return training.fit_gbt(data, NAMES, "y", iterations=4)


def nodes_of(spark, model, path):
    model.write().save(path)
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    trees = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    return [(weights[t], trees[t]) for t in trees]


def value_of_set(nodes, x, known, at=0):
    """Descend the tree; at splits on other features go both ways by training rows."""
    node = nodes[at]
    if node.leftChild < 0:
        return node.prediction
    left, right = node.leftChild, node.rightChild
    f = node.split.featureIndex
    if f in known:
        return value_of_set(nodes, x, known, left if x[f] <= node.split.leftCategoriesOrThreshold[0] else right)
    share = nodes[left].rawCount / node.rawCount
    return share * value_of_set(nodes, x, known, left) + (1 - share) * value_of_set(nodes, x, known, right)


def slow_shapley(trees, x):
    k, out = len(x), [0.0] * len(x)
    for j in range(k):
        others = [i for i in range(k) if i != j]
        for s in range(k):
            weight = factorial(s) * factorial(k - s - 1) / factorial(k)
            for chosen in combinations(others, s):
                for w, nodes in trees:
                    gain = value_of_set(nodes, x, {*chosen, j}) - value_of_set(nodes, x, set(chosen))
                    out[j] += 2 * w * weight * gain
    return out


def test_equal_to_all_subsets(spark, data, model, tmp_path):
    trees = nodes_of(spark, model, str(tmp_path / "m"))
    rows = S.tree_shap(data.limit(25), S.load_leaves(spark, str(tmp_path / "m")), NAMES).collect()
    for row in rows:
        np.testing.assert_allclose(row.effects, slow_shapley(trees, (row.a, row.b, row.c)), atol=1e-12)
    base = sum(2 * w * value_of_set(nodes, (0, 0, 0), set()) for w, nodes in trees)
    assert rows[0].base == pytest.approx(base)


def test_adds_up_to_the_log_odds(spark, data, model):
    explained = S.tree_shap(training.gbt_scores(model, data, NAMES), S.leaves_of(spark, model), NAMES)
    total = F.col("base") + F.expr("aggregate(effects, 0D, (s, x) -> s + x)")
    worst = explained.agg(F.max(F.abs(total - F.log(F.col("score") / (1 - F.col("score")))))).first()[0]
    assert worst < 1e-9 and explained.count() == 500


def test_many_features_on_a_path(monkeypatch):
    rng = np.random.default_rng(5)
    leaves = [
        S.Leaf(1.5, (0, 1, 2, 3), (0.2, -np.inf, 0.1, 0.3), (np.inf, 0.6, 0.9, np.inf), (0.5, 0.25, 0.8, 0.1)),
        S.Leaf(-0.5, (), (), (), ()),
    ]
    x = rng.random((40, 4))
    x[0, 0], x[1, 1] = np.nan, np.nan  # right at every split: agrees with the first, not with the second
    first = S.shapley(x, leaves, S.tables(leaves))
    monkeypatch.setattr(S, "TABLE_FEATURES", 2)
    np.testing.assert_allclose(S.shapley(x, leaves, S.tables(leaves)), first)
    agrees = ~(x <= [0.2, -np.inf, 0.1, 0.3]) & ((x <= [9, 0.6, 0.9, 9]) | np.isnan(x) & [True, False, False, True])
    np.testing.assert_allclose(S.expected(leaves) + first.sum(1), 1.5 * agrees.all(1) - 0.5, atol=1e-12)


def test_table(spark, data, model):
    leaves = S.leaves_of(spark, model)
    nulls = spark.createDataFrame([(None, 0.5, 0.5), (float("nan"), 0.5, 0.5)], "a double, b double, c double")
    one, other = S.tree_shap(nulls, leaves, NAMES).collect()
    assert one.effects == other.effects
    assert S.tree_shap(nulls.limit(0), leaves, NAMES).count() == 0
    summary = {r.feature: r for r in S.mean_effects(data, leaves, NAMES).collect()}
    assert list(summary) == NAMES and summary["a"].mean_abs_effect > summary["c"].mean_abs_effect
    assert S.mean_effects(data.limit(0), leaves, NAMES).first().mean_abs_effect is None
    with pytest.raises(ValueError):
        S.tree_shap(data.withColumn("base", F.lit(1)), leaves, NAMES)
    with pytest.raises(ValueError):
        S.tree_shap(data, leaves, [])
