"""Shapley values of boosted trees, by paths and the training rows that took them.

The value of a set of features in a tree is the mean over its leaves when splits on features outside the set
send a row both ways, weighted by the training rows of each side. A leaf adds a product over the features of
its path: 1 or 0 for a feature in the set (the row agrees with all its splits or not), the product of shares
for one outside. The Shapley values of such a product depend only on which features agree, so each leaf gets
a table by agreement, and a row looks its own pattern up. Rows are independent: one pass in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotstream.session import work_dir

TABLE_FEATURES = 8  # leaves of so many features get a table of all patterns; others of those that occur
LOG_ODDS = 2.0  # the log-odds of a boosted classifier are twice its sum of trees


@dataclass(frozen=True)
class Leaf:
    """``low < x <= high`` for every feature of the path, and the share of rows its splits let through."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    shares: tuple[float, ...]


def _leaves(nodes: dict[int, T.Row], weight: float) -> Iterator[Leaf]:
    open_nodes: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while open_nodes:
        number, path = open_nodes.pop()
        node = nodes[number]
        if node.leftChild < 0:
            bounds = [path[f] for f in sorted(path)]
            low, high, shares = zip(*bounds) if bounds else ((), (), ())
            yield Leaf(weight * node.prediction, tuple(sorted(path)), low, high, shares)
            continue
        if node.split.numCategories != -1:
            raise ValueError("splits by category are not supported")
        feature, limit = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.leftChild, (low, min(high, limit))), (node.rightChild, (max(low, limit), high))):
            part = nodes[child].rawCount / node.rawCount
            open_nodes.append((child, {**path, feature: (*bounds, share * part)}))


def load_leaves(spark: SparkSession, path: str) -> list[Leaf]:
    """Leaves of a boosted classifier saved at ``path``; the model alone bounds their number."""
    weights = {row[0]: row[2] for row in spark.read.parquet(f"{path}/treesMetadata").collect()}
    trees: dict[int, dict[int, T.Row]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    return [leaf for tree in sorted(trees) for leaf in _leaves(trees[tree], LOG_ODDS * weights[tree])]


def leaves_of(spark: SparkSession, model) -> list[Leaf]:
    path = work_dir(spark, "trees")
    model.write().save(path)
    return load_leaves(spark, path)


def _product_values(agrees: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Shapley values of ``prod(agrees[j] if j in S else shares[j])``, a row per pattern."""
    rows, m = agrees.shape
    out = np.empty((rows, m))
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    for j in range(m):
        # Coefficient s: the sum of the products over all sets of s of the other features.
        sums = np.zeros((rows, m))
        sums[:, 0] = 1.0
        for i in range(m):
            if i != j:
                grown = sums * shares[i]
                grown[:, 1:] += sums[:, :-1] * agrees[:, i : i + 1]
                sums = grown
        out[:, j] = (agrees[:, j] - shares[j]) * (sums @ weights)
    return out


def _bits(codes: np.ndarray, m: int) -> np.ndarray:
    return ((codes[:, None] >> np.arange(m)) & 1).astype(np.float64)


def expected(leaves: Sequence[Leaf]) -> float:
    """The value of the empty set: the mean log-odds over the training rows."""
    return float(sum(leaf.value * np.prod(leaf.shares) for leaf in leaves))


def tables(leaves: Sequence[Leaf]) -> list[np.ndarray | None]:
    return [
        leaf.value * _product_values(_bits(np.arange(1 << len(leaf.features)), len(leaf.features)), leaf.shares)
        if len(leaf.features) <= TABLE_FEATURES
        else None
        for leaf in leaves
    ]


def shapley(x: np.ndarray, leaves: Sequence[Leaf], ready: Sequence[np.ndarray | None]) -> np.ndarray:
    """A value per row and feature. As in the trees, what is not at most a limit goes right, NaN too."""
    out = np.zeros(x.shape)
    at_most: dict[tuple[int, float], np.ndarray] = {}  # trees ask the same question many times
    for feature, limit in {(f, b) for leaf in leaves for f, *ends in zip(leaf.features, leaf.low, leaf.high) for b in ends}:
        if np.isfinite(limit):
            at_most[feature, limit] = x[:, feature] <= limit
    for leaf, table in zip(leaves, ready):
        m = len(leaf.features)
        codes = np.zeros(len(x), np.int64)
        for bit, (feature, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
            agrees = np.ones(len(x), bool)
            if low > -np.inf:
                agrees &= ~at_most[feature, low]
            if high < np.inf:
                agrees &= at_most[feature, high]
            codes |= agrees.astype(np.int64) << bit
        if table is None:
            patterns, codes = np.unique(codes, return_inverse=True)
            table = leaf.value * _product_values(_bits(patterns, m), leaf.shares)
        if m:
            out[:, leaf.features] += table[codes]
    return out


def _explainer(handle, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = handle.value
        ready, base = tables(leaves), expected(leaves)
        for batch in batches:
            x = np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names])
            effects = shapley(x, leaves, ready)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names))
            columns = [*batch.columns, pa.array(np.full(len(x), base)), pa.ListArray.from_arrays(ends, effects.ravel())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "base", "effects"])

    return run


def tree_shap(df: DataFrame, leaves: Sequence[Leaf], names: Sequence[str]) -> DataFrame:
    """Add ``base`` and ``effects``, one value per entry of ``names`` in their order; base and effects of a
    row add up to the log-odds of the model. ``names`` are the columns the model was fitted on, in that order;
    a null counts as NaN, which goes right at every split. Columns named base or effects raise an error."""
    taken = {"base", "effects"} & set(df.columns)
    if taken or not names:
        raise ValueError(f"columns named {sorted(taken)}" if taken else "no features")
    handle = df.sparkSession.sparkContext.broadcast(list(leaves))
    schema = T.StructType([*df.schema.fields, T.StructField("base", T.DoubleType()), T.StructField("effects", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(_explainer(handle, names), schema)


def mean_effects(df: DataFrame, leaves: Sequence[Leaf], names: Sequence[str]) -> DataFrame:
    """Per feature: its mean absolute effect and its mean effect over all rows (null for no rows)."""
    effects = tree_shap(df.select(*names), leaves, names)
    rows = [
        F.struct(
            F.lit(n).alias("feature"),
            F.avg(F.abs(F.col("effects")[i])).alias("mean_abs_effect"),
            F.avg(F.col("effects")[i]).alias("mean_effect"),
        )
        for i, n in enumerate(names)
    ]
    return effects.agg(F.array(*rows).alias("_all")).select(F.inline("_all"))
