"""Hard negatives by the threshold algorithm.

Candidates lie in blocks. In a block every dimension has a list of its rows sorted by that component. An
anchor reads the lists together, from the top where its own component is positive and from the bottom
where it is negative; every row met for the first time is scored in whole (random access). After so many
steps no row not met yet can score more than the sum of the anchor's components times the values last
read. An anchor stops once this threshold lies strictly below the kth score of each of its windows, so
that rows of equal score are not missed; a window with fewer than k rows goes on down to its lower edge.

All pairs of anchor blocks and candidate blocks meet, each in one task of bounded size; each returns at
most k rows a window, and the best of all blocks are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotstream.llm.common import stored

ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
# Rows of a block: few enough for a task, enough for as many pairs of blocks as there are cores.
LEAST_ROWS, MOST_ROWS = 2048, 65536
FIRST_STEP = 16


class SortedLists:
    """Rows of integer components (as doubles) and, per dimension, their order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, 0).T)
        self.order = np.ascontiguousarray(order.T)

    def meet(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(rows met for the first time, their scores, most that a row not met yet can score)."""
        n = len(self.vectors)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        depth, step = 0, FIRST_STEP
        while depth < n:
            # Without a component other than 0 there are no lists to read, and all scores are 0.
            until = min(n, depth + step) if len(up) + len(down) else n
            met = np.zeros(n, bool)
            met[self.order[up, n - until : n - depth]] = True
            met[self.order[down, depth:until]] = True
            if until == n:
                met[:] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            threshold = anchor[up] @ self.values[up, n - until] + anchor[down] @ self.values[down, until - 1]
            yield rows, self.vectors[rows] @ anchor, threshold
            depth, step = until, 2 * step


class TopRows:
    """The k best rows of a window: highest score, then smallest id."""

    def __init__(self, k: int, lowest: float = -np.inf, highest: float = np.inf):
        self.k, self.lowest, self.highest = k, lowest, highest
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = self.scores[-1] if len(self.scores) == self.k else -np.inf
        fits = (100 * scores >= self.lowest) & (100 * scores <= self.highest) & (scores >= worst)
        if fits.any():
            scores, ids = np.concatenate((self.scores, scores[fits])), np.concatenate((self.ids, ids[fits]))
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]

    def done(self, threshold: float) -> bool:
        if len(self.scores) == self.k and threshold < self.scores[-1]:
            return True
        return 100 * threshold < self.lowest or self.lowest > self.highest


def _vectors(rows: pa.Table, width: int) -> np.ndarray:
    """Vectors as a matrix; what a vector is shorter counts as zeros."""
    lists = rows.column("vector").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _positives(width: int, k: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if anchors.num_rows and rows.num_rows:
            vectors, ids, labels = _vectors(rows, width), _numbers(rows, "vec_id"), _numbers(rows, "label")
            own = _numbers(anchors, "label")
            lists = {}
            for label in np.unique(own):
                at = np.flatnonzero(labels == label)
                lists[label] = (SortedLists(vectors[at]), ids[at])
            for anchor, vector, label in zip(_numbers(anchors, "vec_id"), _vectors(anchors, width), own):
                found, same = lists[label]
                top = TopRows(k)
                for met, scores, threshold in found.meet(vector):
                    other = same[met] != anchor
                    top.add(scores[other], same[met][other])
                    if top.done(threshold):
                        break
                out += [(anchor, i, s) for i, s in zip(top.ids, top.scores)]
        values = np.array(out, np.float64).reshape(-1, 3)[:, 2].astype(np.int64)
        return pa.table(
            {"anchor_id": pa.array([o[0] for o in out], pa.int64()), "row_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array(values, pa.int64())}
        )

    return find


def _negatives(width: int, k: int, low: int, high: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if anchors.num_rows and rows.num_rows:
            vectors, ids, labels = _vectors(rows, width), _numbers(rows, "vec_id"), _numbers(rows, "label")
            lists = SortedLists(vectors)
            positives = anchors.column("positives").to_pylist()
            for anchor, vector, label, own in zip(_numbers(anchors, "vec_id"), _vectors(anchors, width), _numbers(anchors, "label"), positives):
                windows = [TopRows(k, low * p["score"], high * p["score"]) for p in own]
                for met, scores, threshold in lists.meet(vector):
                    other = labels[met] != label
                    scores, met = scores[other], met[other]
                    for window in windows:
                        window.add(scores, ids[met])
                    if all(window.done(threshold) for window in windows):
                        break
                for p, window in zip(own, windows):
                    out += [(int(anchor), p["row_id"], p["score"], int(i), int(s)) for i, s in zip(window.ids, window.scores)]
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({name: pa.array([o[i] for o in out], pa.int64()) for i, name in enumerate(names)})

    return find


def taking_part(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector of the rows that take part, components scaled and floored.

    Rows without id, label or vector, and those with a null or non-finite component, take no part. Of
    rows sharing an id the one with the smallest label, then the smallest vector, does. No components
    are an empty vector.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    vector = F.transform(x, lambda v: F.floor(v * scale).cast("double"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(F.col("label").cast("bigint").alias("label"), vector.alias("vector")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def _numbered(blocks: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))


def mine(
    rows: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW_PERCENT, high: int = HIGH_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and vector as ``taking_part`` gives them. Anchors are the rows whose id is
    divisible by ``anchor_every``; their positives are the best others of their label, the negatives the
    best of other labels that score from ``low`` to ``high`` percent of the positive. Equal scores come by
    id. Scores are exact up to 2^53. Anchors without a positive, and windows without a row, give no rows.
    """
    spark = rows.sparkSession
    rows = stored(rows.select("vec_id", "label", "vector"), "vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    n, n_anchors, width = rows.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    anchor_blocks = max(1, -(-n_anchors // MOST_ROWS))
    pairs = 3 * spark.sparkContext.defaultParallelism
    block = min(MOST_ROWS, max(LEAST_ROWS, n * anchor_blocks // pairs))
    blocks = max(1, -(-n // block))
    anchor_block = F.pmod(F.xxhash64("vec_id"), F.lit(anchor_blocks)).alias("a")
    row_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("c")
    candidates = rows.select("vec_id", "label", "vector", row_block, F.explode(_numbered(anchor_blocks)).alias("a"))

    def meet(anchors: DataFrame, function, schema: str) -> DataFrame:
        spread = anchors.select("*", anchor_block, F.explode(_numbered(blocks)).alias("c"))
        return spread.groupBy("a", "c").cogroup(candidates.groupBy("a", "c")).applyInArrow(function, schema)

    def best(df: DataFrame, keys: list[str], row: str, score: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), row)
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(is_anchor)
    found = meet(anchors, _positives(width, positives), "anchor_id bigint, row_id bigint, score bigint")
    found = best(found, ["anchor_id"], "row_id", "score", positives)
    found = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("row_id", "score")).alias("positives"))
    anchors = stored(anchors.join(found, "vec_id"), "anchors")
    mined = meet(
        anchors, _negatives(width, negatives, low, high),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    mined = best(mined, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``rows`` whose label moves on by one where the id is divisible by ``every``."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
