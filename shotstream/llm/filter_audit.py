"""What each of five text filters removes, alone and after the others, in every order.

A document fails a set of filters, its mask; per part (language) the documents of each mask are counted
once. A recursive query then extends prefixes of filter orders by the letters they have not used: it
joins the mask cells of the part, carries the bits applied so far, and each level emits the measures of
the step it adds. An order's steps are those of its prefixes, and a filter's share (Shapley) sums its
removals over all orders.

Copies are found by the digest of the text: counts and the smallest ids are added up before rows of one
text meet, so that a text held by a third of all documents costs a few rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import batched_texts, map_batches, stored

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails. ``bytes.split`` cuts at the six ASCII spaces."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batched_texts(batches):
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pc.fill_null(batch.column("part"), ""),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array(np.fromiter(map(text_mask, texts), np.int32, len(texts))),
            ],
            names=["doc_id", "part", "digest", "mask"],
        )


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each part and mask: part, mask, n, good, toxic.

    A document with a null id has no labels and no smaller id, nor is it a smaller one. Rows of one id
    are documents each; if they have the same text they are not copies of each other. An id labelled
    more than once is good, or toxic, if one of its rows says so.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(
        docs.select("doc_id", F.col("lang").cast("string").alias("part"), "text"), _masks,
        f"doc_id {kind}, part string, digest binary, mask int",
    )
    # Repeated rows are one row with a count; null ids spread over the join by their digest.
    rows = rows.groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.withColumns(
        {
            "id": F.coalesce("doc_id", F.lit(0)),
            "spread": F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part").bitwiseOR(1)).otherwise(0),
        }
    )
    judged = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("is_good"),
            F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("is_toxic"),
        )
        .withColumn("spread", F.lit(0).cast("bigint"))
    )
    rows = rows.join(judged, ["id", "spread"], "left").select(
        "digest", "part", "mask", "doc_id", "n",
        (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )
    counts = ("n", "good", "toxic")
    with_id = F.col("doc_id").isNotNull()
    texts = rows.groupBy("digest", "part", "mask").agg(
        *[F.sum(F.when(with_id, F.col(c)).otherwise(0)).alias(c) for c in counts],
        *[F.sum(F.when(with_id, 0).otherwise(F.col(c))).alias(f"{c}_no_id") for c in counts],
        F.min(F.when(with_id, F.struct("doc_id", *counts))).alias("first"),
    )
    # One row per text and part is left, so this join is even however often a text occurs.
    owner = texts.groupBy("digest").agg(F.min("first.doc_id").alias("owner"))
    texts = texts.join(owner, "digest").withColumn("owns", F.coalesce(F.col("first.doc_id") == F.col("owner"), F.lit(False)))
    own = {c: F.when(F.col("owns"), F.col(f"first.{c}")).otherwise(F.lit(0)) for c in counts}
    cells = texts.select(
        "part",
        F.explode(
            F.array(
                F.struct("mask", *[(own[c] + F.col(f"{c}_no_id")).alias(c) for c in counts]),
                F.struct(F.col("mask").bitwiseOR(16).alias("mask"), *[(F.col(c) - own[c]).alias(c) for c in counts]),
            )
        ).alias("cell"),
    ).select("part", "cell.*")
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


_SUM = "aggregate(filter(c.cells, x -> {}), 0L, (total, x) -> total + x.{})"
_HERE = "x.mask & s.applied = 0 AND x.mask & l.bit <> 0"
STEPS = f"""
WITH RECURSIVE steps(part, prefix, applied, step, {', '.join(MEASURES)}) AS (
  SELECT part, '', 0, 0, {', '.join(['0L'] * len(MEASURES))} FROM {{cells}}
  UNION ALL
  SELECT s.part, concat(s.prefix, l.letter), s.applied | l.bit, s.step + 1,
    {_SUM.format('x.mask & (s.applied | l.bit) = 0', 'n')},
    {_SUM.format(_HERE, 'n')},
    {_SUM.format('x.mask & s.applied <> 0 AND x.mask & l.bit <> 0', 'n')},
    {_SUM.format('x.mask = l.bit', 'n')},
    {_SUM.format(_HERE, 'good')},
    {_SUM.format(_HERE, 'toxic')}
  FROM steps s
  JOIN {{cells}} c ON c.part = s.part
  LATERAL VIEW inline(array({', '.join(f"struct('{x}', {1 << i})" for i, x in enumerate(LETTERS))})) l AS letter, bit
  WHERE s.applied & l.bit = 0)
SELECT * FROM steps WHERE step > 0"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley:
    600 rows a part, zeros included.

    ``docs`` gives doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are left
    out. A null text is the empty text and a null lang the part ''. The empty table has no parts.
    The limit on rows of recursive queries is lifted in the session: there are 326 per part.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    cells = mask_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    cells = stored(cells, "mask_cells")  # at most 32 cells a part
    steps = stored(spark.sql(STEPS, cells=cells), "filter_steps")
    orders = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    orders = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    orders = orders.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    rows = orders.join(steps.drop("applied", "step"), ["part", "prefix"]).withColumn("letter", F.substring("prefix", -1, 1))
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "letter"]).select("part", "filter_order", "step", *MEASURES, "shapley")
