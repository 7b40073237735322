"""Benchmark passages in documents: SimHash of item-sized windows, a multi-index over Hamming blocks,
then exact weighted-shingle similarity. Native: DataFrame functions only.

Texts are lower-cased and cut at ASCII characters that are neither letter nor digit. A shingle is five
words (all words of a shorter item), known by a 64-bit hash. A window has as many words as the item, and a
text that is shorter than the item is one window; its similarity is sum(min) / sum(max) of shingle counts.

Which windows get a fingerprint. With m and s shingles on the two sides a similarity of t needs an overlap
of ``need = ceil(t(m + s) / (1 + t))`` counted shingles. So a window that reaches t holds a shingle of any
``m - need + 1`` fixed shingles of the item, and one of the item's shingles stands among its own first
``s - need + 1``. Windows without either have a similarity below t whatever their fingerprint, and are
left out; nothing else is. A window goes on with each item that suggests it so, and meets no other.

Which pairs are found. Fingerprints of 64 bits are cut into 8 blocks of 8 bits. Two fingerprints at most
23 bits apart have a block that differs in 2 bits at most, so the index lists every item under all block
values within 2 bits, and each window looks up its 8 block values under its items: all pairs within the radius of 23 are
found. At a similarity of exactly 0.8 a bit differs with a chance of about 0.15, so the chance of being
outside the radius is about 1e-5; above 0.8 it is smaller still.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import NOT_ALNUM, stored

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
# Shingles of the benchmark sent to every executor at once, of some 60 bytes each; a larger benchmark goes in
# several blocks.
SENT_SHINGLES = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def shingle_hashes(words: Column, k: int) -> Column:
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(hashed, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def _counted(hashes: Column) -> Column:
    """The k-th copy of a hash becomes a value of its own, so that set overlap counts copies."""
    ordered = F.sort_array(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h)))


def _lanes(m: int) -> int:
    """Bits of a counter so that counts of m never reach its top bit."""
    return next(bits for bits in (8, 16, 32) if m < 1 << (bits - 1))


def _mask(bits: int) -> int:
    value = sum(1 << at for at in range(0, 64, bits))
    return value - (1 << 64) if value >> 63 else value


def add_fingerprints(windows: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """SimHash of each row's ``hashes``: bit b is set when over half of the hashes have it.

    Bits are counted many to a long: long k adds up bits k, k + L, k + 2L ... in lanes of L bits, so one
    shingle costs L additions and the sums are combined before the shuffle.
    """
    bits = _lanes(largest)
    rows = windows.withColumn("__h", F.explode("hashes"))
    sums = rows.groupBy(*keys).agg(
        F.first("hashes").alias("hashes"),
        *[
            F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(_mask(bits)))).alias(f"__s{k}")
            for k in range(bits)
        ],
    )
    set_bits = []
    for k in range(bits):
        for lane in range(64 // bits):
            count = F.shiftrightunsigned(f"__s{k}", lane * bits).bitwiseAND(F.lit((1 << bits) - 1))
            at = k + lane * bits
            value = 1 << at if at < 63 else -(1 << 63)
            set_bits.append(
                F.when(2 * count > F.size("hashes"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            )
    halves = [reduce(lambda a, b: a.bitwiseOR(b), set_bits[i : i + 16]) for i in range(0, 64, 16)]
    parts = sums.select(*keys, "hashes", *[half.alias(f"__p{i}") for i, half in enumerate(halves)])
    return parts.select(
        *keys, "hashes",
        reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"__p{i}") for i in range(4)]).alias("fingerprint"),
    )


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _near_masks() -> list[int]:
    reach = RADIUS // BLOCKS
    return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(BLOCK_BITS), n)]


def benchmark_items(benchmark: DataFrame, similarity: float) -> DataFrame:
    """item, item_id, n (words), k (shingle words), m (shingles), lead, hashes. Items without words are left out."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    short = [F.when(F.size("words") == k, shingle_hashes(F.col("words"), k)) for k in range(1, SHINGLE)]
    items = items.select(
        "item_id",
        F.size("words").alias("n"),
        F.least(F.size("words"), F.lit(SHINGLE)).alias("k"),
        F.coalesce(*short, shingle_hashes(F.col("words"), SHINGLE)).alias("hashes"),
    )
    # Rows are told apart by id and text: ids may repeat or be null, equal rows count once.
    items = items.withColumn("item", F.xxhash64("item_id", "hashes", "n")).dropDuplicates(["item"])
    m = F.size("hashes")
    need = F.ceil(m * (2 * similarity / (1 + similarity)) - 1e-9)
    # A shorter text may have as few as t * m shingles, all of them shared.
    least = F.ceil(m * similarity - 1e-9)
    return items.withColumn("m", m).withColumns(
        {"lead": (m - need + 1).cast("int"), "short_lead": (m - least + 1).cast("int")}
    )


def _candidate_windows(docs: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """Windows that can reach the similarity, one row per window and item that suggests it."""
    hashed = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hashed = hashed.select("doc_id", shingle_hashes(F.col("words"), k).alias("all"))
    leads = items.select(
        F.explode(F.array_distinct(F.slice("hashes", 1, F.col("short_lead")))).alias("h"),
        "item", "m", F.col("hashes").alias("__hashes"), "lead",
    ).select("h", F.struct("item", "m", F.array_contains(F.slice("__hashes", 1, F.col("lead")), F.col("h")).alias("first")).alias("of"))
    # A lookup table: one entry per shingle, with the items that have it; and the shingles of each item.
    leads = leads.groupBy("h").agg(F.collect_list("of").alias("of"))
    whole = items.select(F.col("item"), F.col("hashes").alias("whole"), "lead")
    # The outer form keeps the planner from filtering on the size of the array below the projection,
    # which would hash every text once more per word. Rows without a shingle do not join.
    at = hashed.select("doc_id", "all", F.posexplode_outer("all").alias("pos", "h"))
    hits = at.join(F.broadcast(leads), "h").select("doc_id", "all", "pos", F.explode("of").alias("of")).select("doc_id", "all", "pos", "of.*")
    size, m = F.size("all"), F.col("m")
    hits = hits.filter(F.when(size < m, size >= similarity * m - 1e-9).otherwise(F.col("first")))
    hits = hits.join(F.broadcast(whole), "item").withColumns(
        {
            "low": F.greatest(F.lit(0), F.col("pos") - m + 1),
            "span": F.least(m, size),
            # Distinct shingles by which a window is found first, in a text that is long enough or shorter.
            "lead": F.when(size < m, m - F.ceil(m * similarity - 1e-9) + 1).otherwise(F.col("lead")).cast("int"),
        }
    )
    region = F.slice("all", F.col("low") + 1, F.least(F.col("pos") + m, size) - F.col("low"))
    hits = hits.select("doc_id", "item", "m", "pos", "low", "span", "lead", "whole", F.slice("whole", 1, F.col("lead")).alias("whole_lead"), region.alias("region"))
    starts = hits.select(
        "*",
        F.explode(
            F.sequence(F.col("low"), F.least(F.col("pos"), F.col("low") + F.size("region") - F.col("span")))
        ).alias("start"),
    )
    window = F.slice("region", F.col("start") - F.col("low") + 1, F.col("span"))
    before = F.slice("region", F.col("start") - F.col("low") + 1, F.col("pos") - F.col("start"))
    starts = starts.filter(
        F.arrays_overlap(F.slice("region", F.col("start") - F.col("low") + 1, F.col("lead")), F.col("whole"))
        & ~F.arrays_overlap(before, F.col("whole_lead"))  # an earlier hit has made this window
    )
    return starts.select("doc_id", "item", "start", window.alias("hashes"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, sent: int = SENT_SHINGLES
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity (of the best
    window), start_word (of the first best window), n_words (of the item). Of windows equally similar the
    first counts.

    Null and empty texts contain nothing; items without words are never found; an item shorter than five
    words is one shingle of all its words. Repeated documents are found each; rows that repeat a doc_id
    merge into one. Columns other than doc_id, text, item_id are ignored.
    """
    spark = docs.sparkSession
    # Stored, as is all else that several expressions are built on: plans stay small.
    items = stored(benchmark_items(benchmark, similarity), "items")
    facts = items.groupBy("k").agg(F.max("m").alias("m"), F.sum("m").alias("total")).collect()
    if not facts:
        return spark.createDataFrame(
            [], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id"
            f" {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, start_word int, n_words int"
        )
    largest = max(row["m"] for row in facts)
    parts = []
    for row in facts:
        of_k = items.filter(F.col("k") == row["k"])
        # Blocks of items whose shingles, in all, have a known bound.
        blocks = max(1, math.ceil(row["total"] / sent))
        for block in range(blocks):
            part = of_k if blocks == 1 else of_k.filter(F.pmod("item", F.lit(blocks)) == block)
            parts.append(_candidate_windows(docs, part, row["k"], similarity))
    windows = reduce(DataFrame.unionByName, parts)
    # Windows met twice, as those of repeated documents, must not be added up: each has a number.
    windows = windows.withColumn("row", F.monotonically_increasing_id())
    windows = stored(add_fingerprints(windows, ["doc_id", "item", "start", "row"], largest), "windows")
    index = stored(add_fingerprints(items, ["item", "item_id", "n", "m"], largest), "index")
    masks = F.array(*[F.lit(mask) for mask in _near_masks()])
    index = index.select(
        "item", "item_id", "n", "m", F.col("fingerprint").alias("item_print"),
        F.posexplode(F.array(*[_block(F.col("fingerprint"), i) for i in range(BLOCKS)])).alias("block", "own"),
    ).select("*", F.explode(masks).alias("flip"))
    index = index.withColumn("value", F.col("own").bitwiseXOR(F.col("flip"))).drop("own", "flip")
    probes = windows.select(
        "*",
        F.posexplode(F.array(*[_block(F.col("fingerprint"), i) for i in range(BLOCKS)])).alias("block", "value"),
    )
    # The planner sees the stored items, not the 296 index rows of each: no broadcast by that estimate.
    near = probes.join(index.hint("merge"), ["item", "block", "value"]).filter(
        F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS
    )
    # A pair met in several blocks is kept in the first of them only.
    differs = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    first = F.least(
        *[F.when(F.bit_count(_block(differs, i)) <= RADIUS // BLOCKS, F.lit(i)) for i in range(BLOCKS)]
    )
    near = near.filter(F.col("block") == first)
    counted = items.select("item", _counted(F.col("hashes")).alias("item_counted"))
    near = near.join(counted.hint("merge"), "item")
    overlap = F.size(F.array_intersect(_counted(F.col("hashes")), F.col("item_counted")))
    both = F.col("m") + F.size("hashes")
    scored = near.select(
        "doc_id", "item_id", "n", "start", (overlap / (both - overlap)).alias("similarity")
    ).filter(F.col("similarity") >= similarity - 1e-12)
    return scored.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"),
        F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).cast("int").alias("start_word"),
        F.first("n").cast("int").alias("n_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no benchmark item is found, unchanged. A null doc_id is kept only if no
    document with a null id is found."""
    found = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti")
