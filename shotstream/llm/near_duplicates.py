"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, bands, and exact
weighted Jaccard similarity of what the bands bring together.

Shingles are five words (all words of a shorter text), lower-cased, cut at ASCII characters other than
letters and digits. A shingle weighs ``tf * (1 + idf / max_idf)`` with ``idf = ln(N / df)`` and df held at
``RARE * N`` at least: a shingle in few documents weighs twice as much as one in all. So only the
frequent shingles' df has to be known, and there are at most ``words per document / RARE`` of them, at any
size of the corpus. They are found exactly in two scans: counts of shingle hashes in BUCKETS buckets rule
out most shingles, the rest are counted.

Each of 16 samples picks a shingle with the chance of its weight, consistently between texts, so two
texts agree in a sample as often as their weighted Jaccard similarity is. Eight bands of two samples
miss a pair at 0.8 with a chance of 0.36**8 = 0.0003, and fewer above.

Texts that share a band are compared. A text is the more central the more texts share its buckets: copies
with edits of their own differ from each other more than from what they were made of, which shares most
bands. Round 1 compares each text of a bucket with its most central one. Then groups are formed, and in
every bucket that still holds several, all pairs of texts of different groups are compared: in buckets of
up to SMALL texts one by one, in larger ones in blocks of about BLOCK texts. A block's shingles are made
once and all its similarities come from sums over shared shingles, so a task has a bounded size and
returns at most as many links as it has texts. The work in a bucket is (texts outside its largest group)
times (texts); nothing is left out. One by one, pairs that agree in fewer than AGREE of the 16 samples are
not compared: at 0.8 that has a chance of 3e-5. In blocks every pair is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import WordHashes, batched_texts, map_batches, mix, split_words, stored
from shotstream.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, ROWS = 16, 2
AGREE = 6
RARE = 1 / 250
BUCKETS = 1 << 19
SMALL = 32
BLOCK, BLOCK_BYTES = 512, 4 << 20  # texts of a large bucket, and their bytes, compared with as many others at a time
COMMON = 32  # shingles in more texts of a block are summed by matrix products
ID_BITS = 44  # of a shingle's hash; the rest of 64 bits numbers the documents of a batch
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the sum of two unit exponentials at 2**16 evenly spaced chances."""
    chance = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < chance
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


class Shingler:
    """Weighted shingles of batches of texts."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingle ids by text, how often each occurs, the text of each, the number of each text's."""
        hashed, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = split_words(text)
            sizes[i] = len(words)
            hashed.append(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)))
        words = np.concatenate((*hashed, np.zeros(SHINGLE, np.uint64)))
        begins = np.cumsum(sizes) - sizes
        counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
        code = np.zeros(len(at), np.uint64)
        for j in range(SHINGLE):
            part = words[at + j] * _PLACES[j]
            code += np.where(sizes[owner] > j, part, np.uint64(0)) if (sizes < SHINGLE).any() else part
        code = mix(code) >> np.uint64(64 - ID_BITS)
        code |= owner.astype(np.uint64) << np.uint64(ID_BITS)
        code.sort()
        heads = np.flatnonzero(np.diff(code, prepend=code[:1] ^ np.uint64(1))) if len(code) else np.zeros(0, np.int64)
        times = np.diff(np.append(heads, len(code)))
        code = code[heads]
        owner = (code >> np.uint64(ID_BITS)).astype(np.int64)
        ids = code & np.uint64((1 << ID_BITS) - 1)
        return ids, times, owner, np.bincount(owner, minlength=len(texts))


class Weights:
    """Weights of shingles from the frequent ones' document shares."""

    def __init__(self, frequent: dict[int, float]):
        self.ids = np.array(sorted(frequent), np.uint64)
        idf = np.log(1 / np.array([frequent[i] for i in sorted(frequent)], np.float64)) if frequent else np.zeros(0)
        self.factor = 1 + idf / np.log(1 / RARE)

    def __call__(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        factor = np.full(len(ids), 2.0)
        if len(self.ids):
            slot = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            factor = np.where(self.ids[slot] == ids, self.factor[slot], factor)
        return factor * times


class Sampler:
    """Consistent weighted samples: for each sample k, the shingle with the least ln a."""

    def __init__(self):
        gamma = _gamma_quantiles()
        self.gamma, self.log_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)

    def __call__(self, ids: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row per text with shingles, SAMPLES unsigned 32-bit columns."""
        begins = (np.cumsum(counts) - counts)[counts > 0]
        logs = np.log(weights).astype(np.float32)
        out = np.zeros((len(begins), SAMPLES), np.uint32)
        low16 = np.uint64(0xFFFF)
        for k in range(SAMPLES):
            code = mix(ids + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            r = self.gamma[code & low16]
            log_c = self.log_gamma[(code >> np.uint64(16)) & low16]
            beta = ((code >> np.uint64(32)) & low16).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(logs / r + beta)
            a = log_c - r * (t + 1 - beta)
            bits = a.view(np.uint32)
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
            name = (code ^ (t.astype(np.int64).astype(np.uint64) * _PLACES[1])) * _PLACES[2] >> np.uint64(32)
            least = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | name, begins)
            out[:, k] = least & np.uint64(0xFFFFFFFF)
        return out


def node_of(text: str = "text") -> Column:
    """What a text is known by: equal texts are one node. Null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles, seen, texts_seen = Shingler(), np.zeros(BUCKETS + 1, np.int64), 0
    for _, texts in batched_texts(batches):
        ids, _, _, _ = shingles(texts)
        seen += np.bincount((ids % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS + 1)
        texts_seen += len(texts)
    if texts_seen:
        seen[BUCKETS] = texts_seen  # the last row counts the documents
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["bucket", "n"])


def _in_buckets(handle):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, shingles = np.unpackbits(np.frombuffer(handle.value, np.uint8)).astype(bool), Shingler()
        for _, texts in batched_texts(batches):
            ids, _, _, _ = shingles(texts)
            ids = ids[full[(ids % np.uint64(BUCKETS)).astype(np.int64)]]
            if len(ids):
                ids, n = np.unique(ids, return_counts=True)
                yield pa.record_batch([pa.array(ids.astype(np.int64)), pa.array(n, pa.int64())], names=["id", "n"])

    return emit


def frequent_shingles(docs: DataFrame) -> dict[int, float]:
    """Share of documents with each shingle that is in more than RARE of them."""
    counts = map_batches(docs.select("text"), _bucket_counts, "bucket bigint, n bigint")
    counts = stored(counts.groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    total = counts.filter(F.col("bucket") == BUCKETS).select("n").first()
    if not total:
        return {}
    full = np.zeros(BUCKETS, bool)
    # At most words per document / RARE buckets can hold so many.
    for (bucket,) in counts.filter((F.col("bucket") < BUCKETS) & (F.col("n") > total[0] * RARE)).select("bucket").collect():
        full[bucket] = True
    if not full.any():
        return {}
    handle = docs.sparkSession.sparkContext.broadcast(np.packbits(full).tobytes())
    found = map_batches(docs.select("text"), _in_buckets(handle), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {i: n / total[0] for i, n in found.filter(F.col("n") > total[0] * RARE).collect()}


def _signing(handle):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sampler = Shingler(), Sampler()
        for batch, texts in batched_texts(batches):
            ids, times, _, counts = shingles(texts)
            rows = np.zeros((len(texts), SAMPLES), np.uint32)
            if len(ids):
                rows[counts > 0] = sampler(ids, handle.value(ids, times), counts)
            ends = np.concatenate(([0], np.cumsum(np.where(counts > 0, SAMPLES, 0))))
            samples = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(rows[counts > 0].view(np.int32).ravel(), pa.int32())
            )
            sizes = pa.array([len(text) for text in texts], pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("node"), samples, sizes], names=["doc_id", "node", "samples", "size"]
            )

    return sign


def similarity(first: bytes, second: bytes, shingles: Shingler, weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts; 0 if neither has a word."""
    ids, times, owner, _ = shingles([first, second])
    weight = weights(ids, times)
    a, b = owner == 0, owner == 1
    ids_a, ids_b, wa, wb = ids[a], ids[b], weight[a], weight[b]
    if not len(ids_a) or not len(ids_b):
        return 0.0
    slot = np.minimum(np.searchsorted(ids_b, ids_a), len(ids_b) - 1)
    both = np.where(ids_b[slot] == ids_a, np.minimum(wa, wb[slot]), 0).sum()
    return float(both / (wa.sum() + wb.sum() - both))


def _verifying(handle, least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            first, second = (batch.column(c).cast(pa.binary()).fill_null(b"").to_pylist() for c in ("text_a", "text_b"))
            keep = [similarity(x, y, shingles, handle.value) >= least - 1e-9 for x, y in zip(first, second)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _similarities(texts: list[bytes], shingles: Shingler, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of texts; 0 if neither of two has a word."""
    ids, times, owner, _ = shingles(texts)
    n, factor = len(texts), weights(ids, np.ones(len(ids)))
    totals = np.bincount(owner, factor * times, minlength=n)
    # A shingle that occurs t times is t features, so that features in both texts add up to the lesser count.
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    ids, owner, factor = np.repeat(ids, times), np.repeat(owner, times), np.repeat(factor, times)
    order = np.lexsort((ids, nth))
    ids, nth, owner, factor = ids[order], nth[order], owner[order], factor[order]
    heads = np.flatnonzero((np.diff(ids, prepend=ids[:1] ^ np.uint64(1)) != 0) | (np.diff(nth, prepend=-1) != 0)) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(ids)))
    both = np.zeros(n * n)
    for c in range(2, COMMON + 1):
        these = heads[counts == c]
        step = max(1, (1 << 20) // c**2)
        for at in range(0, len(these), step):
            part = these[at : at + step]
            mine = owner[part[:, None] + np.arange(c)]
            code = mine[:, :, None] * n + mine[:, None, :]
            both += np.bincount(code.ravel(), np.repeat(factor[part], c * c), minlength=n * n)
    both = both.reshape(n, n)
    common = np.flatnonzero(counts > COMMON)
    for at in range(0, len(common), 1024):
        part = common[at : at + 1024]
        column = np.repeat(np.arange(len(part)), counts[part])
        row = np.arange(counts[part].sum()) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        has = np.zeros((n, len(part)))
        has[owner[heads[part][column] + row], column] = 1
        both += (has * factor[heads[part]]) @ has.T
    np.fill_diagonal(both, totals)
    return both / np.maximum(totals[:, None] + totals[None, :] - both, 1e-300)


def _linking(handle, least: float):
    def link(block: pa.Table) -> pa.Table:
        """Links that join the groups of a block's texts as all pairs of 0.8 and more would."""
        nodes = block.column("node").to_pylist()
        _, group = np.unique(np.array([root.hex() for root in block.column("root").to_pylist()]), return_inverse=True)
        similar = np.zeros((0, 0), bool)
        if group.max(initial=0):
            texts = block.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            similar = _similarities(texts, Shingler(), handle.value) >= least - 1e-9
        same = group[:, None] == group[None, :]
        links, fresh = [], np.full(len(similar), True)
        while fresh.any():
            at = [int(np.argmax(fresh))]
            fresh[at] = False
            while at:
                x = at.pop()
                fresh[near := np.flatnonzero(fresh & (same[x] | similar[x]))] = False
                at += near.tolist()
                links += [sorted((nodes[x], nodes[y])) for y in near[group[near] != group[x]]]
        return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    return link


def _agreeing(x: str, y: str) -> Column:
    same = F.zip_with(x, y, lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda total, one: total + one)


def _pairs(members: DataFrame, hubs: DataFrame, when: Column) -> DataFrame:
    """Distinct pairs (a < b) of members and hubs of a bucket that agree often enough."""
    met = members.join(hubs, ["band", "value"]).filter((F.col("node") != F.col("hub")) & when)
    met = met.filter(_agreeing("samples", "hub_samples") >= AGREE)
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every document, and (node, low, class_id, stays) of every distinct text: its least
    id, the least id of its class, and whether it is the text that stands for the class."""
    rows = docs.select("doc_id", "text", node_of().alias("node"))
    context = docs.sparkSession.sparkContext
    weights = context.broadcast(Weights(frequent_shingles(rows)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(
        map_batches(rows, _signing(weights), f"doc_id {kind}, node binary, samples array<int>, size bigint"), "signed"
    )
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("samples").alias("samples"), F.first("size").alias("size"))
    bands = F.array(
        *[
            F.shiftleft(F.get("samples", i).cast("bigint"), 32).bitwiseOR(
                F.get("samples", i + 1).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
            )
            for i in range(0, SAMPLES, ROWS)
        ]
    )
    nodes = nodes.filter(F.size("samples") > 0)
    banded = nodes.select("node", "doc_id", "samples", "size", F.posexplode(bands).alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(banded.join(buckets, ["band", "value"]), "shared")
    central = shared.groupBy("node").agg(F.sum("n").alias("centre"))
    members = stored(shared.join(central, "node"), "members")
    # The text of every node that shares a bucket, once. The id narrows the join to one document a node.
    chosen = members.select("node", F.col("doc_id").alias("chosen")).distinct()
    texts = rows.join(
        chosen.withColumnRenamed("node", "known"),
        (F.col("node") == F.col("known")) & F.col("doc_id").eqNullSafe(F.col("chosen")),
    )
    texts = stored(texts.select("node", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        x = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).dropDuplicates(["a"])
        y = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).dropDuplicates(["b"])
        return stored(
            map_batches(pairs.join(x, "a").join(y, "b"), _verifying(weights, least), "a binary, b binary"), "links"
        )

    hubs = members.groupBy("band", "value").agg(F.max(F.struct("centre", "node", "samples")).alias("top")).select(
        "band", "value", F.col("top.node").alias("hub"), F.col("top.samples").alias("hub_samples")
    )
    tried = stored(_pairs(members, hubs, F.lit(True)), "pairs")
    links = verified(tried)
    open_ = _open_buckets(members, components(links))
    links = links.union(verified(_small_pairs(open_).join(tried, ["a", "b"], "left_anti")))
    large = open_.filter(F.col("n") > SMALL)
    if large.limit(1).count():
        known = texts.dropDuplicates(["node"])
        blocks = _blocks(large).join(known, "node").groupBy("band", "value", "part")
        links = links.union(stored(blocks.applyInArrow(_linking(weights, least), "a binary, b binary"), "links"))
    groups = components(links)
    lowest = signed.groupBy("node").agg(F.min("doc_id").alias("low"))
    lowest = lowest.join(groups, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = stored(lowest, "nodes")
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("first")
    tops = lowest.groupBy("root").agg(first)
    classes = lowest.join(tops, "root").select(
        "node", "low", F.col("first.low").alias("class_id"), (F.col("node") == F.col("first.node")).alias("stays")
    )
    return signed.select("doc_id", "node"), stored(classes, "classes")


def duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class).

    Classes are the connected components of pairs with a similarity of ``least`` or more; equal texts
    share a class. Null counts as the empty text; texts without a word are similar to equal ones only.
    Repeated rows are documents of one class; a class of null ids has a null class_id. Other columns are
    ignored. An empty table gives no rows.
    """
    documents, classes = _classes(docs, least)
    return documents.join(classes, "node").select("doc_id", "class_id")


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, unchanged: the one with the least id, of rows repeated with id and text
    one. Null ids come last."""
    documents, classes = _classes(docs, least)
    stays = classes.filter("stays").select(F.col("node").alias("__stays"), F.col("low").alias("__low"))
    rows = docs.withColumn("__node", node_of())
    kept = rows.join(stays, (F.col("__node") == F.col("__stays")) & F.col("doc_id").eqNullSafe(F.col("__low")), "left_semi")
    # Only if rows repeat is there a need to move the texts once more.
    again = documents.groupBy("doc_id", "node").count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "__node"]) if again else kept).drop("__node")


def _open_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members, with their groups, of the buckets that hold several groups."""
    placed = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("doc_id")
    placed = stored(placed, "placed")
    several = placed.groupBy("band", "value").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    return stored(placed.join(several.select("band", "value"), ["band", "value"]), "open")


def _small_pairs(placed: DataFrame) -> DataFrame:
    """All pairs between groups in small buckets."""
    small = placed.filter(F.col("n") <= SMALL)
    as_hubs = small.select(
        "band", "value", F.col("node").alias("hub"), F.col("samples").alias("hub_samples"), F.col("root").alias("hub_root")
    )
    return _pairs(small, as_hubs, (F.col("root") != F.col("hub_root")) & (F.col("node") < F.col("hub")))


def _blocks(large: DataFrame) -> DataFrame:
    """(band, value, part, node, root): parts in which all pairs between groups of a bucket meet.

    The bucket's largest group and the rest are cut into blocks; each block of the rest meets every other
    block, those of the largest group do not meet each other.
    """
    key = ["band", "value"]
    tops = large.groupBy(*key, "root").agg(F.count("*").alias("k")).groupBy(*key).agg(F.max(F.struct("k", "root")).alias("top"))
    sided = large.select(*key, "node", "root", "size").join(tops.select(*key, F.col("top.root").alias("main")), key)
    sided = sided.withColumn("rest", F.col("root") != F.col("main"))

    def needed(side: Column, name: str) -> Column:
        texts, sizes = F.sum(F.when(side, 1).otherwise(0)), F.sum(F.when(side, F.col("size")).otherwise(0))
        return F.ceil(F.greatest(texts / BLOCK, sizes / BLOCK_BYTES)).cast("int").alias(name)

    counts = sided.groupBy(*key).agg(needed(F.col("rest"), "rests"), needed(~F.col("rest"), "mains"))
    placed = sided.join(counts, key)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    placed = placed.withColumn("own", own)
    rests, mains = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    parts = F.when(
        F.col("rest"),
        F.concat(
            F.transform(mains, lambda j: F.array(F.lit(0), F.col("own"), j)),
            F.transform(
                F.filter(rests, lambda j: j != F.col("own")),
                lambda j: F.array(F.lit(1), F.least("own", j), F.greatest("own", j)),
            ),
        ),
    ).otherwise(F.transform(rests, lambda i: F.array(F.lit(0), i, F.col("own"))))
    return placed.select(*key, "node", "root", F.explode(parts).alias("part"))
