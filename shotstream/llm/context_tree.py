"""Context-tree weighting over bytes.

Every byte is eight binary decisions; every context of up to DEPTH earlier bytes keeps, for each of the
255 decision nodes, the zeros and ones that training saw there. A Krichevsky-Trofimov estimator gives
the block probability of such counts, and the weighted probability of a context mixes its own estimate
with the product of its longer contexts', half and half, from the longest contexts up. After training
the mixture is fixed, so the probability of a byte follows from its context alone and is tabulated.

The tree holds every context of the training texts. Counts are combined in Spark, and so is the tree:
contexts with the same HEAD latest bytes are weighed in one task, the fewer shorter ones on the driver,
and every gram (DEPTH bytes and the byte that follows) of any text gets its log2 probability. The
SENT_GRAMS most frequent ones go to all executors, which score the texts; the rest of a text's grams are
joined with theirs. A decision without training data is predicted as one context shorter.

A model of given size is made on request: with ``share`` the tree branches into a longer context only where
that holds such a share of the training bytes, and the rarer ones of a context share one branch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import batched_texts, map_batches, remainder, stored

DEPTH = 5
HEAD = 3  # contexts with so many latest bytes in common are weighed together
END = 255  # no UTF-8 text has this byte; it ends a text and stands before its first byte
SENT_WORDS = 200_000  # so many of the most frequent words go to all executors; others are joined
SENT_BYTES = 64  # so are longer words, as whole paragraphs are in writing without spaces
COUNT_BYTES = 6 << 20  # text counted at a time
MOST_GRAMS = 1 << 20  # grams a task holds before it passes them on
SENT_GRAMS = 1 << 20  # so many of the most frequent grams go to all executors; others are joined
PATHS = 1 << 18  # grams weighed at a time, whole heads
GRAM_KEY = b"\n"  # before the bytes of a gram in a join with words, which hold no white space
HALF = np.log(0.5)
COLUMNS = 16  # decision nodes worked on at a time when the tree is built
MOST_WORDS = 500_000  # words counted in a task before it passes them on


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with END between, positions of predicted bytes (texts and their ends), text lengths."""
    gap = bytes([END]) * DEPTH
    stream = np.frombuffer(gap + b"".join(text + gap for text in texts), np.uint8)
    lengths = np.array([len(text) + 1 for text in texts], np.int64)
    begins = DEPTH + np.concatenate(([0], np.cumsum(lengths + DEPTH - 1)[:-1]))
    at = np.repeat(begins - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    return stream, at, lengths


def _packed(texts: list[bytes]) -> np.ndarray:
    stream, at, _ = grams(texts)
    packed = np.zeros(len(at), np.int64)
    for d in range(DEPTH, -1, -1):
        packed = (packed << 8) | stream[at - d]
    return packed


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def told(keys, codes, counts):
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["word", "gram", "n"])

    def told_words():
        return told(list(words), [None] * len(words), list(words.values()))

    def merged(codes, counts, texts, weight=1):
        if not texts:
            return codes, counts
        fresh, n = np.unique(_packed(texts), return_counts=True)
        n *= weight
        both, where = np.unique(np.concatenate((codes, fresh)), return_inverse=True)
        return both, np.bincount(where, np.concatenate((counts, n))).astype(np.int64)

    def told_grams(codes, counts):
        return told(pa.nulls(len(codes), pa.binary()), codes, counts)

    nothing = np.zeros(0, np.int64)
    waiting, asked, size, codes, counts = [], [], 0, nothing, nothing
    for batch, texts in batched_texts(batches, 1 << 20):
        for text, held in zip(texts, batch.column("held_out").to_pylist()):
            text = text.lower()
            size += len(text)
            if held:
                asked.append(text)
                continue
            words.update(text.split())
            words[b""] += 1  # the end of a text
            waiting.append(text)
        if len(words) > MOST_WORDS:
            yield told_words()
            words.clear()
        if size > COUNT_BYTES:
            codes, counts = merged(*merged(codes, counts, waiting), asked, 0)
            waiting, asked, size = [], [], 0
            if len(codes) > MOST_GRAMS:
                yield told_grams(codes, counts)
                codes, counts = nothing, nothing
    codes, counts = merged(*merged(codes, counts, waiting), asked, 0)
    if len(codes):
        yield told_grams(codes, counts)
    if words:
        yield told_words()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument up by eight; exact to 1e-12 for x >= 0.5."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _weigh(key, zeros, ones, below, shorter, steps: int) -> list[tuple]:
    """Decisions of the contexts in ``key`` and of those up to ``steps`` bytes shorter, the shortest first.

    Per length: keys, zeros, ones, the weight of the own estimate, the logarithm of the mixture, and where
    each decision stands among the next shorter ones. ``below`` sums the mixtures of the longer contexts."""
    made = []
    for step in range(steps + 1):
        own = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)
        mixed = own if below is None else HALF + np.logaddexp(own, below)
        stop = np.ones(len(key)) if below is None else np.exp(HALF + own - mixed)
        above, up = np.unique(shorter(key), return_inverse=True) if step < steps else (None, None)
        made.append((key, zeros, ones, stop, mixed, up))
        if step < steps:
            key = above
            zeros, ones, below = (np.bincount(up, x, len(above)).astype(float) for x in (zeros, ones, mixed))
    return made[::-1]


def _mix(made: list[tuple], state: tuple) -> tuple:
    """(own estimate, chance of a one so far, weight left) of the longest contexts, from those of the contexts
    above the first."""
    one, sure, left = state
    for i, (_, zeros, ones, stop, _, up) in enumerate(made):
        if i:
            one, sure, left = one[up], sure[up], left[up]
        one = np.where(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1), one)
        sure, left = sure + left * stop * one, left * (1 - stop)
    return one, sure, left


def _by_head(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns path, gram and n of sorted paths, cut between heads into about PATHS rows."""
    waiting, rows, most = [], 0, PATHS
    for batch in batches:
        waiting.append([batch.column(name).to_numpy() for name in ("path", "gram", "n")])
        rows += batch.num_rows
        if rows > most:
            columns = [np.concatenate(x) for x in zip(*waiting)]
            head = columns[0] >> 8 * (DEPTH + 1 - HEAD)
            cut = int(np.searchsorted(head, head[-1]))
            if cut:
                yield [x[:cut] for x in columns]
            waiting, rows = [[x[cut:] for x in columns]], rows - cut
            most = max(PATHS, 2 * rows)
    if rows:
        yield [np.concatenate(x) for x in zip(*waiting)]


def _decisions(path: np.ndarray, n: np.ndarray, level: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The decisions of a level from the longest contexts up to HEAD bytes; where each path's stands among
    those of the longest; the numbers in the next shorter contexts of those of the shortest."""
    bit = path >> (7 - level) & 1

    def shorter(key):
        return key >> (level + 8) << level | key & ((1 << level) - 1)

    key, place = np.unique(path >> (8 - level), return_inverse=True)
    zeros, ones = np.bincount(place, n * (1 - bit), len(key)), np.bincount(place, n * bit, len(key))
    made = _weigh(key, zeros, ones, None, shorter, DEPTH - HEAD)
    first = made[0][0]
    return made, place, first >> (level + 8) << 8 | (1 << level) - 1 + (first & ((1 << level) - 1))


def _sum_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, _, n in _by_head(batches):
        for level in range(8):
            made, _, slots = _decisions(path, n, level)
            _, zeros, ones, _, mixed, _ = made[0]
            slot, up = np.unique(slots, return_inverse=True)
            sums = [np.bincount(up, x, len(slot)) for x in (zeros, ones, mixed)]
            yield pa.record_batch([slot, *sums], names=["slot", "zeros", "ones", "below"])


def _tell_chances(top):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *state = top.value
        for path, gram, n in _by_head(batches):
            log2 = np.zeros(len(path))
            for level in range(8):
                made, place, slots = _decisions(path, n, level)
                at = np.searchsorted(known, slots)
                _, chance, _ = _mix(made, tuple(x[at] for x in state))
                chance = np.clip(chance, 1e-7, 1 - 1e-7)[place]
                log2 += np.log2(np.where(path >> (7 - level) & 1, chance, 1 - chance))
            yield pa.record_batch([gram, n, log2.astype(np.float32)], names=["gram", "n", "log2"])

    return tell


def gram_chances(counts: DataFrame) -> DataFrame:
    """(gram, n, log2) of every gram, also those that training did not see (n = 0), in the tree of all
    contexts. Stored.

    A path is a gram with its latest byte first, so the contexts of a head lie side by side. What reaches the
    driver are sums for the contexts of HEAD - 1 bytes that occur, at most 255 decisions each.
    """
    gram = F.col("gram")
    path = gram.bitwiseAND(F.lit(255))
    for d in range(1, DEPTH + 1):
        path = path + F.shiftleft(F.shiftright(gram, 8 * d).bitwiseAND(F.lit(255)), 8 * (DEPTH + 1 - d))
    paths = (
        counts.filter("gram IS NOT NULL").select(path.alias("path"), "gram", "n")
        .repartition(F.shiftright("path", 8 * (DEPTH + 1 - HEAD))).sortWithinPartitions("path")
    )
    sums = map_batches(paths, _sum_heads, "slot bigint, zeros double, ones double, below double", 1 << 16)
    rows = sums.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    rows = rows.toArrow().sort_by("slot")
    slot, zeros, ones, below = (rows[name].to_numpy() for name in ("slot", "zeros", "ones", "below"))
    made = _weigh(slot, zeros, ones, below, lambda key: key >> 16 << 8 | key & 255, HEAD - 1)
    n = len(made[0][0])
    state = _mix(made, (np.full(n, 0.5), np.zeros(n), np.ones(n)))
    top = counts.sparkSession.sparkContext.broadcast((slot, *state))
    return stored(map_batches(paths, _tell_chances(top), "gram bigint, n bigint, log2 float", 1 << 16), "chances")


@dataclass(frozen=True)
class Chances:
    """log2 probabilities of grams in a table of open addresses; an empty place holds -1."""

    grams: np.ndarray
    log2: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, log2: np.ndarray) -> Chances:
        size = 1 << (2 * len(grams) + 1).bit_length()
        made = Chances(np.full(size, -1, np.int64), np.zeros(size, np.float32))
        at, rest = made.places(grams), np.arange(len(grams))
        while len(rest):
            free = rest[made.grams[at[rest]] < 0]
            made.grams[at[free]] = grams[free]
            here = made.grams[at[rest]] == grams[rest]
            made.log2[at[rest[here]]] = log2[rest[here]]
            rest = rest[~here]
            at[rest] = (at[rest] + 1) & (size - 1)
        return made

    def places(self, grams: np.ndarray) -> np.ndarray:
        bits = len(self.grams).bit_length() - 1
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """log2 of each gram, NaN for those that are not here."""
        at = self.places(grams)
        there = self.grams[at]
        found = self.log2[at]
        rest = np.flatnonzero(there != grams)
        found[rest] = np.nan
        rest = rest[there[rest] >= 0]
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.grams) - 1)
            there = self.grams[at[rest]]
            here = there == grams[rest]
            found[rest[here]] = self.log2[at[rest[here]]]
            rest = rest[~here & (there >= 0)]
        return found

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log2 probability of the grams of each text that are here; for the others the number of the text,
        the gram, and how often it occurs there."""
        packed = _packed(texts)
        ends = np.cumsum([len(text) + 1 for text in texts])
        bits = self.find(packed).astype(np.float64)
        lost = np.flatnonzero(np.isnan(bits))
        bits[lost] = 0
        rest, times = np.unique(np.searchsorted(ends, lost, "right") << 48 | packed[lost], return_counts=True)
        return np.add.reduceat(bits, ends - [len(text) + 1 for text in texts]), rest >> 48, rest & ((1 << 48) - 1), times


@dataclass(frozen=True)
class Tree:
    """``child[node, byte]`` leads one byte further back; a negative value -1 - r means row r of ``log2``,
    the code lengths (negated) of the 256 next bytes."""

    child: np.ndarray
    log2: np.ndarray

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log2 probability of each text and its end; no gram is left to be joined."""
        stream, at, lengths = grams(texts)
        node = np.zeros(len(at), np.int32)
        for d in range(1, DEPTH + 1):
            step = self.child[np.maximum(node, 0), stream[at - d]]
            node = np.where(node < 0, node, step)
        bits = self.log2[-1 - node, stream[at]].astype(np.float64)
        nothing = np.zeros(0, np.int64)
        return np.add.reduceat(bits, np.concatenate(([0], np.cumsum(lengths)[:-1]))), nothing, nothing, nothing


def build_tree(depth: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Tree:
    """The mixed tree from the byte counts of the kept contexts, one entry per context and byte.

    A context is a number whose lowest byte is the latest one. Every suffix of a kept context is kept.
    Without entries the tree is one node that knows nothing: every decision has a probability of a half.
    Decision nodes do not depend on each other, so they are worked on COLUMNS at a time.
    """
    keys = np.concatenate(([0], (depth.astype(np.int64) << 40) | context))
    nodes, owner = np.unique(keys, return_inverse=True)
    owner = owner[1:]
    depth_of, context_of = nodes >> 40, nodes & ((1 << 40) - 1)
    shorter = np.maximum(depth_of - 1, 0)
    parent = np.searchsorted(nodes, (shorter << 40) | (context_of & ((1 << (8 * shorter)) - 1)))
    symbol = context_of >> (8 * shorter)
    known = len(nodes)
    child_of = parent[1:]
    inner = np.unique(child_of)
    # One more branch under every inner node, for all its rarer contexts.
    total = known + len(inner)
    place = np.full(known, -1)
    place[inner] = np.arange(len(inner))
    parent = np.concatenate((parent, inner))
    depth_of = np.concatenate((depth_of, depth_of[inner] + 1))
    is_inner = np.zeros(total, bool)
    is_inner[inner] = True
    leaves = np.flatnonzero(~is_inner)
    levels = [np.flatnonzero(depth_of == d) for d in range(int(depth_of.max()) + 1)]

    def side(low: int, high: int, level: int, bit: int) -> np.ndarray:
        """Counts of ``bit`` at the decisions ``low`` to ``high`` of a level, for all nodes."""
        prefix = byte >> (8 - level)
        mine = (prefix >= low) & (prefix < high) & ((byte >> (7 - level)) & 1 == bit)
        at = owner[mine] * (high - low) + (prefix[mine] - low)
        counts = np.bincount(at, n[mine], minlength=known * (high - low)).astype(np.float64).reshape(known, high - low)
        rest = counts[inner].copy()
        np.subtract.at(rest, place[child_of], counts[1:])
        return np.concatenate((counts, rest))

    log2 = np.zeros((len(leaves), 1), np.float32)
    for level in range(8):
        chances = np.empty((len(leaves), 1 << level), np.float32)
        for low in range(0, 1 << level, COLUMNS):
            high = min(low + COLUMNS, 1 << level)
            zeros, ones = side(low, high, level, 0), side(low, high, level, 1)
            seen = zeros + ones
            own = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(seen + 1) - np.log(np.pi)
            weighted, below = own.copy(), np.zeros_like(own)
            for mine in levels[::-1]:
                mixed = mine[is_inner[mine]]
                weighted[mixed] = HALF + np.logaddexp(own[mixed], below[mixed])
                if mine[0]:
                    np.add.at(below, parent[mine], weighted[mine])
            stop = np.where(is_inner[:, None], np.exp(HALF + own - weighted), 1.0)
            one = np.where(seen > 0, (ones + 0.5) / (seen + 1), np.nan)
            one[0] = (ones[0] + 0.5) / (seen[0] + 1)
            sure, left = np.zeros_like(one), np.ones_like(one)
            for mine in levels:
                if mine[0]:
                    up = parent[mine]
                    one[mine] = np.where(np.isnan(one[mine]), one[up], one[mine])
                    sure[mine], left[mine] = sure[up], left[up]
                sure[mine] += left[mine] * stop[mine] * one[mine]
                left[mine] *= 1 - stop[mine]
            chances[:, low:high] = np.clip(sure[leaves], 1e-7, 1 - 1e-7)
        log2 = np.stack((log2 + np.log2(1 - chances), log2 + np.log2(chances)), axis=2).reshape(len(leaves), -1)
    name = np.zeros(total, np.int32)
    name[inner] = np.arange(len(inner))
    name[leaves] = -1 - np.arange(len(leaves))
    if not len(inner):  # a lone root: every way leads to its row
        return Tree(np.full((1, 256), -1, np.int32), log2)
    child = np.repeat(name[known:, None], 256, axis=1)
    child[place[child_of], symbol[1:]] = name[1:known]
    return Tree(child, log2)


def count_corpus(docs: DataFrame) -> DataFrame:
    """Counts (word, null, n) of words, the empty word being the ends, and (null, gram, n) of bytes
    together with the DEPTH bytes before, in texts that are not held out; grams that only texts held out
    have come with n = 0. Stored."""
    counts = map_batches(docs.select("text", "held_out"), _count, "word binary, gram bigint, n bigint")
    return stored(counts.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")


def fit_tree(counts: DataFrame, share: float) -> Tree:
    """The tree of the contexts that hold ``share`` of the bytes, which bounds what reaches the driver."""
    rows = counts.filter("gram IS NOT NULL AND n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    levels = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth"), F.col("gram"), "n"
    ).select(
        "depth",
        F.shiftright("gram", 8).bitwiseAND(F.expr("shiftleft(1L, 8 * depth) - 1")).alias("context"),
        F.col("gram").bitwiseAND(F.lit(255)).alias("byte"),
        "n",
    )
    bytes_ = levels.groupBy("depth", "context", "byte").agg(F.sum("n").alias("n"))
    # One row per byte and context; a context's bytes are few, so its row is small.
    contexts = bytes_.groupBy("depth", "context").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("byte", "n")).alias("bytes")
    )
    kept = contexts.filter(F.col("total") >= max(1, total * share))
    rows = kept.select("depth", "context", F.inline("bytes")).toArrow()
    return build_tree(*(rows[name].to_numpy() for name in ("depth", "context", "byte", "n")))


def _gram_keys(grams: np.ndarray) -> pa.Array:
    keys = np.empty((len(grams), 1 + 6), np.uint8)
    keys[:, 0] = GRAM_KEY[0]
    keys[:, 1:] = grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return pa.Array.from_buffers(pa.binary(7), len(grams), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def _scorer(model_handle, words_handle):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = model_handle.value, words_handle.value
        names = ["key", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "times"]
        for batch, texts in batched_texts(batches, 1 << 20):
            texts = [text.lower() for text in texts]
            scores, of, grams_, often = model.score(texts)
            scores = scores * np.log10(2.0)
            ids = batch.column("row").to_pylist()
            keys, rows, times, tokens, sure, base = [], [], [], [], [], []
            for row, text in zip(ids, texts):
                found = Counter(text.split())
                found[b""] = 1
                tokens.append(found.total())
                seen, logs = 0, 0.0
                for word, n in found.items():
                    value = known.get(word)
                    if value is None:
                        keys.append(word)
                        rows.append(row)
                        times.append(n)
                    else:
                        seen += n
                        logs += n * value
                sure.append(seen)
                base.append(logs)
            n = len(texts)
            whole = [
                pa.array([b" %d" % row for row in ids], pa.binary()), batch.column("row"), batch.column("doc_id"),
                batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(sure, pa.int64()),
                pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array([0] * n, pa.int64()),
            ]
            yield pa.record_batch(whole, names=names)
            for key, row, count in (
                (pa.array(keys, pa.binary()), pa.array(rows, pa.int64()), pa.array(times, pa.int64())),
                (_gram_keys(grams_), batch.column("row").take(pa.array(of)), pa.array(often, pa.int64())),
            ):
                if len(key):
                    nothing = [pa.nulls(len(key), whole[i].type) for i in range(2, 8)]
                    yield pa.record_batch([key, row, *nothing, count], names=names)

    return score


def score_documents(docs: DataFrame, share: float = 0.0, modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) modulo ``modulus`` is not ``held``; scores all. Texts are
    lower-cased in A-Z. Tokens are words between ASCII white space and one end per text. ``base_score``
    adds log10((c + 1) / (N + V + 1)) over tokens; ``score`` is the tree's log10 probability of the bytes
    and the end. A null text is empty, a null id counts as the empty text; repeated rows are scored each.
    With ``share`` the tree is cut as the module says. Without training rows every decision has a probability of a half and c, N and V are 0.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (remainder(modulus) == held).alias("held_out"))
    counts = count_corpus(rows)
    words = counts.filter("word IS NOT NULL").select("word", F.col("n").alias("c"))
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rest = words.select("word", "c", F.lit(None).cast("float").alias("log2"))
    if share:
        model = fit_tree(counts, share)
    else:
        chances = gram_chances(counts)
        first = chances.orderBy(F.desc("n"), "gram").limit(SENT_GRAMS).toArrow()
        model = Chances.of(first["gram"].to_numpy(), first["log2"].to_numpy())
        if len(first) == SENT_GRAMS:
            key = F.concat(F.lit(GRAM_KEY), F.unhex(F.lpad(F.hex("gram"), 12, "0")))
            rarer = chances.filter(F.col("n") <= first["n"][-1].as_py())
            rest = rest.unionByName(rarer.select(key.alias("word"), F.lit(None).cast("bigint").alias("c"), "log2"))
    unit = float(np.log10(tokens + kinds + 1))
    frequent = words.filter(F.octet_length("word") <= SENT_BYTES).orderBy(F.desc("c"), "word").limit(SENT_WORDS).toArrow()
    values = np.log10(np.array(frequent["c"], np.float64) + 1) - unit
    sent = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), values.tolist())))
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = map_batches(
        rows.withColumn("row", F.monotonically_increasing_id()),
        _scorer(spark.sparkContext.broadcast(model), sent),
        f"key binary, row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint,"
        " base double, score double, times bigint",
    )
    # Words and grams that were not sent are joined with theirs; every document brings a key of its own.
    joined = parts.join(rest, F.col("key") == F.col("word"), "left")
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (
            F.sum("base")
            + F.sum(
                F.when(F.col("log2").isNull(), F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(unit)))
                .otherwise(0.0)
            )
        ).alias("base_score"),
        (F.sum("score") + F.sum(F.coalesce(F.col("times") * F.col("log2") * F.log10(F.lit(2.0)), F.lit(0.0)))).alias("score"),
    ).drop("row")
