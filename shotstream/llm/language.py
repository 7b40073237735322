"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of two to four characters (lower-cased letters with their marks, everything
else one space) with weights ``(1 + ln tf) * idf``, scaled to unit length. The weights are learnt by
follow-the-regularised-leader steps with an elastic net: the L1 part leaves most of them at exactly zero,
the L2 part keeps the rest small. A last part of the sample sets the temperature of the softmax.

Document frequencies come from all training texts. The classifier knows the ``languages`` most frequent
values of lang (the first in order where equally frequent) and is fitted on a sample of about
``per_language`` different documents of each; prediction covers every row. The driver gets the sample's
n-gram counts, at most BUCKETS a document however long its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import batched_texts, map_batches, mix, remainder

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
PER_LANGUAGE = 500
LANGUAGES = 256
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_CHARACTERS = 1 << 20  # looked at together


def letters(text: bytes) -> str:
    """Lower-cased letters and their marks, one space for each run of anything else; empty without a
    letter (Unicode category L)."""
    words = _NOT_LETTERS.sub(" ", text.decode("utf-8", "replace").lower()).strip()
    return f" {words} " if _LETTER.search(words) else ""


def term_counts(plain: str) -> np.ndarray:
    """How often each bucket's n-grams occur."""
    total = np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for begin in range(0, len(plain), _CHARACTERS):
        for order in ORDERS:
            part = plain[begin : begin + _CHARACTERS + order - 1]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = len(points) - order + 1
            if n > 0:
                code = np.full(n, order, np.uint64)
                for i in range(order):
                    code = code * np.uint64(0x100000001B3) + points[i : i + n]
                total += np.bincount((mix(code) >> shift).astype(np.int64), minlength=BUCKETS)
    return total


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of unit length from buckets and counts."""
    weights = (1 + np.log(counts)) * idf[at]
    return at, weights / (np.sqrt((weights**2).sum()) or 1.0)


def vector(plain: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = term_counts(plain)
    at = np.flatnonzero(counts)
    return weighted(at, counts[at], idf)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _small(vector: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Half the memory; the sample is held whole while it is fitted."""
    return vector[0].astype(np.int32), vector[1].astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for _, texts in batched_texts(batches):
        for text in texts:
            seen += term_counts(letters(text)) > 0
            n += 1
    if n:
        at = np.concatenate((np.flatnonzero(seen), [BUCKETS]))  # the last row counts the texts
        yield pa.record_batch(
            [pa.array(at, pa.int64()), pa.array(np.concatenate((seen, [n]))[at], pa.int64())], names=["bucket", "n"]
        )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (uint16) and counts (uint32) of every text in place of the text."""
    for batch, texts in batched_texts(batches):
        found = [term_counts(letters(text)) for text in texts]
        at = [np.flatnonzero(counts) for counts in found]
        yield pa.record_batch(
            [
                *[batch.column(name) for name in ("doc_id", "text_hash", "lang")],
                pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                pa.array([c[a].astype(np.uint32).tobytes() for c, a in zip(found, at)], pa.binary()),
            ],
            names=["doc_id", "text_hash", "lang", "at", "counts"],
        )


def fit(
    vectors: list[tuple[np.ndarray, np.ndarray]], langs: list[str], classes: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, held: int = 5,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, intercepts and temperature. Every ``held``-th text is left for the temperature."""
    index = {c: i for i, c in enumerate(classes)}
    labels = [index[lang] for lang in langs]
    k = len(classes)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    thresholds = np.full((BUCKETS + 1, 1), l1)
    thresholds[-1] = 0.0  # the intercepts are not penalised

    def weights(at):
        part = z[at]
        shrunk = np.sign(part) * np.maximum(np.abs(part) - thresholds[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    learn = [i for i in range(len(vectors)) if i % held or len(vectors) < 2 * held]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(learn):
            at = np.append(vectors[i][0], BUCKETS)
            x = np.append(vectors[i][1], 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[labels[i]] -= 1
            gradient = x[:, None] * error
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    w = weights(np.arange(BUCKETS + 1))
    check = [i for i in range(len(vectors)) if i % held == 0] or learn
    logits = np.array([vectors[i][1] @ w[vectors[i][0]] + w[-1] for i in check])
    truth = np.array([labels[i] for i in check])
    scale = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-300).mean() for t in scale]
    return w[:-1], w[-1], float(scale[int(np.argmin(loss))])


def _predictor(handle, lang: str, score: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, idf, weights, bias, temperature = handle.value
        for batch, texts in batched_texts(batches):
            langs, scores = [], []
            for text in texts:
                plain = letters(text)
                if not plain or not classes:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = vector(plain, idf)
                p = softmax((x @ weights[at] + bias) / temperature)
                best = int(p.argmax())
                langs.append(classes[best])
                scores.append(float(p[best]))
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.record_batch(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, lang, score],
            )

    return predict


def fit_model(training: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES):
    """(classes, idf, weights, intercepts, temperature) from ``doc_id``, ``text`` and ``lang``."""
    totals = map_batches(training.select("text"), _frequencies, "bucket bigint, n bigint")
    rows = totals.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row per bucket
    seen = np.zeros(BUCKETS + 1)
    for bucket, n in rows:
        seen[bucket] = n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    sizes = training.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return [], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0
    classes = sorted(row["lang"] for row in sizes)
    sizes = training.sparkSession.createDataFrame(sizes, "lang string, count bigint")
    share = F.col("count") / per_language
    # The hash of id and text decides, so the sample is the same on every run, and null or repeated ids are
    # drawn no more often than others. Rows of the same id and text are one document.
    drawn = training.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(sizes), "lang")
    drawn = drawn.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) * share < (1 << 30))
    drawn = drawn.dropDuplicates(["doc_id", "text_hash", "lang"]).select("doc_id", "text_hash", "lang", "text")
    kind = training.schema["doc_id"].dataType.simpleString()
    sample = map_batches(drawn, _counts, f"doc_id {kind}, text_hash bigint, lang string, at binary, counts binary")
    sample = sample.toArrow().sort_by([("doc_id", "ascending"), ("text_hash", "ascending"), ("lang", "ascending")])
    langs = sample["lang"].to_pylist()
    vectors = [
        _small(weighted(np.frombuffer(at, np.uint16), np.frombuffer(counts, np.uint32), idf))
        for at, counts in zip(sample["at"].to_pylist(), sample["counts"].to_pylist())
    ]
    del sample
    return classes, idf, *fit(vectors, langs, classes)


def predict_language(
    docs: DataFrame, per_language: int = PER_LANGUAGE, modulus: int = 3, held: int = 1
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the calibrated probability).

    Learns from rows with text and lang whose crc32(doc_id) modulo ``modulus`` is not ``held``; predicts
    all rows from their text alone. ``und`` with score 0 for a null text, one without a letter, or when
    nothing could be learnt. Of equally probable languages the first in order is predicted. A null id
    counts as the empty text; repeated rows are predicted each, and learnt from once. Columns besides
    doc_id, text and lang are left out.
    """
    rows = docs.select("doc_id", "text", "lang", (remainder(modulus) == held).alias("held_out"))
    training = rows.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(fit_model(training, per_language))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        rows.drop("lang"), _predictor(model, "lang_pred", "score"), f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def keep_known(docs: DataFrame, min_score: float = 0.4, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents whose language is recognised, in the columns of ``docs``; ``lang`` becomes the
    predicted one. Rejected: no letters, or a calibrated probability below ``min_score``. Other columns
    pass through, whatever their names."""
    rows = docs.select("doc_id", "text", "lang")
    training = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(fit_model(training, per_language))
    # The text goes along under another name, so that it need not be joined back.
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    found = map_batches(
        docs.select(*others, F.col("text").alias("__text"), "text"),
        _predictor(model, "__lang", "__score"), f"{schema}, __text string, __lang string, __score double",
    )
    found = found.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score))
    return found.select(
        *[
            F.col("__text").alias("text") if c == "text" else F.col("__lang").alias("lang") if c == "lang" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )
