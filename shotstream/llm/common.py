"""Helpers the text operators share: tables, Arrow batches, word hashes, stored intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotstream.session import work_dir

# Rows per Arrow batch. Texts may be megabytes long, so batches of texts are kept short.
BATCH_ROWS = 500
# ASCII characters other than letters and digits end a word in the near-duplicate operators.
SEPARATORS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
WORD_SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: Callable, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with short batches. ``function`` takes and yields ``pyarrow.RecordBatch``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    """The id as text, a null id being the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_key(column).cast("binary")) % modulus


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; forgets everything when full so that memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(text: bytes) -> list[bytes]:
    """Lower-case words of letters and digits; every other ASCII character separates."""
    return text.decode("utf-8", "replace").lower().encode().translate(SEPARATORS).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def batched_texts(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the incoming batches of about ``limit`` bytes of text, at least a row each."""
    for batch in batches:
        texts = texts_of(batch)
        begin, size = 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
