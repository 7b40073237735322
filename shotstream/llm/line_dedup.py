"""Reversible line dedup over a store of lines that documents are put into and taken out of.

A line's key is the line without spaces at its ends and with A-Z in lower case; keys count from
``min_chars`` code points. The store is a folder of Parquet tables in the cluster's file system:

- ``lines``: the keys of every document put in, as 128-bit digests,
- ``counts``: the exact reference count of every key, with the smallest and the largest id holding it,
- ``filters``: a cuckoo filter a shard of the key space, of bounded size,
- ``removed``: ids taken out.

Putting documents in first asks the filters. Keys they don't know are new and go straight into a new part
of the counts; only the others are joined with the exact counts. Taking documents out lowers the
counts, finds the next holder where the smallest or largest one goes, and deletes the fingerprints of keys
that nobody holds any more, so that inserting and deleting the same documents changes no answer. Tables
are only added; a manifest row written last makes a step valid, so a failed step leaves the store as it was.

A key that a third of all documents hold is added up before the shuffle; where documents look up their
keys, the at most ``HOT`` keys with more than a share of 1/HOT of the lines are sent to all tasks and the
others are joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotstream.llm.common import batched_texts, map_batches, texts_of
from shotstream.llm.cuckoo import SLOTS, CuckooFilter
from shotstream.session import work_dir

MIN_CHARS = 10
HOT = 10_000
SHARD_KEYS = 1 << 17
NO_ID = (1 << 63) - 1
_SPACES = b" \t\n\x0b\x0c\r"
KEY = ("k1", "k2")


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Digest of the line's key in two signed halves; None for keys too short to count."""
    key = line.strip(_SPACES).lower()  # lower() of bytes changes A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    value = xxhash.xxh3_128_intdigest(key)
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def _identified(docs: DataFrame) -> DataFrame:
    """doc and text_hash tell texts apart, also where one id, or none, stands in many rows."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", _doc().alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batched_texts(batches):
            rows, found = [], []
            for row, text in enumerate(texts):
                own = {line_key(line, min_chars) for line in text.split(b"\n")}
                own.discard(None)
                rows += [row] * len(own)
                found += own
            at = pa.array(rows, pa.int64())
            halves = np.array(found, np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [batch.column("doc").take(at), batch.column("text_hash").take(at), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc", "text_hash", *KEY],
            )

    return keys


COUNTS = "shard int, k1 bigint, k2 bigint, refs bigint, owner bigint, last bigint"
PROBED = f"{COUNTS}, known boolean, slots binary"


def _filter_of(rows: pa.Table, buckets: int) -> CuckooFilter:
    return CuckooFilter(buckets, rows.column("slots")[0].as_py() if rows.num_rows else None)


def _halves(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in KEY)


def _filter_row(rows: pa.Table, shard: int, cuckoo: CuckooFilter, schema: pa.Schema) -> pa.Table:
    last = {"shard": [shard], "slots": [cuckoo.to_bytes()]}
    extra = [pa.array(last.get(f.name, [None]), f.type) for f in schema]
    return pa.concat_tables([rows, pa.table(extra, schema=schema)])


_SCHEMA = pa.schema(
    [("shard", pa.int32()), *[(c, pa.int64()) for c in ("k1", "k2", "refs", "owner", "last")], ("known", pa.bool_()), ("slots", pa.binary())]
)


def _probe(buckets: int):
    """Keys of a shard, each marked whether the filter knows it, and the filter with all of them."""

    def probe(group: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
        cuckoo = _filter_of(filters, buckets)
        k1, k2 = _halves(keys)
        known = cuckoo.contains(k1, k2)
        cuckoo.insert(k1[~known], k2[~known])
        rows = keys.append_column("known", pa.array(known)).append_column("slots", pa.nulls(len(known), pa.binary()))
        return _filter_row(rows.select(_SCHEMA.names).cast(_SCHEMA), group[0].as_py(), cuckoo, _SCHEMA)

    return probe


_FILTERS = pa.schema([("shard", pa.int32()), ("slots", pa.binary())])


def _amend(buckets: int, gone: bool):
    """The filter of a shard without, or with, the keys."""

    def amend(group: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
        cuckoo = _filter_of(filters, buckets)
        (cuckoo.remove if gone else cuckoo.insert)(*_halves(keys))
        return pa.table({"shard": pa.array([group[0].as_py()], pa.int32()), "slots": pa.array([cuckoo.to_bytes()], pa.binary())})

    return amend


class LineStore:
    """A store in ``folder``, created when its first documents are put in.

    ``insert`` puts documents in, ``delete`` takes ids out, ``clean`` drops repeated lines. An id is a
    document: inserting an id that is there replaces it, and rows of one id in one call are one document
    with the keys of all. A null id counts as the id 2^63-1. Null texts are empty; lines are cut at \\n.
    """

    def __init__(self, spark: SparkSession, folder: str, min_chars: int = MIN_CHARS):
        self.spark, self.folder, self.min_chars = spark, folder.rstrip("/"), min_chars
        self.step, self.shards, self.buckets, self.rows = 0, 0, 0, 0
        self.tables: dict[str, list[str]] = {"lines": [], "counts": [], "removed": [], "filters": []}
        if self._exists("manifest"):
            last = self.spark.read.json(f"{self.folder}/manifest").orderBy(F.desc("step")).first()
            self.step, self.shards, self.buckets, self.rows = last["step"], last["shards"], last["buckets"], last["rows"]
            self.tables = json.loads(last["tables"])

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, df: DataFrame, name: str) -> str:
        """A table of the running step; what a failed try left there is overwritten."""
        path = f"{name}/step={self.step + 1:06d}"
        df.write.mode("overwrite").parquet(f"{self.folder}/{path}")
        return path

    def _read(self, name: str, schema: str, paths: list[str] | None = None) -> DataFrame:
        """All parts of a table, ``step`` telling which step wrote a row."""
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.folder}/{p}").withColumn("step", F.lit(int(p.rsplit("=", 1)[1])))
            for p in (self.tables[name] if paths is None else paths)
        ]
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, step int")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _commit(self, tables: dict[str, list[str]], rows: int) -> None:
        state = (self.step + 1, self.shards, self.buckets, rows, json.dumps(tables))
        row = self.spark.createDataFrame([state], "step int, shards int, buckets int, rows bigint, tables string")
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        self.step, self.rows, self.tables = self.step + 1, rows, tables

    def lines(self) -> DataFrame:
        """doc, text_hash, k1, k2 of all documents in the store."""
        rows = self._read("lines", "doc bigint, text_hash bigint, k1 bigint, k2 bigint")
        if self.tables["removed"]:
            gone = self._read("removed", "doc bigint").groupBy("doc").agg(F.max("step").alias("gone"))
            rows = rows.join(gone, "doc", "left").where("gone is null or step > gone").drop("gone")
        return rows.drop("step")

    def counts(self) -> DataFrame:
        """shard, k1, k2, refs, owner, last of all keys held: references, smallest and largest id."""
        rows = self._read("counts", COUNTS)
        if len(self.tables["counts"]) > 1:
            value = F.max_by(F.struct("refs", "owner", "last"), "step").alias("v")
            rows = rows.groupBy("shard", *KEY).agg(value).select("shard", *KEY, "v.*")
        return rows.drop("step").where("refs > 0")

    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, slots binary").drop("step")

    def _shard(self) -> Column:
        return F.shiftrightunsigned("k1", 65 - self.shards.bit_length()).cast("int")

    def keys_of(self, docs: DataFrame) -> DataFrame:
        """doc, text_hash, k1, k2: the keys of every text, each once a text."""
        return map_batches(
            _identified(docs).drop("doc_id"), _keys(self.min_chars),
            "doc bigint, text_hash bigint, k1 bigint, k2 bigint",
        )

    def insert(self, docs: DataFrame) -> None:
        path = f"incoming/step={self.step + 1:06d}"
        self.keys_of(docs).write.mode("overwrite").parquet(f"{self.folder}/{path}")
        if self.tables["lines"]:
            ids = docs.select(_doc().alias("doc")).distinct()
            present = self._read("lines", "doc bigint").drop("step").join(ids, "doc", "left_semi").distinct()
            if not present.isEmpty():
                self._delete(present)
        self._add(self.spark.read.parquet(f"{self.folder}/{path}"))

    def insert_in_rounds(self, docs: DataFrame, rounds: int) -> None:
        """``insert`` of all documents by ``rounds`` disjoint sets of new ids, reading the texts once."""
        path = work_dir(self.spark, "line_keys")
        self.keys_of(docs).write.parquet(path)
        rows = self.spark.read.parquet(path)
        for i in range(rounds):
            self._add(rows.where(F.pmod(F.xxhash64("doc"), F.lit(rounds)) == i))

    def _size(self, rows: int) -> None:
        """Shards for so many keys; the filters are built anew from the exact counts when they become too full."""
        fit = max(8, 1 << max(0, (2 * rows // SHARD_KEYS).bit_length()))
        if not self.shards:
            self.shards = fit
            per_shard = min(SHARD_KEYS, 2 * rows // fit + 64)
            self.buckets = 1 << max(4, (int(per_shard / 0.8) // SLOTS).bit_length())
        elif rows // self.shards > 2 * SHARD_KEYS:
            self._reshard(fit)

    def _reshard(self, shards: int) -> None:
        self.shards = shards
        self.buckets = 1 << (int(SHARD_KEYS / 0.8) // SLOTS).bit_length()
        keys = self.counts().withColumn("shard", self._shard())
        counts = self._write(keys, "counts")
        empty = self.spark.createDataFrame([], "shard int, slots binary").groupBy("shard")
        keys = self._read("counts", COUNTS, [counts]).select("shard", *KEY).groupBy("shard")
        filters = self._write(keys.cogroup(empty).applyInArrow(_amend(self.buckets, False), "shard int, slots binary"), "filters")
        self._commit({**self.tables, "counts": [counts], "filters": [filters]}, self.rows)

    def _add(self, rows: DataFrame) -> None:
        rows_path = self._write(rows.select("doc", "text_hash", *KEY), "lines")
        rows = self._read("lines", "doc bigint, text_hash bigint, k1 bigint, k2 bigint", [rows_path]).drop("step")
        n = rows.count()
        before = self.step
        self._size(self.rows + n)
        if self.step != before:  # a change of the shards took this step's number
            rows_path = self._write(rows, "lines")
        keys = rows.groupBy(*KEY).agg(
            F.count("*").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last")
        )
        keys = keys.withColumn("shard", self._shard())
        probed = keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probe(self.buckets), PROBED)
        probed_path = self._write(probed, "probed")
        probed = self._read("probed", PROBED, [probed_path]).drop("step")
        filters = self._write(probed.where("slots is not null").select("shard", "slots"), "filters")
        # A filter row for every shard: those without new keys come with an empty group of keys.
        keys = probed.where("slots is null").drop("slots")
        fresh = keys.where("not known").drop("known")
        held = self.counts().select(*KEY, *[F.col(c).alias(f"{c}_held") for c in ("refs", "owner", "last")])
        merged = keys.where("known").join(held, [*KEY], "left").select(
            "shard", *KEY,
            (F.col("refs") + F.coalesce("refs_held", F.lit(0))).alias("refs"),
            F.least("owner", "owner_held").alias("owner"),
            F.greatest("last", "last_held").alias("last"),
        )
        counts = self._write(fresh.unionByName(merged), "counts")
        tables = {
            **self.tables, "filters": [filters],
            "lines": [*self.tables["lines"], rows_path], "counts": [*self.tables["counts"], counts],
        }
        self._commit(tables, self.rows + n)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents whose ``doc_id`` stands in ``ids``; ids that are not there are ignored."""
        self._delete(ids.select(_doc().alias("doc")).distinct())

    def _delete(self, ids: DataFrame) -> None:
        if not self.tables["lines"]:
            return
        removed = self._write(ids, "removed")
        gone_ids = self._read("removed", "doc bigint", [removed]).drop("step")
        lines = self.lines()
        going = lines.join(gone_ids, "doc", "left_semi").groupBy(*KEY).agg(
            F.count("*").alias("less"), F.min("doc").alias("low"), F.max("doc").alias("high")
        )
        touched_path = self._write(
            self.counts().join(going, [*KEY]).withColumn("refs", F.col("refs") - F.col("less")).drop("less"), "touched"
        )
        touched = self._read("touched", f"{COUNTS}, low bigint, high bigint", [touched_path]).drop("step")
        moved = touched.where("refs > 0 and (low = owner or high = last)").select(*KEY)
        rest = lines.join(moved, [*KEY], "left_semi").join(gone_ids, "doc", "left_anti").groupBy(*KEY).agg(
            F.min("doc").alias("new_owner"), F.max("doc").alias("new_last")
        )
        counts = touched.drop("low", "high").join(rest, [*KEY], "left").select(
            "shard", *KEY, "refs", F.coalesce("new_owner", "owner").alias("owner"), F.coalesce("new_last", "last").alias("last")
        )
        counts_path = self._write(counts, "counts")
        dead = touched.where("refs = 0").select("shard", *KEY).groupBy("shard")
        filters = self._write(dead.cogroup(self.filters().groupBy("shard")).applyInArrow(_amend(self.buckets, True), "shard int, slots binary"), "filters")
        tables = {
            **self.tables, "filters": [filters],
            "removed": [*self.tables["removed"], removed], "counts": [*self.tables["counts"], counts_path],
        }
        self._commit(tables, self.rows)

    def repeated(self) -> DataFrame:
        """Keys that at least two ids hold: k1, k2, refs, owner."""
        return self.counts().where("owner < last").select(*KEY, "refs", "owner")

    def verdicts(self, lines: DataFrame) -> DataFrame:
        """doc, text_hash and the keys that the text loses, for texts that lose any."""
        repeated = self.repeated()
        hot = repeated.where(F.col("refs") * HOT > self.rows).select(*KEY, F.col("owner").alias("hot_owner"))
        cold = repeated.where(F.col("refs") * HOT <= self.rows).select(*KEY, "owner")
        lines = lines.join(F.broadcast(hot), [*KEY], "left")
        lost = lines.where("hot_owner <> doc").select("doc", "text_hash", *KEY).unionByName(
            lines.where("hot_owner is null").join(cold, [*KEY]).where("owner <> doc").select("doc", "text_hash", *KEY)
        )
        return lost.groupBy("doc", "text_hash").agg(F.collect_set(F.struct(*KEY)).alias("lost")).select(
            "doc", "text_hash", F.col("lost.k1").alias("lost1"), F.col("lost.k2").alias("lost2")
        )

    def clean(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of every row of ``docs``.

        A line goes when its key is in the store with two ids or more and the smallest is not this row's.
        ``docs`` may be in the store or not. ``lines`` spares reading them again when known. Columns of
        ``docs`` besides doc_id and text are left out; a text without lines left is empty.
        """
        verdicts = self.verdicts(self.keys_of(docs) if lines is None else lines)
        rows = _identified(docs).join(verdicts.hint("shuffle_hash"), ["doc", "text_hash"], "left")
        kind = docs.schema["doc_id"].dataType.simpleString()
        return map_batches(
            rows.select("doc_id", "text", "lost1", "lost2"), _without(self.min_chars),
            f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_text string",
        )


def _without(min_chars: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batched_texts(batches):
            firsts, seconds = batch.column("lost1").to_pylist(), batch.column("lost2").to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for text, first, second in zip(texts, firsts, seconds):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if first:
                    lost = set(zip(first, second))
                    lines = [line for line in lines if line_key(line, min_chars) not in lost]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines) if n_dropped[-1] else text)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    return drop


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, rounds: int = 2) -> DataFrame:
    """``docs`` without lines that a document of smaller id holds, by a store made for them.

    The documents come in ``rounds`` sets, so that all but the first meet filters and counts that hold
    the earlier ones. See ``LineStore.clean`` for the columns.
    """
    store = LineStore(docs.sparkSession, work_dir(docs.sparkSession, "line_store"), min_chars)
    store.insert_in_rounds(docs, rounds)
    return store.clean(docs, store.lines())
