"""Tables that grow by parts: upserts and appends that touch what they must, snapshots that stay readable.

Rows lie in cells, a bucket (hash of one column) by a slice (range of time), inside the parts that wrote them:
``data/part=<id>/_bucket=<b>/_slice=<s>``. A write adds one part with the cells its rows fall into. A
version is a folder of the log that says which cells of which parts came and which went; it counts once it
is complete, and is written last. So a write that fails leaves the last version as it was.

Reading merges the parts of a cell, the last write of a key winning; cells of one part are read as they
are. A write takes older parts of its cells along while they are not twice as large as what is
newer. That keeps the parts of a cell few (a logarithm of its rows), and what is written follows the rows
written, not the table: a row is rewritten as often as its part has doubled.

A Bloom filter a cell, if the layout asks for it, tells an append which cells may hold its keys; no
other files are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotstream.operators.upsert import latest_by_key

CELL = ("part", "_bucket", "_slice")
_LOG = "added boolean, part string, _bucket int, _slice bigint, rows bigint, bloom binary"
# Up to so many cells are named to the reader; more are found by a join with the list of live cells.
NAMED_CELLS = 4096
FULL_EVERY = 16
KEPT_VERSIONS = 2
WRITERS = 4
BITS_A_KEY, PROBES, MOST_BITS = 16, 6, 1 << 24


@dataclass(frozen=True)
class Layout:
    """``keys`` identify a row, ``order`` columns (kept in the table) decide between rows of one key, then
    the later write. ``spread`` is hashed to ``buckets``; ``time`` is cut into slices of ``slice_width``."""

    schema: str
    keys: tuple[str, ...]
    spread: str
    buckets: int = 64
    order: tuple[str, ...] = ()
    time: str | None = None
    slice_width: int = 1
    bloom: bool = False


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Positions of each hash in a filter of ``size`` bits: double hashing with its two halves."""
    value = hashes.view(np.uint64)
    first, step = value & np.uint64(0xFFFFFFFF), (value >> np.uint64(32)) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


def bloom_of(hashes: np.ndarray) -> bytes:
    size = min(MOST_BITS, max(64, -(-len(hashes) * BITS_A_KEY // 8) * 8))
    bits = np.zeros(size, bool)
    bits[_bits(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
    return bits[_bits(hashes, len(bits))].all(axis=1)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _cell_bloom(group: tuple, rows: pa.Table) -> pa.Table:
    key = [g.as_py() for g in group]
    return pa.table(
        {"_bucket": pa.array([key[0]], pa.int32()), "_slice": pa.array([key[1]], pa.int64()), "bloom": pa.array([bloom_of(_column(rows, "h"))], pa.binary())}
    )


def _candidates(group: tuple, asked: pa.Table, cells: pa.Table) -> pa.Table:
    """Cells whose filter knows one of the hashes; a cell without a filter may hold any."""
    keep = []
    if asked.num_rows:
        hashes = _column(asked, "h")
        keep = [i for i, bloom in enumerate(cells.column("bloom").to_pylist()) if bloom is None or may_hold(bloom, hashes).any()]
    return cells.select(list(CELL)).take(pa.array(keep, pa.int64()))


class SnapshotTable:
    """A table in ``path``. Its methods may run again after a failure; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout) -> None:
        self.spark, self.path, self.layout = spark, path.rstrip("/"), layout

    @classmethod
    def create(cls, spark: SparkSession, path: str, layout: Layout) -> SnapshotTable:
        table = cls(spark, path, layout)
        row = spark.createDataFrame([(json.dumps(asdict(layout)),)], "layout string")
        row.coalesce(1).write.json(f"{table.path}/layout")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SnapshotTable:
        stored = json.loads(spark.read.schema("layout string").json(f"{path.rstrip('/')}/layout").first()["layout"])
        return cls(spark, path, Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items()}))

    def _file_system(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _versions(self) -> dict[int, list[str]]:
        """Folders of complete versions; a number may have a step and a full list."""
        fs, root = self._file_system(f"{self.path}/log")
        found: dict[int, list[str]] = {}
        if fs.exists(root):
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if fs.exists(self._file_system(f"{self.path}/log/{name}/_SUCCESS")[1]):
                    found.setdefault(int(name.split("=")[1].split("-")[0]), []).append(name)
        return found

    def version(self) -> int:
        """The last complete version; 0 for an empty table."""
        return max(self._versions(), default=0)

    def cells(self, version: int | None = None) -> DataFrame:
        """part, _bucket, _slice, rows, bloom of the cells that are live in a version."""
        found = {v: names for v, names in self._versions().items() if version is None or v <= version}
        full = max((v for v, names in found.items() if any(n.endswith("-full") for n in names)), default=0)
        paths = [f"{self.path}/log/{n}" for v, names in found.items() for n in names if (v == full and n.endswith("-full")) or (v > full and not n.endswith("-full"))]
        if not paths:
            return self.spark.createDataFrame([], _LOG).drop("added")
        log = self.spark.read.schema(_LOG).parquet(*paths)
        # A cell of a part comes once and goes once.
        state = log.groupBy(*CELL).agg(F.min("added").alias("added"), F.max("rows").alias("rows"), F.max_by("bloom", "added").alias("bloom"))
        return state.where("added").select(*CELL, "rows", "bloom")

    def _placed(self, rows: DataFrame) -> DataFrame:
        at = self.layout
        piece = F.expr(f"`{at.time}` div {at.slice_width}L") if at.time else F.lit(0)
        return rows.withColumns(
            {
                "_bucket": F.pmod(F.xxhash64(at.spread), F.lit(at.buckets)).cast("int"),
                "_slice": F.coalesce(piece.cast("bigint"), F.lit(-1).cast("bigint")),
            }
        )

    def _scan(self, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of cells with a single part, and of the others, each with part, _bucket and _slice."""
        counted = cells.select(*CELL, F.count("*").over(Window.partitionBy("_bucket", "_slice")).alias("_parts"))
        named = [tuple(row) for row in counted.limit(NAMED_CELLS + 1).collect()]
        schema = f"{self.layout.schema}, part string, _bucket int, _slice bigint"
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        if len(named) > NAMED_CELLS:
            parts = [row["part"] for row in cells.select("part").distinct().collect()]
            rows = reader.parquet(*[f"{self.path}/data/part={p}" for p in parts]).join(counted, [*CELL])
            return rows.where("_parts = 1").drop("_parts"), rows.where("_parts > 1").drop("_parts")

        return self._named([c[:3] for c in named if c[3] == 1]), self._named([c[:3] for c in named if c[3] > 1])

    def _named(self, cells: list[tuple]) -> DataFrame:
        """Rows of the cells (part, bucket, slice)."""
        schema = f"{self.layout.schema}, part string, _bucket int, _slice bigint"
        paths = [f"{self.path}/data/part={p}/_bucket={b}/_slice={s}" for p, b, s in cells]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def _latest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in CELL]
        return latest_by_key(rows.drop("_bucket", "_slice"), self.layout.keys, [*self.layout.order, "part"], keep_arrival=True).select(*columns)

    def _merged(self, cells: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        single, several = self._scan(cells)
        if keys is not None:
            single, several = (part.join(keys, [*self.layout.keys], "left_semi") for part in (single, several))
        return single.drop(*CELL).unionByName(self._latest(several))

    def read(self, value=None, low: int | None = None, high: int | None = None, version: int | None = None) -> DataFrame:
        """The rows; with a ``value`` of the spread column, or bounds of time, only the cells they lie in."""
        cells, at = self.cells(version), self.layout
        if value is not None:
            cells = cells.where(F.col("_bucket") == F.pmod(F.xxhash64(F.lit(value)), F.lit(at.buckets)).cast("int"))
        bounds = [(F.col(at.time) >= low, f"_slice >= {low}L div {at.slice_width}L") for low in [low] if low is not None]
        bounds += [(F.col(at.time) <= high, f"_slice <= {high}L div {at.slice_width}L") for high in [high] if high is not None]
        for _, on_cells in bounds:
            cells = cells.where(on_cells)
        rows = self._merged(cells)
        if value is not None:
            rows = rows.where(F.col(at.spread) == F.lit(value))
        for on_rows, _ in bounds:
            rows = rows.where(on_rows)
        return rows

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the given keys. ``keys`` has the columns that place a row besides the keys."""
        placed = self._placed(keys)
        touched = placed.select("_bucket", "_slice").distinct()
        return self._merged(self.cells(version).join(touched, ["_bucket", "_slice"], "left_semi"), placed.select(*self.layout.keys).distinct())

    def upsert(self, rows: DataFrame, version: int | None = None, alive: Column | None = None) -> int:
        """Merge rows in, last write wins; returns the new version.

        A ``version`` to build on makes a repeated write replace the version after it. Older rows for which
        ``alive`` is not true are left behind when their part is merged.
        """
        base = self.version() if version is None else version
        columns = [c for c in rows.columns if c in self._names()]
        fresh = rows.select(*columns)
        if self.layout.order:
            fresh = latest_by_key(fresh, self.layout.keys, self.layout.order, keep_arrival=True)
        else:
            fresh = fresh.dropDuplicates([*self.layout.keys])
        fresh = self._placed(fresh.select(*columns))
        stage = self._write(fresh, base, "new")
        added = self._entries(stage)
        # The driver gets a few short rows a cell that the batch touches.
        merging = self._worth_merging(added.select("_bucket", "_slice", "rows"), base)
        if not merging:
            self._commit(added, [], base)
            return base + 1
        old = self._named([c[:3] for c in merging])
        if alive is not None:
            old = old.where(alive)
        cells = F.broadcast(self.spark.createDataFrame(list({c[1:3] for c in merging}), "_bucket int, _slice bigint"))
        new = self._named([(stage, "*", "*")])
        both = old.unionByName(new.join(cells, ["_bucket", "_slice"], "left_semi").select(*old.columns))
        kept = new.join(cells, ["_bucket", "_slice"], "left_anti").select(*columns)
        whole = self._write(self._placed(self._latest(both).select(*columns).unionByName(kept)), base, "all")
        self._commit(self._entries(whole), merging, base)
        self._delete(stage)
        return base + 1

    def _worth_merging(self, added: DataFrame, base: int) -> list[tuple]:
        """(part, bucket, slice, rows) of the cells to merge with what was added: from the newest part back to the
        oldest one that is less than twice as large as all that is newer."""
        newer = {(c["_bucket"], c["_slice"]): c["rows"] for c in added.collect()}
        if not newer or not base:
            return []
        places = self.spark.createDataFrame(list(newer), "_bucket int, _slice bigint")
        touched = self.cells(base).join(F.broadcast(places), ["_bucket", "_slice"], "left_semi").select(*CELL, "rows").collect()
        passed: dict[tuple, list[tuple]] = {}
        merging: list[tuple] = []
        for cell in sorted(map(tuple, touched), reverse=True):  # the newest part first
            place = cell[1:3]
            passed.setdefault(place, []).append(cell)
            if cell[3] < 2 * newer[place]:
                merging += passed.pop(place)
            newer[place] += cell[3]
        return merging

    def append(self, rows: DataFrame) -> int:
        """Add the rows whose key is not there, once each; returns how many cells were read for that.

        Replaying an append adds nothing. Cells are read if their filter knows one of the new keys.
        """
        base = self.version()
        rows = rows.select(*self._names()).dropDuplicates([*self.layout.keys])
        hashed = self._placed(rows).select("_bucket", "_slice", F.xxhash64(*self.layout.keys).alias("h"))
        cells = self.cells(base).select(*CELL, "bloom")
        asked = hashed.groupBy("_bucket", "_slice").cogroup(cells.groupBy("_bucket", "_slice"))
        near = asked.applyInArrow(_candidates, "part string, _bucket int, _slice bigint")
        near = [tuple(row) for row in near.collect()]
        held = self._named(near).select(*self.layout.keys)
        fresh = rows.join(held, [*self.layout.keys], "left_anti").select(*self._names())
        part = self._write(self._placed(fresh), base, "new")
        added = self._entries(part)
        if added.isEmpty():
            self._delete(part)
        else:
            self._commit(added, None, base)
        return len(near)

    def _names(self) -> list[str]:
        return self.spark.createDataFrame([], self.layout.schema).columns

    def _write(self, placed: DataFrame, base: int, kind: str) -> str:
        """Write a part, each cell by WRITERS tasks, sorted by key."""
        part = f"{base + 1:08d}-{kind}-{uuid.uuid4().hex[:12]}"
        order = ["_bucket", "_slice", *self.layout.keys]
        spread = placed.repartition("_bucket", "_slice", F.pmod(F.xxhash64(*self.layout.keys), F.lit(WRITERS)))
        spread.sortWithinPartitions(*order).write.partitionBy("_bucket", "_slice").parquet(f"{self.path}/data/part={part}")
        return part

    def _entries(self, part: str) -> DataFrame:
        fs, root = self._file_system(f"{self.path}/data/part={part}")
        if not any(s.isDirectory() for s in fs.listStatus(root)):  # no rows were written
            return self.spark.createDataFrame([], _LOG)
        rows = self._named([(part, "*", "*")])
        counts = rows.groupBy("_bucket", "_slice").agg(F.count("*").alias("rows"))
        if not self.layout.bloom:
            entries = [(True, part, c["_bucket"], c["_slice"], c["rows"], None) for c in counts.collect()]
            return self.spark.createDataFrame(entries, _LOG)
        hashed = rows.select("_bucket", "_slice", F.xxhash64(*self.layout.keys).alias("h"))
        blooms = hashed.groupBy("_bucket", "_slice").applyInArrow(_cell_bloom, "_bucket int, _slice bigint, bloom binary")
        entries = counts.join(blooms, ["_bucket", "_slice"])
        return entries.select(F.lit(True).alias("added"), F.lit(part).alias("part"), "_bucket", "_slice", "rows", "bloom")

    def _commit(self, added: DataFrame, removed: list[tuple], base: int) -> None:
        entries = added
        if removed:
            gone = self.spark.createDataFrame([(False, *c, None) for c in removed], _LOG)
            entries = entries.unionByName(gone)
        name = f"version={base + 1:08d}"
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        if (base + 1) % FULL_EVERY == 0:
            live = self.cells(base + 1).select(F.lit(True).alias("added"), *CELL, "rows", "bloom")
            live.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{name}-full")
        # Files of cells that went in a version which no reader asks for any more are deleted.
        old = base + 1 - KEPT_VERSIONS
        if f"version={old:08d}" in self._versions().get(old, []):
            log = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/version={old:08d}")
            for c in log.where("not added").select(*CELL).collect():
                self._delete(f"{c['part']}/_bucket={c['_bucket']}/_slice={c['_slice']}")

    def _delete(self, below: str) -> None:
        fs, target = self._file_system(f"{self.path}/data/part={below}")
        fs.delete(target, True)


def rows_and_files(table: SnapshotTable) -> Sequence[int]:
    """Live rows as written (before merging) and live cells."""
    row = table.cells().agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    return row[0], row[1]
