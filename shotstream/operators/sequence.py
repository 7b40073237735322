"""Ordered per-key computation that does not put a whole key into one task.

A plain ``Window.partitionBy(key)`` gives each key one task. That is right while keys are small and
wrong when one shot holds a large part of the data, so every ordered operator comes through here:

* the row count of the largest key is measured (one scalar, read from the key columns only);
* keys that fit keep the plain window, which costs one shuffle, into tasks of a bounded number of rows;
* otherwise rows get their position in the key from slices of about equal row count (counts per slice,
  prefix sum over the slice table, row number inside a slice), and work is cut into chunks. A
  bounded look-back is served by copying the last rows of a chunk into the next one; an unbounded
  look-back by carrying one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shotstream.session import work_dir


@dataclass(frozen=True)
class Limits:
    """Row budgets of one task group, and of a task with whole keys. ``known`` holds bounds on the rows of the largest key, by key columns,
    ``rows`` one on all rows; operators that get them do not count again."""

    key_rows: int = 250_000
    slice_rows: int = 50_000
    chunk_rows: int = 50_000
    task_rows: int = 250_000
    known: tuple[tuple[tuple[str, ...], int], ...] = ()
    rows: int | None = None


DEFAULT_LIMITS = Limits()


def largest_key_fits(df: DataFrame, keys: Sequence[str], limits: Limits) -> bool:
    return dict(measured(df, keys, limits).known)[tuple(keys)] <= limits.key_rows


def measured(df: DataFrame, keys: Sequence[str], limits: Limits) -> Limits:
    """The limits with the rows of the largest key and all rows of ``df``, for a chain of operators none of which adds
    rows to a key: counted once, at the source."""
    if tuple(keys) in dict(limits.known):
        return limits
    largest, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return replace(limits, known=(*limits.known, (tuple(keys), largest or 0)), rows=max(rows or 0, limits.rows or 0))


def spread(df: DataFrame, keys: Sequence[str], rows: int | None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Keys dealt over tasks of about ``task_rows`` rows. A plain shuffle is coalesced by its compressed
    bytes, so that its tasks grow with the table; few rows are left to it."""
    if rows is None or rows <= limits.task_rows:
        return df
    return df.repartition(max(-(-rows // limits.task_rows), df.sparkSession.sparkContext.defaultParallelism), *keys)


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Limits) -> DataFrame:
    """Add ``_key`` and ``_slice``: each key's rows in order, cut into slices of about ``slice_rows``.

    Slices are the partitions of a range repartitioning by key and order. Its edges are quantiles of the
    rows, so bursts, sparse keys and null order values (which come first, as in a plain window) make no
    slice larger. A hash of the row is the last sort key: even equal order values are spread. The result
    is stored, because its edges come from a sample and must not be drawn twice.
    """
    parts = max(1, -(-df.count() // limits.slice_rows))
    # Maps cannot be hashed; rows that differ in a map only are spread no further.
    plain = [F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t]
    ranged = df.repartitionByRange(parts, *keys, *order, F.xxhash64(*plain))
    path = work_dir(df.sparkSession, "slices")
    ranged.withColumn("_slice", F.spark_partition_id()).write.parquet(path)
    # Two structs with null fields are equal, two nulls are not: joining on a struct of the keys
    # keeps rows whose key is null.
    stored = df.sparkSession.read.schema(f"{_ddl(df)}, _slice int").parquet(path)
    return stored.withColumn("_key", F.struct(*keys))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


_SLICE = ("_key", "_slice")


def _before(*parts: str) -> WindowSpec:
    return Window.partitionBy(*parts).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Limits) -> DataFrame:
    sliced = _sliced(df, keys, order, limits)
    offsets = (
        sliced.groupBy(*_SLICE)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*_SLICE, F.coalesce(F.sum("_rows").over(_before("_key")), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*_SLICE).orderBy(*order)
    return (
        sliced.join(offsets, [*_SLICE])
        .withColumn("pos", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop(*_SLICE, "_offset")
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``pos``, the 0-based row number of each row in its key. Rows equal in ``order`` come in any
    order among themselves; state an order that tells rows apart where that matters."""
    limits = measured(df, keys, limits)
    if largest_key_fits(df, keys, limits):
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return spread(df, keys, limits.rows, limits).withColumn("pos", number.cast("bigint") - 1)
    return _ranked(df, keys, order, limits)


@dataclass(frozen=True)
class Chunks:
    """Rows ready for windows that look back a bounded number of rows."""

    rows: DataFrame
    parts: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def owned(self, df: DataFrame) -> DataFrame:
        """Drop the copied rows again."""
        return df.filter("_own").drop("_own", "_chunk") if self.chunked else df


def chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    limits: Limits = DEFAULT_LIMITS,
) -> Chunks:
    """Partition each key so that every row sees its ``lookback`` predecessors. Adds ``pos``."""
    limits = measured(df, keys, limits)
    if largest_key_fits(df, keys, limits):
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = spread(df, keys, limits.rows, limits).withColumn("pos", number.cast("bigint") - 1)
        return Chunks(rows, tuple(keys), tuple(order), chunked=False)
    size = max(limits.chunk_rows, lookback, 1)
    home = F.expr(f"pos div {size}L")
    copies = F.when(F.col("pos") % size >= size - lookback, 1).otherwise(0)
    rows = (
        _ranked(df, keys, order, limits)
        .withColumn("_chunk", F.explode(F.sequence(home, home + copies)))
        .withColumn("_own", F.col("_chunk") == home)
    )
    return Chunks(rows, (*keys, "_chunk"), tuple(order), chunked=True)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add, per name, the latest non-null value at or before each row of its key."""
    for name, value in values.items():
        df = df.withColumn(name, value)
    upto = (Window.unboundedPreceding, 0)
    limits = measured(df, keys, limits)
    if largest_key_fits(df, keys, limits):
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return spread(df, keys, limits.rows, limits).withColumns({n: F.last(n, ignorenulls=True).over(window) for n in values})
    sliced = _sliced(df, keys, order, limits)
    latest = [
        F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(f"_carry_{n}")
        for n in values
    ]
    before = _before("_key")
    carries = (
        sliced.groupBy(*_SLICE)
        .agg(*latest)
        .withColumns(
            {f"_carry_{n}": F.last(f"_carry_{n}", ignorenulls=True).over(before) for n in values}
        )
    )
    inside = Window.partitionBy(*_SLICE).orderBy(*order).rowsBetween(*upto)
    return (
        sliced.join(carries, [*_SLICE])
        .withColumns(
            {
                n: F.coalesce(F.last(n, ignorenulls=True).over(inside), F.col(f"_carry_{n}"))
                for n in values
            }
        )
        .drop(*_SLICE, *[f"_carry_{n}" for n in values])
    )


def running_max_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    name: str,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add the largest ``column`` among strictly earlier rows of the key (null for the first)."""
    earlier = (Window.unboundedPreceding, -1)
    limits = measured(df, keys, limits)
    if largest_key_fits(df, keys, limits):
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
        return spread(df, keys, limits.rows, limits).withColumn(name, F.max(column).over(window))
    sliced = _sliced(df, keys, order, limits)
    carries = (
        sliced.groupBy(*_SLICE)
        .agg(F.max(column).alias("_carry"))
        .withColumn("_carry", F.max("_carry").over(_before("_key")))
    )
    inside = Window.partitionBy(*_SLICE).orderBy(*order).rowsBetween(*earlier)
    return (
        sliced.join(carries, [*_SLICE])
        .withColumn(name, F.greatest(F.max(column).over(inside), F.col("_carry")))
        .drop(*_SLICE, "_carry")
    )


# A dimension is broadcast up to so many rows and bytes.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def dimension_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = 32,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join facts to a narrow table with one row per key.

    The rows of the dimension and the bytes of its texts are counted first. Few enough are broadcast,
    which leaves the facts where they are; more are joined by shuffle with a hot key spread over
    ``salts`` partitions. Both ways give the same rows.
    """
    texts = [F.coalesce(F.octet_length(n), F.lit(0)) for n, t in dimension.dtypes if t in ("string", "binary")]
    width = reduce(lambda a, b: a + b, texts, F.lit(24 + 16 * len(dimension.columns)))
    seen = dimension.limit(broadcast_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if seen[0] <= broadcast_rows and seen[1] <= BROADCAST_BYTES:
        return facts.join(F.broadcast(dimension), [*on], how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
