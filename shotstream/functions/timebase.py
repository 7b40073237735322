"""Time as bigint epoch nanoseconds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotstream.schema import TIME_COLUMNS


def time_column(columns: Iterable[str]) -> str:
    """The time column that wins: nanoseconds, then milliseconds, then seconds."""
    present = set(columns)
    for name in TIME_COLUMNS:
        if name in present:
            return name
    raise ValueError(f"no time column, expected one of {', '.join(TIME_COLUMNS)}")


def unix_ns(columns: Iterable[str]) -> Column:
    """Nanoseconds from whichever time column wins.

    A double holds whole nanoseconds only up to 2^53, about 104 days, so larger products are formed
    from the whole and the fractional part.
    """
    name = time_column(columns)
    value = F.col(name).cast("double")
    if name == "time_unix_ns":
        return F.coalesce(F.col(name).try_cast("bigint"), value.cast("bigint"))
    scale = 1_000_000 if name == "time_ms" else 1_000_000_000
    product, whole = value * float(scale), F.floor(value)
    exact = whole.cast("bigint") * scale + F.round((value - whole) * float(scale)).cast("bigint")
    return F.when(F.abs(product) < 2.0**53, product.cast("bigint")).otherwise(exact)


def timestamp_of(ns: str | Column) -> Column:
    """A timestamp for event-time windows; nanoseconds below a microsecond are dropped."""
    column = F.col(ns) if isinstance(ns, str) else ns
    return F.timestamp_micros(F.floor(column / 1000).cast("bigint"))


def ns_of(timestamp: str | Column) -> Column:
    return F.unix_micros(timestamp) * 1000
