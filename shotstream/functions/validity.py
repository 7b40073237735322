"""Column rules for incoming points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def reject_reason(allowed: Sequence[str], max_channels: int | None = None) -> Column:
    """First rule a point breaks, null when it is valid. A point is rejected as a whole."""
    channels = F.col("channels")
    empty_id = F.col("shot_id").isNull() | (F.col("shot_id") == "")
    no_channels = channels.isNull() | (F.size(channels) == 0)
    bad_time = F.col("ts_unix_ns").isNull() | (F.col("ts_unix_ns") <= 0)
    foreign = ~F.forall(
        channels, lambda c: F.coalesce(c["name"].isin(*allowed), F.lit(False))
    )
    reason = (
        F.when(empty_id, "missing shot_id")
        .when(no_channels, "no channels")
        .when(bad_time, "invalid timestamp")
        .when(foreign, "channel not allowed")
    )
    if max_channels is not None:
        reason = reason.when(F.size(channels) > max_channels, "too many channels")
    return reason


def missing_ratio(channels: str | Column, expected: Sequence[str]) -> Column:
    """Share of expected channels not seen; unknown names count as seen, as in the service."""
    if not expected:
        return F.lit(0.0)
    column = F.col(channels) if isinstance(channels, str) else channels
    seen = F.size(F.array_distinct(F.transform(column, lambda c: c["name"])))
    return F.greatest(F.lit(len(expected)) - seen, F.lit(0)) / F.lit(float(len(expected)))


def missing_as_null(column: str | Column) -> Column:
    """NaN and null both mean "no sample"."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(value), value)


def good_value(value: str = "value", quality: str = "quality") -> Column:
    return F.when(F.col(quality) == "good", F.col(value))


def last_per_name(channels: str | Column) -> Column:
    """Samples of a point with repeated names removed, the last one of a name kept."""
    column = F.col(channels) if isinstance(channels, str) else channels

    def is_last(sample: Column, i: Column) -> Column:
        later = F.slice(column, i + 2, F.size(column))
        return ~F.exists(later, lambda other: other["name"] == sample["name"])

    return F.filter(column, is_last)
