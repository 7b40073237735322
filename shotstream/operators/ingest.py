"""Decode, validate and acknowledge incoming points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotstream.functions.validity import missing_ratio, reject_reason
from shotstream.operators.sequence import (
    DEFAULT_LIMITS,
    Limits,
    dimension_join,
    running_max_before,
)
from shotstream.schema import CHANNELS, POINT

_DECODED = T.StructType([*POINT.fields, T.StructField("_corrupt_record", T.StringType())])
LATE = "timestamp must increase"


def decode(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Parse JSON points; ``corrupt`` marks text that is not one."""
    parsed = F.from_json(F.col(payload), _DECODED, {"columnNameOfCorruptRecord": "_corrupt_record"})
    rest = [c for c in messages.columns if c != payload]
    return messages.select(*rest, parsed.alias("_p")).select(
        *rest,
        "_p.shot_id",
        "_p.ts_unix_ns",
        "_p.channels",
        (F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()).alias("corrupt"),
    )


def validate(
    points: DataFrame, allowed: Sequence[str] = CHANNELS, max_channels: int | None = 128
) -> DataFrame:
    """Add ``reason``: the first rule a point breaks, null for a valid point."""
    reason = reject_reason(allowed, max_channels)
    if "corrupt" in points.columns:
        return points.withColumn(
            "reason", F.when(F.col("corrupt"), "invalid payload").otherwise(reason)
        ).drop("corrupt")
    return points.withColumn("reason", reason)


def monotonic(
    validated: DataFrame,
    order: Sequence[str] = ("arrival",),
    last_accepted: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Mark points whose time does not exceed every point accepted before them in their shot.

    Accepting only larger times means the last accepted time is the running maximum over all valid
    points, so no row-by-row state is needed. ``last_accepted`` (shot_id, last_ts) continues an
    earlier run.
    """
    timed = validated.withColumn(
        "_ts", F.when(F.col("reason").isNull(), F.col("ts_unix_ns"))
    )
    timed = running_max_before(timed, ["shot_id"], order, "_ts", "_seen", limits)
    if last_accepted is not None:
        timed = (
            dimension_join(timed, last_accepted, ["shot_id"], order)
            .withColumn("_seen", F.greatest("_seen", "last_ts"))
            .drop("last_ts")
        )
    late = F.col("reason").isNull() & (F.col("_ts") <= F.col("_seen"))
    return timed.withColumn("reason", F.when(late, LATE).otherwise(F.col("reason"))).drop(
        "_ts", "_seen"
    )


def acknowledge(judged: DataFrame) -> DataFrame:
    """Accepted and rejected point counts per shot and reason."""
    return judged.groupBy("shot_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("points")
    )


def drop_rate(judged: DataFrame) -> DataFrame:
    rejected = F.count_if(F.col("reason").isNotNull())
    return judged.groupBy("shot_id").agg(
        F.count(F.lit(1)).alias("points"),
        rejected.alias("rejected"),
        (rejected / F.count(F.lit(1))).alias("drop_rate"),
    )


def with_missing_ratio(points: DataFrame, expected: Sequence[str] = CHANNELS) -> DataFrame:
    return points.withColumn("missing_ratio", missing_ratio("channels", expected))


def quality_gate(vectors: DataFrame, max_missing_ratio: float = 0.2) -> DataFrame:
    return vectors.filter(F.col("missing_ratio") <= max_missing_ratio)
