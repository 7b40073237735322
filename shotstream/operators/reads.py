"""Reads of the stored tables. Bounds are inclusive and each is honoured on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, with_position

KINDS = ("risk", "telemetry", "features")


def _range(
    df: DataFrame, shot_id: str | None, start_ns: int | None, end_ns: int | None
) -> DataFrame:
    for bound in (start_ns, end_ns):
        if bound is not None and (isinstance(bound, bool) or not isinstance(bound, int)):
            raise ValueError("time bounds are integer nanoseconds")
    if shot_id is not None:
        df = df.filter(F.col("shot_id") == shot_id)
    if start_ns is not None:
        df = df.filter(F.col("ts_unix_ns") >= start_ns)
    if end_ns is not None:
        df = df.filter(F.col("ts_unix_ns") <= end_ns)
    return df


def list_shots(shots: DataFrame) -> DataFrame:
    """Newest first, shots that never started last."""
    return shots.select("shot_id", "started_unix_ns", "finished_unix_ns").orderBy(
        F.col("started_unix_ns").desc_nulls_last(), "shot_id"
    )


def risk_series(risks, shot_id=None, start_ns=None, end_ns=None) -> DataFrame:
    versions = ("model_version", "calibration_version")
    return (
        _range(risks, shot_id, start_ns, end_ns)
        .select(
            "shot_id",
            "ts_unix_ns",
            "risk_h50",
            "risk_h200",
            *[F.coalesce(v, F.lit("")).alias(v) for v in versions],
        )
        .orderBy("shot_id", "ts_unix_ns")
    )


def telemetry_series(telemetry, shot_id=None, start_ns=None, end_ns=None) -> DataFrame:
    return (
        _range(telemetry, shot_id, start_ns, end_ns)
        .select("shot_id", "channel_name", "ts_unix_ns", "value")
        .orderBy("shot_id", "channel_name", "ts_unix_ns")
    )


def telemetry_pages(
    telemetry: DataFrame, page_rows: int = 10_000, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Nested form: arrays of (ts, value) per channel, cut into pages so none grows with the shot."""
    key = ["shot_id", "channel_name"]
    placed = with_position(telemetry.select(*key, "ts_unix_ns", "value"), key, ["ts_unix_ns"], limits)
    page = F.expr(f"pos div {page_rows}L").alias("page")
    return placed.groupBy(*key, page).agg(
        F.array_sort(F.collect_list(F.struct("ts_unix_ns", "value"))).alias("points")
    )


def feature_series(vectors, shot_id=None, start_ns=None, end_ns=None) -> DataFrame:
    return _range(vectors, shot_id, start_ns, end_ns).orderBy("shot_id", "ts_unix_ns", "window_ms")


def shot_events(events, shot_id=None) -> DataFrame:
    """Events by time; an empty severity reads as absent."""
    return (
        _range(events, shot_id, None, None)
        .select(
            "shot_id", "ts_unix_ns", "kind", "message",
            F.nullif(F.col("severity"), F.lit("")).alias("severity"),
        )
        .orderBy("shot_id", "ts_unix_ns", "message")
    )


def risk_at(risks: DataFrame, shot_id: str, at_ns: int) -> DataFrame:
    """The latest risk point of one shot at or before a time; empty when there is none."""
    return _range(risks, shot_id, None, at_ns).orderBy(F.col("ts_unix_ns").desc()).limit(1)


def latest_risk(risks: DataFrame, values: Sequence[str] = ("risk_h50", "risk_h200", "model_version")) -> DataFrame:
    """Newest risk point per shot, combined before the shuffle."""
    newest = F.max_by(F.struct("ts_unix_ns", *values), F.col("ts_unix_ns"))
    return risks.groupBy("shot_id").agg(newest.alias("_r")).select("shot_id", "_r.*")


def series(kind: str, df: DataFrame, shot_id=None, start_ns=None, end_ns=None) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    read = {"risk": risk_series, "telemetry": telemetry_series, "features": feature_series}[kind]
    return read(df, shot_id, start_ns, end_ns)
