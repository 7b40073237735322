"""Sliding-window features per shot and channel.

Windows count samples. Input is long: shot_id, ts_unix_ns, channel_name, value. All window sizes and
statistics of a call share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shotstream.functions.validity import missing_as_null
from shotstream.operators.ewm import ewm_zscore
from shotstream.operators.robust import anomaly
from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, chunks, measured, with_position
from shotstream.schema import SERIES_KEY, WINDOWS

# Statistic names that become part of feature names.
ONLINE_STATS = ("mean", "std", "min", "max", "slope", "last", "delta")
OFFLINE_STATS = ONLINE_STATS


def window_samples(window_ms: int, rate_hz: int) -> int:
    return int(window_ms * rate_hz / 1000)


def _divisor(n: int) -> int:
    """Length of the pieces a frame of ``n`` rows is put together from: few rows, few pieces."""
    return min((d for d in range(1, n + 1) if n % d == 0), key=lambda d: (d + n // d, -d))


# A frame is re-aggregated for every row, so its cost grows with its length. Longer frames are
# therefore joined from shorter ones that lie end to end: the piece that ends at this row, the piece
# that ended one length earlier, and so on, and pieces from pieces in turn. 200 rows become four lagged
# results of 50, and 50 rows five of 10; 5000 rows cost some 50 terms in all.
_MAX_PIECES = 16


def _pieces(n: int, known: Sequence[int]) -> list[tuple[int, int]]:
    """(length, rows back) of the pieces of a frame; empty for one that is computed directly."""
    if n <= _MAX_PIECES:
        return []
    made = [p for p in known if n % p == 0 and 1 < n // p <= _MAX_PIECES]
    piece = max(made, default=_divisor(n))
    if piece == n or n // piece > _MAX_PIECES:
        piece = -(-n // _MAX_PIECES)
    whole, rest = divmod(n, piece)
    return [(piece, k * piece) for k in range(whole)] + ([(rest, whole * piece)] if rest else [])


def _frame_plan(sizes: Sequence[int]) -> dict[int, list[tuple[int, int]]]:
    """The pieces of each frame length, pieces before the frames made of them."""
    plan: dict[int, list[tuple[int, int]]] = {}

    def add(n: int) -> None:
        if n in plan:
            return
        pieces = _pieces(n, list(plan))
        for length, _ in pieces:
            add(length)
        plan[n] = pieces

    for n in sorted(set(sizes)):
        add(n)
    return plan


def _direct(frame: WindowSpec, trend: bool) -> Column:
    """Moments of a frame: count, mean, sum of squared deviations, extremes; with ``trend`` those of
    the row numbers and the cross moment too."""
    value = F.col("value")
    count = F.count(value).over(frame)
    fields = [
        count.alias("n"),
        F.avg(value).over(frame).alias("mean"),
        (F.var_pop(value).over(frame) * count).alias("m2"),
        F.min(value).over(frame).alias("min"),
        F.max(value).over(frame).alias("max"),
    ]
    if trend:
        at = F.when(value.isNotNull(), F.col("pos").cast("double"))
        fields += [
            F.avg(at).over(frame).alias("at"),
            (F.var_pop(at).over(frame) * count).alias("at2"),
            (F.covar_pop(value, at).over(frame) * count).alias("cross"),
        ]
    return F.struct(*fields)


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])


def _joined(df: DataFrame, pieces: Sequence[str], name: str, trend: bool) -> DataFrame:
    """Moments of a frame from those of its pieces (columns ``pieces``; absent pieces are null).

    Deviations between piece means are taken around the joint mean, so nothing cancels.
    """
    part = [F.col(p) for p in pieces]
    counts = [F.coalesce(p["n"], F.lit(0)) for p in part]
    total = reduce(lambda a, b: a + b, counts)

    def mean_of(field: str) -> Column:
        origin = F.coalesce(*[p[field] for p in part])
        shift = _sum([n * (p[field] - origin) for n, p in zip(counts, part)])
        return F.when(total > 0, origin + shift / total)

    means = df.withColumns(
        {f"_{name}_n": total, f"_{name}_mean": mean_of("mean")}
        | ({f"_{name}_at": mean_of("at")} if trend else {})
    )
    centre = {f: F.col(f"_{name}_{f}") for f in ("mean", *(("at",) if trend else ()))}

    def spread(within: str, a: str, b: str) -> Column:
        between = [n * (p[a] - centre[a]) * (p[b] - centre[b]) for n, p in zip(counts, part)]
        return _sum([p[within] for p in part]) + _sum(between)

    fields = [
        F.col(f"_{name}_n").alias("n"),
        centre["mean"].alias("mean"),
        spread("m2", "mean", "mean").alias("m2"),
        F.least(*[p["min"] for p in part]).alias("min"),
        F.greatest(*[p["max"] for p in part]).alias("max"),
    ]
    if trend:
        fields += [
            centre["at"].alias("at"),
            spread("at2", "at", "at").alias("at2"),
            spread("cross", "mean", "at").alias("cross"),
        ]
    helpers = [f"_{name}_n", *[f"_{name}_{f}" for f in centre]]
    return means.withColumn(name, F.struct(*fields)).drop(*helpers)


def _with_moments(df: DataFrame, order: WindowSpec, sizes: Sequence[int], trend: bool) -> DataFrame:
    """Add a struct ``_f{n}`` of moments per frame length."""
    plan = _frame_plan(sizes)
    direct = {
        f"_f{n}": _direct(order.rowsBetween(-(n - 1), 0), trend) for n, p in plan.items() if not p
    }
    df = df.withColumns(direct)
    for n, pieces in plan.items():
        if not pieces:
            continue
        lagged = {
            f"_p{back}": F.lag(f"_f{length}", back).over(order) for length, back in pieces if back
        }
        df = df.withColumns(lagged)
        df = _joined(df, [f"_f{pieces[0][0]}", *lagged], f"_f{n}", trend).drop(*lagged)
    return df.drop(*[f"_f{n}" for n in plan if n not in sizes])


def _stat(stat: str, size: int, window: int, rate_hz: float, order: WindowSpec) -> Column:
    value, frame = F.col("value"), F.col(f"_f{size}")
    zero = F.lit(0.0)
    if stat in ("mean", "min", "max"):
        return frame[stat]
    if stat == "std":
        return F.when(frame["n"] > 1, F.sqrt(frame["m2"] / (frame["n"] - 1))).otherwise(zero)
    if stat == "last":
        return value
    if stat == "delta":
        return F.coalesce(value - F.lag(value).over(order), zero)
    if stat == "slope_ep":
        if window <= 0:
            return zero
        start = F.first("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
        oldest = F.when(F.col("pos") >= size - 1, F.lag(value, size - 1).over(order)).otherwise(start)
        return F.when(frame["n"] >= 2, (value - oldest) / F.lit(float(window))).otherwise(zero)
    if stat == "trend":
        fitted = frame["cross"] / frame["at2"] * F.lit(rate_hz / 1000.0)
        return F.when(frame["n"] >= 2, fitted).otherwise(zero)
    raise ValueError(f"unknown statistic {stat}")


def _window_features(
    telemetry: DataFrame,
    sizes: dict[int, int],
    stats: dict[str, str],
    rate_hz: float,
    limits: Limits,
) -> DataFrame:
    """``sizes`` maps window names to row counts, ``stats`` output names to definitions."""
    for definition in stats.values():
        if definition not in _KNOWN:
            raise ValueError(f"unknown statistic {definition}")
    rows = list(sizes.values())
    seq = chunks(telemetry, SERIES_KEY, ["ts_unix_ns"], max(1, *(n - 1 for n in rows)), limits)
    df = _with_moments(seq.rows, seq.window, rows, "trend" in stats.values())
    columns = {
        f"{name}_w{window}": _stat(definition, size, window, rate_hz, seq.window)
        for window, size in sizes.items()
        for name, definition in stats.items()
    }
    df = df.withColumns(columns).drop("pos", *[f"_f{n}" for n in set(rows)])
    return seq.owned(df)


_KNOWN = ("mean", "std", "min", "max", "last", "delta", "slope_ep", "trend")


def online_features(
    telemetry: DataFrame,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = ONLINE_STATS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """One row per sample with ``{stat}_w{N}`` columns; ``slope`` joins the end points of a frame."""
    definitions = {s: "slope_ep" if s == "slope" else s for s in stats}
    return _window_features(telemetry, {w: w for w in windows}, definitions, 1000.0, limits)


def offline_features(
    telemetry: DataFrame,
    windows_ms: Sequence[int] = WINDOWS,
    rate_hz: int = 1000,
    stats: Sequence[str] = OFFLINE_STATS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """One row per sample with ``{stat}_w{ms}`` columns; ``slope`` is the least-squares trend per ms.

    ``slope_ep`` may be asked for as well, so that training and serving can share one definition.
    """
    clean = telemetry.withColumn("value", missing_as_null("value"))
    sizes = {ms: max(1, window_samples(ms, rate_hz)) for ms in windows_ms}
    definitions = {s: "trend" if s == "slope" else s for s in stats}
    return _window_features(clean, sizes, definitions, float(rate_hz), limits)


def per_window(
    features: DataFrame,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = ONLINE_STATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Turn ``{stat}_w{N}`` columns into one row per window size."""
    rows = F.array(
        *[
            F.struct(
                F.lit(w).alias("window_ms"), *[F.col(f"{s}_w{w}").alias(s) for s in stats]
            )
            for w in windows
        ]
    )
    return features.select(
        "shot_id", "ts_unix_ns", "channel_name", *keep, F.explode(rows).alias("_w")
    ).select("shot_id", "ts_unix_ns", "channel_name", *keep, "_w.*")


def feature_vectors(
    features: DataFrame,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = ONLINE_STATS,
    merge_windows: bool = False,
) -> DataFrame:
    """One vector per point and window (or per point) as a map, with ``missing_ratio``.

    ``features`` carries a ``missing_ratio`` column from the point. Of samples that repeat a channel at
    one time a single one counts, the one with the greatest values. Rows of a channel are combined before
    the shuffle, so repeated samples cost one row per task.
    """
    columns = [f"{s}_w{w}" for w in windows for s in stats]
    row = F.struct(*columns)
    channels = features.groupBy("shot_id", "ts_unix_ns", "channel_name").agg(
        F.max("missing_ratio").alias("missing_ratio"), F.max(row).alias("_row")
    )
    # Now a point holds each channel once; their number is limited at ingest.
    points = channels.groupBy("shot_id", "ts_unix_ns").agg(
        F.max("missing_ratio").alias("missing_ratio"),
        F.collect_list(F.struct("channel_name", "_row")).alias("_channels"),
    )
    ratio = F.struct(F.lit("missing_ratio").alias("key"), F.col("missing_ratio").alias("value"))

    def entries(window: int) -> Column:
        return F.flatten(
            F.transform(
                "_channels",
                lambda c: F.array(
                    *[
                        F.struct(
                            F.concat(c["channel_name"], F.lit(f"_{s}_w{window}")).alias("key"),
                            c["_row"][f"{s}_w{window}"].alias("value"),
                        )
                        for s in stats
                    ]
                ),
            )
        )

    if merge_windows:
        merged = F.map_from_entries(F.concat(*[entries(w) for w in windows], F.array(ratio)))
        return points.select("shot_id", "ts_unix_ns", "missing_ratio", merged.alias("features"))
    vectors = F.array(
        *[
            F.struct(F.lit(w).alias("window_ms"), F.map_from_entries(F.concat(entries(w), F.array(ratio))).alias("features"))
            for w in windows
        ]
    )
    return points.select(
        "shot_id", "ts_unix_ns", "missing_ratio", F.explode(vectors).alias("_v")
    ).select("shot_id", "ts_unix_ns", "missing_ratio", "_v.window_ms", "_v.features")


def all_features(
    telemetry: DataFrame,
    windows_ms: Sequence[int] = WINDOWS,
    rate_hz: int = 1000,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Window statistics, EMA z-score and robust anomaly of every sample.

    Each sample gets a number of its own, so samples that repeat a key stay as many as they are.
    """
    limits = measured(telemetry, SERIES_KEY, limits)
    numbered = with_position(telemetry, SERIES_KEY, ["ts_unix_ns", "value"], limits).withColumnRenamed("pos", "_at")
    key = [*SERIES_KEY, "_at"]
    base = offline_features(numbered, windows_ms, rate_hz, limits=limits)
    scores = ewm_zscore(numbered, limits=limits).select(*key, "zscore")
    odd = anomaly(numbered, limits=limits, keep=("_at",)).select(*key, "anomaly")
    return base.join(scores, key, "left").join(odd, key, "left").drop("_at")


def _bucket(bucket_ns: int) -> Column:
    return F.expr(f"(ts_unix_ns div {bucket_ns}L) * {bucket_ns}L")


def grid_steps(telemetry: DataFrame, bucket_ns: int, channels: Sequence[str]) -> DataFrame:
    """The keys of the rows that ``pivot_features`` makes, one row each."""
    mine = telemetry.filter(F.col("channel_name").isin(*channels))
    return mine.select("shot_id", _bucket(bucket_ns).alias("ts_unix_ns")).distinct()


def pivot_features(
    features: DataFrame,
    bucket_ns: int,
    channels: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Wide vectors on a time grid: the last row of each channel in each bucket, one struct column
    per channel. Channels without a sample in the bucket are null."""
    bucket = _bucket(bucket_ns)
    row = F.struct(*columns)
    last = []
    for name in channels:
        mine = F.col("channel_name") == name
        last.append(F.max_by(F.when(mine, row), F.when(mine, F.col("ts_unix_ns"))).alias(name))
    return (
        features.filter(F.col("channel_name").isin(*channels))
        .groupBy("shot_id", bucket.alias("ts_unix_ns"))
        .agg(*last)
    )


def flatten_features(
    grid: DataFrame, channels: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``{channel}_{column}`` columns from one struct per channel, absent features 0."""
    wide = [
        F.coalesce(F.col(f"{ch}.{c}"), F.lit(0.0)).alias(f"{ch}_{c}")
        for ch in channels
        for c in columns
    ]
    seen = reduce(
        lambda a, b: a + b, [F.col(ch).isNotNull().cast("int") for ch in channels]
    )
    ratio = (F.lit(len(channels)) - seen) / F.lit(float(len(channels)))
    return grid.select("shot_id", "ts_unix_ns", *wide, ratio.alias("missing_ratio"))
