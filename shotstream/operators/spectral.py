"""Energy and dominant frequency of the trailing samples of a series.

The frame length depends on the series: a tenth of its rows, at most 1000; below 32 samples both
features are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotstream.functions.validity import missing_as_null
from shotstream.operators.sequence import DEFAULT_LIMITS, Chunks, Limits, chunks, dimension_join, largest_key_fits, measured
from shotstream.schema import SERIES_KEY

MAX_WINDOW = 1000
MIN_SAMPLES = 32
_BATCH = 2048


def trailing_windows(values: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Frames that end at each row: growing ones first, then blocks of full ones."""
    for end in range(1, min(size, len(values) + 1)):
        yield end - 1, end, values[None, :end]
    if len(values) >= size:
        full = np.lib.stride_tricks.sliding_window_view(values, size)
        for start in range(0, len(full), _BATCH):
            block = full[start : start + _BATCH]
            yield size - 1 + start, size - 1 + start + len(block), block


def _framed(telemetry: DataFrame, limits: Limits) -> Chunks:
    """Samples that are not missing, with ``frame``, the number of samples the features of a series look
    at; null where the key has a null. Both features leave missing samples out, so they see the same ones.
    Series that fit are counted where they are cut, others by a join."""
    telemetry = telemetry.withColumn("value", missing_as_null("value")).filter("value IS NOT NULL")
    limits = measured(telemetry, SERIES_KEY, limits)
    order, lookback = ["ts_unix_ns"], MAX_WINDOW - 1
    if largest_key_fits(telemetry, SERIES_KEY, limits):
        seq = chunks(telemetry, SERIES_KEY, order, lookback, limits)
        n = F.count(F.lit(1)).over(Window.partitionBy(*seq.parts))
        frame = F.least(F.lit(MAX_WINDOW), F.floor(n / 10)).cast("int")
        whole = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in SERIES_KEY])
        return replace(seq, rows=seq.rows.withColumn("frame", F.when(whole, frame)))
    sizes = telemetry.groupBy(*SERIES_KEY).agg(
        F.least(F.lit(MAX_WINDOW), F.expr("count(1) div 10")).cast("int").alias("frame")
    )
    return chunks(dimension_join(telemetry, sizes, SERIES_KEY, order), SERIES_KEY, order, lookback, limits)


def spectral_energy(telemetry: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Sum of squared magnitudes of the one-sided transform, without a transform.

    Parseval: N * sum(x^2) is the two-sided energy; the one-sided sum halves it after adding the two
    bins that have no mirror image, the sum of x and (even N) the alternating sum of x.
    """
    seq = _framed(telemetry, limits)
    # Blocks of a frame's length: the last `frame` rows are those of the block before that stand after the
    # row's place, and those of its own block up to it. So each row costs the same whatever the frame, nothing
    # is subtracted, and all windows keep the partitioning of the series.
    numbered = seq.rows.withColumn("_i", F.row_number().over(seq.window) - 1)
    size = F.greatest(F.col("frame"), F.lit(1))
    placed = numbered.withColumns({"_block": F.floor(F.col("_i") / size), "_at": F.col("_i") % size})
    terms = {
        "_sum": F.col("value"),
        "_alt": F.when(F.col("_i") % 2 == 0, F.col("value")).otherwise(-F.col("value")),
        "_sq": F.col("value") * F.col("value"),
    }
    block = Window.partitionBy(*seq.parts, "_block")
    upto = block.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    after = block.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*seq.parts, "_at").orderBy("_block")
    halves = placed.withColumns({name: F.sum(term).over(upto) for name, term in terms.items()}).withColumns(
        {f"{name}_after": F.sum(term).over(after) for name, term in terms.items()}
    )
    sums = halves.withColumns(
        {name: F.col(name) + F.coalesce(F.lag(f"{name}_after").over(earlier), F.lit(0.0)) for name in terms}
    ).withColumn("_n", F.least(F.col("_i") + 1, F.col("frame")))
    nyquist = F.when(F.col("_n") % 2 == 0, F.col("_alt") * F.col("_alt")).otherwise(F.lit(0.0))
    energy = (F.col("_n") * F.col("_sq") + F.col("_sum") * F.col("_sum") + nyquist) / 2.0
    usable = (F.col("frame") >= MIN_SAMPLES) & (F.col("_n") >= MIN_SAMPLES)
    return seq.owned(
        sums.withColumn("energy", F.when(usable, energy).otherwise(F.lit(0.0)))
    ).select("shot_id", "channel_name", "ts_unix_ns", "value", "frame", "energy")


def peak_frequency(values: np.ndarray, size: int, rate_hz: float) -> np.ndarray:
    """Frequency of the strongest bin other than 0 of each trailing frame; the lowest on ties."""
    out = np.zeros(len(values))
    if size < MIN_SAMPLES:
        return out
    for first, last, block in trailing_windows(values, size):
        n = block.shape[1]
        if n < MIN_SAMPLES:
            continue
        power = np.abs(np.fft.rfft(block, axis=1)) ** 2
        out[first:last] = (np.argmax(power[:, 1:], axis=1) + 1) * rate_hz / n
    return out


def dominant_frequency(
    telemetry: DataFrame, rate_hz: float = 1000.0, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``dominant_freq``. A Fourier transform per frame is numpy's work; Spark hands it chunks
    of bounded length."""
    seq = _framed(telemetry, limits)
    own = seq.chunked
    names = ["shot_id", "channel_name", "ts_unix_ns", "value", "frame"]

    def peaks(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ts_unix_ns")
        size = rows["frame"][0].as_py() or 0
        freq = peak_frequency(rows["value"].to_numpy(), size, rate_hz)
        out = rows.select(names).append_column("dominant_freq", pa.array(freq))
        return out.filter(rows["_own"]) if own else out

    extra = ["_chunk", "_own"] if own else []
    return seq.rows.select(*names, *extra).groupBy(*seq.parts).applyInArrow(
        peaks,
        "shot_id string, channel_name string, ts_unix_ns bigint, value double, frame int,"
        " dominant_freq double",
    )
