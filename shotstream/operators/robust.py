"""Distance from the trailing median in units of the median absolute deviation."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from shotstream.functions.validity import missing_as_null
from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, chunks
from shotstream.schema import SERIES_KEY

WINDOW = 1000
MIN_SAMPLES = 10
EPS = 1e-9


def _nth_deviation(ordered: list[float], centre: float, k: int) -> float:
    """The k-th smallest distance to ``centre``. The k nearest values are neighbours in sorted
    order, so the widest reach of k neighbours is minimised by a binary search for their start."""
    low, high = 0, len(ordered) - k
    while low < high:
        middle = (low + high) // 2
        if centre - ordered[middle] > ordered[middle + k] - centre:
            low = middle + 1
        else:
            high = middle
    return max(centre - ordered[low], ordered[low + k - 1] - centre)


def robust_scores(values: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Scores of one series. The frame is kept sorted, so both medians cost O(log size) per row."""
    out = np.zeros(len(values))
    samples, ordered = values.tolist(), []
    for i, value in enumerate(samples):
        if i >= size:
            del ordered[bisect_left(ordered, samples[i - size])]
        insort(ordered, value)
        n = len(ordered)
        if n < MIN_SAMPLES:
            continue
        half = n // 2
        if n % 2:
            median = ordered[half]
            mad = _nth_deviation(ordered, median, half + 1)
        else:
            median = (ordered[half - 1] + ordered[half]) / 2.0
            lower = _nth_deviation(ordered, median, half)
            mad = (lower + _nth_deviation(ordered, median, half + 1)) / 2.0
        if mad > 0:
            out[i] = abs(value - median) / (mad + EPS)
    return out


def anomaly(
    telemetry: DataFrame, size: int = WINDOW, limits: Limits = DEFAULT_LIMITS, keep: Sequence[str] = ()
) -> DataFrame:
    """Add ``anomaly``: 0 below ten samples or when the deviation is 0. ``keep`` names further columns
    to carry along.

    Medians of sliding frames have no incremental form in SQL, so Python works on one chunk at a
    time, whose length ``limits`` bounds.
    """
    clean = telemetry.select(*SERIES_KEY, "ts_unix_ns", *keep, missing_as_null("value").alias("value"))
    seq = chunks(clean.filter("value is not null"), SERIES_KEY, ["ts_unix_ns"], size - 1, limits)
    rows = seq.rows if seq.chunked else seq.rows.drop("pos")
    own = seq.chunked

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_unix_ns", kind="stable")
        scores = robust_scores(pdf["value"].to_numpy(), size)
        out = pdf[["shot_id", "channel_name", "ts_unix_ns", *keep, "value"]].assign(anomaly=scores)
        return out[pdf["_own"].to_numpy()] if own else out

    kept = "".join(f", `{n}` {telemetry.schema[n].dataType.simpleString()}" for n in keep)
    return rows.groupBy(*seq.parts).applyInPandas(
        score,
        f"shot_id string, channel_name string, ts_unix_ns bigint{kept}, value double, anomaly double",
    )
