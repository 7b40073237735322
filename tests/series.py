"""Small literal series for the tests, and row budgets."""

import numpy as np
import pandas as pd

from shotstream.operators.sequence import Limits

# Budgets so small that every series is cut into slices and chunks.
TINY = Limits(key_rows=1, slice_rows=7, chunk_rows=16)
WHOLE = Limits()


def telemetry_pdf(lengths, seed=7, gaps=True):
    """One series per (shot, channel) with irregular times; two decimals as in the given tables."""
    rng = np.random.default_rng(seed)
    frames = []
    for (shot, channel), n in lengths.items():
        step = rng.integers(1, 50, n) if gaps else np.full(n, 10)
        frames.append(
            pd.DataFrame(
                {
                    "shot_id": shot,
                    "channel_name": channel,
                    "ts_unix_ns": 1_000 + np.cumsum(step),
                    "value": np.round(rng.gamma(2.0, 20.0, n), 2),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


LENGTHS = {("hot", "ip"): 400, ("hot", "ne"): 90, ("b", "ip"): 33, ("c", "ip"): 1, ("d", "prad"): 2}


def by_series(pdf):
    return pdf.sort_values(["shot_id", "channel_name", "ts_unix_ns"]).reset_index(drop=True)
