"""Time to disruption and horizon labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.operators.sequence import dimension_join

INF = float("inf")


def time_to_disruption(facts: DataFrame, shots: DataFrame) -> DataFrame:
    """Milliseconds to the disruption of the row's shot; +inf for a shot known to be safe, null for
    a shot that is not known."""
    known = shots.select(
        "shot_id", "disruption_time_unix_ns", F.lit(True).alias("_known")
    )
    joined = dimension_join(facts, known, ["shot_id"], ["ts_unix_ns"])
    ttd = (F.col("disruption_time_unix_ns") - F.col("ts_unix_ns")) / 1e6
    return joined.withColumn(
        "time_to_disruption", F.when(F.col("_known"), F.coalesce(ttd, F.lit(INF)))
    ).drop("_known")


def label_horizons(df: DataFrame, horizons_ms: Sequence[int], drop_post: bool = False) -> DataFrame:
    """0/1 per horizon. Null and NaN are 0; rows after the disruption are 1 unless dropped."""
    ttd = F.col("time_to_disruption")
    if drop_post:
        df = df.filter(F.coalesce(ttd >= 0, F.lit(True)))
    return df.withColumns(
        {f"label_h{h}": F.coalesce(ttd <= h, F.lit(False)).cast("int") for h in horizons_ms}
    )


def fill_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Model input without gaps: null and NaN become 0."""
    return df.withColumns({f: F.coalesce(F.nanvl(f, F.lit(0.0)), F.lit(0.0)) for f in features})
