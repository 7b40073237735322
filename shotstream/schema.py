"""Row shapes shared by batch and streaming code."""

from pyspark.sql import types as T

# Names the data contract prescribes.
CHANNELS = ("ip", "ne", "dwdt", "prad", "h_alpha")
QUALITIES = ("good", "missing", "outlier")
EVENT_KINDS = ("alert", "disruption", "info")
SEVERITIES = ("low", "medium", "high")
TIME_COLUMNS = ("time_unix_ns", "time_ms", "time")
METADATA_COLUMNS = (
    "shot_id",
    "time_unix_ns",
    "time_ms",
    "time",
    "time_to_disruption",
    "disruption_time_unix_ns",
)
WINDOWS = (50, 200)
HORIZONS_MS = (50, 200)

SAMPLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("quality", T.StringType()),
    ]
)

POINT = T.StructType(
    [
        T.StructField("shot_id", T.StringType()),
        T.StructField("ts_unix_ns", T.LongType()),
        T.StructField("channels", T.ArrayType(SAMPLE)),
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("shot_id", T.StringType()),
        T.StructField("ts_unix_ns", T.LongType()),
        T.StructField("channel_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("quality", T.StringType()),
    ]
)

# What the bus delivers: a message number that gives arrival order, and the JSON text.
MESSAGE = T.StructType(
    [
        T.StructField("arrival", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)

RISK = T.StructType(
    [
        T.StructField("shot_id", T.StringType()),
        T.StructField("ts_unix_ns", T.LongType()),
        T.StructField("risk_h50", T.DoubleType()),
        T.StructField("risk_h200", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("calibration_version", T.StringType()),
    ]
)

SAMPLE_KEY = ("shot_id", "ts_unix_ns", "channel_name")
SERIES_KEY = ("shot_id", "channel_name")


def feature_name(channel: str, stat: str, window: int) -> str:
    return f"{channel}_{stat}_w{window}"
