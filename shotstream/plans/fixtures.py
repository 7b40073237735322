"""Domain views over the given tables.

``events`` becomes telemetry: a day is a shot, the event type a channel, and ``props.k`` the quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotstream.functions.risk import Calibration, LinearModel
from shotstream.functions.timebase import ns_of
from shotstream.operators import features as feats
from shotstream.operators import labels, scoring
from shotstream.operators.points import assemble_points
from shotstream.operators.sequence import carry_forward, dimension_join, spread
from shotstream.schema import CHANNELS, feature_name

MINUTE = 60_000_000_000
BUCKET = 10 * MINUTE
HOURS = (3_600_000, 14_400_000)
MODEL_CHANNELS = ("prad", "ip", "h_alpha", "ne", "dwdt")
# How the event types stand for channels.
CHANNEL_OF = {
    "click": "ip",
    "view": "ne",
    "signup": "dwdt",
    "purchase": "prad",
    "error": "h_alpha",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_model(version: str = "demo", tilt: float = 0.0) -> LinearModel:
    """Coefficients from a rule: one weight per channel, statistic and window."""
    channel = {"prad": 0.010, "ip": 0.007, "h_alpha": -0.004, "ne": 0.002, "dwdt": -0.003}
    stat = {
        "mean": 1.0,
        "std": 0.31,
        "min": -0.17,
        "max": 0.053,
        "slope": 0.71,
        "last": 0.57,
        "delta": 0.13,
    }
    window = {50: 0.9 + tilt, 200: 0.63 - tilt}
    return LinearModel(
        {
            feature_name(c, s, w): round(cw * sw * ww, 9)
            for c, cw in channel.items()
            for s, sw in stat.items()
            for w, ww in window.items()
        },
        -1.0,
        version,
    )


DEMO_CALIBRATION = Calibration("platt", 1.0, 0.0, "demo-cal")


def _channel() -> Column:
    pairs = [F.lit(x) for pair in CHANNEL_OF.items() for x in pair]
    return F.create_map(*pairs)[F.col("event_type")]


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry samples with ``event_id`` and ``arrival``, a locally disordered sequence."""
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    quality = F.when(k % 10 == 0, "missing").when(k % 10 == 1, "outlier").otherwise("good")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") + (F.col("event_id") * 7919) % 13).alias("arrival"),
        F.date_format(ts, "yyyyMMdd").alias("shot_id"),
        ns_of(ts).alias("ts_unix_ns"),
        _channel().alias("channel_name"),
        "value",
        quality.alias("quality"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals(spark, sf_dir).drop("event_id", "arrival")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_points(telemetry(spark, sf_dir), BUCKET)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus messages with JSON payloads, some of them broken in each of the ways ingest rejects."""
    i = F.col("event_id")
    good = F.array(F.struct(F.col("channel_name").alias("name"), "value", "quality"))
    foreign = F.array(F.struct(F.lit("spare").alias("name"), "value", "quality"))
    body = F.to_json(
        F.struct(
            F.when(i % 97 == 0, "").otherwise(F.col("shot_id")).alias("shot_id"),
            F.when(i % 83 == 0, 0).otherwise(F.col("ts_unix_ns")).alias("ts_unix_ns"),
            F.when(i % 89 == 0, F.slice(good, 1, 0))
            .when(i % 79 == 0, foreign)
            .otherwise(good)
            .alias("channels"),
        )
    )
    return arrivals(spark, sf_dir).select(
        (F.col("arrival") * 16 + i % 13).alias("arrival"),
        F.when(i % 73 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("payload"),
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day its first and last time; every third day ends in a disruption, at its largest value
    in the last 30 % of the day."""
    samples = telemetry(spark, sf_dir)
    span = samples.groupBy("shot_id").agg(
        F.min("ts_unix_ns").alias("started_unix_ns"), F.max("ts_unix_ns").alias("finished_unix_ns")
    )
    late = F.expr(
        "ts_unix_ns >= started_unix_ns + ((finished_unix_ns - started_unix_ns) div 10) * 7"
    )
    peak = F.max_by("ts_unix_ns", F.when(late, F.struct("value", "ts_unix_ns")))
    return (
        dimension_join(samples, span, ["shot_id"], ["ts_unix_ns"], "inner")
        .groupBy("shot_id")
        .agg(
            F.min("started_unix_ns").alias("started_unix_ns"),
            F.max("finished_unix_ns").alias("finished_unix_ns"),
            peak.alias("_peak"),
        )
        .select(
            "shot_id",
            "started_unix_ns",
            "finished_unix_ns",
            F.when(F.substring("shot_id", 7, 2).cast("int") % 3 == 0, F.col("_peak")).alias(
                "disruption_time_unix_ns"
            ),
        )
    )


def stat_columns(windows=(50, 200), stats=feats.ONLINE_STATS) -> list[str]:
    return [f"{s}_w{w}" for w in windows for s in stats]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide feature vectors on a 10-minute grid, the last state of each channel carried forward."""
    samples = telemetry(spark, sf_dir).filter(F.col("channel_name").isin(*MODEL_CHANNELS))
    online = feats.online_features(samples.drop("quality"))
    grid = feats.pivot_features(online, BUCKET, MODEL_CHANNELS, stat_columns())
    filled = carry_forward(
        grid, ["shot_id"], ["ts_unix_ns"], {c: F.col(c) for c in MODEL_CHANNELS}
    )
    return feats.flatten_features(filled, MODEL_CHANNELS, stat_columns())


def risks(spark: SparkSession, sf_dir: str, model: LinearModel | None = None) -> DataFrame:
    return scoring.risk_points(vectors(spark, sf_dir), model or demo_model(), DEMO_CALIBRATION)


def scored(spark: SparkSession, sf_dir: str, *models: LinearModel) -> DataFrame:
    """Risk per grid point with the label of its shot: p, label, time_to_disruption."""
    wide = vectors(spark, sf_dir)
    chosen = models or (demo_model(),)
    probabilities = F.array(
        *[
            F.struct(
                F.lit(m.version).alias("model_version"),
                scoring.R.calibrated(
                    scoring.R.linear_score(m, scoring.lookup_for(wide)), DEMO_CALIBRATION
                ).alias("p"),
            )
            for m in chosen
        ]
    )
    rows = wide.select("shot_id", "ts_unix_ns", F.explode(probabilities).alias("_m")).select(
        "shot_id", "ts_unix_ns", "_m.*"
    )
    timed = labels.time_to_disruption(rows, shots(spark, sf_dir))
    return labels.label_horizons(timed, HOURS).withColumn("label", F.col(f"label_h{HOURS[1]}"))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a supplier as a series of quantities in order-key sequence."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rank = F.struct("l_partkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem")
    keyed = lines.select(
        F.col("l_suppkey").cast("string").alias("shot_id"),
        # Not a literal: the optimizer would put it in place of the key, and the rows would be shuffled again.
        F.explode(F.array(F.lit("quantity"))).alias("channel_name"),
        line.alias("ts_unix_ns"),
        rank.alias("_rank"),
    )
    return (
        spread(keyed, ["shot_id", "ts_unix_ns"], lines.count())
        .groupBy("shot_id", "channel_name", "ts_unix_ns")
        .agg(F.min("_rank").alias("_r"))
        .select("shot_id", "channel_name", "ts_unix_ns", F.col("_r.l_quantity").alias("value"))
    )
