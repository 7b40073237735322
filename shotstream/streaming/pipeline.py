"""From bus messages to risks and alerts with Structured Streaming.

Acceptance order and sliding windows need state per shot and channel. Keyed streaming state puts all
rows of a key into one task; here each micro-batch instead runs the batch operators, which split hot
keys, on its rows plus a small state table:

* ``state/last_ts``: the last accepted time of each shot,
* ``state/tail``: the last samples of each series, as many as the widest window looks back.

State lies in snapshot tables: a batch looks up the shots and series it holds samples of and writes those
alone, as the version after the one it read. Every output goes to a directory named after its batch. So a
batch that is run again after a failure reads the state it read before and replaces its own output.
``keyed.py`` has the same acceptance with Spark's keyed state, for streams without hot shots.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotstream.functions.risk import Calibration, LinearModel, Thresholds
from shotstream.functions.rules import Rule
from shotstream.functions.validity import last_per_name
from shotstream.operators import features, ingest, points, scoring
from shotstream.operators.sequence import DEFAULT_LIMITS, Limits, with_position
from shotstream.schema import CHANNELS, MESSAGE, SERIES_KEY, WINDOWS
from shotstream.sources.sinks import path_exists
from shotstream.sources.snapshots import Layout, SnapshotTable

STAGES = ("ingest", "features", "risk")
# What a shot, and a series, leaves behind for the next batch.
_LAST = Layout("shot_id string, last_ts bigint", ("shot_id",), "shot_id")
_TAIL = Layout(
    "shot_id string, channel_name string, newest bigint, samples array<struct<ts_unix_ns: bigint, value: double>>",
    SERIES_KEY, "shot_id",
)


@dataclass(frozen=True)
class StreamPlan:
    """What a stream computes and the folder that holds its tables, state and checkpoint.

    A shot or series without a sample for ``ttl_ns`` before the newest one accepted in earlier batches is
    forgotten: its next sample is taken as its first. Without ``ttl_ns`` nothing is forgotten.
    """

    root: str
    until: str = "risk"
    allowed: Sequence[str] = CHANNELS
    max_channels: int | None = 128
    windows: Sequence[int] = WINDOWS
    model: LinearModel = field(default_factory=LinearModel)
    calibration: Calibration = field(default_factory=Calibration)
    rules: Sequence[Rule] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)
    limits: Limits = DEFAULT_LIMITS
    ttl_ns: int | None = None
    state_buckets: int = 64

    def __post_init__(self) -> None:
        if self.until not in STAGES:
            raise ValueError(f"until must be one of {', '.join(STAGES)}")


def read_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Messages as a stream of JSON lines (arrival, payload)."""
    return spark.readStream.schema(MESSAGE).options(**options).json(path)


class RiskStream:
    """One stream; ``process`` handles a micro-batch and may be called again for the same batch."""

    def __init__(self, plan: StreamPlan) -> None:
        self.plan = plan

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        return (
            messages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.plan.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.plan.root}/{name}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        judged = self._ingest(batch, batch_id)
        if self.plan.until == "ingest":
            return
        computed = self._features(judged, batch_id)
        if self.plan.until == "features":
            return
        self._risk(computed, batch_id)

    def _store(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.plan.root}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def memory(self, spark: SparkSession, name: str) -> SnapshotTable:
        """State ``last_ts`` or ``tail``: version n + 1 is what batch n left."""
        path = f"{self.plan.root}/state/{name}"
        if path_exists(spark, f"{path}/layout/_SUCCESS"):
            return SnapshotTable.open(spark, path)
        layout = _LAST if name == "last_ts" else _TAIL
        return SnapshotTable.create(spark, path, replace(layout, buckets=self.plan.state_buckets))

    def _horizon(self, spark: SparkSession, batch_id: int) -> int | None:
        """What was last heard of before this time is forgotten."""
        if self.plan.ttl_ns is None or batch_id == 0:
            return None
        clock = spark.read.schema("now bigint").json(f"{self.plan.root}/state/clock/batch_id={batch_id - 1}").first()
        return None if clock is None or clock["now"] is None else clock["now"] - self.plan.ttl_ns

    def _tick(self, judged: DataFrame, horizon: int | None, batch_id: int) -> None:
        if self.plan.ttl_ns is not None:
            newest = F.max(F.when(F.col("reason").isNull(), F.col("ts_unix_ns")))
            before = F.lit(None if horizon is None else horizon + self.plan.ttl_ns).cast("bigint")
            now = judged.agg(F.greatest(newest, before).alias("now"))
            now.write.mode("overwrite").json(f"{self.plan.root}/state/clock/batch_id={batch_id}")

    def _ingest(self, batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        valid = ingest.validate(
            ingest.decode(batch), self.plan.allowed, self.plan.max_channels
        )
        memory, horizon = self.memory(spark, "last_ts"), self._horizon(spark, batch_id)
        shots = valid.filter("reason is null").select("shot_id").distinct()
        last = memory.lookup(shots, version=batch_id)
        if horizon is not None:
            last = last.filter(F.col("last_ts") >= horizon)
        judged = ingest.monotonic(valid, last_accepted=last, limits=self.plan.limits)
        judged = self._store(judged, "judged", batch_id)
        newest = (
            judged.filter("reason is null")
            .groupBy("shot_id")
            .agg(F.max("ts_unix_ns").alias("last_ts"))
        )
        memory.upsert(newest, version=batch_id, alive=None if horizon is None else F.col("last_ts") >= horizon)
        self._tick(judged, horizon, batch_id)
        return judged

    def _features(self, judged: DataFrame, batch_id: int) -> DataFrame:
        spark = judged.sparkSession
        memory, horizon = self.memory(spark, "tail"), self._horizon(spark, batch_id)
        accepted = judged.filter("reason is null").withColumn(
            "channels", last_per_name("channels")
        )
        fresh = points.explode_points(
            ingest.with_missing_ratio(accepted, self.plan.allowed), "missing_ratio"
        )
        # Only the series of this batch are looked up and written.
        tail = memory.lookup(fresh.select(*SERIES_KEY).distinct(), version=batch_id)
        if horizon is not None:
            tail = tail.filter(F.col("newest") >= horizon)
        tail = tail.select(*SERIES_KEY, F.inline("samples"))
        line = fresh.withColumn("_fresh", F.lit(True)).unionByName(
            tail.withColumn("_fresh", F.lit(False)), allowMissingColumns=True
        )
        computed = features.online_features(line, self.plan.windows, limits=self.plan.limits)
        computed = self._store(
            computed.filter("_fresh").drop("_fresh"), "features", batch_id
        )
        backwards = line.select(*SERIES_KEY, "ts_unix_ns", "value").withColumn(
            "_back", -F.col("ts_unix_ns")
        )
        ranked = with_position(backwards, SERIES_KEY, ["_back"], self.plan.limits)
        depth = max(1, *(w - 1 for w in self.plan.windows))
        tails = ranked.filter(F.col("pos") < depth).groupBy(*SERIES_KEY).agg(
            F.max("ts_unix_ns").alias("newest"),
            F.sort_array(F.collect_list(F.struct("ts_unix_ns", "value"))).alias("samples"),
        )
        memory.upsert(tails, version=batch_id, alive=None if horizon is None else F.col("newest") >= horizon)
        return computed

    def _risk(self, computed: DataFrame, batch_id: int) -> None:
        vectors = features.feature_vectors(computed, self.plan.windows, merge_windows=True)
        risks = self._store(
            scoring.full_risk_points(
                vectors, self.plan.model, self.plan.calibration, self.plan.rules
            ),
            "risks",
            batch_id,
        )
        self._store(scoring.alert_events(risks, self.plan.thresholds), "alerts", batch_id)


def score_stream(
    vectors: DataFrame,
    model: LinearModel,
    calibration: Calibration,
    rules: Sequence[Rule],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Stateless scoring of a stream of vectors into an exactly-once file sink."""
    risks = scoring.full_risk_points(vectors, model, calibration, rules)
    return (
        risks.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
