"""Sources, validation and storage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotstream.functions.timebase import unix_ns
from shotstream.functions.validity import good_value
from shotstream.operators import ingest, labels, points, resample, shots, upsert
from shotstream.plans import fixtures as fx
from shotstream.plans.catalog import query, r, rounded
from shotstream.plans.sql_views import with_views
from shotstream.schema import CHANNELS
from shotstream.session import work_dir
from shotstream.sources import dataset, files, sinks
from shotstream.sources.snapshots import Layout, SnapshotTable

STEP = 30 * fx.MINUTE
UNPIVOT_WIDE = " UNION ALL ".join(
    f"SELECT shot_id, ts_unix_ns, '{c}' AS channel_name, max(value) AS value FROM tel"
    f" WHERE channel_name = '{c}' GROUP BY ALL"
    for c in CHANNELS
)


def _wide(spark, sf_dir):
    return points.long_to_wide(fx.telemetry(spark, sf_dir)).withColumnRenamed(
        "ts_unix_ns", "time_unix_ns"
    )


@query(
    "csv_source",
    with_views(
        "tel",
        f"SELECT shot_id, time_ms * 1000000 AS time_unix_ns, {', '.join(r(c) + ' AS ' + c for c in CHANNELS)}"
        " FROM (SELECT shot_id, ts_unix_ns // 1000000 AS time_ms, "
        + ", ".join(f"max(value) FILTER (WHERE channel_name = '{c}') AS {c}" for c in CHANNELS)
        + " FROM tel GROUP BY 1, 2)",
    ),
)
def csv_source(spark, sf_dir):
    """Wide telemetry written as CSV with a millisecond column and loaded back; half of the files have
    their columns in another order."""
    path = work_dir(spark, "csv") + ".csv"
    rows = fx.telemetry(spark, sf_dir).withColumn("ts_unix_ns", F.expr("ts_unix_ns div 1000000"))
    wide = points.long_to_wide(rows).withColumnRenamed("ts_unix_ns", "time_ms")
    half = F.pmod(F.xxhash64("shot_id"), F.lit(2))
    wide.filter(half == 0).write.option("header", True).csv(path)
    wide.filter(half == 1).select(*reversed(wide.columns)).write.option("header", True).mode("append").csv(path)
    return rounded(files.load(spark, path).select("shot_id", "time_unix_ns", *CHANNELS))


@query(
    "json_points",
    with_views("pts", f"SELECT shot_id, ts_unix_ns, channel_name, {r('value')} AS value, quality FROM pts"),
)
def json_points(spark, sf_dir):
    path = work_dir(spark, "points") + ".json"
    fx.points(spark, sf_dir).write.json(path)
    return rounded(points.explode_points(files.load(spark, path)))


@query(
    "wide_to_points",
    with_views(
        "tel",
        f"SELECT shot_id, ts_unix_ns, channel_name, {r('value')} AS value, 'good' AS quality,"
        f" CAST(1 AS INTEGER) AS channels FROM ({UNPIVOT_WIDE})",
    ),
)
def wide_to_points(spark, sf_dir):
    made = points.wide_to_points(_wide(spark, sf_dir))
    sized = made.withColumn("channels_seen", F.size("channels"))
    return rounded(
        points.explode_points(sized, "channels_seen").withColumnRenamed("channels_seen", "channels")
    )


@query(
    "shot_arrays_explode",
    "SELECT CAST(vec_id AS VARCHAR) AS shot_id, CAST(i - 1 AS BIGINT) * 1000000 AS time_unix_ns, "
    f"{r('CAST(embedding[i] AS DOUBLE)')} AS signal, CAST(32000000 AS BIGINT) AS disruption_time_unix_ns,"
    f" {r('32 - (i - 1)')} AS time_to_disruption"
    " FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
)
def shot_arrays_explode(spark, sf_dir):
    """Each embedding taken as a shot sampled every millisecond."""
    arrays = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("shot_id"),
        F.transform(
            F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("bigint") * 1_000_000
        ).alias("time_unix_ns"),
        F.col("embedding").alias("signal"),
        F.lit(32).alias("disrupted_ms"),
    )
    return rounded(
        files.explode_arrays(
            arrays, ["signal"], disruption="disrupted_ms", disruption_unit_ns=1_000_000
        )
    )


@query(
    "dataset_union",
    with_views(
        "pts shots",
        "SELECT source, channel_name, count(*) AS samples,"
        " count(disruption_time_unix_ns) AS with_disruption,"
        f" {r('avg(value)')} AS mean_value, {r('avg(time_to_disruption)')} AS mean_ttd FROM ("
        " SELECT 'points' AS source, channel_name, value, CAST(NULL AS BIGINT) AS disruption_time_unix_ns,"
        " CAST(NULL AS DOUBLE) AS time_to_disruption FROM pts UNION ALL"
        " SELECT 'samples', channel_name, value, disruption_time_unix_ns,"
        " (disruption_time_unix_ns - ts_unix_ns) / 1e6 FROM tel JOIN shots USING (shot_id))"
        " GROUP BY 1, 2",
    ),
)
def dataset_union(spark, sf_dir):
    """Two sources with different columns: bucketed points, and samples that know a disruption."""
    bucketed = points.explode_points(fx.points(spark, sf_dir)).select(
        F.lit("points").alias("source"),
        F.col("ts_unix_ns").alias("time_unix_ns"),
        "channel_name",
        "value",
    )
    known = fx.shots(spark, sf_dir).select("shot_id", "disruption_time_unix_ns")
    samples = labels.dimension_join(
        fx.telemetry(spark, sf_dir), known, ["shot_id"], ["ts_unix_ns"]
    ).select(
        F.lit("samples").alias("source"),
        F.col("ts_unix_ns").alias("time_unix_ns"),
        "channel_name",
        "value",
        "disruption_time_unix_ns",
    )
    both = dataset.union_sources([bucketed, samples])
    return rounded(
        both.groupBy("source", "channel_name").agg(
            F.count(F.lit(1)).alias("samples"),
            F.count("disruption_time_unix_ns").alias("with_disruption"),
            F.avg("value").alias("mean_value"),
            F.avg("time_to_disruption").alias("mean_ttd"),
        )
    )


@query(
    "explode_points",
    with_views("pts", f"SELECT shot_id, ts_unix_ns, channel_name, {r('value')} AS value, quality FROM pts"),
)
def explode_points(spark, sf_dir):
    return rounded(points.explode_points(fx.points(spark, sf_dir)))


@query(
    "ingest_validate",
    with_views("judged0", "SELECT arrival, shot_id, reason FROM judged0"),
)
def ingest_validate(spark, sf_dir):
    return ingest.validate(ingest.decode(fx.messages(spark, sf_dir))).select(
        "arrival", "shot_id", "reason"
    )


@query(
    "monotonic_filter",
    with_views("judged", "SELECT arrival, shot_id, ts_unix_ns FROM judged WHERE reason IS NULL"),
)
def monotonic_filter(spark, sf_dir):
    valid = ingest.validate(ingest.decode(fx.messages(spark, sf_dir)))
    return ingest.monotonic(valid).filter("reason is null").select(
        "arrival", "shot_id", "ts_unix_ns"
    )


def _judged(spark, sf_dir):
    return ingest.monotonic(ingest.validate(ingest.decode(fx.messages(spark, sf_dir))))


@query(
    "ingest_ack",
    with_views(
        "judged",
        "SELECT shot_id, coalesce(reason, 'accepted') AS outcome, count(*) AS points FROM judged GROUP BY 1, 2",
    ),
)
def ingest_ack(spark, sf_dir):
    return ingest.acknowledge(_judged(spark, sf_dir))


@query(
    "drop_rate",
    with_views(
        "judged",
        "SELECT shot_id, count(*) AS points, count(reason) AS rejected,"
        f" {r('count(reason) / count(*)')} AS drop_rate FROM judged GROUP BY 1",
    ),
)
def drop_rate(spark, sf_dir):
    return rounded(ingest.drop_rate(_judged(spark, sf_dir)))


@query(
    "time_normalize",
    with_views(
        "arr",
        "SELECT event_id, unit, ns FROM (SELECT event_id, 'time_unix_ns' AS unit, ts_unix_ns AS ns FROM arr"
        " UNION ALL SELECT event_id, 'time_ms', (ts_unix_ns // 1000000) * 1000000 FROM arr"
        " UNION ALL SELECT event_id, 'time', (ts_unix_ns // 1000000000) * 1000000000 FROM arr)",
    ),
)
def time_normalize(spark, sf_dir):
    base = fx.arrivals(spark, sf_dir)
    forms = {"time_unix_ns": 1, "time_ms": 1_000_000, "time": 1_000_000_000}
    # Whole numbers of each unit, as a file with that time column would hold them.
    frames = [
        base.select("event_id", F.expr(f"ts_unix_ns div {size}L").alias(unit)).select(
            "event_id", F.lit(unit).alias("unit"), unix_ns([unit]).alias("ns")
        )
        for unit, size in forms.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "missing_ratio",
    with_views(
        "pts",
        "SELECT shot_id, ts_unix_ns, CAST(count(DISTINCT channel_name) AS INTEGER) AS seen,"
        f" {r('greatest(5 - count(DISTINCT channel_name), 0) / 5.0')} AS missing_ratio FROM pts GROUP BY 1, 2",
    ),
)
def missing_ratio(spark, sf_dir):
    return rounded(
        ingest.with_missing_ratio(fx.points(spark, sf_dir)).select(
            "shot_id", "ts_unix_ns", F.size("channels").alias("seen"), "missing_ratio"
        )
    )


@query(
    "quality_gate",
    with_views(
        "pts",
        "SELECT shot_id, ts_unix_ns, missing_ratio, good_samples, mean_good FROM ("
        f" SELECT shot_id, ts_unix_ns, {r('(5 - count(*)) / 5.0')} AS missing_ratio,"
        " (5 - count(*)) / 5.0 AS m, count(*) FILTER (WHERE quality = 'good') AS good_samples,"
        f" {r('''avg(value) FILTER (WHERE quality = 'good')''')} AS mean_good"
        " FROM pts GROUP BY 1, 2) WHERE m <= 0.4",
    ),
)
def quality_gate(spark, sf_dir):
    """Points with at most two of five channels missing, read through good samples only."""
    kept = ingest.quality_gate(ingest.with_missing_ratio(fx.points(spark, sf_dir)), 0.4)
    return rounded(
        points.explode_points(kept, "missing_ratio")
        .groupBy("shot_id", "ts_unix_ns", "missing_ratio")
        .agg(
            F.count(good_value()).alias("good_samples"), F.avg(good_value()).alias("mean_good")
        )
    )


@query(
    "resample_grid",
    with_views(
        "tel",
        f"""SELECT shot_id, slot * {STEP} AS ts_unix_ns, channel_name,
        {r('CASE WHEN slot = step THEN value ELSE prev END')} AS value, slot < step AS filled FROM (
          SELECT *, unnest(list_concat(CASE WHEN prev_step IS NULL THEN []
            ELSE range(prev_step + 1, least(step - 1, prev_step + 3) + 1) END, [step])) AS slot
          FROM (SELECT *, lag(step) OVER o AS prev_step, lag(value) OVER o AS prev FROM (
            SELECT shot_id, channel_name, ts_unix_ns // {STEP} AS step,
            arg_max(value, ts_unix_ns) AS value FROM tel GROUP BY 1, 2, 3)
            WINDOW o AS (PARTITION BY shot_id, channel_name ORDER BY step)))""",
    ),
)
def resample_grid(spark, sf_dir):
    return rounded(resample.resample(fx.telemetry(spark, sf_dir), STEP, max_fill=3))


@query(
    "time_to_disruption",
    with_views(
        "tel shots",
        "SELECT shot_id, ts_unix_ns, channel_name, disruption_time_unix_ns,"
        f" {r('''coalesce((disruption_time_unix_ns - ts_unix_ns) / 1e6, CAST('Infinity' AS DOUBLE))''')}"
        " AS time_to_disruption FROM tel JOIN shots USING (shot_id)",
    ),
)
def time_to_disruption(spark, sf_dir):
    timed = labels.time_to_disruption(fx.telemetry(spark, sf_dir), fx.shots(spark, sf_dir))
    return rounded(
        timed.select(
            "shot_id", "ts_unix_ns", "channel_name", "disruption_time_unix_ns", "time_to_disruption"
        )
    )


@query(
    "label_horizons",
    with_views(
        "tel shots",
        "SELECT shot_id, ts_unix_ns, channel_name, "
        + ", ".join(
            f"CASE WHEN (disruption_time_unix_ns - ts_unix_ns) / 1e6 <= {h} THEN 1 ELSE 0 END AS label_h{h}"
            for h in fx.HOURS
        )
        + " FROM tel JOIN shots USING (shot_id)",
    ),
)
def label_horizons(spark, sf_dir):
    timed = labels.time_to_disruption(fx.telemetry(spark, sf_dir), fx.shots(spark, sf_dir))
    return labels.label_horizons(timed, fx.HOURS).select(
        "shot_id", "ts_unix_ns", "channel_name", *[f"label_h{h}" for h in fx.HOURS]
    )


@query(
    "telemetry_upsert",
    with_views(
        "arr",
        f"""SELECT shot_id, ts_unix_ns, channel_name, {r('arg_max(value, arrival)')} AS value,
        arg_max(quality, arrival) AS quality FROM (
          SELECT shot_id, (ts_unix_ns // {STEP}) * {STEP} AS ts_unix_ns, channel_name, value, quality,
          arrival * 16 + event_id % 13 AS arrival FROM arr) GROUP BY 1, 2, 3""",
    ),
)
def telemetry_upsert(spark, sf_dir):
    """Samples snapped to half hours collide on their key; half of them are stored, the other half
    merged into the stored table."""
    rows = fx.arrivals(spark, sf_dir).select(
        "shot_id",
        F.expr(f"(ts_unix_ns div {STEP}L) * {STEP}L").alias("ts_unix_ns"),
        "channel_name",
        "value",
        "quality",
        (F.col("arrival") * 16 + F.col("event_id") % 13).alias("arrival"),
    )
    middle = rows.agg(F.expr("percentile_approx(arrival, 0.5)").alias("_mid"))
    marked = rows.crossJoin(F.broadcast(middle))
    first = marked.filter("arrival <= _mid").drop("_mid")
    second = marked.filter("arrival > _mid").drop("_mid")
    path = work_dir(spark, "telemetry")
    sinks.write_series(upsert.telemetry_upsert(first, ["arrival"]), path, buckets=16)
    merged = sinks.upsert_series(spark, path, second, upsert.SAMPLE_KEY, ["arrival"])
    return rounded(merged.select("shot_id", "ts_unix_ns", "channel_name", "value", "quality"))


@query(
    "telemetry_snapshots",
    with_views(
        "arr",
        f"""SELECT shot_id, ts_unix_ns, channel_name, {r('arg_max(value, arrival)')} AS value,
        arg_max(quality, arrival) AS quality FROM (
          SELECT shot_id, (ts_unix_ns // {STEP}) * {STEP} AS ts_unix_ns, channel_name, value, quality,
          arrival * 16 + event_id % 13 AS arrival FROM arr) GROUP BY 1, 2, 3""",
    ),
)
def telemetry_snapshots(spark, sf_dir):
    """The samples of ``telemetry_upsert`` in three upserts of a snapshot table of buckets and weeks."""
    rows = fx.arrivals(spark, sf_dir).select(
        "shot_id",
        F.expr(f"(ts_unix_ns div {STEP}L) * {STEP}L").alias("ts_unix_ns"),
        "channel_name",
        "value",
        "quality",
        (F.col("arrival") * 16 + F.col("event_id") % 13).alias("arrival"),
    )
    layout = Layout(
        "shot_id string, ts_unix_ns bigint, channel_name string, value double, quality string, arrival bigint",
        upsert.SAMPLE_KEY, "shot_id", buckets=4, order=("arrival",), time="ts_unix_ns", slice_width=7 * 86_400_000_000_000,
    )
    table = SnapshotTable.create(spark, work_dir(spark, "snapshots"), layout)
    for i in range(3):
        table.upsert(rows.filter(F.pmod(F.xxhash64("arrival"), F.lit(3)) == i))
    return rounded(table.read().drop("arrival"))


@query(
    "event_append",
    "SELECT event_id, user_id, event_type FROM events",
)
def event_append(spark, sf_dir):
    """All events appended in two batches that share a third of them, then the second once more."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    layout = Layout("event_id bigint, user_id bigint, event_type string", ("event_id",), "event_id", buckets=4, bloom=True)
    table = SnapshotTable.create(spark, work_dir(spark, "events"), layout)
    for wanted in ("event_id % 3 < 2", "event_id % 3 > 0", "event_id % 3 > 0"):
        table.append(rows.filter(wanted))
    return table.read()


@query(
    "risk_upsert",
    with_views(
        "risk",
        f"""SELECT shot_id, ts_unix_ns // {6 * fx.BUCKET} * {6 * fx.BUCKET} AS ts_unix_ns,
        {r('arg_max(risk_h50, r.ts_unix_ns)')} AS risk_h50, {r('arg_max(risk_h200, r.ts_unix_ns)')} AS risk_h200
        FROM risk r GROUP BY 1, 2""",
    ),
)
def risk_upsert(spark, sf_dir):
    """Risks of one hour share a key; the last one written stays. The risks of some shots are stored
    first, all others are merged into the stored table."""
    hour = 6 * fx.BUCKET
    rows = fx.risks(spark, sf_dir).select(
        "shot_id",
        F.expr(f"(ts_unix_ns div {hour}L) * {hour}L").alias("ts_unix_ns"),
        "risk_h50",
        "risk_h200",
        F.col("ts_unix_ns").alias("arrival"),
    )
    early = F.col("arrival") % 3 == 0
    path = work_dir(spark, "risks")
    sinks.write_series(rows.filter(early).transform(upsert.risk_upsert, ["arrival"], keep_arrival=True), path, buckets=8)
    return rounded(sinks.upsert_series(spark, path, rows, upsert.RISK_KEY, ["arrival"]).drop("arrival"))


@query(
    "shots_dim",
    with_views(
        "tel",
        "SELECT shot_id, min(ts_unix_ns) AS started_unix_ns, max(ts_unix_ns) AS finished_unix_ns"
        " FROM tel GROUP BY 1",
    ),
)
def shots_dim(spark, sf_dir):
    """Built in two increments, the odd and the even events."""
    rows = fx.arrivals(spark, sf_dir)
    odd = shots.shots_dimension(rows.filter("event_id % 2 = 1"))
    even = shots.shots_dimension(rows.filter("event_id % 2 = 0"))
    return shots.merge_shots(odd, even)


@query(
    "orphan_points",
    with_views(
        "tel shots",
        "SELECT shot_id, count(*) AS points FROM tel WHERE shot_id NOT IN ("
        "SELECT shot_id FROM shots WHERE disruption_time_unix_ns IS NULL) GROUP BY 1",
    ),
)
def orphan_points(spark, sf_dir):
    """Samples of disrupted days have no row in a dimension of safe days."""
    safe = fx.shots(spark, sf_dir).filter("disruption_time_unix_ns is null")
    return shots.orphans(fx.telemetry(spark, sf_dir), safe)
