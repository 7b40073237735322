"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotstream.operators import ewm, features, ingest, labels, points, reads, robust, spectral
from shotstream.plans import fixtures as fx
from shotstream.plans.catalog import ORACLES, query, r, rounded
from shotstream.plans.sql_views import STATS, stat_sql, wide_names, window_sql, with_views


@query(
    "online_features",
    with_views(
        "online",
        "SELECT shot_id, ts_unix_ns, channel_name, "
        + ", ".join(f"{r(s)} AS {s}" for s in STATS)
        + " FROM online",
    ),
)
def online_features(spark, sf_dir):
    made = features.online_features(fx.telemetry(spark, sf_dir))
    return rounded(made.select("shot_id", "ts_unix_ns", "channel_name", *fx.stat_columns()))


def _point_features(spark, sf_dir):
    pts = ingest.with_missing_ratio(fx.points(spark, sf_dir))
    return features.online_features(points.explode_points(pts, "missing_ratio"))


_POINT_ONLINE = (
    f"(SELECT shot_id, ts_unix_ns, channel_name, value, {stat_sql()} FROM pts {window_sql()})"
)


@query(
    "feature_vectors",
    with_views(
        "pts",
        "SELECT shot_id, ts_unix_ns, CAST(w AS INTEGER) AS window_ms, feature, value FROM ("
        + " UNION ALL ".join(
            f"SELECT shot_id, ts_unix_ns, {w} AS w, channel_name || '_{s}_w{w}' AS feature,"
            f" {r(f'{s}_w{w}')} AS value FROM {_POINT_ONLINE}"
            for w in (50, 200)
            for s in features.ONLINE_STATS
        )
        + " UNION ALL SELECT shot_id, ts_unix_ns, w, 'missing_ratio', "
        + r("(5 - count(*)) / 5.0")
        + " FROM pts, (VALUES (50), (200)) AS t(w) GROUP BY 1, 2, 3)",
    ),
)
def feature_vectors(spark, sf_dir):
    """Vectors as maps, opened again into rows for comparison."""
    made = features.feature_vectors(_point_features(spark, sf_dir))
    rows = made.select(
        "shot_id", "ts_unix_ns", "window_ms", F.explode("features").alias("feature", "value")
    )
    return rounded(rows)


@query(
    "feature_series",
    with_views(
        "pts",
        "SELECT shot_id, ts_unix_ns, channel_name, window_ms, "
        + ", ".join(f"{r(s)} AS {s}" for s in features.ONLINE_STATS)
        + " FROM ("
        + " UNION ALL ".join(
            f"SELECT shot_id, ts_unix_ns, channel_name, CAST({w} AS INTEGER) AS window_ms, "
            + ", ".join(f"{s}_w{w} AS {s}" for s in features.ONLINE_STATS)
            + f" FROM {_POINT_ONLINE}"
            for w in (50, 200)
        )
        + ")",
    ),
)
def feature_series(spark, sf_dir):
    rows = features.per_window(_point_features(spark, sf_dir))
    return rounded(reads.series("features", rows))


@query(
    "offline_features",
    with_views(
        "tel",
        "SELECT shot_id, ts_unix_ns, channel_name, "
        + ", ".join(f"{r(s)} AS {s}" for s in STATS)
        + " FROM (SELECT * REPLACE ("
        + ", ".join(
            f"CASE WHEN i >= 2 THEN regr_slope(value, i) OVER w{w} ELSE 0.0 END AS slope_w{w}"
            for w in (50, 200)
        )
        + f") FROM (SELECT *, {stat_sql()} FROM (SELECT *, CAST(row_number() OVER"
        " (PARTITION BY shot_id, channel_name ORDER BY ts_unix_ns) AS DOUBLE) AS i FROM tel) "
        + window_sql()
        + ") "
        + window_sql()
        + ")",
    ),
)
def offline_features(spark, sf_dir):
    made = features.offline_features(fx.telemetry(spark, sf_dir))
    return rounded(made.select("shot_id", "ts_unix_ns", "channel_name", *fx.stat_columns()))


# Short series (the day shots) let SQL sum the weights directly, row by earlier row.
@query(
    "ewm_zscore",
    with_views(
        "tel",
        f"""SELECT shot_id, ts_unix_ns, channel_name, {r('m')} AS ema, {r('std')} AS ema_std,
        {r('(value - m) / (std + 1e-9)')} AS zscore FROM (
          SELECT a.shot_id, a.channel_name, a.ts_unix_ns, any_value(a.value) AS value,
            sum(w * b.value) AS m,
            CASE WHEN any_value(a.i) = 0 THEN 1.0 ELSE sqrt(greatest(sum(w * b.x * b.x)
              - sum(w * b.x) * sum(w * b.x), 0.0) / (1.0 - sum(w * w))) END AS std
          FROM s a JOIN (SELECT *, value - first_value(value) OVER (PARTITION BY shot_id, channel_name ORDER BY i) AS x
            FROM s) b ON a.shot_id = b.shot_id AND a.channel_name = b.channel_name AND b.i <= a.i,
          LATERAL (SELECT CASE WHEN b.i = 0 THEN 1.0 ELSE 0.01 END * pow(0.99, a.i - b.i) AS w) t
          GROUP BY 1, 2, 3)""",
    ).replace(" SELECT shot_id, ts_unix_ns, channel_name, (round", ", s AS (SELECT *, row_number() OVER"
        " (PARTITION BY shot_id, channel_name ORDER BY ts_unix_ns) - 1 AS i FROM tel)"
        " SELECT shot_id, ts_unix_ns, channel_name, (round", 1),
)
def ewm_zscore(spark, sf_dir):
    made = ewm.ewm_zscore(fx.telemetry(spark, sf_dir))
    return rounded(
        made.select("shot_id", "ts_unix_ns", "channel_name", "ema", "ema_std", "zscore")
    )


@query(
    "anomaly_mad",
    with_views(
        "tel",
        f"""SELECT shot_id, ts_unix_ns, channel_name,
        {r('CASE WHEN n >= 10 AND mad > 0 THEN abs(value - med) / (mad + 1e-9) ELSE 0.0 END')} AS anomaly
        FROM (SELECT *, count(*) OVER w AS n, median(value) OVER w AS med, mad(value) OVER w AS mad
          FROM tel WINDOW w AS (PARTITION BY shot_id, channel_name ORDER BY ts_unix_ns
          ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))""",
    ),
)
def anomaly_mad(spark, sf_dir):
    made = robust.anomaly(fx.telemetry(spark, sf_dir))
    return rounded(made.select("shot_id", "ts_unix_ns", "channel_name", "anomaly"))


@query(
    "all_features",
    f"SELECT * FROM ({ORACLES['offline_features']}) JOIN (SELECT shot_id, ts_unix_ns, channel_name, zscore"
    f" FROM ({ORACLES['ewm_zscore']})) USING (shot_id, ts_unix_ns, channel_name) JOIN ({ORACLES['anomaly_mad']})"
    " USING (shot_id, ts_unix_ns, channel_name)",
)
def all_features(spark, sf_dir):
    made = features.all_features(fx.telemetry(spark, sf_dir))
    return rounded(
        made.select("shot_id", "ts_unix_ns", "channel_name", *fx.stat_columns(), "zscore", "anomaly")
    )


_FRAMED = (
    "(SELECT *, least(1000, n // 10) AS frame FROM (SELECT *, count(*) OVER (PARTITION BY shot_id) AS n,"
    " row_number() OVER (PARTITION BY shot_id ORDER BY ts_unix_ns) AS i FROM sup))"
)


@query(
    "spectral_energy",
    with_views(
        "sup",
        f"""SELECT shot_id, ts_unix_ns, CAST(frame AS INTEGER) AS frame,
        {r('''CASE WHEN frame >= 32 AND c >= 32 THEN (c * sq + s * s
        + CASE WHEN c % 2 = 0 THEN alt * alt ELSE 0.0 END) / 2.0 ELSE 0.0 END''')} AS energy
        FROM (SELECT *, count(*) OVER w AS c, sum(value) OVER w AS s, sum(value * value) OVER w AS sq,
          sum(CASE WHEN i % 2 = 0 THEN value ELSE -value END) OVER w AS alt FROM {_FRAMED}
          WINDOW w AS (PARTITION BY shot_id ORDER BY i
            ROWS BETWEEN greatest(frame - 1, 0) PRECEDING AND CURRENT ROW))""",
    ),
)
def spectral_energy(spark, sf_dir):
    made = spectral.spectral_energy(fx.supplier_series(spark, sf_dir))
    return rounded(made.select("shot_id", "ts_unix_ns", "frame", "energy"))


# A discrete Fourier transform: for full frames by sums over a window per frequency (the power does not
# depend on where the phase starts), for the growing frames at the start of a series term by term.
@query(
    "dominant_freq",
    with_views(
        "sup",
        f"""SELECT f.shot_id, f.ts_unix_ns, {r('coalesce(best * 1000.0 / f.c, 0.0)')} AS dominant_freq
        FROM f LEFT JOIN (
          SELECT shot_id, i, arg_max(k, (round(power, 4), -k)) AS best FROM (
            SELECT * FROM (
              SELECT shot_id, i, k, frame, pow(sum(value * cos(2 * pi() * k * i / frame)) OVER w, 2)
                + pow(sum(value * sin(2 * pi() * k * i / frame)) OVER w, 2) AS power
              FROM (SELECT *, unnest(range(1, frame // 2 + 1)) AS k FROM f WHERE frame >= 32)
              WINDOW w AS (PARTITION BY shot_id, k ORDER BY i ROWS BETWEEN greatest(frame - 1, 0) PRECEDING AND CURRENT ROW))
            WHERE i >= frame
            UNION ALL
            SELECT a.shot_id, a.i, k, any_value(a.frame),
              pow(sum(b.value * cos(2 * pi() * k * (b.i - a.i) / a.c)), 2)
              + pow(sum(b.value * sin(2 * pi() * k * (b.i - a.i) / a.c)), 2) AS power
            FROM (SELECT *, unnest(range(1, c // 2 + 1)) AS k FROM f WHERE frame >= 32 AND c >= 32 AND i < frame) a
            JOIN f b ON a.shot_id = b.shot_id AND b.i BETWEEN a.i - a.c + 1 AND a.i
            GROUP BY 1, 2, 3) GROUP BY 1, 2) p USING (shot_id, i)""",
    ).replace(
        " SELECT f.shot_id",
        f", f AS (SELECT *, least(i, frame) AS c FROM {_FRAMED}) SELECT f.shot_id",
        1,
    ),
)
def dominant_freq(spark, sf_dir):
    made = spectral.dominant_frequency(fx.supplier_series(spark, sf_dir))
    return rounded(made.select("shot_id", "ts_unix_ns", "dominant_freq"))


@query(
    "feature_matrix",
    with_views(
        "filled",
        "SELECT shot_id, ts_unix_ns, "
        + ", ".join(f"{r(f'coalesce({n}, 0.0)')} AS {n}" for n in wide_names())
        + " FROM filled",
    ),
)
def feature_matrix(spark, sf_dir):
    wide = fx.vectors(spark, sf_dir)
    return rounded(labels.fill_features(wide, wide_names()).select("shot_id", "ts_unix_ns", *wide_names()))
