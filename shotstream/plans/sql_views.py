"""The fixture views as SQL common table expressions, written apart from the Spark code."""

from __future__ import annotations

from shotstream.operators.features import ONLINE_STATS
from shotstream.plans import fixtures as fx

B = fx.BUCKET
CASE_CHANNEL = "CASE event_type " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in fx.CHANNEL_OF.items()
) + " END"


def stat_sql(windows=(50, 200)) -> str:
    parts = []
    for w in windows:
        parts.append(
            f"avg(value) OVER w{w} AS mean_w{w},"
            f" coalesce(CASE WHEN count(*) OVER w{w} > 1 THEN stddev_samp(value) OVER w{w} END, 0.0)"
            f" AS std_w{w},"
            f" min(value) OVER w{w} AS min_w{w}, max(value) OVER w{w} AS max_w{w},"
            f" CASE WHEN count(*) OVER w{w} >= 2"
            f" THEN (value - first_value(value) OVER w{w}) / {float(w)} ELSE 0.0 END AS slope_w{w},"
            f" value AS last_w{w},"
            f" coalesce(value - lag(value) OVER ordered, 0.0) AS delta_w{w}"
        )
    return ", ".join(parts)


def window_sql(windows=(50, 200), keys="shot_id, channel_name") -> str:
    frames = [
        f"w{w} AS (PARTITION BY {keys} ORDER BY ts_unix_ns"
        f" ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for w in windows
    ]
    return "WINDOW ordered AS (PARTITION BY " + keys + " ORDER BY ts_unix_ns), " + ", ".join(frames)


STATS = [f"{s}_w{w}" for w in (50, 200) for s in ONLINE_STATS]


def score_sql(model, column=lambda name: name) -> str:
    terms = [f"{column(n)} * ({c!r})" for n, c in sorted(model.coefficients.items())]
    return f"({model.intercept!r} + " + " + ".join(terms) + ")"


def sigmoid_sql(score: str) -> str:
    return f"(1.0 / (1.0 + exp(-({score}))))"


def wide_names() -> list[str]:
    return [f"{c}_{s}" for c in fx.MODEL_CHANNELS for s in STATS]


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (needs, body)


_view(
    "arr",
    (),
    f"""SELECT event_id, event_id + (event_id * 7919) % 13 AS arrival,
    strftime(ts, '%Y%m%d') AS shot_id, epoch_ns(ts) AS ts_unix_ns,
    {CASE_CHANNEL} AS channel_name, value,
    CASE WHEN k % 10 = 0 THEN 'missing' WHEN k % 10 = 1 THEN 'outlier' ELSE 'good' END AS quality
    FROM (SELECT *, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)""",
)
_view("tel", ("arr",), "SELECT shot_id, ts_unix_ns, channel_name, value, quality FROM arr")
_view(
    "pts",
    ("tel",),
    f"""SELECT shot_id, (ts_unix_ns // {B}) * {B} AS ts_unix_ns, channel_name,
    arg_max(value, ts_unix_ns) AS value, arg_max(quality, ts_unix_ns) AS quality
    FROM tel GROUP BY ALL""",
)
_view(
    "judged0",
    ("arr",),
    """SELECT event_id, arrival * 16 + event_id % 13 AS arrival, ts_unix_ns,
    CASE WHEN event_id % 73 = 0 THEN NULL WHEN event_id % 97 = 0 THEN '' ELSE shot_id END AS shot_id,
    shot_id AS day, channel_name, value, quality,
    CASE WHEN event_id % 73 = 0 THEN 'invalid payload'
         WHEN event_id % 97 = 0 THEN 'missing shot_id'
         WHEN event_id % 89 = 0 THEN 'no channels'
         WHEN event_id % 83 = 0 THEN 'invalid timestamp'
         WHEN event_id % 79 = 0 THEN 'channel not allowed' END AS reason FROM arr""",
)
_view(
    "judged",
    ("judged0",),
    """SELECT * EXCLUDE (reason, seen), CASE WHEN reason IS NULL AND ts_unix_ns <= seen
    THEN 'timestamp must increase' ELSE reason END AS reason FROM (
      SELECT *, max(CASE WHEN reason IS NULL THEN ts_unix_ns END) OVER (
        PARTITION BY shot_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM judged0)""",
)
_view(
    "shots",
    ("tel",),
    """SELECT shot_id, started_unix_ns, finished_unix_ns,
    CASE WHEN CAST(substr(shot_id, 7, 2) AS INTEGER) % 3 = 0 THEN peak END AS disruption_time_unix_ns
    FROM (SELECT shot_id, min(lo) AS started_unix_ns, max(hi) AS finished_unix_ns,
      arg_max(ts_unix_ns, (value, ts_unix_ns)) FILTER (WHERE ts_unix_ns >= lo + ((hi - lo) // 10) * 7) AS peak
      FROM (SELECT *, min(ts_unix_ns) OVER (PARTITION BY shot_id) AS lo,
            max(ts_unix_ns) OVER (PARTITION BY shot_id) AS hi FROM tel) GROUP BY shot_id)""",
)
_view(
    "online",
    ("tel",),
    f"SELECT shot_id, ts_unix_ns, channel_name, value, {stat_sql()} FROM tel {window_sql()}",
)
_view(
    "grid",
    ("online",),
    f"SELECT shot_id, (ts_unix_ns // {B}) * {B} AS ts_unix_ns, "
    + ", ".join(
        f"arg_max({s}, ts_unix_ns) FILTER (WHERE channel_name = '{c}') AS {c}_{s}"
        for c in fx.MODEL_CHANNELS
        for s in STATS
    )
    + " FROM online WHERE channel_name IN ("
    + ", ".join(f"'{c}'" for c in fx.MODEL_CHANNELS)
    + ") GROUP BY 1, 2",
)
_view(
    "filled",
    ("grid",),
    "SELECT shot_id, ts_unix_ns, "
    + ", ".join(f"last_value({n} IGNORE NULLS) OVER f AS {n}" for n in wide_names())
    + " FROM grid WINDOW f AS (PARTITION BY shot_id ORDER BY ts_unix_ns"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
_view(
    "vec",
    ("filled",),
    "SELECT shot_id, ts_unix_ns, "
    + ", ".join(f"coalesce({n}, 0.0) AS {n}" for n in wide_names())
    + ", ("
    + " + ".join(f"CASE WHEN {c}_last_w50 IS NULL THEN 1 ELSE 0 END" for c in fx.MODEL_CHANNELS)
    + f") / {float(len(fx.MODEL_CHANNELS))} AS missing_ratio FROM filled",
)
_view(
    "risk",
    ("vec",),
    f"""SELECT shot_id, ts_unix_ns, p AS risk_h50, least(1.0, p * 0.9 + 0.05) AS risk_h200,
    'demo' AS model_version, 'demo-cal' AS calibration_version, missing_ratio, prad_mean_w50
    FROM (SELECT *, {sigmoid_sql(score_sql(fx.demo_model()))} AS p FROM vec)""",
)
_view(
    "scored",
    ("risk", "shots"),
    f"""SELECT r.shot_id, r.ts_unix_ns, r.risk_h50 AS p, time_to_disruption, disruption_time_unix_ns,
    CASE WHEN time_to_disruption <= {fx.HOURS[0]} THEN 1 ELSE 0 END AS label_h{fx.HOURS[0]},
    CASE WHEN time_to_disruption <= {fx.HOURS[1]} THEN 1 ELSE 0 END AS label
    FROM (SELECT r.*, s.disruption_time_unix_ns,
      coalesce((s.disruption_time_unix_ns - r.ts_unix_ns) / 1e6, CAST('Infinity' AS DOUBLE))
        AS time_to_disruption FROM risk r JOIN shots s USING (shot_id)) r""",
)
_view(
    "alerts",
    ("risk",),
    """SELECT shot_id, ts_unix_ns, 'alert' AS kind,
    printf('High disruption risk (%s=%.3f)', horizon, risk) AS message,
    CASE WHEN risk >= 0.9 THEN 'high' ELSE 'medium' END AS severity, horizon FROM (
      SELECT shot_id, ts_unix_ns, 'h50' AS horizon, risk_h50 AS risk FROM risk WHERE risk_h50 >= 0.85
      UNION ALL
      SELECT shot_id, ts_unix_ns, 'h200', risk_h200 FROM risk WHERE risk_h200 >= 0.75)""",
)
_view(
    "contrib",
    ("vec",),
    "SELECT shot_id, ts_unix_ns, feature, value * coef AS contribution, value FROM (UNPIVOT vec ON "
    + ", ".join(wide_names())
    + " INTO NAME feature VALUE value) JOIN (VALUES "
    + ", ".join(f"('{n}', {c!r})" for n, c in sorted(fx.demo_model().coefficients.items()))
    + ") AS m(feature, coef) USING (feature)",
)
_view(
    "drivers",
    ("contrib",),
    """SELECT shot_id, ts_unix_ns, rank, feature, contribution FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY shot_id, ts_unix_ns
      ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM contrib) WHERE rank <= 5""",
)
_view(
    "sup",
    (),
    """SELECT CAST(l_suppkey AS VARCHAR) AS shot_id, l_orderkey * 8 + l_linenumber AS ts_unix_ns,
    arg_min(l_quantity, (l_partkey, l_extendedprice, l_quantity)) AS value
    FROM lineitem GROUP BY 1, 2""",
)


def with_views(views: str, select: str) -> str:
    """Prefix a select with the views it names (space separated) and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for need in VIEWS[name][0]:
            add(need)
        order.append(name)

    for name in views.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + " " + select
