"""As-of joins, alignment, outer joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.config import AlignSettings
from vitalgrid.functions.timekeys import floor_window
from vitalgrid.operators import align, asof, joins, ordered
from vitalgrid.plans import aggregator
from vitalgrid.queries.base import query
from vitalgrid.queries.ingest import W
from vitalgrid.sources import event_view as view
from vitalgrid.sources.registry import ENSEMBLE_SLOTS

DAY = 86_400_000
R = view.READINGS_SQL

# --- as-of ----------------------------------------------------------------------


def _asof_sql(expr: str) -> str:
    """Candidates by aggregates over the whole event list of the user."""
    return f"""WITH {R}, p AS (SELECT userid, eventId, time_stamp AS t FROM readings WHERE sensor = 'gyroscope'),
    e AS (SELECT userid, time_stamp AS s FROM readings WHERE sensor = 'accelerometer'),
    c AS (SELECT p.userid, p.eventId, p.t, max(CASE WHEN s < t THEN s END) AS b, min(CASE WHEN s >= t THEN s END) AS a
      FROM p LEFT JOIN e ON p.userid = e.userid GROUP BY ALL)
    SELECT userid, eventId, t, CASE WHEN a IS NULL THEN NULL WHEN b IS NULL THEN a ELSE {expr} END AS matched FROM c"""


def _asof(spark, sf_dir, mode):
    rows = view.readings(spark, sf_dir, labels=False)
    probes = rows.where("sensor = 'gyroscope'").select("userid", "eventId", F.col("time_stamp").alias("t"))
    found = rows.where("sensor = 'accelerometer'").select("userid", F.col("time_stamp").alias("matched"))
    piece = ordered.fit_piece_ms(rows, ["userid"], "time_stamp", 3 * DAY)
    return asof.asof_join(probes, found, ["userid"], "t", "matched", mode, piece_ms=piece)


@query("asof_backward", _asof_sql("b"))
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, "backward")


@query("asof_forward", _asof_sql("a"))
def asof_forward(spark, sf_dir):
    return _asof(spark, sf_dir, "forward")


@query("asof_nearest", _asof_sql("CASE WHEN a - t < t - b THEN a ELSE b END"))
def asof_nearest(spark, sf_dir):
    return _asof(spark, sf_dir, "nearest")


# --- alignment ------------------------------------------------------------------

STEP = 2 * DAY
EPOCH = 6 * DAY


def align_sql(group: str, rows: str, reference: str, step: int, n_sensors: int = 5) -> str:
    """The definition, step by step over an explicit grid.

    ``group`` lists key columns, ``rows`` names a table with these, sensor,
    time_stamp and eventId.
    """
    keys = [g.strip() for g in group.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    g = ", ".join(keys)
    ag = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    return f"""
    u AS (SELECT {g}, sensor, time_stamp, max(eventId) AS eventId FROM {rows} GROUP BY {g}, sensor, time_stamp),
    per AS (SELECT {g}, sensor, count(*) AS n, min(time_stamp) AS lo, max(time_stamp) AS hi FROM u GROUP BY {g}, sensor),
    slowest AS (SELECT {g}, sensor AS slow, hi, row_number() OVER (PARTITION BY {g} ORDER BY n, sensor) AS rn,
      count(*) OVER (PARTITION BY {g}) AS n_sensors FROM per),
    clock AS (SELECT {ag('s')}, slow, s.hi, r.lo AS t0 FROM slowest s JOIN per r ON {on('s', 'r')} AND r.sensor = '{reference}'
      WHERE rn = 1 AND n_sensors = {n_sensors}),
    grid AS (SELECT {g}, slow, t0, unnest(generate_series(t0 + {step}, hi, {step})) AS p FROM clock WHERE t0 + {step} <= hi),
    anchored AS (SELECT {ag('g')}, g.p, coalesce(max(CASE WHEN e.time_stamp < g.p THEN e.time_stamp END), min(e.time_stamp)) AS anchor
      FROM grid g JOIN u e ON {on('g', 'e')} AND e.sensor = g.slow GROUP BY {ag('g')}, g.p),
    anchors AS (SELECT {g}, anchor, lag(anchor) OVER (PARTITION BY {g} ORDER BY anchor) AS prev
      FROM (SELECT DISTINCT {g}, anchor FROM anchored)),
    near AS (SELECT {ag('a')}, a.anchor, e.sensor,
      max(CASE WHEN e.time_stamp < a.anchor THEN e.time_stamp END) AS b,
      min(CASE WHEN e.time_stamp >= a.anchor THEN e.time_stamp END) AS f
      FROM anchors a JOIN u e ON {on('a', 'e')} AND (a.prev IS NULL OR e.time_stamp > a.prev) GROUP BY {ag('a')}, a.anchor, e.sensor),
    chosen AS (SELECT {g}, anchor, sensor, CASE WHEN b IS NULL OR f - anchor < anchor - b THEN f ELSE b END AS time_stamp
      FROM near WHERE f IS NOT NULL),
    aligned AS (SELECT {ag('c')}, c.anchor, c.sensor, c.time_stamp, u.eventId FROM chosen c
      JOIN u ON {on('c', 'u')} AND c.sensor = u.sensor AND c.time_stamp = u.time_stamp)"""


PRED = f"{view.PREDICTIONS_SQL}, rows AS (SELECT userid, sensor, time_stamp, eventId, label FROM predictions)"
ALIGNED_SQL = f"{PRED}, {align_sql('userid', 'rows', 'gyroscope', STEP)}"


def sensor_predictions(spark, sf_dir):
    return aggregator.decode(view.predictions(spark, sf_dir))


def aligned_predictions(spark, sf_dir):
    rows = sensor_predictions(spark, sf_dir)
    piece = ordered.fit_piece_ms(view.events(spark, sf_dir, False), ["userid"], "time_stamp", 5 * DAY)
    return aggregator.aligned(rows, view.SENSORS, AlignSettings(step_ms=STEP, piece_ms=piece))


@query("aligned_sensors", f"WITH {ALIGNED_SQL} SELECT userid, anchor, sensor, time_stamp, eventId FROM aligned")
def aligned_sensors(spark, sf_dir):
    return aligned_predictions(spark, sf_dir).drop("label")


EPOCH_SQL = f"""{view.PREDICTIONS_SQL}, rows AS (SELECT userid, time_stamp // {EPOCH} AS epoch, sensor, time_stamp, eventId, label
  FROM predictions), {align_sql('userid, epoch', 'rows', 'gyroscope', STEP)}"""


@query(
    "aligned_sensors_by_epoch",
    f"WITH {EPOCH_SQL} SELECT userid, epoch, anchor, sensor, time_stamp, eventId FROM aligned",
)
def aligned_sensors_by_epoch(spark, sf_dir):
    """Alignment restarted every epoch; epochs of a busy user are cut into measured pieces."""
    rows = sensor_predictions(spark, sf_dir).withColumn("epoch", floor_window("time_stamp", EPOCH))
    piece = ordered.fit_piece_ms(view.events(spark, sf_dir, False), ["userid"], "time_stamp", EPOCH)
    out = align.align(rows, ["userid", "epoch"], view.SENSORS, "gyroscope", STEP, piece_ms=piece)
    return out.drop("label")


@query(
    "slowest_sensor",
    f"""WITH {PRED}, n AS (SELECT userid, sensor, count(DISTINCT time_stamp) AS n FROM rows GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY n, sensor) AS rn FROM n)
    SELECT r.userid, sensor AS slow, t0 FROM r JOIN (SELECT userid, min(time_stamp) AS t0 FROM rows WHERE sensor = 'gyroscope' GROUP BY 1) g
    ON r.userid = g.userid WHERE rn = 1""",
)
def slowest_sensor(spark, sf_dir):
    unique = align.last_per_time(sensor_predictions(spark, sf_dir), ["userid"], "sensor", "time_stamp", "eventId")
    clock = align.group_clock(unique, ["userid"], "sensor", "time_stamp", "gyroscope")
    return clock.select("userid", "slow", "t0")


@query(
    "ensemble_slots",
    f"""WITH {ALIGNED_SQL}, coded AS (SELECT a.userid, a.anchor, a.sensor, p.code FROM aligned a JOIN predictions p ON a.eventId = p.eventId)
    SELECT userid, anchor, {', '.join(f"max(CASE WHEN sensor = '{s}' THEN CAST(code AS DOUBLE) END) AS {s.lower()}" for s in ENSEMBLE_SLOTS)}
    FROM coded GROUP BY ALL""",
)
def ensemble_slots(spark, sf_dir):
    from vitalgrid.functions.scalars import label_code

    rows = aligned_predictions(spark, sf_dir).withColumn("code", label_code("label").cast("double"))
    wide = align.slots(rows, ["userid", "anchor"], "sensor", "code", ENSEMBLE_SLOTS)
    return wide.select("userid", "anchor", *[F.col(s).alias(s.lower()) for s in ENSEMBLE_SLOTS])


@query(
    "nested_events",
    f"""WITH {ALIGNED_SQL} SELECT userid, anchor, count(*) AS n, string_agg(sensor || ':' || eventId, ',' ORDER BY sensor) AS events
    FROM aligned GROUP BY ALL""",
)
def nested_events(spark, sf_dir):
    nested = align.nested_events(aligned_predictions(spark, sf_dir), ["userid", "anchor"], ["eventId", "time_stamp"])
    text = F.transform("events", lambda e: F.concat_ws(":", e["sensor"], e["eventId"]))
    return nested.select(
        "userid", "anchor", F.size("events").cast("bigint").alias("n"), F.array_join(text, ",").alias("events")
    )


@query(
    "user_event_lists",
    f"""WITH {R}, numbered AS (SELECT userid, eventId, row_number() OVER (PARTITION BY userid ORDER BY time_stamp, eventId) AS idx FROM readings)
    SELECT userid, (idx - 1) // 16 AS page, count(*) AS n, string_agg(eventId, ',' ORDER BY idx) AS events
    FROM numbered GROUP BY ALL""",
)
def user_event_lists(spark, sf_dir):
    """All events of a user in order, as lists of a fixed length: a user of any size
    is spread over many rows and tasks."""
    rows = view.readings(spark, sf_dir, labels=False).select("userid", "time_stamp", "eventId")
    piece = ordered.fit_piece_ms(rows, ["userid"], "time_stamp", 5 * DAY)
    return align.event_pages(rows, ["userid"], ["time_stamp", "eventId"], 16, piece).select(
        "userid", "page", F.size("events").cast("bigint").alias("n"),
        F.array_join(F.transform("events", lambda v: v["eventId"]), ",").alias("events"),
    )


# --- other joins ----------------------------------------------------------------

_THREE = ["accelerometer", "gyroscope", "barometer"]
WINDOWED_SQL = f"""{view.PREDICTIONS_SQL}, w AS (SELECT userid, time_stamp // {W} AS win, sensor, min(label) AS label
  FROM predictions WHERE sensor IN ('accelerometer', 'gyroscope', 'barometer') GROUP BY ALL)"""


def windowed_labels(spark, sf_dir):
    return sensor_predictions(spark, sf_dir).where(F.col("sensor").isin(_THREE)).withColumn(
        "win", floor_window("time_stamp", W)
    )


@query(
    "full_outer_by_window",
    f"""WITH {WINDOWED_SQL}, a AS (SELECT * FROM w WHERE sensor = 'accelerometer'), g AS (SELECT * FROM w WHERE sensor = 'gyroscope'),
    b AS (SELECT * FROM w WHERE sensor = 'barometer'),
    ag AS (SELECT coalesce(a.userid, g.userid) AS userid, coalesce(a.win, g.win) AS win, a.label AS accelerometer, g.label AS gyroscope
      FROM a FULL OUTER JOIN g ON a.userid = g.userid AND a.win = g.win)
    SELECT coalesce(ag.userid, b.userid) AS userid, coalesce(ag.win, b.win) AS win, accelerometer, gyroscope, b.label AS barometer
    FROM ag FULL OUTER JOIN b ON ag.userid = b.userid AND ag.win = b.win""",
)
def full_outer_by_window(spark, sf_dir):
    return joins.outer_by_pivot(windowed_labels(spark, sf_dir), ["userid", "win"], "sensor", "label", _THREE)


@query(
    "complete_windows",
    f"""WITH {WINDOWED_SQL} SELECT a.userid, a.win, a.label AS accelerometer, g.label AS gyroscope, b.label AS barometer
    FROM w a JOIN w g ON a.userid = g.userid AND a.win = g.win JOIN w b ON a.userid = b.userid AND a.win = b.win
    WHERE a.sensor = 'accelerometer' AND g.sensor = 'gyroscope' AND b.sensor = 'barometer'""",
)
def complete_windows(spark, sf_dir):
    wide = joins.outer_by_pivot(windowed_labels(spark, sf_dir), ["userid", "win"], "sensor", "label", _THREE)
    return joins.complete_rows(wide, _THREE)


@query(
    "positional_join",
    f"""WITH {R}, a AS (SELECT eventId, row_number() OVER (ORDER BY time_stamp, eventId) AS idx FROM readings WHERE sensor = 'accelerometer'),
    b AS (SELECT eventId AS other, row_number() OVER (ORDER BY time_stamp, eventId) AS idx FROM readings WHERE sensor = 'gyroscope')
    SELECT idx, eventId, other FROM a JOIN b USING (idx)""",
)
def positional_join(spark, sf_dir):
    rows = view.readings(spark, sf_dir, labels=False).select("eventId", "time_stamp", "sensor")
    order = ["time_stamp", "eventId"]
    piece = ordered.fit_piece_ms(rows, [], "time_stamp", DAY)
    left = ordered.running_index(rows.where("sensor = 'accelerometer'"), [], order, piece).select("idx", "eventId")
    right = ordered.running_index(rows.where("sensor = 'gyroscope'"), [], order, piece)
    return left.join(right.select("idx", F.col("eventId").alias("other")), "idx")
