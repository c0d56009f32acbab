"""Window features and ordered passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions.scalars import rounded
from vitalgrid.operators import features, joins, ordered
from vitalgrid.queries.base import query, r6
from vitalgrid.queries.ingest import W
from vitalgrid.sources import event_view as view

DAY = 86_400_000
R = view.READINGS_SQL


def _corr(a: str, b: str) -> str:
    return f"coalesce(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 0)"


AXIS_SQL = ", ".join(
    [f"{r6(f'avg({a})')} AS avg_{a}" for a in "xyz"]
    + [f"{r6(f'coalesce(var_samp({a}), 0)')} AS var_{a}" for a in "xyz"]
    + [f"{r6(f'coalesce(stddev_samp({a}), 0)')} AS std_{a}" for a in "xyz"]
    + [f"{r6(_corr(a, b))} AS corr_{a}{b}" for a, b in ("xy", "xz", "yz")]
)


@query(
    "axis_features_serving",
    f"""WITH {R}, {view.KNOWN_SQL}, unique_rows AS (
      SELECT DISTINCT deviceid, userid, CAST(round_even(time_stamp / {W}e0, 0) AS BIGINT) AS win, x, y, z
      FROM readings WHERE sensor = 'accelerometer' AND userid IN (SELECT userid FROM known))
    SELECT deviceid, userid, win, win * {W} AS time_stamp, count(*) AS n, {AXIS_SQL} FROM unique_rows
    GROUP BY deviceid, userid, win""",
)
def axis_features_serving(spark, sf_dir):
    """Flagship: readings of one sensor, users with a model, distinct rows per
    rounded window, twelve features."""
    rows = view.readings(spark, sf_dir, sensors=["accelerometer"])
    mine = joins.keep_known(rows, view.known_users(spark, sf_dir), "userid", ["eventId"])
    out = features.axis_features(mine, ["deviceid", "userid"], "time_stamp", W, "round")
    return out.select(
        "deviceid", "userid", F.col("window").alias("win"), (F.col("window") * W).alias("time_stamp"), "n",
        *[rounded(c).alias(c) for c in features.AXIS_FEATURES],
    )


@query(
    "axis_features_training",
    f"""WITH {R}, unique_rows AS (SELECT DISTINCT userid, activity, sensor, time_stamp // {W} AS win, x, y, z
      FROM readings WHERE activity <> 'NONE')
    SELECT userid, activity, sensor, win, count(*) AS n, {AXIS_SQL} FROM unique_rows GROUP BY userid, activity, sensor, win""",
)
def axis_features_training(spark, sf_dir):
    """All sensors and users in one aggregate, instead of one scan per sensor."""
    rows = view.readings(spark, sf_dir).where("activity <> 'NONE'")
    out = features.axis_features(rows, ["userid", "activity", "sensor"], "time_stamp", W)
    return out.select(
        "userid", "activity", "sensor", F.col("window").alias("win"), "n",
        *[rounded(c).alias(c) for c in features.AXIS_FEATURES],
    )


SLOPE_SQL = f"""{R}, unique_rows AS (SELECT DISTINCT userid, time_stamp // {W} AS win, time_stamp, x, y FROM readings
      WHERE sensor = 'barometer'),
    lagged AS (SELECT *, time_stamp - lag(time_stamp) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy
      FROM unique_rows WINDOW w AS (PARTITION BY userid, win ORDER BY time_stamp, x, y)),
    sloped AS (SELECT userid, win, time_stamp, coalesce(dx / nullif(dt, 0), 0) * 1e6 AS sx,
      coalesce(dy / nullif(dt, 0), 0) * 1e6 AS sy FROM lagged)"""


def _barometer(spark, sf_dir):
    return view.readings(spark, sf_dir, sensors=["barometer"]).select(
        "userid", "time_stamp", F.col("x").alias("air_pressure"), F.col("y").alias("temperature")
    )


@query(
    "lag_slopes",
    f"WITH {SLOPE_SQL} SELECT userid, win, time_stamp, {r6('sx')} AS slope_pressure, {r6('sy')} AS slope_temperature FROM sloped",
)
def lag_slopes(spark, sf_dir):
    """Slopes per million milliseconds, cut into daily pieces: five days is a long
    window for a busy user."""
    unique = features.distinct_readings(
        _barometer(spark, sf_dir), ["userid"], ["time_stamp", "air_pressure", "temperature"], "time_stamp", W
    )
    piece = ordered.fit_piece_ms(view.events(spark, sf_dir, False), ["userid"], "time_stamp", DAY)
    out = features.slopes(unique, ["userid", "window"], "time_stamp", ["air_pressure", "temperature"], piece)
    return out.select(
        "userid", F.col("window").alias("win"), "time_stamp",
        rounded(F.col("slope_air_pressure") * 1e6).alias("slope_pressure"),
        rounded(F.col("slope_temperature") * 1e6).alias("slope_temperature"),
    )


@query(
    "slope_features",
    f"""WITH {SLOPE_SQL} SELECT userid, win, {r6('avg(sx)')} AS avg_slope_pressure, {r6('avg(sy)')} AS avg_slope_temperature
    FROM sloped GROUP BY ALL""",
)
def slope_features(spark, sf_dir):
    rows = _barometer(spark, sf_dir)
    piece = ordered.fit_piece_ms(view.events(spark, sf_dir, False), ["userid"], "time_stamp", DAY)
    out = features.slope_features(rows, ["userid"], "time_stamp", W, piece_ms=piece)
    return out.select(
        "userid", F.col("window").alias("win"),
        *[rounded(F.col(c) * 1e6).alias(c) for c in features.SLOPE_FEATURES],
    )


@query(
    "distinct_window_rows",
    f"""WITH {R}, unique_rows AS (SELECT DISTINCT userid, time_stamp // {W} AS win, sensor, y FROM readings)
    SELECT sensor, win, count(*) AS n FROM unique_rows GROUP BY ALL""",
)
def distinct_window_rows(spark, sf_dir):
    rows = features.distinct_readings(view.readings(spark, sf_dir), ["userid", "sensor"], ["y"], "time_stamp", W)
    return rows.groupBy("sensor", F.col("window").alias("win")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "forward_fill",
    f"""WITH {R}, holes AS (SELECT userid, time_stamp, eventId, CASE WHEN k % 3 = 0 THEN x END AS x,
      CASE WHEN sensor = 'gyroscope' THEN z END AS z FROM readings)
    SELECT userid, time_stamp, {r6('last_value(x IGNORE NULLS) OVER w')} AS x, last_value(z IGNORE NULLS) OVER w AS z FROM holes
    WINDOW w AS (PARTITION BY userid ORDER BY time_stamp, eventId ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def forward_fill(spark, sf_dir):
    holes = view.readings(spark, sf_dir).select(
        "userid", "time_stamp", "eventId", F.when(F.col("k") % 3 == 0, F.col("x")).alias("x"),
        F.when(F.col("sensor") == "gyroscope", F.col("z")).alias("z"),
    )
    piece = ordered.fit_piece_ms(view.events(spark, sf_dir, False), ["userid"], "time_stamp", 2 * DAY)
    out = ordered.forward_fill(holes, ["userid"], ["time_stamp", "eventId"], ["x", "z"], piece)
    return out.select("userid", "time_stamp", rounded("x").alias("x"), "z")


@query(
    "ordinal_position",
    f"WITH {R} SELECT eventId, row_number() OVER (ORDER BY time_stamp, eventId) AS idx FROM readings",
)
def ordinal_position(spark, sf_dir):
    rows = view.readings(spark, sf_dir, labels=False).select("eventId", "time_stamp")
    piece = ordered.fit_piece_ms(rows, [], "time_stamp", DAY)
    return ordered.running_index(rows, [], ["time_stamp", "eventId"], piece).select("eventId", "idx")


@query(
    "last_event_per_time",
    """WITH t AS (SELECT l_suppkey AS userid, l_returnflag AS sensor, epoch_ms(l_shipdate) AS time_stamp,
      l_orderkey * 10 + l_linenumber AS id, l_partkey FROM lineitem),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY userid, sensor, time_stamp ORDER BY id DESC, l_partkey DESC) AS rn FROM t)
    SELECT userid, sensor, time_stamp, id, l_partkey FROM ranked WHERE rn = 1""",
)
def last_event_per_time(spark, sf_dir):
    from vitalgrid.functions.timekeys import epoch_ms

    rows = view.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("userid"), F.col("l_returnflag").alias("sensor"),
        epoch_ms("l_shipdate").alias("time_stamp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "l_partkey",
    )
    return ordered.latest_per_key(rows, ["userid", "sensor", "time_stamp"], [F.desc("id"), F.desc("l_partkey")])


@query(
    "first_rows_after_sort",
    f"WITH {R} SELECT eventId, userid, time_stamp FROM readings ORDER BY time_stamp DESC, eventId LIMIT 10",
)
def first_rows_after_sort(spark, sf_dir):
    rows = view.readings(spark, sf_dir, labels=False).select("eventId", "userid", "time_stamp")
    return rows.orderBy(F.desc("time_stamp"), "eventId").limit(10)


@query(
    "sorted_features",
    f"""WITH {R} SELECT userid, time_stamp // {W} AS win, {r6('avg(x)')} AS avg_x FROM readings
    GROUP BY ALL ORDER BY userid, win""",
)
def sorted_features(spark, sf_dir):
    from vitalgrid.functions.timekeys import floor_window

    rows = view.readings(spark, sf_dir, labels=False).groupBy("userid", floor_window("time_stamp", W).alias("win"))
    return rows.agg(rounded(F.avg("x")).alias("avg_x")).orderBy("userid", "win")
