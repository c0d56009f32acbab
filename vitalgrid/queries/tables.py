"""Keyed tables, metric posts, purges, counts, sets and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions import scalars
from vitalgrid.functions.scalars import rounded
from vitalgrid.functions.timekeys import epoch_ms
from vitalgrid.operators import metrics, parse
from vitalgrid.queries.base import query, r6
from vitalgrid.queries.ingest import POINTS_SQL
from vitalgrid.session import scratch_path
from vitalgrid.sources import event_view as view
from vitalgrid.sources import keyed, scans, sinks
from vitalgrid.sources.registry import ACTIVITY_SENSORS, PHYSIO_SENSORS

DAY = 86_400_000


def _points(spark, sf_dir):
    return metrics.metric_points(parse.accepted(parse.parse_messages(view.messages(spark, sf_dir))))


@query(
    "keyed_table_upsert",
    f"""WITH {view.EVENTS_SQL}, writes AS (
      SELECT l_orderkey AS event_id, epoch_ms(l_shipdate) AS time_stamp, CAST(l_linenumber AS BIGINT) AS batch_seq,
             l_partkey, l_extendedprice FROM lineitem),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time_stamp DESC, batch_seq DESC,
      l_partkey DESC, l_extendedprice DESC) AS rn FROM writes)
    SELECT event_id, time_stamp, batch_seq, l_partkey, {r6('l_extendedprice')} AS price FROM ranked WHERE rn = 1""",
)
def keyed_table_upsert(spark, sf_dir):
    """Line items as writes to an order's row, in two loads: the latest one stays."""
    writes = view.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), epoch_ms("l_shipdate").alias("time_stamp"),
        F.col("l_linenumber").cast("bigint").alias("batch_seq"), "l_partkey", "l_extendedprice",
    )
    first, second = writes.where("batch_seq <= 3"), writes.where("batch_seq > 3")
    order = ["time_stamp", "batch_seq", "l_partkey", "l_extendedprice"]
    now = sinks.upsert(sinks.last_write_wins(first, "event_id", order), second, "event_id", order)
    return now.select("event_id", "time_stamp", "batch_seq", "l_partkey", rounded("l_extendedprice").alias("price"))


@query(
    "keyed_table_files",
    f"""WITH {view.READINGS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY userid, sensor, time_stamp // {DAY}
      ORDER BY time_stamp DESC, eventId DESC) AS rn FROM readings)
    SELECT userid, sensor, time_stamp, {r6('x')} AS x FROM ranked WHERE rn = 1""",
)
def keyed_table_files(spark, sf_dir):
    """Two batches written to a keyed table on disk, one of them twice, read back
    with one row per user, sensor and day."""
    rows = view.readings(spark, sf_dir, labels=False).select(
        F.concat_ws("/", "userid", "sensor", F.floor(F.col("time_stamp") / DAY)).alias("event_id"),
        "userid", "sensor", "time_stamp", "x", "eventId",
    )
    path = scratch_path(spark, "keyed")
    early = F.pmod(F.xxhash64("eventId"), F.lit(2)) == 0
    for batch_id, part in ((0, rows.where(early)), (1, rows.where(~early)), (1, rows.where(~early))):
        sinks.append_keyed(part, path, batch_id, ["sensor"])
    stored = spark.read.parquet(path).drop("batch_id")
    now = sinks.last_write_wins(stored, "event_id", ["time_stamp", "eventId"])
    return now.select("userid", "sensor", "time_stamp", rounded("x").alias("x"))


MERGE_ORDER = ["time_stamp", "batch_seq", "l_partkey", "l_extendedprice"]
PURGE_MS = 60 * DAY


@query(
    "keyed_table_merge",
    f"""WITH writes AS (
      SELECT l_orderkey AS event_id, epoch_ms(l_shipdate) AS time_stamp, CAST(l_linenumber AS BIGINT) AS batch_seq,
             l_partkey, l_extendedprice, false AS deleted FROM lineitem
      UNION ALL SELECT o_orderkey, epoch_ms(o_orderdate) + {PURGE_MS}, 99, NULL, NULL, true FROM orders WHERE o_orderpriority = '1-URGENT'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY time_stamp DESC, batch_seq DESC,
      l_partkey DESC, l_extendedprice DESC) AS rn FROM writes)
    SELECT event_id, time_stamp, batch_seq, l_partkey, {r6('l_extendedprice')} AS price FROM ranked WHERE rn = 1 AND NOT deleted""",
)
def keyed_table_merge(spark, sf_dir):
    """Line items as writes to an order's row: a first load, then two merges, the first of which also
    purges urgent orders as of a time. Writes older than the purge come after it and stay out."""
    writes = view.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), epoch_ms("l_shipdate").alias("time_stamp"),
        F.col("l_linenumber").cast("bigint").alias("batch_seq"), "l_partkey", "l_extendedprice",
    )
    urgent = view.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("event_id"), (epoch_ms("o_orderdate") + PURGE_MS).alias("at"))
    path, key, buckets = scratch_path(spark, "keyed"), ["event_id"], 8
    first = sinks.last_write_wins(writes.where("batch_seq <= 2"), key, MERGE_ORDER)
    table = keyed.write(first, f"{path}/v1", key, buckets)
    purged = keyed.tombstones(urgent, table, key, {"time_stamp": F.col("at"), "batch_seq": F.lit(99)})
    live = writes.where("batch_seq IN (3, 4)").withColumn("deleted", F.lit(False))
    table = keyed.merge(table, live.unionByName(purged), f"{path}/v2", key, MERGE_ORDER, buckets)
    table = keyed.merge(table, writes.where("batch_seq > 4"), f"{path}/v3", key, MERGE_ORDER, buckets)
    out = keyed.current(table)
    return out.select("event_id", "time_stamp", "batch_seq", "l_partkey", rounded("l_extendedprice").alias("price"))


# One metric of one time piece is numbered by so many tasks.
SHARDS = 4
NUMBERED_SQL = f"""{POINTS_SQL}, sharded AS (SELECT *, timestamp // {5 * DAY} AS piece,
  CAST(CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % {SHARDS} AS INTEGER) AS shard FROM points),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name, piece, shard ORDER BY timestamp, event_id) AS idx FROM sharded)"""


@query(
    "metric_post_numbers",
    f"""WITH {NUMBERED_SQL}
    SELECT name, piece, shard, (idx - 1) // 50 AS post_id, count(*) AS n, min(timestamp) AS first_time, max(timestamp) AS last_time
    FROM numbered GROUP BY ALL""",
)
def metric_post_numbers(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("id", F.substring(F.col("tags")["event_id"], 2, 20).cast("bigint"))
    numbered = metrics.number_posts(points, ["name"], ["timestamp", "id"], 50, 5 * DAY, "id", SHARDS)
    return numbered.groupBy("name", "piece", "shard", "post_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")
    )


@query(
    "metric_post_bodies",
    f"""WITH {NUMBERED_SQL}
    SELECT name, piece, shard, (idx - 1) // 50 AS post_id, count(*) AS n_points, count(*) AS n_in_body,
    arg_min(timestamp, idx) AS first_time FROM numbered GROUP BY ALL""",
)
def metric_post_bodies(spark, sf_dir):
    """Posts as text, written, read back and counted."""
    points = _points(spark, sf_dir).withColumn("id", F.substring(F.col("tags")["event_id"], 2, 20).cast("bigint"))
    numbered = metrics.number_posts(points, ["name"], ["timestamp", "id"], 50, 5 * DAY, "id", SHARDS)
    bodies = metrics.posts(numbered, ["name"])
    path = scratch_path(spark, "posts")
    sinks.write_json_lines(bodies, path)
    back = scans.read_json_lines(spark, path, "name STRING, piece BIGINT, shard INT, post_id BIGINT, body STRING, n_points BIGINT")
    return back.select(
        "name", "piece", "shard", "post_id", "n_points", F.json_array_length("body").cast("bigint").alias("n_in_body"),
        F.get_json_object("body", "$[0].timestamp").cast("bigint").alias("first_time"),
    )


@query(
    "purge_metrics",
    f"""WITH {POINTS_SQL} SELECT name, count(*) AS n FROM points
    WHERE name NOT IN (SELECT 'raw_altimeter_' || c FROM (VALUES ('rate'), ('total_gain'), ('total_loss')) t(c)) GROUP BY 1""",
)
def purge_metrics(spark, sf_dir):
    names = spark.createDataFrame(
        [("raw_altimeter_rate",), ("raw_altimeter_total_gain",), ("raw_altimeter_total_loss",)], "name STRING"
    )
    kept = sinks.purge(_points(spark, sf_dir), names)
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "table_sizes",
    f"WITH {view.MESSAGES_SQL} SELECT 'raw_' || sensor AS \"table\", count(*) AS n FROM good GROUP BY 1",
)
def table_sizes(spark, sf_dir):
    rows = parse.accepted(parse.parse_messages(view.messages(spark, sf_dir)))
    return sinks.table_sizes(rows.select(F.concat(F.lit("raw_"), F.col("sensor")).alias("table")))


@query(
    "published_messages",
    f"WITH {view.PREDICTIONS_SQL} SELECT eventId, label AS activity, userid, time_stamp FROM predictions",
)
def published_messages(spark, sf_dir):
    """Results as JSON text, written, read and parsed again."""
    p = view.predictions(spark, sf_dir).select(
        "eventId", scalars.normalise_label("result").alias("activity"), "userid", "time_stamp"
    )
    path = scratch_path(spark, "published")
    sinks.as_messages(p).write.text(path)
    schema = "eventId STRING, activity STRING, userid STRING, time_stamp BIGINT"
    return spark.read.text(path).select(F.from_json("value", schema).alias("m")).select("m.*")


@query(
    "records_per_sensor",
    f"WITH {view.READINGS_SQL} SELECT sensor, count(*) AS n, count(DISTINCT userid) AS users FROM readings GROUP BY 1",
)
def records_per_sensor(spark, sf_dir):
    """Counts in two steps: distinct (sensor, user) first, so no sensor is one task."""
    pairs = view.readings(spark, sf_dir, labels=False).groupBy("sensor", "userid").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("sensor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("users"))


@query("distinct_users", f"WITH {view.READINGS_SQL} SELECT DISTINCT userid FROM readings")
def distinct_users(spark, sf_dir):
    return view.readings(spark, sf_dir, labels=False).select("userid").distinct()


@query(
    "message_rate",
    """SELECT event_type AS topic, CAST(floor(epoch_us(ts) / 3600000000e0) AS BIGINT) AS hour, count(*) AS n
    FROM events GROUP BY ALL""",
)
def message_rate(spark, sf_dir):
    """Messages per topic and time unit; an hour here, since stored events are sparse."""
    ev = view.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    rate = ev.groupBy(F.col("event_type").alias("topic"), F.window("t", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return rate.select("topic", F.floor(F.unix_seconds("window.start") / 3600).cast("bigint").alias("hour"), "n")


@query(
    "union_sensor_families",
    f"""WITH {view.MESSAGES_SQL} SELECT CASE WHEN sensor IN ('skinTemperature', 'heartRate', 'gsr', 'rrinterval')
    THEN 'physio' ELSE 'activity' END AS family, sensor, count(*) AS n, count(CASE WHEN sensor IN ('accelerometer', 'gyroscope') THEN 1 END) AS with_x
    FROM good WHERE sensor <> 'hdhld' GROUP BY ALL""",
)
def union_sensor_families(spark, sf_dir):
    wide = parse.wide_records(parse.accepted(parse.parse_messages(view.messages(spark, sf_dir))))
    activity = wide.where(F.col("sensor").isin(ACTIVITY_SENSORS)).select("sensor", "x", F.lit("activity").alias("family"))
    body = wide.where(F.col("sensor").isin(PHYSIO_SENSORS)).select("sensor", F.lit("physio").alias("family"))
    both = activity.unionByName(body, allowMissingColumns=True)
    return both.groupBy("family", "sensor").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("with_x"))


@query(
    "silent_sensors",
    f"""WITH {view.READINGS_SQL}, grid AS (SELECT DISTINCT r.userid, r.time_stamp // {DAY} AS day, s.sensor
      FROM readings r, (SELECT DISTINCT sensor FROM readings) s),
    seen AS (SELECT DISTINCT userid, time_stamp // {DAY} AS day, sensor FROM readings)
    SELECT userid, day, string_agg(sensor, ',' ORDER BY sensor) AS missing FROM
      (SELECT * FROM grid EXCEPT SELECT userid, day, sensor FROM seen) GROUP BY ALL""",
)
def silent_sensors(spark, sf_dir):
    from vitalgrid.operators.align import missing_sensors

    rows = view.readings(spark, sf_dir, labels=False).withColumn("day", F.floor(F.col("time_stamp") / DAY).cast("bigint"))
    out = missing_sensors(rows, ["userid", "day"], "sensor", view.SENSORS)
    return out.where("size(missing) > 0").withColumn("missing", F.array_join("missing", ","))


@query(
    "result_json_lines",
    f"WITH {view.PREDICTIONS_SQL} SELECT eventId, userid, label FROM predictions",
)
def result_json_lines(spark, sf_dir):
    rows = view.predictions(spark, sf_dir).select("eventId", "userid", scalars.normalise_label("result").alias("label"))
    path = scratch_path(spark, "results")
    sinks.write_json_lines(rows, path)
    return scans.read_json_lines(spark, path, "eventId STRING, userid STRING, label STRING")
