"""Streams run to the end of their input, closed by an end mark, and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions.scalars import last_token, normalise_label, rounded
from vitalgrid.operators import align, features, joins, metrics, novelty, parse
from vitalgrid.operators.bayesnet import SIGNALS
from vitalgrid.operators.decide import EQUAL_WEIGHTS, VOTE_WEIGHTS, vote
from vitalgrid.plans import novelty as novelty_plan
from vitalgrid.plans import raw_writer
from vitalgrid.queries.base import query, r6
from vitalgrid.queries.decisions import _DAILY, _vote_sql
from vitalgrid.queries.ingest import POINTS_SQL, W
from vitalgrid.queries.joins import ALIGNED_SQL, EPOCH, EPOCH_SQL, STEP
from vitalgrid.queries.network import (
    ALARM_POINTS_SQL, LIVE, N, NOVELTY_TABLE_SQL, PHYSIO_NOVELTY_SQL, PHYSIO_STEP, RATE_SQL, SETTINGS, SHIFT, fitted, network_of,
)
from vitalgrid.queries.windows import AXIS_SQL
from vitalgrid.session import scratch_path, stored
from vitalgrid.sources import event_view as view
from vitalgrid.sources import scans, sinks
from vitalgrid.streaming import alignment, control, posts, runner, windows
from vitalgrid.streaming import novelty as novelty_stream

DAY = 86_400_000
DELAY = "1 day"
R = view.READINGS_SQL


def event_stream(spark, sf_dir, with_k=True):
    """The events table as a file stream."""
    runner.prepare(spark)
    schema = view.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return view.shape_events(raw, with_k)


@query(
    "stream_axis_features",
    f"""WITH {R}, {view.KNOWN_SQL}, unique_rows AS (SELECT DISTINCT deviceid, userid, time_stamp // {W} AS win, x, y, z
      FROM readings WHERE sensor = 'accelerometer' AND userid IN (SELECT userid FROM known))
    SELECT deviceid, userid, win, count(*) AS n, {AXIS_SQL} FROM unique_rows
    GROUP BY deviceid, userid, win""",
)
def stream_axis_features(spark, sf_dir):
    """Flagship as a stream: filter against the static users, distinct, features."""
    rows = view.as_readings(event_stream(spark, sf_dir)).where("sensor = 'accelerometer'")
    mine = joins.keep_known(rows, view.known_users(spark, sf_dir), "userid", ["eventId"])
    mine = mine.select("deviceid", "userid", "time_stamp", "x", "y", "z")
    out = runner.run_to_table(mine, "axis", lambda s: windows.axis_features(s, ["deviceid", "userid"], W), delay=DELAY)
    return out.select(
        "deviceid", "userid", F.col("window").alias("win"), "n", *[rounded(c).alias(c) for c in features.AXIS_FEATURES]
    )


@query(
    "stream_valid_users",
    f"WITH {R}, {view.KNOWN_SQL} SELECT eventId, userid FROM readings WHERE userid IN (SELECT userid FROM known)",
)
def stream_valid_users(spark, sf_dir):
    rows = view.as_readings(event_stream(spark, sf_dir, False), False).select("eventId", "userid")
    mine = joins.keep_known(rows, view.known_users(spark, sf_dir), "userid", ["eventId"])
    return runner.run_to_table(mine, "valid")


def written_messages(spark, sf_dir):
    """The raw writer over messages that are all sent twice; returns its folder."""
    runner.prepare(spark)
    path = scratch_path(spark, "raw")
    sent = view.messages(spark, sf_dir).select("value")
    sent.unionByName(sent).write.text(f"{path}/topics/band")
    stream = scans.read_messages(spark, f"{path}/topics/*", max_files=4)
    runner.drain(raw_writer.start(stream, path, f"{path}/checkpoint", None, piece_ms=5 * DAY, shards=2))
    return path


@query(
    "stream_raw_writer",
    f"WITH {view.MESSAGES_SQL} SELECT sensor, 'e' || event_id AS event_id, time_stamp FROM good",
)
def stream_raw_writer(spark, sf_dir):
    """Text messages to keyed tables, batch by batch. Every message is sent twice;
    the key keeps one."""
    path = written_messages(spark, sf_dir)
    return sinks.read_keyed(spark, f"{path}/records").select("sensor", "event_id", "time_stamp")


@query(
    "stream_offsets",
    f"WITH {view.MESSAGES_SQL} SELECT sensor, 'e' || event_id AS event_id, time_stamp FROM good",
)
def stream_offsets(spark, sf_dir):
    """Messages from the logs of two topics: a first run stops within them, at a third of their bytes,
    a second one goes on from its offsets. No message is lost or read twice."""
    runner.prepare(spark)
    path = scratch_path(spark, "logs")
    sent = view.messages(spark, sf_dir).select("value")
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    for i, topic in enumerate(("band", "phone")):
        sent.where(half == i).write.text(f"{path}/{topic}")
    size = sent.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    for limit in (max(1, size // 3), None):
        lines = scans.read_log(spark, path, ["band", "phone"], "writers", limit)
        runner.drain(runner.start_table(lines.select("value"), f"{path}/table", f"{path}/checkpoint"))
    good = parse.accepted(parse.parse_messages(spark.read.schema("value string").parquet(f"{path}/table")))
    return parse.wide_records(good).select("sensor", "event_id", "time_stamp")


@query(
    "stream_metric_posts",
    f"""WITH {POINTS_SQL} SELECT name, 2 * count(*) AS n_points FROM points GROUP BY 1""",
)
def stream_metric_posts(spark, sf_dir):
    """Metric posts of the raw writer: all points of all batches, in full posts."""
    sent = spark.read.parquet(f"{written_messages(spark, sf_dir)}/posts")
    return sent.groupBy("name").agg(F.sum("n_points").alias("n_points"))


POST_SHARDS = 2


@query(
    "stream_full_posts",
    f"""WITH {POINTS_SQL}, dealt AS (SELECT name, CAST(CAST(('0x' || substr(md5('e' || event_id), 1, 8)) AS BIGINT) % {POST_SHARDS} AS INTEGER) AS shard, count(*) AS n
      FROM points GROUP BY 1, 2)
    SELECT name, shard, p AS post_id, CAST(least(50, n - 50 * p) AS INTEGER) AS n_points, least(50, n - 50 * p) AS n_in_body
    FROM (SELECT name, shard, n, unnest(range((n + 49) // 50)) AS p FROM dealt)""",
)
def stream_full_posts(spark, sf_dir):
    """Metric posts over several batches: every post is full but the last of a metric's shard."""
    runner.prepare(spark)
    path = scratch_path(spark, "posts")
    view.messages(spark, sf_dir).select("value").repartition(4).write.text(f"{path}/topics/band")
    stream = scans.read_messages(spark, f"{path}/topics/*", max_files=1)
    points = metrics.metric_points(parse.accepted(parse.parse_messages(stream)))
    out = runner.run_to_table(
        points, "full-posts", lambda s: posts.post_stream(s, 50, DAY, POST_SHARDS, "tags['event_id']"), ts_ms="timestamp",
        delay="60 days")
    return out.withColumn("n_in_body", F.json_array_length("body").cast("bigint")).drop("body")


@query(
    "stream_rejects",
    f"""WITH {view.MESSAGES_SQL} SELECT CASE WHEN form = 7 THEN 'bad_json' ELSE 'unknown_sensor' END AS status, 2 * count(*) AS n
    FROM msg WHERE form <> 11 AND (form = 7 OR sensor IN ('contact', 'pedometer')) GROUP BY 1""",
)
def stream_rejects(spark, sf_dir):
    rejects = spark.read.parquet(f"{written_messages(spark, sf_dir)}/rejects")
    return rejects.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_published",
    f"WITH {view.PREDICTIONS_SQL} SELECT eventId, label AS activity FROM predictions",
)
def stream_published(spark, sf_dir):
    """Results as JSON text, one file per task and batch."""
    p = view.as_predictions(event_stream(spark, sf_dir))
    rows = p.select("eventId", normalise_label("result").alias("activity"))
    path = scratch_path(spark, "out")
    writer = sinks.message_stream(rows, f"{path}/checkpoint", path=f"{path}/messages")
    runner.drain(writer.trigger(**runner.trigger(None)).start())
    back = spark.read.text(f"{path}/messages")
    return back.select(F.from_json("value", "eventId STRING, activity STRING").alias("m")).select("m.*")


@query(
    "stream_aligned_sensors",
    f"""WITH {EPOCH_SQL} SELECT userid, epoch, anchor, sensor, time_stamp, eventId FROM aligned""",
)
def stream_aligned_sensors(spark, sf_dir):
    """One stream per sensor, fanned in and aligned with keyed state."""
    runner.prepare(spark)
    p = view.predictions(spark, sf_dir).withColumn("topic", last_token("processor_name"))
    path = scratch_path(spark, "fan")
    rows = p.select("topic", "userid", "time_stamp", "eventId")
    rows.write.partitionBy("topic").parquet(path)
    schema = rows.drop("topic").schema
    streams = [
        spark.readStream.schema(schema).parquet(f"{path}/topic={s}").withColumn("sensor", F.lit(s)) for s in view.SENSORS
    ]
    return runner.run_to_table(
        scans.union_streams(streams), "aligned",
        lambda s: alignment.align_stream(s, view.SENSORS, "gyroscope", STEP, EPOCH), delay=DELAY, sensor="gyroscope",
    )


def live_clock(rows, sensors, reference):
    """Slowest sensor and start of each user that has all sensors."""
    times = rows.select("userid", "sensor", "time_stamp").distinct()
    return stored(align.group_clock(times, ["userid"], "sensor", "time_stamp", reference, sensors), "clock")


@query("stream_aligned_live", f"WITH {ALIGNED_SQL} SELECT userid, anchor, sensor, time_stamp, eventId FROM aligned")
def stream_aligned_live(spark, sf_dir):
    """Alignment without epochs: anchors leave as the watermark moves, by the clock of a table."""
    clock = live_clock(
        view.predictions(spark, sf_dir).select("userid", last_token("processor_name").alias("sensor"), "time_stamp"), view.SENSORS, "gyroscope")
    rows = view.as_predictions(event_stream(spark, sf_dir)).select(
        "userid", last_token("processor_name").alias("sensor"), "time_stamp", "eventId")
    return runner.run_to_table(
        rows, "live", lambda s: alignment.align_live(s, clock, view.SENSORS, STEP, DAY), delay=DELAY, sensor="gyroscope", userid="end")


@query(
    "stream_activity_by_vote",
    "WITH " + _vote_sql(
        VOTE_WEIGHTS, f"{EPOCH_SQL}, voters AS (SELECT a.userid, epoch, anchor, p.label FROM aligned a JOIN predictions p ON a.eventId = p.eventId)",
        "userid, epoch, anchor",
    ),
)
def stream_activity_by_vote(spark, sf_dir):
    """The aggregator as a stream: predictions of all sensors are aligned with their labels,
    and every anchor is decided by the weighted vote of its sensors.

    All sensors of an anchor leave the state in one batch, so each batch votes on its own."""
    p = view.as_predictions(event_stream(spark, sf_dir))
    rows = p.select("userid", last_token("processor_name").alias("sensor"), "time_stamp", "eventId", normalise_label("result").alias("label"))
    path = scratch_path(spark, "activity")
    timed = runner.with_event_time(runner.with_end(rows, f"{path}/end"), "time_stamp", DELAY)
    aligned = alignment.align_stream(timed, view.SENSORS, "gyroscope", STEP, EPOCH, "label")

    def write(batch, batch_id):
        voted = vote(batch, ["userid", "epoch", "anchor"], "label", VOTE_WEIGHTS)
        voted.write.mode("overwrite").parquet(f"{path}/activity/batch_id={batch_id}")

    runner.drain(runner.start_batches(aligned, write, f"{path}/checkpoint"))
    runner.write_end(spark, rows.schema, f"{path}/end", "time_stamp", sensor="gyroscope")
    runner.drain(runner.start_batches(aligned, write, f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/activity").drop("batch_id")


@query(
    "stream_novelty_rate",
    f"""WITH {RATE_SQL} SELECT event_id, {r6('novel_rate')} AS novel_rate, alarm FROM alarms""",
)
def stream_novelty_rate(spark, sf_dir):
    """Records judged against a fitted network, then the rate with memory per user."""
    _, cuts, tables = fitted(spark, sf_dir)
    live = view.as_physio(event_stream(spark, sf_dir)).withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
    judged = novelty.decide(novelty_plan.judge(live, cuts, tables, ["network"], ["event_id"]), SETTINGS.threshold)
    out = runner.run_to_table(
        judged.select("user_id", "time_stamp", "event_id", "novel"), "rate",
        lambda s: novelty_stream.trailing_rate_stream(s, N, SETTINGS.rate_threshold, DAY),
        delay=DELAY, user_id="end", event_id=-1, novel=False,
    )
    return out.select("event_id", rounded("novel_rate").alias("novel_rate"), "alarm")


def stream_points(spark, sf_dir):
    """Violations of the trailing rows of every alarm, from the stream."""
    _, cuts, tables = fitted(spark, sf_dir)
    live = view.as_physio(event_stream(spark, sf_dir)).withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
    judged = novelty.decide(novelty_plan.judge(live, cuts, tables, ["network"], ["event_id"]), SETTINGS.threshold)
    return runner.run_to_table(
        judged.select("user_id", "time_stamp", "event_id", "novel", "violations"), "points",
        lambda s: novelty_stream.novelty_points_stream(s, N, SETTINGS.rate_threshold, DAY, idle_ms=400 * DAY),
        delay=DELAY, user_id="end", event_id=-1, novel=False,
    )


@query("stream_novelty_table", NOVELTY_TABLE_SQL)
def stream_novelty_table(spark, sf_dir):
    """The novelty table as the stream writes it: one row per violation of an alarmed record."""
    out = novelty_stream.point_rows(stream_points(spark, sf_dir))
    return out.drop("novel_event_id").withColumns({c: rounded(c) for c in ("result_percentage", "novel_rate")})


@query("stream_alarm_points", ALARM_POINTS_SQL)
def stream_alarm_points(spark, sf_dir):
    """Every alarm of the stream with all the violations of its trailing rows."""
    return stream_points(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("alarm_event_id"), F.col("point_event_id").alias("event_id"), "out_event",
        rounded("result_percentage").alias("percentage"))


@query("stream_physio_novelty", PHYSIO_NOVELTY_SQL)
def stream_physio_novelty(spark, sf_dir):
    """One stream, two stateful steps: the five signals are aligned as the watermark moves, each whole
    anchor is judged by its network, and the rate keeps a memory per user."""
    _, cuts, tables = fitted(spark, sf_dir)
    signals = list(view.PHYSIO_OF.values())
    clock = live_clock(view.physio_events(view.events(spark, sf_dir)), signals, "HR_RATE")

    def build(s):
        whole = alignment.align_live(s, clock, signals, PHYSIO_STEP, DAY, "reading", whole=True)
        rows = novelty_plan.live_slots(whole, "userid", "anchor").withColumn("network", network_of("user_id"))
        rows = rows.withColumns({s: F.col(s) * SHIFT for s in SIGNALS})
        judged = novelty.decide(novelty_plan.judge(rows, cuts, tables, ["network"], ["user_id", "event_id"]), LIVE.threshold)
        judged = judged.select("user_id", "time_stamp", "event_id", "novel", "event_time")
        return novelty_stream.trailing_rate_stream(judged, LIVE.window_rows, LIVE.rate_threshold, DAY)

    out = runner.run_to_table(view.physio_events(event_stream(spark, sf_dir)), "physio", build, delay=DELAY, sensor="HR_RATE", userid="end")
    return out.select("user_id", "time_stamp", rounded("novel_rate").alias("novel_rate"), "alarm", "novel")


_COMMAND_SQL = f"CASE event_id % 40 WHEN 0 THEN '{control.STOP}' WHEN 20 THEN '{control.START}' WHEN 10 THEN '{control.STATUS}' END"


@query(
    "stream_control",
    f"""WITH {view.EVENTS_SQL}, sent AS (SELECT userid AS owner, time_stamp, event_id, value, {_COMMAND_SQL} AS command FROM ev),
    seen AS (SELECT *, coalesce(last_value(CASE command WHEN '{control.STOP}' THEN 'STOPPED' WHEN '{control.START}' THEN 'STARTED' END IGNORE NULLS) OVER
      (PARTITION BY owner ORDER BY time_stamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'STARTED') AS state FROM sent)
    SELECT owner, time_stamp, event_id, CASE WHEN command IS NULL THEN 'data' ELSE 'status' END AS kind, state FROM seen
    WHERE command = '{control.STATUS}' OR (command IS NULL AND state = 'STARTED')""",
)
def stream_control(spark, sf_dir):
    """Data and commands in one stream: a stopped user's data is dropped until the user is started again."""
    ev = event_stream(spark, sf_dir, False)
    command = F.expr(_COMMAND_SQL)
    text = F.when(command.isNotNull(), F.to_json(F.struct(command.alias("control_msg"), "userid"))).otherwise(F.to_json(F.struct("userid", "value")))
    rows = ev.select("userid", "time_stamp", "event_id", text.alias("value"))
    out = runner.run_to_table(rows, "control", lambda s: control.gated(s, "userid", DAY), delay=DELAY, userid="end", event_id=-1)
    return out.drop("payload")


@query(
    "stream_two_stages",
    "WITH " + _vote_sql(EQUAL_WEIGHTS, _DAILY, "userid, day"),
)
def stream_two_stages(spark, sf_dir):
    """Stage one writes labelled predictions to a table, stage two reads that table
    as a stream and votes. Each stage has its own checkpoint."""
    p = view.as_predictions(event_stream(spark, sf_dir))
    first = p.select("userid", "time_stamp", normalise_label("result").alias("label"))
    path = scratch_path(spark, "stages")
    runner.drain(runner.start_table(first, f"{path}/labels", f"{path}/checkpoint"))
    second = spark.readStream.schema(first.schema).parquet(f"{path}/labels")
    out = runner.run_to_table(
        second, "votes", lambda s: windows.window_votes(s, ["userid"], "label", DAY, EQUAL_WEIGHTS), delay=DELAY
    )
    return out.withColumnRenamed("window", "day")


@query(
    "stream_late_rows",
    f"""WITH {view.EVENTS_SQL}, parts AS (SELECT *, time_stamp // {W} AS win, CASE WHEN k % 10 = 3 OR time_stamp >= lo + 20 * {DAY}
      THEN 1 ELSE 0 END AS part FROM ev, (SELECT min(time_stamp) AS lo FROM ev)),
    wm AS (SELECT max(time_stamp) - {DAY} AS mark FROM parts WHERE part = 0)
    SELECT event_type, win, count(*) AS n FROM parts, wm
    WHERE part = 0 OR (win + 1) * {W} > mark GROUP BY ALL""",
)
def stream_late_rows(spark, sf_dir):
    """The stream stops and goes on: rows of the second part that belong to windows
    already closed are dropped, the others are counted."""
    runner.prepare(spark)
    ev = view.events(spark, sf_dir)
    turn = ev.agg(F.min("time_stamp") + 20 * DAY).scalar()
    parts = ev.withColumn(
        "part", ((F.col("k") % 10 == 3) | (F.col("time_stamp") >= turn)).cast("int")
    ).select("event_type", "time_stamp", "part")
    path = scratch_path(spark, "late")
    schema = "event_type STRING, time_stamp BIGINT"
    for part in (0, 1):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        if part == 0:
            spark.createDataFrame([], schema).write.parquet(f"{path}/end")
        both = stream.unionByName(spark.readStream.schema(schema).parquet(f"{path}/end"))
        out = windows.counts(runner.with_event_time(both, "time_stamp", DELAY), ["event_type"], W)
        runner.drain(runner.start_table(out, f"{path}/table", f"{path}/checkpoint"))
    runner.write_end(spark, stream.schema, f"{path}/end", "time_stamp")
    runner.drain(runner.start_table(out, f"{path}/table", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table").withColumnRenamed("window", "win")
