"""Scans, parsing, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.functions import scalars, timekeys
from vitalgrid.functions.scalars import rounded
from vitalgrid.operators import features, joins, metrics, parse
from vitalgrid.queries.base import query, r6
from vitalgrid.session import scratch_path
from vitalgrid.sources import event_view as view
from vitalgrid.sources import scans, sinks
from vitalgrid.sources.registry import SENSOR_FIELDS, table_name

M = view.MESSAGES_SQL
R = view.READINGS_SQL

# --- parsing --------------------------------------------------------------------


def _numeric_columns() -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for sensor, fields in SENSOR_FIELDS.items():
        for j, c, t, _ in fields:
            if t != "string":
                out.setdefault(c, []).append((sensor, view.FIELD_SQL[j], t))
    return out


def _wide_sql() -> str:
    cols = []
    for c, uses in _numeric_columns().items():
        whens = " ".join(f"WHEN sensor = '{s}' THEN CAST(CAST({e} AS {t}) AS DOUBLE)" for s, e, t in uses)
        cols.append(f"{r6(f'CASE {whens} END')} AS {c}")
    return ", ".join(cols)


_COMMON_SQL = """'e' || event_id AS event_id, 'band' AS device_type,
  CASE WHEN form = 23 THEN 'NA' ELSE deviceid END AS device_id, time_stamp,
  CASE WHEN form = 23 THEN 'NA' ELSE userid END AS user_id, training AS training_mode"""


@query(
    "parse_sensor_records",
    f"""WITH {M} SELECT sensor, {_COMMON_SQL}, {_wide_sql()},
    CASE WHEN sensor = 'hdhld' THEN {view.FIELD_SQL['handheldActivity']} END AS handheld_activity FROM good""",
)
def parse_sensor_records(spark, sf_dir):
    wide = parse.wide_records(parse.accepted(parse.parse_messages(view.messages(spark, sf_dir))))
    return wide.drop("event_type").withColumns({c: rounded(c) for c in parse.reading_columns()})


@query(
    "typed_altimeter_table",
    f"""WITH {M} SELECT {_COMMON_SQL}, CASE WHEN form = 17 THEN '  ALTIMETER ' ELSE 'altimeter' END AS event_type,
    {', '.join(f"CAST({view.FIELD_SQL[j]} AS {'INTEGER' if t == 'int' else 'DOUBLE'}) AS {c}"
               for j, c, t, _ in SENSOR_FIELDS['altimeter'])}
    FROM good WHERE sensor = 'altimeter'""",
)
def typed_altimeter_table(spark, sf_dir):
    rows = parse.sensor_records(parse.parse_messages(view.messages(spark, sf_dir)), "altimeter")
    return rows.withColumn("rate", F.col("rate").cast("double"))


@query(
    "default_values",
    f"""WITH {M} SELECT sensor, CASE WHEN form = 23 THEN 'NA' ELSE userid END AS user_id,
    count(*) AS n FROM good GROUP BY ALL""",
)
def default_values(spark, sf_dir):
    wide = parse.wide_records(parse.accepted(parse.parse_messages(view.messages(spark, sf_dir))))
    return wide.groupBy("sensor", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reject_counts",
    f"""WITH {M} SELECT CASE WHEN form = 7 THEN 'bad_json' ELSE 'unknown_sensor' END AS status, count(*) AS n
    FROM msg WHERE form <> 11 AND (form = 7 OR sensor IN ('contact', 'pedometer')) GROUP BY 1""",
)
def reject_counts(spark, sf_dir):
    refused = parse.rejected(parse.parse_messages(view.messages(spark, sf_dir)))
    return refused.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unknown_sensor_names",
    f"""WITH {M} SELECT lower(sensor) AS name, count(*) AS n FROM msg
    WHERE form NOT IN (7, 11) AND sensor IN ('contact', 'pedometer') GROUP BY 1""",
)
def unknown_sensor_names(spark, sf_dir):
    parsed = parse.parse_messages(view.messages(spark, sf_dir)).where("status = 'unknown_sensor'")
    return parsed.groupBy(F.lower(F.trim("msg.eventtype")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_empty_messages", f"WITH {M} SELECT event_id FROM msg WHERE form <> 11")
def drop_empty_messages(spark, sf_dir):
    return parse.drop_empty(view.messages(spark, sf_dir)).select("event_id")


@query(
    "exclude_disabled_sensors",
    f"""WITH {M} SELECT sensor, count(*) AS n FROM good
    WHERE sensor NOT IN ('accelerometer', 'gyroscope', 'uv', 'hdhld') GROUP BY 1""",
)
def exclude_disabled_sensors(spark, sf_dir):
    parsed = parse.parse_messages(view.messages(spark, sf_dir))
    kept = parse.accepted(parsed, ["accelerometer", "gyroscope", "uv", "hdhld"])
    return kept.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unwrap_array_messages",
    f"""WITH {M} SELECT event_id, 'e' || event_id AS id, form = 13 AS wrapped FROM msg WHERE form NOT IN (7, 11)""",
)
def unwrap_array_messages(spark, sf_dir):
    rows = view.messages(spark, sf_dir).withColumn("one", parse.unwrap_single())
    out = rows.select(
        "event_id", F.get_json_object("one", "$.eventId").alias("id"), F.col("value").startswith("[").alias("wrapped")
    )
    return out.where("id IS NOT NULL")


@query(
    "normalise_sensor_names",
    f"""WITH {view.EVENTS_SQL} SELECT event_id, CASE k % 5 WHEN 0 THEN 'accelerometer' WHEN 1 THEN 'rrinterval'
    WHEN 2 THEN 'skinTemperature' WHEN 3 THEN 'heartRate' END AS sensor FROM ev""",
)
def normalise_sensor_names(spark, sf_dir):
    spelled = F.expr(
        "CASE k % 5 WHEN 0 THEN ' Accel' WHEN 1 THEN 'rrInterval ' WHEN 2 THEN 'SKINTEMPERATURE' "
        "WHEN 3 THEN 'heartrate' ELSE 'contact' END"
    )
    return view.events(spark, sf_dir).select("event_id", scalars.normalise_sensor(spelled).alias("sensor"))


@query(
    "column_roles",
    f"""WITH {view.EVENTS_SQL}, named AS (SELECT CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'time_stamp' WHEN 2 THEN 'event_id'
      WHEN 3 THEN 'Timestamp' WHEN 4 THEN 'user_id' ELSE 'rate' END AS name,
      CASE event_id % 6 WHEN 0 THEN 'float' WHEN 1 THEN 'bigint' WHEN 2 THEN 'uuid' WHEN 3 THEN 'bigint' WHEN 4 THEN 'text'
      ELSE ' INT ' END AS type FROM ev)
    SELECT name, type, CASE WHEN regexp_matches(lower(trim(name)), '^timestamp|time_stamp$') THEN 'timestamp'
      WHEN regexp_matches(lower(trim(type)), 'float|double|int|long|byte|bigint') THEN 'value' ELSE 'tags' END AS role,
      count(*) AS n FROM named GROUP BY ALL""",
)
def column_roles(spark, sf_dir):
    named = view.events(spark, sf_dir).select(
        F.expr("CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'time_stamp' WHEN 2 THEN 'event_id' "
               "WHEN 3 THEN 'Timestamp' WHEN 4 THEN 'user_id' ELSE 'rate' END").alias("name"),
        F.expr("CASE event_id % 6 WHEN 0 THEN 'float' WHEN 1 THEN 'bigint' WHEN 2 THEN 'uuid' "
               "WHEN 3 THEN 'bigint' WHEN 4 THEN 'text' ELSE ' INT ' END").alias("type"),
    )
    return named.groupBy("name", "type", metrics.point_role("name", "type").alias("role")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- metric points --------------------------------------------------------------


def _points_sql() -> str:
    parts = []
    for sensor, fields in SENSOR_FIELDS.items():
        for j, c, t, _ in fields:
            if t != "string":
                parts.append(
                    f"SELECT event_id, '{table_name(sensor)}_{c}' AS name, time_stamp AS timestamp, "
                    f"CAST(CAST({view.FIELD_SQL[j]} AS {t}) AS DOUBLE) AS value, "
                    f"CASE WHEN form = 23 THEN 'NA' ELSE userid END AS tag_user_id, training AS tag_training_mode, "
                    + (f"{view.FIELD_SQL['handheldActivity']}" if sensor == "hdhld" else "CAST(NULL AS VARCHAR)")
                    + f" AS tag_handheld FROM good WHERE sensor = '{sensor}'"
                )
    return " UNION ALL ".join(parts)


POINTS_SQL = f"{M}, points AS ({_points_sql()})"


@query(
    "metric_points",
    f"""WITH {POINTS_SQL} SELECT 'e' || event_id AS tag_event_id, name, timestamp, {r6('value')} AS value,
    tag_user_id, tag_training_mode, tag_handheld FROM points""",
)
def metric_points(spark, sf_dir):
    points = metrics.metric_points(parse.accepted(parse.parse_messages(view.messages(spark, sf_dir))))
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    return points.select(
        tag("event_id").alias("tag_event_id"), "name", "timestamp", rounded("value").alias("value"),
        tag("user_id").alias("tag_user_id"), tag("training_mode").alias("tag_training_mode"),
        tag("handheld_activity").alias("tag_handheld"),
    )


@query(
    "prediction_points",
    f"""WITH {view.PREDICTIONS_SQL} SELECT 'activity_prediction' AS name, time_stamp AS timestamp,
    CAST(code + 1 AS DOUBLE) AS value, userid FROM predictions""",
)
def prediction_points(spark, sf_dir):
    p = view.predictions(spark, sf_dir)
    points = metrics.prediction_points(p, "activity_prediction", scalars.label_code(scalars.normalise_label("result"), 1))
    return points.select("name", "timestamp", "value", F.col("tags")["userid"].alias("userid"))


# --- scalar functions -----------------------------------------------------------

W = 432_000_000  # five days: the stored events are sparse


@query(
    "window_keys",
    f"""WITH {view.EVENTS_SQL} SELECT event_id, CAST(floor(time_stamp / {W}e0) AS BIGINT) AS floor_key,
    CAST(round_even(time_stamp / {W}e0, 0) AS BIGINT) AS round_key,
    CAST(round_even(time_stamp / {W}e0, 0) AS BIGINT) * {W} AS round_time FROM ev""",
)
def window_keys(spark, sf_dir):
    key = timekeys.round_window("time_stamp", W)
    return view.events(spark, sf_dir, False).select(
        "event_id", timekeys.floor_window("time_stamp", W).alias("floor_key"),
        key.alias("round_key"), timekeys.window_start(key, W).alias("round_time"),
    )


@query(
    "label_codes",
    f"""WITH {R} SELECT eventId, activity,
    CASE activity WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1 WHEN 'WALKING_UP' THEN 2 WHEN 'WALKING_DOWN' THEN 3 END AS zero_based,
    CASE activity WHEN 'SITTING' THEN 1 WHEN 'WALKING' THEN 2 WHEN 'WALKING_UP' THEN 3 WHEN 'WALKING_DOWN' THEN 4 END AS one_based,
    CASE activity WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1 WHEN 'WALKING_DOWN' THEN 2 WHEN 'WALKING_UP' THEN 3 END AS sorted_code
    FROM readings""",
)
def label_codes(spark, sf_dir):
    return view.readings(spark, sf_dir).select(
        "eventId", "activity", scalars.label_code("activity").alias("zero_based"),
        scalars.label_code("activity", 1).alias("one_based"),
        scalars.sorted_label_code("activity").alias("sorted_code"),
    )


@query(
    "normalise_results",
    f"WITH {view.PREDICTIONS_SQL} SELECT eventId, label, CAST(code AS INTEGER) AS code FROM predictions",
)
def normalise_results(spark, sf_dir):
    label = scalars.normalise_label("result")
    return view.predictions(spark, sf_dir).select(
        "eventId", label.alias("label"), scalars.label_code(label).alias("code")
    )


@query(
    "one_hot_codes",
    f"""WITH {view.PREDICTIONS_SQL} SELECT eventId, {', '.join(
        f"CASE WHEN (CASE label WHEN 'SITTING' THEN 0 WHEN 'WALKING' THEN 1 WHEN 'WALKING_DOWN' THEN 2 ELSE 3 END) = {i} THEN 1 ELSE 0 END AS code_{i}"
        for i in range(5))} FROM predictions""",
)
def one_hot_codes(spark, sf_dir):
    code = scalars.sorted_label_code(scalars.normalise_label("result"))
    rows = view.predictions(spark, sf_dir).select("eventId", code.alias("c"))
    return rows.select("eventId", *scalars.one_hot("c", 5, "code"))


@query(
    "sensor_of_processor",
    f"WITH {view.PREDICTIONS_SQL} SELECT eventId, sensor FROM predictions",
)
def sensor_of_processor(spark, sf_dir):
    return view.predictions(spark, sf_dir).select("eventId", scalars.last_token("processor_name").alias("sensor"))


@query(
    "repeatable_row_ids",
    f"WITH {view.EVENTS_SQL} SELECT md5(userid || '|' || time_stamp || '|' || event_id) AS row_id FROM ev",
)
def repeatable_row_ids(spark, sf_dir):
    return view.events(spark, sf_dir, False).select(scalars.stable_id("userid", "time_stamp", "event_id").alias("row_id"))


@query("arrival_time", "SELECT event_id, true AS later FROM events")
def arrival_time(spark, sf_dir):
    """Wall-clock time differs between runs; that it is later than the event does not."""
    return view.events(spark, sf_dir, False).select("event_id", (timekeys.now_ms() > F.col("time_stamp")).alias("later"))


@query(
    "fill_and_blank_zeros",
    f"""WITH {R} SELECT eventId, coalesce(nullif(y, 0), 0) + 0.0 AS filled, nullif(z, 0) AS blanked FROM readings""",
)
def fill_and_blank_zeros(spark, sf_dir):
    rows = view.readings(spark, sf_dir).select("eventId", "y", "z")
    blanked = scalars.zero_to_null(rows, ["y", "z"])
    filled = scalars.fill_numeric(blanked.select("eventId", "y", F.col("z").cast("string").alias("_z")))
    return filled.select("eventId", F.col("y").alias("filled"), F.col("_z").cast("double").alias("blanked"))


@query(
    "clean_text",
    """SELECT doc_id, length(regexp_replace(replace(text, '"', ''), '[^\\x00-\\x7F]', '', 'g')) AS n,
    md5(regexp_replace(replace(text, '"', ''), '[^\\x00-\\x7F]', '', 'g')) AS digest FROM documents""",
)
def clean_text(spark, sf_dir):
    text = scalars.ascii_only(scalars.strip_quotes("text"))
    return view.table(spark, sf_dir, "documents").select(
        "doc_id", F.length(text).cast("bigint").alias("n"), F.md5(text).alias("digest")
    )


@query(
    "result_columns",
    f"""WITH {view.PREDICTIONS_SQL} SELECT eventId, 'forest_' || sensor AS processor_name, userid, time_stamp,
    label AS activity FROM predictions""",
)
def result_columns(spark, sf_dir):
    p = view.predictions(spark, sf_dir)
    return p.select(
        "eventId", F.concat(F.lit("forest_"), scalars.last_token("processor_name")).alias("processor_name"),
        "userid", "time_stamp", scalars.normalise_label("result").alias("activity"),
    )


@query(
    "feature_vectors",
    f"WITH {R} SELECT eventId, {r6('x')} AS f0, {r6('y')} AS f1, {r6('z')} AS f2 FROM readings WHERE sensor = 'accelerometer'",
)
def feature_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = view.readings(spark, sf_dir, sensors=["accelerometer"])
    v = vector_to_array("features")
    return features.feature_vector(rows, ["x", "y", "z"]).select(
        "eventId", *[rounded(v[i]).alias(f"f{i}") for i in range(3)]
    )


_ALTIMETER = [(view.FIELD_SQL[j], t) for j, _, t, _ in SENSOR_FIELDS["altimeter"]]


@query(
    "altimeter_vectors",
    f"""WITH {M} SELECT 'e' || event_id AS event_id, {', '.join(
        f"{r6(f'CAST(CAST({e} AS {t}) AS DOUBLE)')} AS f{i}" for i, (e, t) in enumerate(_ALTIMETER))}
    FROM good WHERE sensor = 'altimeter' AND {' + '.join(f'({e})' for e, _ in _ALTIMETER)} <> 0""",
)
def altimeter_vectors(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = parse.sensor_records(parse.parse_messages(view.messages(spark, sf_dir)), "altimeter")
    v = vector_to_array("features")
    return features.sensor_vectors(rows, "altimeter").select(
        "event_id", *[rounded(v[i]).alias(f"f{i}") for i in range(len(_ALTIMETER))]
    )


# --- filters --------------------------------------------------------------------


@query(
    "valid_user_readings",
    f"WITH {R}, {view.KNOWN_SQL} SELECT eventId FROM readings WHERE userid IN (SELECT userid FROM known)",
)
def valid_user_readings(spark, sf_dir):
    rows = view.readings(spark, sf_dir, labels=False).select("eventId", "userid")
    return joins.keep_known(rows, view.known_users(spark, sf_dir), "userid", ["eventId"]).select("eventId")


@query(
    "unknown_user_readings",
    f"WITH {R}, {view.KNOWN_SQL} SELECT eventId FROM readings WHERE userid NOT IN (SELECT userid FROM known)",
)
def unknown_user_readings(spark, sf_dir):
    rows = view.readings(spark, sf_dir, labels=False).select("eventId", "userid")
    return joins.drop_known(rows, view.known_users(spark, sf_dir), "userid", ["eventId"]).select("eventId")


@query(
    "labelled_sensor_rows",
    f"WITH {R} SELECT eventId, activity FROM readings WHERE activity <> 'NONE' AND sensor = 'accelerometer'",
)
def labelled_sensor_rows(spark, sf_dir):
    rows = view.readings(spark, sf_dir)
    return rows.where("activity <> 'NONE' AND sensor = 'accelerometer'").select("eventId", "activity")


@query(
    "rows_per_user_and_sensor",
    f"WITH {R} SELECT userid, sensor, count(*) AS n FROM readings GROUP BY ALL",
)
def rows_per_user_and_sensor(spark, sf_dir):
    return view.readings(spark, sf_dir, labels=False).groupBy("userid", "sensor").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nonzero_feature_rows",
    f"WITH {R} SELECT eventId FROM readings WHERE y + z <> 0",
)
def nonzero_feature_rows(spark, sf_dir):
    return features.nonzero_rows(view.readings(spark, sf_dir), ["y", "z"]).select("eventId")


@query(
    "complete_feature_rows",
    f"WITH {R} SELECT eventId FROM readings WHERE y <> 0 AND z <> 0",
)
def complete_feature_rows(spark, sf_dir):
    blanked = scalars.zero_to_null(view.readings(spark, sf_dir), ["y", "z"])
    return blanked.na.drop("any", subset=["y", "z"]).select("eventId")


@query(
    "control_messages",
    f"""WITH {view.EVENTS_SQL} SELECT 'control' AS kind, count(*) AS n FROM ev WHERE k % 8 = 0
    UNION ALL SELECT 'data', count(*) FROM ev WHERE k % 8 <> 0""",
)
def control_messages(spark, sf_dir):
    ev = view.events(spark, sf_dir)
    order = F.when(F.col("k") % 8 == 0, F.lit("START"))
    text = F.to_json(F.struct("event_id", "userid", order.alias("control_msg")))
    control, data = parse.split_control(ev.select(text.alias("value")))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(control, "control").unionByName(count(data, "data"))


@query(
    "recent_accesses",
    f"""WITH {view.EVENTS_SQL}, ref AS (SELECT max(time_stamp) AS t FROM ev)
    SELECT event_id, event_type, time_stamp FROM ev, ref
    WHERE time_stamp >= t - 86400000 AND event_type NOT LIKE 'err%' AND event_type LIKE '%i%' ORDER BY time_stamp DESC""",
)
def recent_accesses(spark, sf_dir):
    ev = view.events(spark, sf_dir, False)
    since = ev.agg(F.max("time_stamp") - 86_400_000).scalar()
    kept = ev.where("event_type NOT LIKE 'err%' AND event_type LIKE '%i%'").where(F.col("time_stamp") >= since)
    return kept.select("event_id", "event_type", "time_stamp").orderBy(F.desc("time_stamp"))


# --- scans and files ------------------------------------------------------------


@query(
    "labelled_csv_scan",
    f"""WITH {R} SELECT eventId AS event_id, activity AS activity_train, userid AS user_id, sensor AS event_name,
    time_stamp AS time_stamp_ms, {r6('CAST(CAST(x AS FLOAT) AS DOUBLE)')} AS accel_x FROM readings WHERE activity <> 'NONE'""",
)
def labelled_csv_scan(spark, sf_dir):
    """Write the 40-column file from readings, then scan it."""
    blank = F.lit(None).cast("string")
    names = [c.strip().split(" ")[0] for c in scans.labelled_schema().split(",")]
    given = {
        "EVENT_ID": "eventId", "ACTIVITY_TRAIN": "activity", "TIME_STAMP_MS": "time_stamp", "USER_ID": "userid",
        "EVENT_NAME": "sensor", "ACCEL_X": "x", "ACCEL_Y": "y", "ACCEL_Z": "z",
    }
    rows = view.readings(spark, sf_dir).select(*[F.col(given[n]).alias(n) if n in given else blank.alias(n) for n in names])
    path = scratch_path(spark, "labelled")
    sinks.write_csv(rows, path)
    back = scans.read_labelled_csv(spark, path).where("ACTIVITY_TRAIN <> 'NONE'")
    return back.select(
        F.col("EVENT_ID").alias("event_id"), F.col("ACTIVITY_TRAIN").alias("activity_train"),
        F.col("USER_ID").alias("user_id"), F.col("EVENT_NAME").alias("event_name"),
        F.col("TIME_STAMP_MS").alias("time_stamp_ms"), rounded(F.col("ACCEL_X").cast("double")).alias("accel_x"),
    )


@query(
    "json_lines_scan",
    f"WITH {R} SELECT userid, sensor, time_stamp, x FROM readings",
)
def json_lines_scan(spark, sf_dir):
    """Write readings as JSON lines, then scan them."""
    path = scratch_path(spark, "readings")
    sinks.write_json_lines(view.readings(spark, sf_dir, labels=False).select("userid", "sensor", "time_stamp", "x"), path)
    return scans.read_json_lines(spark, path, "userid STRING, sensor STRING, time_stamp BIGINT, x DOUBLE")


PREDICTION_FILE_SQL = f"""{R}, stored AS (
  SELECT activity AS label, CASE WHEN k % 3 = 0 THEN 'SITTING' ELSE activity END AS prediction,
         time_stamp // {W} AS win, sensor FROM readings WHERE activity <> 'NONE')"""


def stored_predictions(spark, sf_dir):
    rows = view.readings(spark, sf_dir).where("activity <> 'NONE'")
    return rows.select(
        F.col("k").cast("bigint").alias("colNum"), F.col("activity").alias("label"),
        F.when(F.col("k") % 3 == 0, "SITTING").otherwise(F.col("activity")).alias("prediction"),
        timekeys.floor_window("time_stamp", W).alias("win"), "sensor",
    )


@query(
    "prediction_csv_scan",
    f"WITH {PREDICTION_FILE_SQL} SELECT label, prediction, win, count(*) AS n FROM stored WHERE sensor = 'gyroscope' GROUP BY ALL",
)
def prediction_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    rows = stored_predictions(spark, sf_dir).where("sensor = 'gyroscope'").drop("sensor")
    sinks.write_csv(rows, path, header=True, quote_all=False)
    back = scans.read_predictions_csv(spark, path)
    return back.groupBy("label", "prediction", F.col("window").alias("win")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stored_prediction_error",
    f"""WITH {PREDICTION_FILE_SQL} SELECT sensor, count(*) AS n,
    {r6('avg(CASE WHEN label <> prediction THEN 1.0 ELSE 0.0 END)')} AS error FROM stored GROUP BY 1""",
)
def stored_prediction_error(spark, sf_dir):
    from vitalgrid.operators.decide import error_rate

    out = error_rate(stored_predictions(spark, sf_dir), "label", "prediction", ["sensor"])
    return out.withColumn("error", rounded("error"))


_CATALOG_NAMES = """CASE c_custkey % 5
  WHEN 0 THEN 'accelerometer_user' || c_custkey || '@example.org_FEA_.MDL'
  WHEN 1 THEN 'sk_gyroscope_user' || c_custkey || '@example.org_FEA_.MDL'
  WHEN 2 THEN 'sk_barometer_user' || c_custkey || '@example.org_FEA_.mdl'
  WHEN 3 THEN 'sk_aggr_user' || c_custkey || '@example.org_labelEncoder'
  ELSE 'aggregation_user' || c_custkey || '@example.org_AGR_.MDL' END"""


@query(
    "model_catalog",
    f"""WITH names AS (SELECT c_custkey, {_CATALOG_NAMES} AS name FROM customer)
    SELECT CASE c_custkey % 5 WHEN 0 THEN 'accelerometer' WHEN 1 THEN 'gyroscope' ELSE 'barometer' END AS sensor,
    'user' || c_custkey || '@example.org' AS userid,
    CASE WHEN c_custkey % 5 = 0 THEN 'forest' ELSE 'plain' END AS kind, '/models/' || name AS path
    FROM names WHERE c_custkey % 5 < 3""",
)
def model_catalog(spark, sf_dir):
    name = F.expr(_CATALOG_NAMES)
    files = view.table(spark, sf_dir, "customer").select(F.concat(F.lit("/models/"), name).alias("path"))
    return scans.parse_model_names(files)


@query(
    "users_in_catalog",
    """SELECT DISTINCT 'user' || c_custkey || '@example.org' AS userid FROM customer WHERE c_custkey % 5 < 3""",
)
def users_in_catalog(spark, sf_dir):
    return scans.users_with_models(model_catalog(spark, sf_dir))


@query(
    "csv_export",
    "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def csv_export(spark, sf_dir):
    """Export the whole joined table with quotes, then read it back."""
    c = view.table(spark, sf_dir, "customer")
    n = view.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "export")
    sinks.write_csv(c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", "c_acctbal"), path)
    back = spark.read.schema("c_custkey BIGINT, n_name STRING, c_acctbal DOUBLE").option("quote", '"').csv(path)
    return back.groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("c_acctbal"), 2).alias("balance")
    )
