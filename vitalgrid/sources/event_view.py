"""Sensor views over the ``events`` and ``customer`` tables.

The operators know nothing of these tables; this adapter turns stored events into
readings, messages and physiological records so that every operator can run on
them. Expressions used by both engines are kept as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalgrid.functions.scalars import once
from vitalgrid.functions.timekeys import epoch_ms
from vitalgrid.session import pin_utc
from vitalgrid.sources.registry import SENSOR_FIELDS

# Which sensor an event type stands for.
EVENT_SENSOR = {
    "click": "accelerometer", "view": "gyroscope", "purchase": "barometer",
    "error": "heartRate", "signup": "skinTemperature",
}
SENSORS = list(EVENT_SENSOR.values())
PHYSIO_OF = {
    "click": "Activity", "view": "RRI_INTERVAL", "purchase": "GSR_RESISTANCE",
    "error": "HR_RATE", "signup": "SKTMP_TEMPERATURE",
}

ACTIVITY_SQL = (
    "CASE WHEN k % 10 = 9 THEN 'NONE' WHEN k % 4 = 0 THEN 'SITTING' WHEN k % 4 = 1 THEN 'WALKING' "
    "WHEN k % 4 = 2 THEN 'WALKING_UP' ELSE 'WALKING_DOWN' END"
)
SIGNAL_SQL = {
    "SKTMP_TEMPERATURE": "29e0 + (event_id % 40) / 10e0",
    "GSR_RESISTANCE": "70e0 + value * value",
    "HR_RATE": "62e0 + k / 2e0",
    "RRI_INTERVAL": "2e-2 + k * 15e-3",
}
# Value of every message field, by json name; a sensor takes the ones it sends.
FIELD_SQL = {
    "x": "value", "y": "CAST(k AS DOUBLE)", "z": "CAST(event_id % 97 AS DOUBLE)",
    "flightsAscended": "k", "flightsDescended": "k % 7", "rate": "60 + k",
    "steppingGain": "k * 2", "steppingLoss": "k % 11", "stepsAscended": "k * 3",
    "stepsDescended": "k % 13", "totalGain": "k * 5", "totalLoss": "k % 17",
    "brightness": "k * 10", "temperature": "29e0 + (event_id % 40) / 10e0",
    "airPressure": "1000e0 + k / 4e0", "calories": "k + 1000", "currentMotion": "k % 5",
    "pace": "value / 2e0", "speed": "value / 4e0", "totalDistance": "k * 100",
    "index": "k % 4", "resistance": "70 + k * 50", "quality": "k % 2",
    "interval": "2e-2 + k * 15e-3",
    "handheldActivity": "CASE WHEN k % 2 = 0 THEN 'STILL' ELSE 'ON_FOOT' END",
    "handheldActivityConfidence": "k", "handhelLat": "k / 2e0", "handhelLong": "k / 4e0",
}
# Names a message may carry; the last two belong to no record type.
MESSAGE_SENSORS = [*SENSOR_FIELDS, "contact", "pedometer"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _case(pairs: dict[str, str], column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def events(spark: SparkSession, sf_dir: str, with_k: bool = True, types: list[str] | None = None) -> DataFrame:
    """``event_id, user_id, event_type, value, k, time_stamp, userid, deviceid``; of some
    ``types`` only, chosen on the stored column, so that the scan skips the others."""
    raw = table(spark, sf_dir, "events")
    return shape_events(raw if types is None else raw.where(F.col("event_type").isin(types)), with_k)


def shape_events(raw: DataFrame, with_k: bool = True) -> DataFrame:
    """``k`` is parsed from JSON; leave it out where nothing derives from it."""
    if with_k:
        raw = once(raw, "k", F.get_json_object("props", "$.k").cast("int"))
    return raw.select(
        "event_id", "user_id", "event_type", "value", *(["k"] if with_k else []),
        epoch_ms("ts").alias("time_stamp"),
        F.expr("concat('user_', user_id)").alias("userid"),
        F.expr("concat('dev_', user_id % 10)").alias("deviceid"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) // 1000 AS time_stamp,
         'user_' || user_id AS userid, 'dev_' || (user_id % 10) AS deviceid
  FROM events)"""


def readings(spark: SparkSession, sf_dir: str, labels: bool = True, sensors: list[str] | None = None) -> DataFrame:
    """Activity readings: three axes, a sensor and a label per row. Without
    ``labels`` the columns derived from ``k`` (y, activity) are left out. With
    ``sensors`` only theirs are read."""
    types = None if sensors is None else [t for t, s in EVENT_SENSOR.items() if s in sensors]
    return as_readings(events(spark, sf_dir, labels, types), labels)


def as_readings(ev: DataFrame, labels: bool = True) -> DataFrame:
    derived = [F.expr(FIELD_SQL["y"]).alias("y"), F.expr(ACTIVITY_SQL).alias("activity"), "k"] if labels else []
    return ev.select(
        F.col("event_id").cast("string").alias("eventId"), "deviceid", "userid",
        F.expr(_case(EVENT_SENSOR, "event_type")).alias("sensor"), "time_stamp",
        F.col("value").alias("x"), F.expr(FIELD_SQL["z"]).alias("z"), *derived,
    )


READINGS_SQL = f"""{EVENTS_SQL}, readings AS (
  SELECT CAST(event_id AS VARCHAR) AS eventId, deviceid, userid,
         {_case(EVENT_SENSOR, 'event_type')} AS sensor, time_stamp,
         value AS x, {FIELD_SQL['y']} AS y, {FIELD_SQL['z']} AS z,
         {ACTIVITY_SQL} AS activity, k
  FROM ev)"""


def known_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that own a model: customers whose account is not overdrawn."""
    return table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(
        F.expr("concat('user_', c_custkey)").alias("userid")
    )


KNOWN_SQL = "known AS (SELECT 'user_' || c_custkey AS userid FROM customer WHERE c_acctbal >= 0)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text per event, over all sensors, with the defects real traffic has.

    ``event_id % 50`` selects the form: 7 broken text, 11 empty, 13 a one-element
    array, 17 an odd spelling of the sensor, 23 without user and device.
    """
    ev = events(spark, sf_dir).withColumn(
        "sensor_name", F.element_at(F.array(*[F.lit(s) for s in MESSAGE_SENSORS]),
                                    (F.col("event_id") % len(MESSAGE_SENSORS) + 1).cast("int"))
    )
    form = F.col("event_id") % 50
    odd = F.concat(F.lit("  "), F.upper("sensor_name"), F.lit(" "))
    fields = []
    for name, sql in FIELD_SQL.items():
        owners = [s for s, fs in SENSOR_FIELDS.items() if name in [f[0] for f in fs]]
        value = F.expr(sql)
        if name == "rate":  # heart rate arrives as text
            value = value.cast("string")
        fields.append(F.when(F.col("sensor_name").isin(owners), value).alias(name))
    text = F.to_json(
        F.struct(
            F.concat(F.lit("e"), F.col("event_id")).alias("eventId"),
            F.lit("band").alias("deviceType"),
            F.when(form != 23, F.col("deviceid")).alias("deviceid"),
            F.when(form == 17, odd).otherwise(F.col("sensor_name")).alias("eventtype"),
            F.col("time_stamp").alias("timestamp"),
            F.when(form != 23, F.col("userid")).alias("userid"),
            F.expr(ACTIVITY_SQL).alias("trainingMode"),
            *fields,
        )
    )
    text = once(ev, "_text", text)
    whole = F.col("_text")
    shaped = (
        F.when(form == 7, F.substring(whole, 1, 20)).when(form == 11, F.lit(""))
        .when(form == 13, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    )
    return once(text, "_msg", shaped).select("event_id", F.col("_msg").alias("value"))


MESSAGES_SQL = f"""{EVENTS_SQL}, msg AS (
  SELECT *, ([{', '.join(f"'{s}'" for s in MESSAGE_SENSORS)}])[CAST(event_id % {len(MESSAGE_SENSORS)} + 1 AS BIGINT)] AS sensor,
         event_id % 50 AS form, {ACTIVITY_SQL} AS training
  FROM ev),
good AS (SELECT * FROM msg WHERE form NOT IN (7, 11) AND sensor NOT IN ('contact', 'pedometer'))"""


def physio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete record per event: activity label and four signals."""
    return as_physio(events(spark, sf_dir))


def as_physio(ev: DataFrame) -> DataFrame:
    label = ACTIVITY_SQL.replace("'NONE'", "'SITTING'")
    return ev.select(
        "event_id", F.col("userid").alias("user_id"), F.col("deviceid").alias("network"), "time_stamp",
        F.expr(label).alias("activity"),
        *[F.expr(sql).alias(s) for s, sql in SIGNAL_SQL.items()],
        *[F.concat(F.lit(f"{s[:3].lower()}-"), F.col("event_id")).alias(f"event_{s}")
          for s in [*SIGNAL_SQL, "Activity"]],
    )


PHYSIO_SQL = f"""{EVENTS_SQL}, physio AS (
  SELECT event_id, userid AS user_id, deviceid AS network, time_stamp,
         {ACTIVITY_SQL.replace("'NONE'", "'SITTING'")} AS activity,
         {', '.join(f'{sql} AS {s}' for s, sql in SIGNAL_SQL.items())},
         {', '.join(f"'{s[:3].lower()}-' || event_id AS event_{s}" for s in [*SIGNAL_SQL, 'Activity'])}
  FROM ev)"""


def physio_events(ev: DataFrame) -> DataFrame:
    """One reading of one signal per event, as text: the label of an activity event, else the signal's value."""
    label = ACTIVITY_SQL.replace("'NONE'", "'SITTING'")
    reading = F.when(F.expr(_case(PHYSIO_OF, "event_type")) == "Activity", F.expr(label))
    for name, sql in SIGNAL_SQL.items():
        reading = reading.when(F.expr(_case(PHYSIO_OF, "event_type")) == name, F.expr(sql).cast("string"))
    return ev.select(
        "userid", F.expr(_case(PHYSIO_OF, "event_type")).alias("sensor"), "time_stamp",
        F.concat(F.lit("e"), F.col("event_id")).alias("eventId"), reading.alias("reading"),
    )


PHYSIO_EVENTS_SQL = f"""{EVENTS_SQL}, readings AS (
  SELECT userid, deviceid, {_case(PHYSIO_OF, 'event_type')} AS sensor, time_stamp, 'e' || event_id AS eventId,
         {ACTIVITY_SQL.replace("'NONE'", "'SITTING'")} AS activity, {', '.join(f'{sql} AS {n}' for n, sql in SIGNAL_SQL.items())} FROM ev)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage-one predictions: a label per reading, named after its sensor. The
    result is sent as a number or as a label."""
    ev = events(spark, sf_dir)
    return as_predictions(ev)


def as_predictions(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("eventId"),
        F.concat(F.lit("forest_"), F.expr(_case(EVENT_SENSOR, "event_type"))).alias("processor_name"),
        "time_stamp", "userid",
        F.when(F.col("event_id") % 2 == 0, (F.col("k") % 4).cast("string"))
        .otherwise(F.expr(PREDICTED_SQL)).alias("result"),
    )


PREDICTED_SQL = (
    "CASE k % 4 WHEN 0 THEN 'SITTING' WHEN 1 THEN 'WALKING' WHEN 2 THEN 'WALKING_UP' ELSE 'WALKING_DOWN' END"
)
PREDICTIONS_SQL = f"""{EVENTS_SQL}, predictions AS (
  SELECT 'e' || event_id AS eventId, 'forest_' || {_case(EVENT_SENSOR, 'event_type')} AS processor_name,
         time_stamp, userid, {_case(EVENT_SENSOR, 'event_type')} AS sensor,
         CASE WHEN event_id % 2 = 0 THEN CAST(k % 4 AS VARCHAR) ELSE {PREDICTED_SQL} END AS result,
         {PREDICTED_SQL} AS label, k % 4 AS code
  FROM ev)"""
