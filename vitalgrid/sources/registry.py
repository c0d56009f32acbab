"""Sensor registry: which fields each sensor sends and which columns they become."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Message fields shared by all sensors (json name, column, type, default).
COMMON_FIELDS = [
    ("eventId", "event_id", "string", "977c9b9a-9a02-4e1e-830b-7fdbc754f987"),
    ("deviceType", "device_type", "string", "NA"),
    ("deviceid", "device_id", "string", "NA"),
    ("eventtype", "event_type", "string", "NA"),
    ("timestamp", "time_stamp", "bigint", None),
    ("userid", "user_id", "string", "NA"),
    ("trainingMode", "training_mode", "string", "NA"),
]

AXES = [("x", "x", "float", None), ("y", "y", "float", None), ("z", "z", "float", None)]

# Fields per sensor (json name, column, type, default).
SENSOR_FIELDS = {
    "accelerometer": AXES,
    "gyroscope": AXES,
    "altimeter": [
        ("flightsAscended", "flights_ascended", "int", None),
        ("flightsDescended", "flights_descended", "int", None),
        ("rate", "rate", "float", None),
        ("steppingGain", "stepping_gain", "int", None),
        ("steppingLoss", "stepping_loss", "int", None),
        ("stepsAscended", "steps_ascended", "int", None),
        ("stepsDescended", "steps_descended", "int", None),
        ("totalGain", "total_gain", "int", None),
        ("totalLoss", "total_loss", "int", None),
    ],
    "ambientLight": [("brightness", "brightness", "int", None)],
    "barometer": [
        ("temperature", "temperature", "float", None),
        ("airPressure", "air_pressure", "float", None),
    ],
    "calorie": [("calories", "calories", "int", None)],
    "distance": [
        ("currentMotion", "current_motion", "int", None),
        ("pace", "pace", "float", None),
        ("speed", "speed", "float", None),
        ("totalDistance", "total_distance", "int", None),
    ],
    "uv": [("index", "index_uv", "int", None)],
    "skinTemperature": [("temperature", "temperature", "float", None)],
    "gsr": [("resistance", "resistance", "int", None)],
    "heartRate": [("rate", "rate", "int", None), ("quality", "quality", "int", None)],
    "rrinterval": [("interval", "interval", "float", None)],
    "hdhld": [
        ("handheldActivity", "handheld_activity", "string", "NA"),
        ("handheldActivityConfidence", "handheld_activity_confidence", "double", "0"),
        ("handhelLat", "handhel_lat", "float", "0.0"),
        ("handhelLong", "handhel_long", "float", "0.0"),
    ],
}

# Spellings that mean another sensor.
SENSOR_ALIASES = {"accel": "accelerometer"}

# The sensors of each family.
ACTIVITY_SENSORS = [
    "accelerometer", "gyroscope", "altimeter", "ambientLight", "barometer",
    "calorie", "distance", "uv", "contact", "pedometer",
]
PHYSIO_SENSORS = ["skinTemperature", "heartRate", "gsr", "rrinterval"]

# Slots of the stacked model, in order.
ENSEMBLE_SLOTS = [
    "accelerometer", "gyroscope", "altimeter", "ambientLight",
    "barometer", "calorie", "distance",
]

# Feature columns per sensor for direct classification.
FEATURE_COLUMNS = {
    "accelerometer": ["x", "y", "z"],
    "gyroscope": ["x", "y", "z"],
    "altimeter": [
        "flights_ascended", "flights_descended", "rate", "stepping_gain", "stepping_loss",
        "steps_ascended", "steps_descended", "total_gain", "total_loss",
    ],
    "ambientLight": ["brightness"],
    "barometer": ["temperature", "air_pressure"],
    "calorie": ["calories"],
    "distance": ["current_motion", "pace", "speed", "total_distance"],
}

# The labelled wide table, in file order.
LABELLED_COLUMNS = """
EVENT_ID STRING, DEVICE_TYPE STRING, ACTIVITY_TRAIN STRING, DEVICE_ID BIGINT,
TIME_STAMP_MS BIGINT, USER_ID STRING, HDHLD_TYPE STRING, HDHLD_CONFIDENCE BIGINT,
HDHLD_LOCATION_LAT FLOAT, HDHLD_LOCATION_LONG FLOAT, EVENT_NAME STRING,
ACCEL_X FLOAT, ACCEL_Y FLOAT, ACCEL_Z FLOAT, AMBLGT_BRIGHTNESS BIGINT,
BRM_AIRPRESSURE FLOAT, BRM_TEMPERATURE FLOAT, GSR_RESISTANCE BIGINT,
GYRO_X FLOAT, GYRO_Y FLOAT, GYRO_Z FLOAT, SKTMP_TEMPERATURE FLOAT, UV_INDEX BIGINT,
HR_RATE BIGINT, HR_QUALITY BIGINT, CAL_CALORIES BIGINT, RRI_INTERVAL FLOAT,
DST_CURR_MOTION BIGINT, DST_PACE FLOAT, DST_SPEED FLOAT, DST_TOTAL_DISTANCE BIGINT,
ALT_FLIGHTS_ASCENDED BIGINT, ALT_FLIGHTS_DESCENDED BIGINT, ALT_RATE FLOAT,
ALT_STEPPING_GAIN BIGINT, ALT_STEPPING_GAIN_LOSS BIGINT, ALT_STEPPING_ASCENDED BIGINT,
ALT_STEPPING_DESCENDED BIGINT, ALT_TOTAL_GAIN BIGINT, ALT_TOTAL_LOSS BIGINT
"""

# Labels and the marker of an unlabelled row.
LABELS = ["SITTING", "WALKING", "WALKING_UP", "WALKING_DOWN"]
UNLABELLED = "NONE"


@dataclass(frozen=True)
class SensorColumn:
    json_name: str
    column: str
    type: str
    default: str | None


def sensor_columns(sensor: str) -> list[SensorColumn]:
    """Common columns followed by the sensor's own."""
    return [SensorColumn(*f) for f in COMMON_FIELDS + SENSOR_FIELDS[sensor]]


def message_schema() -> T.StructType:
    """One struct for every sensor. Numbers may arrive quoted, so all fields are
    read as text and cast per sensor afterwards."""
    names = [f[0] for f in COMMON_FIELDS]
    for fields in SENSOR_FIELDS.values():
        names += [f[0] for f in fields if f[0] not in names]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def table_name(sensor: str, prefix: str = "raw_") -> str:
    return prefix + sensor
