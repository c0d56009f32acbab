import json

import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import scalars, timekeys
from vitalgrid.operators import metrics, parse
from vitalgrid.sources import registry

HEART = {
    "eventId": "7c573cbd", "deviceType": "band", "deviceid": "dev_1", "eventtype": "heartRate",
    "timestamp": 1456939604898, "userid": "user_a", "trainingMode": "SITTING", "rate": "85", "quality": 0,
}


def frame(spark, *values):
    texts = [v if isinstance(v, str) else json.dumps(v) for v in values]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_heart_rate_as_text(spark):
    row = parse.sensor_records(parse.parse_messages(frame(spark, HEART)), "heartRate").first()
    assert (row["rate"], row["quality"], row["time_stamp"], row["user_id"]) == (85, 0, 1456939604898, "user_a")


def test_defaults(spark):
    row = parse.sensor_records(parse.parse_messages(frame(spark, {"eventtype": "hdhld"})), "hdhld").first()
    assert row["event_id"] == "977c9b9a-9a02-4e1e-830b-7fdbc754f987"
    assert (row["user_id"], row["device_id"], row["handheld_activity"]) == ("NA", "NA", "NA")
    assert (row["handheld_activity_confidence"], row["handhel_lat"], row["time_stamp"]) == (0.0, 0.0, None)


def test_status_of_bad_rows(spark):
    values = ["", "{\"eventtype\": \"gsr\"", "no json", {"eventtype": "contact"}, [HEART], {**HEART, "eventtype": " HEARTRATE "}]
    out = parse.parse_messages(frame(spark, *values))
    assert sorted(r["status"] for r in out.collect()) == ["bad_json", "bad_json", "ok", "ok", "unknown_sensor"]
    assert parse.accepted(out).where("sensor = 'heartRate'").count() == 2
    assert parse.rejected(out).count() == 3


def test_text_that_is_no_number_is_null(spark):
    row = parse.sensor_records(parse.parse_messages(frame(spark, {**HEART, "rate": "n/a"})), "heartRate").first()
    assert row["rate"] is None


def test_alias_and_disabled(spark):
    out = parse.parse_messages(frame(spark, {"eventtype": "accel"}, {"eventtype": "gsr"}))
    assert [r["sensor"] for r in parse.accepted(out, ["gsr"]).collect()] == ["accelerometer"]


def test_every_sensor_parses(spark):
    rows = [
        {"eventId": s, "eventtype": s, **{f[0]: "7" for f in fields}} for s, fields in registry.SENSOR_FIELDS.items()
    ]
    parsed = parse.parse_messages(frame(spark, *rows))
    for sensor, fields in registry.SENSOR_FIELDS.items():
        row = parse.sensor_records(parsed, sensor).first()
        assert all(float(row[f[1]]) == 7.0 for f in fields), sensor
    points = metrics.metric_points(parsed).where("value = 7").count()
    assert points == sum(f[2] != "string" for fields in registry.SENSOR_FIELDS.values() for f in fields)


def test_control_split(spark):
    control, data = parse.split_control(frame(spark, {"control_msg": "START"}, HEART))
    assert (control.count(), data.count()) == (1, 1)


def test_metric_point(spark):
    points = metrics.metric_points(parse.parse_messages(frame(spark, HEART))).collect()
    assert {(p["name"], p["value"]) for p in points} == {("raw_heartRate_rate", 85.0), ("raw_heartRate_quality", 0.0)}
    assert points[0]["tags"]["training_mode"] == "SITTING" and points[0]["timestamp"] == HEART["timestamp"]


def test_posts_are_full_but_the_last(spark):
    points = spark.range(23).select(
        F.lit("m").alias("name"), F.col("id").alias("timestamp"), F.lit(1.0).alias("value"),
        F.create_map(F.lit("u"), F.lit("a")).alias("tags"),
    )
    out = metrics.posts(metrics.number_posts(points, ["name"], ["timestamp"], 5, 100), ["name"]).orderBy("post_id").collect()
    assert [r["n_points"] for r in out] == [5, 5, 5, 5, 3]
    assert [p["timestamp"] for p in json.loads(out[1]["body"])] == [5, 6, 7, 8, 9]
    spread = metrics.posts(
        metrics.number_posts(points, ["name"], ["timestamp"], 5, 10, "timestamp", 3), ["name"]
    ).collect()
    assert max(r["n_points"] for r in spread) <= 5
    assert sorted(p["timestamp"] for r in spread for p in json.loads(r["body"])) == list(range(23))


@pytest.mark.parametrize(
    "name,type_,role",
    [("x", "float", "value"), ("time_stamp", "bigint", "timestamp"), ("event_id", "uuid", "tags"), (" Rate ", " INT ", "value")],
)
def test_roles(spark, name, type_, role):
    df = spark.createDataFrame([(name, type_)], "n string, t string")
    assert df.select(metrics.point_role("n", "t")).first()[0] == role


def test_window_keys(spark):
    df = spark.createDataFrame([(5000,), (15000,), (25000,)], "t long")
    got = df.select(timekeys.floor_window("t", 10000), timekeys.round_window("t", 10000)).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 2), (2, 2)]


def test_labels(spark):
    df = spark.createDataFrame([("WALKING_UP",), ("2",), ("2.0",), ("x",)], "r string")
    assert [r[0] for r in df.select(scalars.normalise_label("r")).collect()] == ["WALKING_UP"] * 3 + [None]


def test_the_sensor_filter_reaches_the_scan(spark, capsys):
    from vitalgrid.sources import event_view as view

    view.readings(spark, "/root/testdata/sf0.001", sensors=["accelerometer"]).explain("formatted")
    assert "EqualTo(event_type,click)" in capsys.readouterr().out


def test_small_is_small_in_bytes(spark):
    from vitalgrid.operators.joins import holds_at_most

    wide = spark.createDataFrame([("x" * 1000,)] * 5, "v string")
    assert holds_at_most(wide, 5) and not holds_at_most(wide, 4) and not holds_at_most(wide, 5, 2000)
    assert holds_at_most(wide.limit(0), 1)
