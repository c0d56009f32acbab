"""From raw messages to typed sensor records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.functions.scalars import normalise_sensor, once
from vitalgrid.sources.registry import (
    COMMON_FIELDS,
    SENSOR_FIELDS,
    message_schema,
    sensor_columns,
)

BAD = "_bad"


def drop_empty(messages: DataFrame, value: str = "value") -> DataFrame:
    return messages.where(F.length(value) > 0)


def unwrap_single(value: str | Column = "value") -> Column:
    """A message may be a one-element array; return the element's text."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.ltrim(v).startswith("["), F.get_json_object(v, "$[0]")).otherwise(v)


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``msg`` (struct of text fields), ``sensor`` and ``status``.

    ``status`` is ``ok``, ``bad_json`` or ``unknown_sensor``. A bad message costs
    its own row only.
    """
    schema = message_schema().add(BAD, "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = once(drop_empty(messages, value), "msg", F.from_json(unwrap_single(value), schema, options))
    status = F.struct(
        normalise_sensor("msg.eventtype").alias("sensor"),
        (F.col("msg").isNull() | F.col(f"msg.{BAD}").isNotNull()).alias("bad"),
    )
    return once(parsed, "_s", status).select(
        *parsed.columns,
        "_s.sensor",
        F.when(F.col("_s.bad"), "bad_json").when(F.col("_s.sensor").isNull(), "unknown_sensor")
        .otherwise("ok").alias("status"),
    )


def accepted(parsed: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Parsed rows of known, enabled sensors."""
    out = parsed.where("status = 'ok'")
    return out.where(~F.col("sensor").isin(disabled)) if disabled else out


def rejected(parsed: DataFrame, value: str = "value") -> DataFrame:
    """The side output: what was refused and why."""
    return parsed.where("status <> 'ok'").select(value, "status")


def typed(json_name: str, type_: str, default: str | None) -> Column:
    """Cast a text field; text that is no number becomes null, not an error."""
    text = F.col(f"msg.{json_name}")
    value = text if type_ == "string" else text.try_cast(type_)
    return value if default is None else F.coalesce(value, F.lit(default).cast(type_))


def common_columns() -> list[Column]:
    return [typed(j, t, d).alias(c) for j, c, t, d in COMMON_FIELDS]


def sensor_records(parsed: DataFrame, sensor: str) -> DataFrame:
    """The typed table of one sensor: renamed to snake case, defaults applied."""
    return parsed.where(F.col("sensor") == sensor).select(
        *[typed(c.json_name, c.type, c.default).alias(c.column) for c in sensor_columns(sensor)]
    )


def reading_columns() -> list[str]:
    seen: list[str] = []
    for fields in SENSOR_FIELDS.values():
        seen += [f[1] for f in fields if f[1] not in seen and f[2] != "string"]
    return seen


def wide_records(parsed: DataFrame) -> DataFrame:
    """All sensors in one table: common columns, ``sensor``, every numeric field as
    DOUBLE (null where the sensor has no such field) and the handheld activity."""
    values = []
    for column in reading_columns():
        uses: dict[tuple, list[str]] = {}
        for sensor, fields in SENSOR_FIELDS.items():
            for j, c, t, d in fields:
                if c == column:
                    uses.setdefault((j, t, d), []).append(sensor)
        branch = F.lit(None).cast("double")
        for (j, t, d), owners in uses.items():
            branch = F.when(F.col("sensor").isin(owners), typed(j, t, d).cast("double")).otherwise(branch)
        values.append(branch.alias(column))
    handheld = F.when(F.col("sensor") == "hdhld", typed("handheldActivity", "string", "NA"))
    return parsed.select("sensor", *common_columns(), *values, handheld.alias("handheld_activity"))


def split_control(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(control, data) messages of one stream."""
    marked = messages.withColumn("_ctl", F.get_json_object(value, "$.control_msg"))
    return (
        marked.where("_ctl IS NOT NULL").drop("_ctl"),
        marked.where("_ctl IS NULL").drop("_ctl"),
    )
