"""Alignment of several sensors on the times of the slowest one.

Per group, with t0 the first time of the reference sensor, D the step and s the
sensor with the fewest events: walk the grid t0 + D, t0 + 2D, ... up to the last
time of s. Each grid point selects as anchor the last event of s strictly before
it (the first event if there is none), and for each anchor the nearest event of
every sensor that is later than the previous anchor is emitted.

The grid itself is never built. An event of s is an anchor exactly when a grid
point lies in the interval from it (open) to the next event of s (closed), which
is a comparison of two integer quotients. Work is therefore proportional to the
events, whatever span of time they cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitalgrid.operators.asof import neighbours
from vitalgrid.operators.joins import salted_lookup
from vitalgrid.operators.ordered import lagged, latest_per_key, running_index
from vitalgrid.session import stored


def last_per_time(events: DataFrame, keys: list[str], sensor: str, ts: str, tie: str) -> DataFrame:
    """One event per (group, sensor, time); the largest ``tie`` stays."""
    return latest_per_key(events, [*keys, sensor, ts], [F.col(tie).desc()])


def group_clock(
    events: DataFrame, keys: list[str], sensor: str, ts: str, reference: str,
    sensors: list[str] | None = None,
) -> DataFrame:
    """Per group: ``t0``, the slowest sensor ``slow`` and how many sensors report.

    Counting per sensor first leaves at most one row per sensor for the second
    step. Groups without the reference sensor are dropped; with ``sensors`` given,
    so are groups where one of them is silent.
    """
    per_sensor = events.groupBy(*keys, sensor).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    clock = per_sensor.groupBy(*keys).agg(
        F.min(F.when(F.col(sensor) == reference, F.col("_first"))).alias("t0"),
        F.min(F.struct("_n", sensor))[sensor].alias("slow"),
        F.count(F.lit(1)).alias("n_sensors"),
    ).where("t0 IS NOT NULL")
    if sensors is not None:
        clock = clock.where(F.col("n_sensors") == len(sensors))
    return clock


def anchors(
    events: DataFrame, clock: DataFrame, keys: list[str], sensor: str, ts: str, step_ms: int,
    piece_ms: int | None,
) -> DataFrame:
    """(group, anchor, prev_anchor) in time order."""
    slow = salted_lookup(
        events.select(*keys, F.col(sensor).alias("slow"), ts),
        clock.select(*keys, "slow", "t0"), [*keys, "slow"], [ts],
    )
    seen = lagged(slow, keys, [ts], {ts: "_prev"}, piece_ms)
    # Grid points at or before a time, counted from the first one.
    upto = F.greatest(F.floor((F.col(ts) - F.col("t0")) / F.lit(step_ms)), F.lit(0))
    upto_prev = F.greatest(F.floor((F.col("_prev") - F.col("t0")) / F.lit(step_ms)), F.lit(0))
    hit = upto > F.coalesce(upto_prev, F.lit(0))
    chosen = (
        seen.where(hit)
        .select(*keys, F.coalesce("_prev", ts).alias("anchor"))
        .distinct()
    )
    return lagged(chosen, keys, ["anchor"], {"anchor": "prev_anchor"}, piece_ms)


def align(
    events: DataFrame,
    keys: list[str],
    sensors: list[str],
    reference: str,
    step_ms: int,
    sensor: str = "sensor",
    ts: str = "time_stamp",
    tie: str = "eventId",
    require_all: bool = True,
    piece_ms: int | None = 3_600_000,
) -> DataFrame:
    """Long form: one row per (group, anchor, sensor) with the chosen event's columns.

    The events are read once: one per (group, sensor, time) is stored, which clock, anchors
    and both sides of the neighbour search then read, the first two without payload.
    """
    unique = stored(last_per_time(events.where(F.col(sensor).isin(sensors)), keys, sensor, ts, tie), "unique")
    times = unique.select(*keys, sensor, ts)
    clock = group_clock(times, keys, sensor, ts, reference, sensors if require_all else None)
    probes = anchors(times, clock, keys, sensor, ts, step_ms, piece_ms).withColumn(
        sensor, F.explode(F.array(*[F.lit(s) for s in sensors]))
    )
    near = neighbours(probes, unique, [*keys, sensor], "anchor", ts, [], piece_ms)
    before, after = F.col("before"), F.col("after")
    fresh = before[ts] > F.coalesce(F.col("prev_anchor"), before[ts] - 1)
    later = (after[ts] - F.col("anchor")) < (F.col("anchor") - before[ts])
    chosen = F.when(after.isNotNull(), F.when(~F.coalesce(fresh, F.lit(False)) | later, after).otherwise(before))
    payload = [c for c in events.columns if c not in (*keys, sensor)]
    return (
        near.withColumn("_e", chosen)
        .where("_e IS NOT NULL")
        .select(*keys, "anchor", sensor, *[F.col(f"_e.{c}").alias(c) for c in payload])
    )


def slots(aligned: DataFrame, keys: list[str], sensor: str, value: str, names: list[str]) -> DataFrame:
    """One row per anchor with a column per sensor, null when the sensor is silent."""
    return aligned.groupBy(*keys).agg(
        *[F.min(F.when(F.col(sensor) == n, F.col(value))).alias(n) for n in names]
    )


def nested_events(aligned: DataFrame, keys: list[str], fields: list[str], sensor: str = "sensor") -> DataFrame:
    """The events of each anchor as one array, in sensor order. At most one event
    per sensor exists under an anchor, so the array is bounded by the registry."""
    item = F.struct(F.col(sensor), *[F.col(f) for f in fields])
    return aligned.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("events"))


def event_pages(
    rows: DataFrame, keys: list[str], order: list[str], size: int, piece_ms: int
) -> DataFrame:
    """A key's rows in order, as arrays of at most ``size`` structs, one per ``page``."""
    body = F.struct("idx", *[F.col(c) for c in rows.columns if c not in keys])
    page = F.floor((F.col("idx") - 1) / F.lit(size)).cast("bigint")
    indexed = running_index(rows, keys, order, piece_ms)
    return indexed.groupBy(*keys, page.alias("page")).agg(F.sort_array(F.collect_list(body)).alias("events"))


def missing_sensors(aligned: DataFrame, keys: list[str], sensor: str, names: list[str]) -> DataFrame:
    """Expected minus present sensors of each anchor."""
    present = F.collect_set(F.when(F.col(sensor).isin(names), F.col(sensor)))
    expected = F.array(*[F.lit(n) for n in names])
    return aligned.groupBy(*keys).agg(F.sort_array(F.array_except(expected, present)).alias("missing"))
