"""Windowed features and votes over streams: each window is emitted once, when the
watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitalgrid.functions.scalars import fill_numeric
from vitalgrid.operators.decide import vote
from vitalgrid.operators.features import axis_aggregates


def _keyed_by_window(stream: DataFrame, width_ms: int) -> DataFrame:
    return stream.withColumn("_w", F.window("event_time", f"{width_ms} milliseconds"))


def _number(width_ms: int):
    return F.floor(F.unix_millis("_w.start") / F.lit(width_ms)).cast("bigint").alias("window")


def closed_slices(stream: DataFrame, keys: list[str], order: list[str], carried: list[str], width_ms: int) -> DataFrame:
    """(keys, ``slice``, ``rows``, ``event_time``): the rows of each key and slice of time, once, when the
    watermark has passed the slice's end.

    ``rows`` is a JSON array of objects with ``order`` and ``carried``, sorted by them; null fields are left
    out. The rows wait in Spark's own aggregation state, so a keyed processor behind this meets one row per
    slice, slices of a key never come out of order, and it keeps only what outlives a slice.
    """
    body = F.struct(*order, *carried)
    cut = _keyed_by_window(stream, width_ms).groupBy(*keys, "_w").agg(F.sort_array(F.collect_list(body)).alias("_rows"))
    return cut.select(*keys, _number(width_ms).alias("slice"), F.to_json("_rows").alias("rows"), F.window_time("_w").alias("event_time"))


def axis_features(stream: DataFrame, keys: list[str], width_ms: int) -> DataFrame:
    """Twelve features over the distinct readings of each window. ``stream`` carries
    ``event_time`` with a watermark; the window in the key bounds the state."""
    unique = _keyed_by_window(stream, width_ms).select(*keys, "_w", "x", "y", "z").dropDuplicates()
    out = unique.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("n"), *axis_aggregates())
    return fill_numeric(out.select(*keys, _number(width_ms), *[c for c in out.columns if c not in (*keys, "_w")]))


def window_votes(stream: DataFrame, keys: list[str], label: str, width_ms: int, weights=None) -> DataFrame:
    """The vote of each key and window."""
    scored = vote(_keyed_by_window(stream, width_ms), [*keys, "_w"], label, weights)
    return scored.select(*keys, _number(width_ms), "activity", "score", "n_top")


def counts(stream: DataFrame, keys: list[str], width_ms: int) -> DataFrame:
    """Rows per key and window."""
    out = _keyed_by_window(stream, width_ms).groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, _number(width_ms), "n")
