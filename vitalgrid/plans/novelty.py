"""Novelty detection: records, network, posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.config import NoveltySettings
from vitalgrid.operators import bayesnet, novelty
from vitalgrid.operators.bayesnet import SIGNALS
from vitalgrid.operators.ordered import fit_piece_ms
from vitalgrid.session import stored


def slot_records(
    events: DataFrame, keys: list[str], kind: str, value: str, event_id: Column, order: list[str],
    slots: dict[str, str],
) -> DataFrame:
    """One row per key with a value and an id per slot, from the latest event of each
    kind; a missing slot has value 0 and no id."""
    latest = F.struct(*[F.col(o) for o in order])
    body = F.struct(F.col(value).cast("double").alias("v"), event_id.alias("id"))
    out = events.groupBy(*keys).agg(
        *[F.max_by(body, F.when(F.col(kind) == k, latest)).alias(f"_{name}") for k, name in slots.items()]
    )
    columns = []
    for name in slots.values():
        columns += [F.coalesce(F.col(f"_{name}.v"), F.lit(0.0)).alias(name), F.col(f"_{name}.id").alias(f"id_{name}")]
    return out.select(*keys, *columns)


def aligned_slots(aligned: DataFrame, user: str, anchor: str) -> DataFrame:
    """Aligned readings (long form: sensor, eventId, reading) as one record per anchor that all signals answered.

    ``activity``, the signals as numbers and the id of each chosen event; the anchor is the record's time and id.
    """
    of = lambda s, c: F.max(F.when(F.col("sensor") == s, F.col(c)))
    wide = aligned.where(F.col("sensor").isin(bayesnet.VARIABLES)).groupBy(user, anchor).agg(
        *[of(v, "reading").alias(f"_{v}") for v in bayesnet.VARIABLES], *[of(v, "eventId").alias(f"event_{v}") for v in bayesnet.VARIABLES])
    complete = wide.where(" AND ".join(f"event_{v} IS NOT NULL" for v in bayesnet.VARIABLES))
    return _record(complete, user, anchor, {v: F.col(f"_{v}") for v in bayesnet.VARIABLES}, {v: F.col(f"event_{v}") for v in bayesnet.VARIABLES})


def live_slots(whole: DataFrame, user: str, anchor: str) -> DataFrame:
    """The same records from the stream's whole anchors, each with its event time."""
    parsed = whole.withColumn("_e", F.from_json("events", "map<string, array<string>>"))
    at = lambda i: {v: F.element_at(F.col("_e")[v], i) for v in bayesnet.VARIABLES}
    return _record(parsed, user, anchor, at(3), at(2), "event_time")


def _record(rows: DataFrame, user: str, anchor: str, reading: dict[str, Column], event: dict[str, Column], *keep: str) -> DataFrame:
    return rows.select(
        F.col(user).alias("user_id"), F.col(anchor).alias("time_stamp"), F.col(anchor).alias("event_id"), reading["Activity"].alias("activity"),
        *[reading[s].cast("double").alias(s) for s in SIGNALS], *[event[v].alias(f"event_{v}") for v in bayesnet.VARIABLES], *keep)


def with_states(rows: DataFrame, cuts: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Signals replaced by state numbers under the network's variable names."""
    binned = bayesnet.bin_signals(rows, cuts, keys, SIGNALS, spread, bayesnet.BROADCAST_ROWS)
    return (
        binned.withColumn("_label", bayesnet.activity_state("activity"))
        .drop(*SIGNALS, "activity")
        .withColumnsRenamed({f"state_{s}": s for s in SIGNALS})
        .withColumnRenamed("_label", "Activity")
    )


def fit(rows: DataFrame, keys: list[str], spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cut points and conditional tables of each network.

    Two passes over the data, as fitting needs: one for the cut points, one for the
    counts per state. Both results are small and are stored; everything after works
    on at most 1024 rows per network.
    """
    cuts = stored(bayesnet.cut_points(rows, keys, SIGNALS), "cuts")
    cells = stored(bayesnet.cell_counts(with_states(rows, cuts, keys, spread), keys), "cells")
    return cuts, stored(bayesnet.fit_tables(cells, keys), "tables")


def judge(
    rows: DataFrame, cuts: DataFrame, tables: DataFrame, keys: list[str], spread: list[str],
) -> DataFrame:
    """Posteriors of each record under its network."""
    table = stored(bayesnet.posterior_table(bayesnet.joint_table(tables, keys), keys), "posteriors")
    return bayesnet.posteriors(with_states(rows, cuts, keys, spread), table, keys, spread)


def decide(
    rows: DataFrame, cuts: DataFrame, tables: DataFrame, keys: list[str], spread: list[str],
    settings: NoveltySettings,
) -> DataFrame:
    """Judged records with their violations and the flag."""
    return novelty.decide(judge(rows, cuts, tables, keys, spread), settings.threshold, settings.rule)


def rate(
    decided: DataFrame, keys: list[str], order: list[str], settings: NoveltySettings, widest_ms: int,
    keep_points: bool = False,
) -> DataFrame:
    """Trailing novelty rate. The input is read twice, for the rows and for what their
    time pieces carry over, so it is stored first."""
    slim = stored(decided, "decided")
    piece = fit_piece_ms(slim, keys, order[0], widest_ms)
    return novelty.trailing_rate(
        slim, keys, order, settings.window_rows, settings.rate_threshold, piece, keep_points
    )
