"""As-of joins: backward, forward and nearest.

Rule, with L the event times of a key and t the probe time:
  * t later than every event: no match, in every mode;
  * t not later than the first event: the first event, in every mode;
  * otherwise the candidates are the last event strictly before t and the first
    event at or after t. Nearest takes the later one only if it is strictly closer.

Probes and events are unioned and scanned in order, one shuffle, no pairs. Long
groups are cut into time pieces (see ``ordered``); the last event before and the
first event after a piece enter it as extra rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitalgrid.operators.ordered import PIECE, piece_of

MODES = ("backward", "forward", "nearest")


def neighbours(
    probes: DataFrame,
    events: DataFrame,
    keys: list[str],
    probe_ts: str,
    event_ts: str,
    event_order: list[str],
    piece_ms: int | None,
) -> DataFrame:
    """Each probe with ``before`` and ``after``: structs of the event's columns
    (other than the keys), null where there is none."""
    ev_cols = [c for c in events.columns if c not in keys]
    pr_cols = [c for c in probes.columns if c not in keys]
    body = F.struct(*[F.col(c) for c in ev_cols])
    rank = F.struct(F.col(event_ts).alias("t"), *[F.col(c) for c in event_order])
    ev = events.select(
        *keys, F.col(event_ts).alias("_ts"), F.lit(1).alias("_side"), rank.alias("_rank"),
        body.alias("_ev"), piece_of(event_ts, piece_ms).alias(PIECE),
    )
    pr = probes.select(
        *keys, F.col(probe_ts).alias("_ts"), F.lit(0).alias("_side"),
        F.struct(*[F.col(c) for c in pr_cols]).alias("_pr"),
        piece_of(probe_ts, piece_ms).alias(PIECE),
    )
    both = ev.unionByName(pr, allowMissingColumns=True)
    if piece_ms is not None:
        # One summary row per piece; the sides are unioned and aggregated again
        # rather than joined.
        ends = ev.groupBy(*keys, PIECE).agg(
            F.min(F.struct("_rank", "_ev")).alias("_lo"), F.max(F.struct("_rank", "_ev")).alias("_hi")
        )
        asked = pr.select(*keys, PIECE).distinct().withColumn("_asked", F.lit(True))
        summary = (
            ends.unionByName(asked, allowMissingColumns=True)
            .groupBy(*keys, PIECE)
            .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_asked").alias("_asked"))
        )
        up = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(*keys).orderBy(F.col(PIECE).desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = (
            summary.withColumn("_p", F.last("_hi", True).over(up))
            .withColumn("_n", F.last("_lo", True).over(down))
            .where("_asked")
            .select(*keys, PIECE, F.explode(F.array("_p", "_n")).alias("_c"))
            .where("_c IS NOT NULL")
            .select(
                *keys, F.col("_c._rank.t").alias("_ts"), F.lit(1).alias("_side"),
                F.col("_c._rank").alias("_rank"), F.col("_c._ev").alias("_ev"), PIECE,
            )
        )
        both = both.unionByName(carried, allowMissingColumns=True)
    # The two orders mirror each other. A frame reaching to the end of the
    # partition would be recomputed for every row, hence the descending scan.
    past = (
        Window.partitionBy(*keys, PIECE).orderBy("_ts", "_side", "_rank")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    future = (
        Window.partitionBy(*keys, PIECE)
        .orderBy(F.col("_ts").desc(), F.col("_side").desc(), F.col("_rank").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.withColumn("before", F.last("_ev", True).over(past))
        .withColumn("after", F.last("_ev", True).over(future))
        .where("_side = 0")
        .select(*keys, *[F.col(f"_pr.{c}").alias(c) for c in pr_cols], "before", "after")
    )


def pick(mode: str, probe_ts: str, event_ts: str):
    """The matching struct, given ``before`` and ``after``."""
    before, after, t = F.col("before"), F.col("after"), F.col(probe_ts)
    if mode == "backward":
        inner = before
    elif mode == "forward":
        inner = after
    elif mode == "nearest":
        closer = (after[event_ts] - t) < (t - before[event_ts])
        inner = F.when(closer, after).otherwise(before)
    else:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return F.when(after.isNotNull(), F.when(before.isNull(), after).otherwise(inner))


def asof_join(
    probes: DataFrame,
    events: DataFrame,
    keys: list[str],
    probe_ts: str,
    event_ts: str,
    mode: str = "backward",
    event_order: list[str] | None = None,
    piece_ms: int | None = 3_600_000,
    how: str = "left",
) -> DataFrame:
    """Probes with the matching event's columns (null when none and ``how='left'``)."""
    near = neighbours(probes, events, keys, probe_ts, event_ts, event_order or [], piece_ms)
    out = near.withColumn("_m", pick(mode, probe_ts, event_ts)).drop("before", "after")
    if how == "inner":
        out = out.where("_m IS NOT NULL")
    ev_cols = [c for c in events.columns if c not in keys]
    return out.select(*[c for c in out.columns if c != "_m"], *[F.col(f"_m.{c}").alias(c) for c in ev_cols])
