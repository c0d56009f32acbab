"""Novelty decision from posteriors and its rate over trailing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalgrid.functions.scalars import stable_id
from vitalgrid.operators.bayesnet import SIGNALS, VARIABLES
from vitalgrid.operators.ordered import CARRIED, PIECE, with_lead_in

# Order of the events in a violation record.
EVENT_SLOTS = [*SIGNALS, "Activity"]


def violations(threshold: float, event_id: str = "event_") -> Column:
    """One record per variable whose posterior is below ``threshold``: the four
    observed events, the judged event and its probability."""
    items = []
    for v in EVENT_SLOTS:
        seen = [
            F.col(f"{event_id}Activity") if s == v else F.col(f"{event_id}{s}") for s in SIGNALS
        ]
        items.append(
            F.when(
                F.col(f"post_{v}") < threshold,
                F.struct(
                    F.array(*seen).alias("in_events"),
                    F.col(f"{event_id}{v}").alias("out_event"),
                    F.col(f"post_{v}").alias("result_percentage"),
                ),
            )
        )
    return F.filter(F.array(*items), lambda i: i.isNotNull())


def decide(df: DataFrame, threshold: float, rule: str = "any") -> DataFrame:
    """Adds ``violations`` and ``novel``. ``any``: one violation is enough;
    ``majority``: more than half of the variables must be violated."""
    out = df.withColumn("violations", violations(threshold))
    # Counted on its own, so that plans that need only the flag build no records.
    n = sum(((F.col(f"post_{v}") < threshold).cast("int") for v in VARIABLES), F.lit(0))
    if rule == "any":
        novel = n > 0
    elif rule == "majority":
        novel = n * 2 > len(VARIABLES)
    else:
        raise ValueError(f"rule must be 'any' or 'majority', got {rule!r}")
    return out.withColumn("novel", novel)


def trailing_rate(
    df: DataFrame, keys: list[str], order: list[str], n: int, rate_threshold: float,
    piece_ms: int | None, keep_points: bool = False,
) -> DataFrame:
    """Share of novel rows among the last ``n`` of the key, null until ``n`` rows
    exist, and ``alarm`` when it exceeds the threshold.

    ``keep_points`` adds ``points``: the violations of those n rows.
    """
    carried = ["novel", "violations"] if keep_points else ["novel"]
    cut = with_lead_in(df, keys, order, piece_ms, n - 1, carried)
    w = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(w) == n
    hits = F.sum(F.col("novel").cast("int")).over(w)
    out = cut.withColumn("novel_rate", F.when(full, hits / F.lit(float(n))))
    out = out.withColumn("alarm", F.coalesce(F.col("novel_rate") > rate_threshold, F.lit(False)))
    if keep_points:
        out = out.withColumn("points", F.collect_list(F.struct(*order, "violations")).over(w))
    return out.where(~F.col(CARRIED)).drop(CARRIED, PIECE)


def time_rate(df: DataFrame, keys: list[str], ts: str, width_ms: int) -> DataFrame:
    """Share of novel rows per tumbling time window."""
    window = F.floor(F.col(ts) / F.lit(width_ms)).cast("bigint")
    return df.groupBy(*keys, window.alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("novel").cast("double")).alias("novel_rate")
    )


def novelty_rows(
    rated: DataFrame, user: str = "user_id", ts: str = "time_stamp", order: tuple[str, ...] = ("time_stamp", "event_id"),
) -> DataFrame:
    """Alarmed rows as table rows, one per violation of the row itself. The ids hold the
    whole ``order``, which tells the rows of a user apart; the time alone may not."""
    point = stable_id(F.col(user), *[F.col(o) for o in order])
    flat = rated.where("alarm").select(
        user, F.col(ts).alias("novel_time_stamp"), "novel_rate", F.col("novel").alias("novel_flag"),
        point.alias("novel_point_id"), F.posexplode("violations").alias("_i", "_v"),
    )
    return flat.select(
        stable_id(F.col("novel_point_id"), F.col("_i")).alias("row_id"),
        *[F.col("_v.in_events")[i].alias(f"in_event_{i + 1}") for i in range(4)],
        F.col("_v.out_event").alias("out_event"),
        F.col("novel_point_id").alias("novel_event_id"),
        "novel_point_id", "novel_flag", "novel_rate",
        F.col("_v.result_percentage").alias("result_percentage"),
        "novel_time_stamp", F.col(user).alias("user_id"),
    )


def alarm_points(rated: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each alarmed row, the violations of all rows in its trailing window."""
    flat = rated.where("alarm").select(
        *keys, *[F.col(o).alias(f"alarm_{o}") for o in order], "novel_rate", F.explode("points").alias("_p")
    )
    return flat.select(
        *keys, *[f"alarm_{o}" for o in order], "novel_rate",
        *[F.col(f"_p.{o}").alias(o) for o in order], F.explode("_p.violations").alias("_v"),
    ).select(
        *keys, *[f"alarm_{o}" for o in order], "novel_rate", *order,
        "_v.in_events", "_v.out_event", "_v.result_percentage",
    )
