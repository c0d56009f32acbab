"""Exact order statistics of many groups at once, by counting.

No value is sorted and no width is given. Each round a mergeable quantile sketch proposes,
for every value looked for, two probes close to it; one pre-aggregated pass then counts
exactly how many rows lie below, at, between and above the probes. The sketch only speeds
the search up: the counts decide, and each round leaves at least a probe behind. With
probes a few thousandths apart, 10^12 rows of one group are down to ``FINISH_ROWS`` in
three rounds, however their values are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalgrid.operators.joins import holds_at_most, salted_lookup
from vitalgrid.session import stored

# Probes a sketch is asked for, and its accuracy (rank error 1 / ACCURACY).
GRID = 512
ACCURACY = 2_000
# Rows between two probes that one task may put in order at the end.
FINISH_ROWS = 100_000
# Groups that may be broadcast.
GROUP_ROWS = 200_000


def order_statistics(
    rows: DataFrame, group: list[str], value: str, shares: list[float | Column], finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """``(group, n, low, high, found)``: rows with a value, smallest, largest, and for each share
    the smallest value whose cumulative count reaches it. Null and NaN are no values."""
    rows = stored(
        rows.select(*group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), "values"
    )
    first = stored(rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), _sketch("v").alias("_probes")
    ), "groups")
    # one row per value looked for; rank counts from 1 and is relative to the open interval (after, before)
    targets = first.select(
        *group, F.posexplode(F.array(*[F.ceil(F.col("n") * s) for s in shares])).alias("q", "rank"),
        F.lit(float("-inf")).alias("after"), F.lit(float("inf")).alias("before"), F.col("n").alias("inside"), "_probes",
    ).withColumn("rank", F.greatest("rank", F.lit(1)))
    small = holds_at_most(first.select(*group), GROUP_ROWS // len(shares))  # decided once: later targets are fewer
    done = None
    while True:
        counted = stored(_count(rows, _probe(targets), group, small), "counted")
        ready = counted.where("answer IS NOT NULL").select(*group, "q", "answer")
        done = ready if done is None else done.unionByName(ready)
        open_ = counted.where("answer IS NULL").drop("answer")
        widest = open_.agg(F.max("inside")).first()[0]
        if widest is None:
            break
        if widest <= finish_rows:
            done = done.unionByName(_finish(rows, open_, group, small))
            break
        targets = _sketch_again(rows, open_, group, small)
    found = done.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("q", "answer")))["answer"].alias("found"))
    return first.drop("_probes").join(found, group)


def _sketch(v: str | Column) -> Column:
    return F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _probe(targets: DataFrame) -> DataFrame:
    """Two probes on either side of the rank, two steps of the grid away."""
    at = F.floor((F.col("rank") - 0.5) / F.col("inside") * GRID).cast("int")
    near = lambda i: F.get("_probes", F.least(F.greatest(at + i, F.lit(0)), F.lit(GRID)))
    return targets.withColumns({"lo": near(-2), "hi": near(3)}).drop("_probes")


def _with_targets(rows: DataFrame, targets: DataFrame, group: list[str], small: bool) -> DataFrame:
    """Each row beside the targets of its group whose interval it lies in. A group has as many as there are shares."""
    if small:
        met = rows.join(F.broadcast(targets), group)
    else:
        fields = [c for c in targets.columns if c not in group]
        table = targets.groupBy(*group).agg(F.collect_list(F.struct(*fields)).alias("_t"))
        met = salted_lookup(rows, table, group, ["v"]).select(*group, "v", F.explode("_t").alias("_t")).select(*group, "v", "_t.*")
    return met.where("v > after AND v < before")


def _count(rows: DataFrame, targets: DataFrame, group: list[str], small: bool) -> DataFrame:
    """The answer of each target, or its narrower interval and the rank within."""
    inner = _with_targets(rows, targets, group, small)
    state = ["q", "rank", "after", "before", "lo", "hi"]
    n = lambda test, name: F.count(F.when(F.expr(test), 1)).alias(name)
    seen = inner.groupBy(*group, *state).agg(
        n("v < lo", "n0"), n("v = lo", "n1"), n("v > lo AND v < hi", "n2"), n("v = hi AND hi > lo", "n3"), n("v > hi", "n4"),
    )
    upto = [F.expr(" + ".join(f"n{j}" for j in range(i + 1))) for i in range(4)]
    case = lambda *of: F.when(F.col("rank") <= upto[0], of[0]).when(F.col("rank") <= upto[1], of[1]).when(
        F.col("rank") <= upto[2], of[2]).when(F.col("rank") <= upto[3], of[3]).otherwise(of[4])
    nothing = F.lit(None).cast("double")
    return seen.select(
        *group, "q",
        case(nothing, F.col("lo"), nothing, F.col("hi"), nothing).alias("answer"),
        (F.col("rank") - case(F.lit(0), F.lit(0), upto[1], F.lit(0), upto[3])).alias("rank"),
        case(F.col("after"), F.col("after"), F.col("lo"), F.col("after"), F.col("hi")).alias("after"),
        case(F.col("lo"), F.col("before"), F.col("hi"), F.col("before"), F.col("before")).alias("before"),
        case(F.col("n0"), F.lit(0), F.col("n2"), F.lit(0), F.col("n4")).alias("inside"),
    )


def _sketch_again(rows: DataFrame, targets: DataFrame, group: list[str], small: bool) -> DataFrame:
    inner = _with_targets(rows, targets, group, small)
    state = ["q", "rank", "after", "before", "inside"]
    return inner.groupBy(*group, *state).agg(_sketch("v").alias("_probes"))


def _finish(rows: DataFrame, targets: DataFrame, group: list[str], small: bool) -> DataFrame:
    """Intervals with at most ``finish_rows`` rows, counted by value and put in order."""
    inner = _with_targets(rows, targets, group, small)
    counts = inner.groupBy(*group, "q", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*group, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_cum", F.sum("n").over(up)).where("_cum >= rank")
        .groupBy(*group, "q").agg(F.min("v").alias("answer"))
    )
