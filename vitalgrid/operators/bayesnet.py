"""A discrete Bayesian network over one label and four binned signals.

Structure: HR given A; G given A, HR; S given A, G, HR; R given A, HR, where A is
the activity, G skin resistance, S skin temperature, HR heart rate and R the beat
interval. States are numbered 0 to 3. A model is named by ``network``; there may be
one for all users or one per user or device.

With all other variables observed, the posterior of a variable is the joint divided
by the sum of the joint over the variable's own states. The joint has 4^5 = 1024
entries, so it is computed once per network and events only look it up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalgrid.operators.joins import salted_lookup
from vitalgrid.operators.selection import FINISH_ROWS, order_statistics

# Variables and parents, in the order in which parents are listed.
PARENTS = {
    "Activity": [],
    "HR_RATE": ["Activity"],
    "GSR_RESISTANCE": ["Activity", "HR_RATE"],
    "SKTMP_TEMPERATURE": ["Activity", "GSR_RESISTANCE", "HR_RATE"],
    "RRI_INTERVAL": ["Activity", "HR_RATE"],
}
VARIABLES = list(PARENTS)
SIGNALS = ["SKTMP_TEMPERATURE", "GSR_RESISTANCE", "HR_RATE", "RRI_INTERVAL"]
# States of the activity variable, in network order.
ACTIVITY_STATES = ["SITTING", "WALKING", "WALKING_DOWN", "WALKING_UP"]
N_STATES = 4
JOINT_ROWS = N_STATES ** len(PARENTS)
BROADCAST_ROWS = 500_000
POSTERIOR_DIGITS = 12


def activity_state(label: str) -> Column:
    out = F.lit(None).cast("int")
    for i, n in enumerate(ACTIVITY_STATES):
        out = F.when(F.col(label) == n, F.lit(i)).otherwise(out)
    return out


def bin_index(value: Column, cuts: Column) -> Column:
    """State of a value among five cut points: the first interval is closed on both
    sides, the others exclude their lower end. Null when out of range."""
    at = [cuts[i] for i in range(N_STATES + 1)]
    out = F.when((value >= at[0]) & (value <= at[1]), F.lit(0))
    for i in range(1, N_STATES):
        out = out.when((value > at[i]) & (value <= at[i + 1]), F.lit(i))
    return out.cast("int")


def cut_points(df: DataFrame, keys: list[str], signals: list[str], finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Minimum, quartiles and maximum of each signal: ``(keys, variable, cuts)``.

    A quartile is the smallest value whose cumulative count reaches its share, so it is
    exact. NaN and null are no values; a signal without any has no row.
    """
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("variable"), F.col(s).cast("double").alias("v")) for s in signals])
        ).alias("_s"),
    ).select(*keys, "_s.variable", "_s.v")
    return order_statistics(long, [*keys, "variable"], "v", [F.lit(q) / 4 for q in (1, 2, 3)], finish_rows).select(
        *keys, "variable", F.concat(F.array("low"), "found", F.array("high")).alias("cuts")
    )


def wide_cuts(cuts: DataFrame, keys: list[str], signals: list[str]) -> DataFrame:
    """One row per network with ``cuts_<signal>`` columns."""
    return cuts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == s, F.col("cuts"))).alias(f"cuts_{s}") for s in signals]
    )


def bin_signals(
    df: DataFrame, cuts: DataFrame, keys: list[str], signals: list[str], spread: list[str],
    small_rows: int | None = None,
) -> DataFrame:
    """Replace raw signals by state numbers, null when out of range. Give
    ``small_rows`` when ``cuts`` is a stored table."""
    joined = salted_lookup(df, wide_cuts(cuts, keys, signals), keys, spread, small_rows=small_rows)
    return joined.withColumns(
        {f"state_{s}": bin_index(F.col(s), F.col(f"cuts_{s}")) for s in signals}
    ).drop(*[f"cuts_{s}" for s in signals])


def cell_counts(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per full state, at most 1024 per network: all tables come from this."""
    return states.groupBy(*keys, *VARIABLES).agg(F.count(F.lit(1)).alias("n"))


def _grid(networks: DataFrame, columns: list[str]) -> DataFrame:
    out = networks
    for c in columns:
        out = out.withColumn(c, F.explode(F.array(*[F.lit(i) for i in range(N_STATES)])))
    return out


def fit_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Conditional tables ``(keys, variable, given, state, p)``; ``given`` holds the
    parents' states in listed order. Parent states never seen get a uniform row.

    The counts are laid over the full grid of 1024 states per network, and all five
    tables are read off it by sums over parts of the state: one shuffle by network.
    A table's row is taken where the variables it does not mention are 0.
    """
    full = (
        _grid(cells.select(*keys).distinct(), VARIABLES)
        .join(cells, [*keys, *VARIABLES], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .repartition(*keys)
    )
    sums, rows = {}, []
    for v, parents in PARENTS.items():
        sums[f"_n_{v}"] = F.sum("n").over(Window.partitionBy(*keys, *parents, v))
        sums[f"_all_{v}"] = F.sum("n").over(Window.partitionBy(*keys, *parents))
        rest = [F.col(o) == 0 for o in VARIABLES if o != v and o not in parents]
        kept = F.lit(True)
        for r in rest:
            kept = kept & r
        share = F.coalesce(F.try_divide(F.col(f"_n_{v}"), F.col(f"_all_{v}")), F.lit(1.0 / N_STATES))
        rows.append(
            F.when(
                kept,
                F.struct(
                    F.lit(v).alias("variable"),
                    F.concat_ws(",", *[F.col(p).cast("string") for p in parents]).alias("given"),
                    F.col(v).alias("state"), share.alias("p"),
                ),
            )
        )
    return (
        full.withColumns(sums).select(*keys, F.explode(F.array(*rows)).alias("_r"))
        .where("_r IS NOT NULL").select(*keys, "_r.*")
    )


def joint_table(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The joint over all states, by equi-joins along the parents."""
    out = None
    for variable, parents in PARENTS.items():
        at = F.split("given", ",")
        one = tables.where(F.col("variable") == variable).select(
            *keys,
            *[F.get(at, F.lit(i)).try_cast("int").alias(p) for i, p in enumerate(parents)],
            F.col("state").alias(variable),
            F.col("p").alias("_p"),
        )
        if out is None:
            out = one.withColumnRenamed("_p", "joint")
        else:
            out = (
                out.join(one, [*keys, *parents])
                .withColumn("joint", F.col("joint") * F.col("_p"))
                .drop("_p")
            )
    return out


def posterior_table(joint: DataFrame, keys: list[str]) -> DataFrame:
    """``post_<variable>`` for each full state; 0 where no state is possible. All
    sums share one partitioning by network, a fixed number of rows each."""
    joint = joint.repartition(*keys)
    posts = {}
    for v in VARIABLES:
        others = [o for o in VARIABLES if o != v]
        whole = F.sum("joint").over(Window.partitionBy(*keys, *others))
        share = F.coalesce(F.try_divide(F.col("joint"), whole), F.lit(0.0))
        # The order of a sum differs between runs; without rounding, a posterior
        # equal to a threshold could fall on either side of it.
        posts[f"post_{v}"] = F.round(share, POSTERIOR_DIGITS)
    return joint.withColumns(posts)


def posteriors(
    states: DataFrame, table: DataFrame, keys: list[str], spread: list[str],
) -> DataFrame:
    """Events with the posterior of each variable given the other four; all 0 when a
    signal is out of range.

    The table has 1024 rows per network. It is broadcast when measured small, and
    joined with salt otherwise: common states are hot keys.
    """
    slim = table.select(*keys, *VARIABLES, *[f"post_{v}" for v in VARIABLES])
    joined = salted_lookup(states, slim, [*keys, *VARIABLES], spread, "left", small_rows=BROADCAST_ROWS)
    return joined.withColumns({f"post_{v}": F.coalesce(f"post_{v}", F.lit(0.0)) for v in VARIABLES})
