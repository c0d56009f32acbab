"""Ordered passes over long groups, cut into time pieces.

A plain window partitioned by user puts all rows of that user into one task. Here
each group is cut into pieces of fixed time width and the window runs per (key,
piece). Whatever an ordered function needs from before a piece is carried in by
extra rows, taken from one small summary row per piece. The summary is built with
map-side aggregation, so nothing but piece summaries is ever grouped by key alone.

``piece_ms=None`` says the key itself bounds the group; then no carry is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = "_piece"
CARRIED = "_carried"


def piece_of(ts: str, piece_ms: int | None) -> Column:
    if piece_ms is None:
        return F.lit(0).cast("bigint")
    return F.floor(F.col(ts) / F.lit(piece_ms)).cast("bigint")


def fit_piece_ms(
    rows: DataFrame, keys: list[str], ts: str, widest_ms: int, target_rows: int = 1_000_000
) -> int:
    """The widest piece, up to ``widest_ms``, that no key fills with more than about
    ``target_rows`` rows.

    Counts rows per (key, piece), a pre-aggregated pass over the key and time columns
    that returns one number, and narrows the width until the fullest piece fits. For
    evenly spread data the first count settles it.
    """
    width = widest_ms
    while width > 1:
        fullest = (
            rows.groupBy(*keys, piece_of(ts, width).alias(PIECE)).count().agg(F.max("count")).first()[0]
        )
        if fullest is None or fullest <= target_rows:
            break
        width = max(1, width // min(1000, -(-2 * fullest // target_rows)))
    return width


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def with_lead_in(
    rows: DataFrame, keys: list[str], order: list[str], piece_ms: int | None, n: int = 1,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows plus, for each piece, copies of the ``n`` rows that precede it.

    Adds ``_piece`` and ``_carried``. ``order[0]`` is the time; all of ``order``
    must be a total order within the key. The copies hold the keys, the order and
    ``columns`` (all by default): what they leave out is not read a second time.
    """
    own = rows.withColumn(PIECE, piece_of(order[0], piece_ms)).withColumn(CARRIED, F.lit(False))
    if piece_ms is None:
        return own
    kept = rows.columns if columns is None else list(dict.fromkeys([*keys, *order, *columns]))
    cut = rows.select(*kept, piece_of(order[0], piece_ms).alias(PIECE))
    body = F.struct(*[F.col(c) for c in kept])
    rank = F.struct(*[F.col(c) for c in order])
    if n == 1:
        ends = cut.groupBy(*keys, PIECE).agg(F.max_by(body, rank).alias("_end"))
        carried = ends.withColumn(
            "_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy(PIECE))
        ).where("_end IS NOT NULL")
    else:
        # Spark applies the rank limit before the shuffle, so a piece sends at
        # most n rows per map task.
        latest = Window.partitionBy(*keys, PIECE).orderBy(*[F.col(c).desc() for c in order])
        ends = (
            cut.withColumn("_rn", F.row_number().over(latest))
            .where(F.col("_rn") <= n)
            .groupBy(*keys, PIECE)
            .agg(F.collect_list(F.struct(rank.alias("o"), body.alias("b"))).alias("_ends"))
        )
        # A piece that exists holds at least one row, so n pieces back suffice.
        span = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(-n, -1)
        near = ends.withColumn("_near", F.flatten(F.collect_list("_ends").over(span)))
        tail = F.slice(F.sort_array("_near", asc=False), 1, n)
        carried = near.select(*keys, PIECE, F.explode(tail).alias("_t")).select(
            *keys, PIECE, F.col("_t.b").alias("_end")
        )
    carried = carried.select(
        *[F.col(f"_end.{c}").alias(c) for c in kept],
        PIECE,
        F.lit(True).alias(CARRIED),
    )
    return own.unionByName(carried, allowMissingColumns=True)


def piece_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, PIECE).orderBy(*order)


def drop_carried(df: DataFrame) -> DataFrame:
    return df.where(~F.col(CARRIED)).drop(CARRIED, PIECE)


def lagged(
    rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
    piece_ms: int | None,
) -> DataFrame:
    """Previous row's values as new columns, ``{source: new name}``."""
    w = piece_window(keys, order)
    out = with_lead_in(rows, keys, order, piece_ms, columns=list(columns))
    return drop_carried(out.withColumns({new: F.lag(c).over(w) for c, new in columns.items()}))


def forward_fill(
    rows: DataFrame, keys: list[str], order: list[str], columns: list[str],
    piece_ms: int | None,
) -> DataFrame:
    """Replace nulls by the latest earlier value within the key."""
    cut = rows.withColumn(PIECE, piece_of(order[0], piece_ms)).withColumn(CARRIED, F.lit(False))
    w = (
        Window.partitionBy(*keys, PIECE)
        .orderBy(F.col(CARRIED).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    full = cut
    if piece_ms is not None:
        rank = F.struct(*[F.col(c) for c in order])
        ends = cut.groupBy(*keys, PIECE).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
        )
        seeds = ends.withColumns({c: F.last(c, True).over(_before(keys)) for c in columns})
        seeds = seeds.withColumn(CARRIED, F.lit(True))
        full = cut.unionByName(seeds, allowMissingColumns=True)
    return drop_carried(full.withColumns({c: F.last(c, True).over(w) for c in columns}))


def running_index(
    rows: DataFrame, keys: list[str], order: list[str], piece_ms: int, name: str = "idx"
) -> DataFrame:
    """Exact ordinal position, from 1, without sorting a whole group in one task.

    Position = rows in earlier pieces + row number in the own piece. ``keys`` may
    be empty: then the prefix sum runs over one summary row per piece.
    """
    cut = rows.withColumn(PIECE, piece_of(order[0], piece_ms))
    counts = cut.groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, PIECE, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_off")
    )
    local = cut.withColumn("_rn", F.row_number().over(piece_window(keys, order)))
    return (
        local.join(offsets, [*keys, PIECE])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_off", "_rn", PIECE)
    )


def latest_per_key(rows: DataFrame, keys: list[str], order_desc: list[Column]) -> DataFrame:
    """One row per key, first in the given order.

    Written as ``row_number() = 1``: Spark keeps one row per key in each map task
    before the shuffle, so copies of a hot key do not meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order_desc)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
