"""Equi-joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows of one key that one task may join, and how many keys are watched for more.
KEY_ROWS = 2_000_000
HOT_KEYS = 512
WATCHED_KEYS = 8_192
# What may be broadcast, as text; values in memory take about as much.
BROADCAST_BYTES = 32 << 20


def holds_at_most(table: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small in rows and in bytes, by reading no more than ``rows + 1`` of its rows."""
    text = F.octet_length(F.to_json(F.struct("*")))
    seen = table.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("size")).first()
    return seen["n"] <= rows and seen["size"] <= size


def hot_keys(rows: DataFrame, on: list[str], key_rows: int = KEY_ROWS) -> DataFrame:
    """``(_key, _salts)``: hash of each key with more than about ``key_rows`` rows, and the number of tasks to share it.

    One pass over the key columns into a sketch of frequent items, merged from all tasks, which
    keeps every key that owns more than some 1 / WATCHED_KEYS of the rows: at most ``HOT_KEYS``
    rows come back. A count that is off changes the number of tasks, never the result.
    """
    top = rows.select(F.xxhash64(*on).alias("_h")).agg(F.expr(f"approx_top_k(_h, {HOT_KEYS}, {WATCHED_KEYS})").alias("t")).first()["t"]
    hot = [(r["item"], -(-r["count"] // key_rows)) for r in top if r["count"] > key_rows]
    return rows.sparkSession.createDataFrame(hot, "_key long, _salts int")


def salted_lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    spread: list[str | Column],
    how: str = "inner",
    small_rows: int | None = None,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Join many rows to a table holding at most one row per key.

    With ``small_rows`` given, the table is measured first and broadcast if it holds
    no more rows; use it for stored tables, where measuring costs next to nothing.

    Otherwise the rows are measured: where no key owns more than ``key_rows`` of them, it is
    a plain join. The rows of a hot key pick a salt from a hash of ``spread``, and only that
    key's row of the table is repeated, once per salt. The salt is a function of the data,
    hence the same when a lost task is run again.
    """
    if small_rows is not None and holds_at_most(table, small_rows):
        return rows.join(F.broadcast(table), on, how)
    if rows.isStreaming:
        return rows.join(table, on, how)  # planned anew for each batch
    hot = hot_keys(rows, on, key_rows)
    if hot.isEmpty():
        return rows.join(table, on, how)
    salts = F.broadcast(hot)
    marked = lambda df: df.withColumn("_key", F.xxhash64(*on)).join(salts, "_key", "left").drop("_key")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_salts"))).otherwise(F.lit(0)).cast("int")
    left = marked(rows).withColumn("_salt", salt).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    right = marked(table).withColumn("_salt", copies).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


# Keys that may be broadcast, if their bytes allow it too.
KNOWN_ROWS = 200_000


def _known(rows, known, on, spread, how):
    table = known.select(on).distinct()
    if rows.isStreaming:
        # planned anew for each batch; a table of plain files keeps the file list of the start, so users
        # who are added later are let through after the query is started again
        return rows.join(table, [on], how)
    if holds_at_most(known, KNOWN_ROWS):
        return rows.join(F.broadcast(table), [on], how)
    return salted_lookup(rows, table, [on], spread, how)  # not small, as was just seen


def keep_known(rows: DataFrame, known: DataFrame, on: str, spread: list[str | Column]) -> DataFrame:
    """Rows whose key is in ``known`` (left semi)."""
    return _known(rows, known, on, spread, "left_semi")


def drop_known(rows: DataFrame, known: DataFrame, on: str, spread: list[str | Column]) -> DataFrame:
    """Rows whose key is not in ``known`` (left anti)."""
    return _known(rows, known, on, spread, "left_anti")


def outer_by_pivot(
    rows: DataFrame, keys: list[str], name: str, value: str, names: list[str]
) -> DataFrame:
    """Full outer join of one stream per name, as a single conditional aggregate.

    Joining k inputs pairwise would shuffle k times; here each input row is
    pre-aggregated on the map side and shuffled once. The smallest value wins if
    a name occurs twice under one key.
    """
    return rows.groupBy(*keys).agg(
        *[F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    )


def complete_rows(wide: DataFrame, names: list[str]) -> DataFrame:
    """Only keys present in every input (the inner join of the same inputs)."""
    return wide.na.drop("any", subset=names)
