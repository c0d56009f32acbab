"""Keyed tables merged in place of their history, bucketed by key.

A version of the table is stored in buckets, sorted by key within each. A merge joins the
new rows to it bucket by bucket: only the new rows are shuffled, the history is read where
it lies and written back into the same buckets without an exchange. Deleted keys stay as
tombstones, so that an older write which arrives late does not bring a row back; ``expire``
drops those that nothing older can reach any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitalgrid.sources.sinks import last_write_wins

DELETED = "deleted"


def write(rows: DataFrame, path: str, key: list[str], buckets: int) -> DataFrame:
    """A first version, or the next one, below ``path``; rows must be one per key. Size
    buckets for the table it will become: some hundred MB each."""
    marked = rows if DELETED in rows.columns else rows.withColumn(DELETED, F.lit(False))
    name = _fresh()
    (
        marked.write.mode("errorifexists").bucketBy(buckets, *key).sortBy(*key)
        .option("path", path).saveAsTable(name, format="parquet")
    )
    return rows.sparkSession.table(name)


def open_version(spark: SparkSession, path: str, key: list[str], buckets: int) -> DataFrame:
    """A stored version in another session: the layout is declared again, no file is read but one footer."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    by = ", ".join(f"`{k}`" for k in key)
    name = _fresh()
    spark.sql(
        f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _fresh() -> str:
    return f"keyed_{uuid.uuid4().hex}"


def tombstones(keys: DataFrame, like: DataFrame, key: list[str], order: dict[str, Column]) -> DataFrame:
    """Rows that delete ``keys`` as of ``order``; what else the table holds is null in them."""
    of = {k: F.col(k) for k in key} | order | {DELETED: F.lit(True)}
    return keys.select(*[of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def merged(table: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The next version: of each key the write that comes last in ``order``, nulls first, whether it
    was stored or is new, as ``last_write_wins`` over both would have it. Rows without a key
    count as one key, and meet apart from the buckets."""
    marked = incoming if DELETED in incoming.columns else incoming.withColumn(DELETED, F.lit(False))
    names = table.columns
    new = last_write_wins(marked.select(names), key, order)
    lacking = " OR ".join(f"`{k}` IS NULL" for k in key)
    keyless = last_write_wins(table.where(lacking).unionByName(new.where(lacking)), key, order)
    plain = [f.name for f in table.schema.fields if f.dataType.typeName() != "map"]
    whole = lambda df, side: df.select(*[F.col(k).alias(f"{side}_{k}") for k in key], F.struct(*names).alias(side))
    old, fresh = whole(table.where(f"NOT ({lacking})"), "old"), whole(new.where(f"NOT ({lacking})"), "new")
    # plain equality: a null-safe one would hide the key from the buckets
    same = [F.col(f"old_{k}") == F.col(f"new_{k}") for k in key]
    rank = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in order], F.xxhash64(*[F.col(f"{side}.{c}") for c in plain]))
    later = F.col("old").isNull() | (F.col("new").isNotNull() & (rank("new") > rank("old")))
    both = old.join(fresh, same, "full_outer")
    return both.select(F.when(later, F.col("new")).otherwise(F.col("old")).alias("r")).select("r.*").unionByName(keyless)


def merge(table: DataFrame, incoming: DataFrame, path: str, key: list[str], order: list[str], buckets: int) -> DataFrame:
    """``merged``, stored as the next version below ``path``. The version before stays
    until it is removed, so a merge that fails is simply run again into a new folder."""
    return write(merged(table, incoming, key, order), path, key, buckets)


def current(table: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return table.where(~F.col(DELETED)).drop(DELETED)


def expire(table: DataFrame, before: Column) -> DataFrame:
    """Without the tombstones that meet ``before``: no older write may still be on its way."""
    return table.where(~(F.col(DELETED) & F.coalesce(before, F.lit(False))))
