"""Splitting and balancing labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.operators.joins import salted_lookup
from vitalgrid.operators.ordered import running_index

COPY_BLOCK = 4096

# Labels that set the target, and labels that are raised to it.
MAJORITY = ["WALKING", "SITTING"]


def split_bucket(keys: list[str | Column], parts: int) -> Column:
    """A repeatable part number per key. It depends on the key alone, so a lost and
    recomputed partition falls into the same split."""
    digest = F.md5(F.concat_ws("|", *keys))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def key_split(
    df: DataFrame, keys: list[str], train: int, parts: int
) -> tuple[DataFrame, DataFrame]:
    """Deterministic split: ``train`` of ``parts`` parts for training."""
    b = df.withColumn("_b", split_bucket(keys, parts))
    return b.where(F.col("_b") < train).drop("_b"), b.where(F.col("_b") >= train).drop("_b")


def class_targets(df: DataFrame, keys: list[str], label: str, majority: list[str] | None = None) -> DataFrame:
    """Per key: rows of each class and the balance target, half of the majority
    classes' rows (integer halves). The join is over at most one row per key and
    class."""
    majority = majority or MAJORITY
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    target = counts.groupBy(*keys).agg(
        F.floor(F.coalesce(F.sum(F.when(F.col(label).isin(majority), F.col("n"))), F.lit(0)) / 2)
        .cast("bigint").alias("target")
    )
    return counts.join(target, keys)


def oversample(
    df: DataFrame, keys: list[str], label: str, order: list[str], piece_ms: int,
    majority: list[str] | None = None,
) -> DataFrame:
    """All rows, plus copies of the classes below the target until they reach it.

    Row i of a class with n rows (i from 1, in ``order``) appears
    ``target div n`` times, and once more if i is among the first ``target mod n``:
    the copies cycle through the class. ``copy_no`` is 0 for the original. Copies of one row
    are made in blocks that are spread first, so a class of a single row, raised to half
    of a large one, is written by many tasks.
    """
    targets = class_targets(df, keys, label, majority).withColumnRenamed("n", "_n")
    indexed = running_index(df, [*keys, label], order, piece_ms, "_i")
    joined = salted_lookup(indexed, targets, [*keys, label], order)
    extra = F.when(F.col("_i") <= F.col("target") % F.col("_n"), 1).otherwise(0)
    times = F.greatest(F.floor(F.col("target") / F.col("_n")).cast("bigint") + extra, F.lit(1))
    copies = F.when(F.col("_n") < F.col("target"), times).otherwise(F.lit(1).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    blocks = joined.withColumn("_copies", copies).withColumn(
        "_block", F.explode(F.sequence(zero, F.floor((F.col("_copies") - 1) / COPY_BLOCK).cast("bigint"))))
    # a stated number, since small blocks would be put together again before they grow
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.repartition(tasks, *[F.col(k) for k in (*keys, label, *order)], F.col("_block"))
    first = F.col("_block") * COPY_BLOCK
    last = F.least(first + COPY_BLOCK, F.col("_copies")) - 1
    return spread.withColumn("copy_no", F.explode(F.sequence(first, last))).drop("_i", "_n", "target", "_copies", "_block")
