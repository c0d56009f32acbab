"""Sinks: keyed tables, metric posts, messages, files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from vitalgrid.operators.joins import drop_known
from vitalgrid.operators.ordered import latest_per_key


# A table of all sensors: ids are told apart per sensor, as in one table per sensor.
TABLE_KEY = ["sensor", "event_id"]


def last_write_wins(rows: DataFrame, key: str | list[str] = "event_id", order: list[str] | None = None) -> DataFrame:
    """One row per key: the write that comes last in ``order``. Equal writes are told apart
    by a hash of the whole row, so that a repeated read gives the same row."""
    order = order or ["time_stamp", "batch_seq"]
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() != "map"]
    last = [F.col(c).desc() for c in order] + [F.xxhash64(*plain).desc()]
    return latest_per_key(rows, [key] if isinstance(key, str) else key, last)


def upsert(
    existing: DataFrame, incoming: DataFrame, key: str | list[str] = "event_id", order: list[str] | None = None
) -> DataFrame:
    """The table after the incoming rows are written: one grouping over both, no
    join; the latest write of each key remains."""
    return last_write_wins(existing.unionByName(incoming, allowMissingColumns=True), key, order)


def append_keyed(batch: DataFrame, path: str, batch_id: int, partition: list[str]) -> None:
    """Write one micro-batch into its own folder, so that a replayed batch replaces
    itself. Readers resolve keys with ``read_keyed``: writing never rereads the table.
    """
    (
        batch.withColumn("batch_seq", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/batch_id={batch_id}")
    )


def read_keyed(spark: SparkSession, path: str, key: str | list[str] | None = None) -> DataFrame:
    """Current rows of a keyed table; messages without an id share the default id, of which
    each map task keeps one row per sensor."""
    return last_write_wins(spark.read.parquet(path).drop("batch_id"), key or TABLE_KEY)


def compact_keyed(
    spark: SparkSession, path: str, target: str, partition: list[str], key: str | list[str] | None = None
) -> None:
    """Rewrite a keyed table with one row per key, into a new folder."""
    read_keyed(spark, path, key).write.mode("errorifexists").partitionBy(*partition).parquet(target)


def as_messages(rows: DataFrame, columns: list[str | Column] | None = None) -> DataFrame:
    """Rows as JSON text in ``value``."""
    cols = columns or rows.columns
    return rows.select(F.to_json(F.struct(*cols)).alias("value"))


def message_stream(rows: DataFrame, checkpoint: str, topic: str | None = None, servers: str | None = None,
                   path: str | None = None) -> DataStreamWriter:
    """Publish a stream of rows to a broker topic, or as text files under ``path``."""
    out = as_messages(rows).writeStream.option("checkpointLocation", checkpoint)
    if servers:
        return out.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.format("text").option("path", path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str, header: bool = False, quote_all: bool = True) -> None:
    (
        rows.write.mode("errorifexists").option("quote", '"').option("quoteAll", quote_all)
        .option("header", header).csv(path)
    )


def write_posts(posts: DataFrame, path: str) -> None:
    """One text line per post. Sending them over the network is left to the caller."""
    posts.select("body").write.mode("errorifexists").text(path)


def purge(points: DataFrame, names: DataFrame, name: str = "name", spread: list[str] | None = None) -> DataFrame:
    """Points whose metric is not listed for removal."""
    return drop_known(points, names, name, spread or ["timestamp"])


def table_sizes(rows: DataFrame, table: str = "table") -> DataFrame:
    return rows.groupBy(table).agg(F.count(F.lit(1)).alias("n"))


def each_batch(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Run ``write`` on batches that have rows, keeping them for several actions."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                write(batch, batch_id)
        finally:
            batch.unpersist()

    return run
