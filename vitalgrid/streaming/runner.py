"""Starting streams, and the settings they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalgrid.session import pin_utc, scratch_path
from vitalgrid.sources.sinks import each_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """State beyond executor memory goes to disk; keyed processors require it."""
    pin_utc(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def trigger(seconds: int | None) -> dict:
    """Every so many seconds, or all that is there and then stop."""
    return {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}


def with_event_time(stream: DataFrame, ts_ms: str, delay: str) -> DataFrame:
    """Adds ``event_time`` with a watermark from a milliseconds column."""
    return stream.withColumn("event_time", F.timestamp_millis(ts_ms)).withWatermark("event_time", delay)


def start_table(
    stream: DataFrame, path: str, checkpoint: str, seconds: int | None = None
) -> StreamingQuery:
    """Append finished rows to a Parquet table."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger(seconds)).start()
    )


def start_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None
) -> StreamingQuery:
    """Hand each batch to ``write(batch, batch_id)``; it must replace what an earlier
    attempt of the same batch wrote."""
    return (
        stream.writeStream.foreachBatch(each_batch(write)).option("checkpointLocation", checkpoint)
        .trigger(**trigger(seconds)).start()
    )


def drain(query: StreamingQuery) -> None:
    """Wait for an availableNow query and raise what it raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


# Later than any event: 2200-01-01, which a nanosecond timestamp can still hold.
END_MS = 7_258_118_400_000


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """The stream beside a second source, in which ``write_end`` marks the end of input.

    Put it in before the watermark. Until the mark is written nothing changes.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def write_end(spark: SparkSession, schema, folder: str, ts_ms: str, **values) -> None:
    """One row later than all others. It moves the watermark past every window, epoch and
    slice, so a last run emits what was still open; its own never closes, so it is not
    emitted itself. Input that comes after it is late: write it once, at the very end."""
    row = {f.name: None for f in schema.fields} | values | {ts_ms: END_MS}
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], fields).coalesce(1).write.mode("append").parquet(folder)


def run_to_table(
    stream: DataFrame, name: str, build: Callable[[DataFrame], DataFrame] | None = None, ts_ms: str = "time_stamp",
    delay: str | None = None, **values,
) -> DataFrame:
    """Process all available input and return the table it produced.

    With ``delay``, ``build`` makes the result from the watermarked stream, and a second run
    after the end mark (with ``values`` in columns that must not be null) emits the rest.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    end = f"{path}/end"
    out = stream if delay is None else build(with_event_time(with_end(stream, end), ts_ms, delay))
    drain(start_table(out, f"{path}/table", f"{path}/checkpoint"))
    if delay is not None:
        write_end(spark, stream.schema, end, ts_ms, **values)
        drain(start_table(out, f"{path}/table", f"{path}/checkpoint"))
    return spark.read.schema(out.schema).parquet(f"{path}/table")
