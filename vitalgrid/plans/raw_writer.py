"""Messages to keyed tables and metric posts, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vitalgrid.config import HOUR_MS, MetricSettings
from vitalgrid.operators import metrics, parse
from vitalgrid.sources import sinks
from vitalgrid.streaming import runner


def write_batch(
    messages: DataFrame, batch_id: int, path: str, disabled: list[str] | None = None,
    settings: MetricSettings | None = None, piece_ms: int = HOUR_MS, shards: int = 16,
) -> None:
    """Records, posts and rejects of one batch, each into the batch's own folder, so
    that a batch that is run again replaces what it wrote."""
    settings = settings or MetricSettings()
    parsed = parse.parse_messages(messages).persist()  # three tables are written from one parse
    try:
        _write(parsed, batch_id, path, disabled, settings, piece_ms, shards)
    finally:
        parsed.unpersist()


def _write(parsed: DataFrame, batch_id: int, path: str, disabled, settings: MetricSettings, piece_ms: int, shards: int) -> None:
    good = parse.accepted(parsed, disabled)
    sinks.append_keyed(parse.wide_records(good), f"{path}/records", batch_id, ["sensor"])
    points = metrics.metric_points(good, settings.table_prefix)
    numbered = metrics.number_posts(
        points, ["name"], ["timestamp", "value"], settings.post_size, piece_ms, points["tags"]["event_id"], shards
    )
    bodies = metrics.posts(numbered, ["name"])
    bodies.write.mode("overwrite").parquet(f"{path}/posts/batch_id={batch_id}")
    parse.rejected(parsed).write.mode("overwrite").parquet(f"{path}/rejects/batch_id={batch_id}")


def start(messages: DataFrame, path: str, checkpoint: str, seconds: int | None = 10, **options) -> StreamingQuery:
    return runner.start_batches(
        messages, lambda batch, batch_id: write_batch(batch, batch_id, path, **options), checkpoint, seconds
    )
