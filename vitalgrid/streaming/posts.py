"""Metric posts over a stream: what does not fill a post waits for the next batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalgrid.operators.balance import split_bucket

OUTPUT = "name STRING, shard INT, post_id BIGINT, n_points INT, body STRING"


class PostBuffer(StatefulProcessor):
    """Fewer than ``size`` points of a metric's shard wait in the state; a post leaves when it is full, or
    with what there is when the watermark is ``wait_ms`` past the latest point."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "point STRING")
        self.count = handle.getValueState("count", "next_post BIGINT, latest BIGINT")

    def _post(self, key, number: int, points: list[str]) -> tuple:
        return (key[0], int(key[1]), number, len(points), "[" + ",".join(points) + "]")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, latest = self.count.get() if self.count.exists() else (0, 0)
        held = [p for (p,) in self.points.get()]
        for pdf in rows:
            pdf = pdf.sort_values(["timestamp", "point"])
            latest = max(latest, int(pdf["timestamp"].iloc[-1]))
            held += pdf["point"].tolist()
            full = len(held) // self.size
            if full:
                yield pd.DataFrame([self._post(key, number + i, held[i * self.size : (i + 1) * self.size]) for i in range(full)],
                                   columns=["name", "shard", "post_id", "n_points", "body"]).astype({"shard": "int32", "n_points": "int32"})
                number, held = number + full, held[full * self.size :]
        if held:
            self.points.put([(p,) for p in held])
            self.handle.registerTimer(latest + self.wait_ms)
        else:
            self.points.clear()
        self.count.update((number, latest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, latest = self.count.get()
        held = [p for (p,) in self.points.get()]
        # a later point has set a later timer
        if held and timerValues.getCurrentWatermarkInMs() >= latest + self.wait_ms:
            self.points.clear()
            self.count.update((number + 1, latest))
            yield pd.DataFrame([self._post(key, number, held)], columns=["name", "shard", "post_id", "n_points", "body"]).astype(
                {"shard": "int32", "n_points": "int32"})

    def close(self) -> None:
        pass


def post_stream(points: DataFrame, size: int, wait_ms: int, shards: int, spread: str) -> DataFrame:
    """``points``: name, timestamp, value, tags and a watermarked event_time.

    Posts of exactly ``size`` points per metric and shard, whatever the batches were, but for the last
    one of a metric that fell silent. ``spread`` is an expression that deals a metric's points to shards.
    """
    body = F.to_json(F.struct("name", "timestamp", "value", "tags")).alias("point")
    rows = points.select("name", split_bucket([F.expr(spread)], shards).alias("shard"), "timestamp", body, "event_time")
    return rows.groupBy("name", "shard").transformWithStateInPandas(PostBuffer(size, wait_ms), OUTPUT, "Append", "EventTime")
