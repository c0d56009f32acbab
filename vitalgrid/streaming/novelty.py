"""Trailing novelty rate over a stream.

Rows wait until the watermark has passed the end of their time slice, then leave in
event-time order; the last flags of each user stay in the state. Aligned records
come at most once per alignment step and user, which bounds what a user can send.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vitalgrid.functions.scalars import stable_id
from vitalgrid.streaming.owners import OwnerProcessor, by_owner

OUTPUT = "user_id STRING, time_stamp BIGINT, event_id BIGINT, novel BOOLEAN, novel_rate DOUBLE, alarm BOOLEAN"


class TrailingRate(OwnerProcessor):
    columns = ["user_id", "time_stamp", "event_id", "novel", "novel_rate", "alarm"]

    def __init__(self, n: int, rate_threshold: float):
        self.n, self.rate_threshold = n, rate_threshold

    def step(self, owner, kept, first, rows, mark) -> tuple[list, list[tuple]]:
        memory, due = kept or [], list(rows)
        flags = np.array(memory + [bool(r.get("novel")) for r in due], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(flags)])
        at = np.arange(len(memory), len(flags)) + 1
        rate = (total[at] - total[np.maximum(at - self.n, 0)]) / float(self.n)
        rates = [float(v) if full else None for v, full in zip(rate, at >= self.n)]
        out = [(owner, r["time_stamp"], r["event_id"], bool(r.get("novel")), v, v is not None and v > self.rate_threshold)
               for r, v in zip(due, rates)]
        return flags[max(0, len(flags) - (self.n - 1)):].tolist(), out


def trailing_rate_stream(stream: DataFrame, n: int, rate_threshold: float, slice_ms: int) -> DataFrame:
    """``stream``: user_id, time_stamp, event_id, novel and a watermarked event_time."""
    return by_owner(
        stream, "user_id", [], ["time_stamp", "event_id"], ["novel"], slice_ms, TrailingRate(n, rate_threshold), OUTPUT)


POINTS = (
    "user_id STRING, time_stamp BIGINT, event_id BIGINT, novel_rate DOUBLE, novel BOOLEAN, point_time_stamp BIGINT, point_event_id BIGINT, "
    "slot INT, in_events ARRAY<STRING>, out_event STRING, result_percentage DOUBLE"
)


class NoveltyPoints(OwnerProcessor):
    """Alarms with the violations of their trailing rows.

    Rows come in closed slices of time; the last n - 1 rows with their violations stay as memory. A user
    without rows for ``idle_ms`` of event time is forgotten wholly, and its memory begins anew.
    """

    columns = ["user_id", "time_stamp", "event_id", "novel_rate", "novel", "point_time_stamp", "point_event_id", "slot",
               "in_events", "out_event", "result_percentage"]

    def __init__(self, n: int, rate_threshold: float, slice_ms: int, idle_ms: int | None):
        self.n, self.rate_threshold, self.slice_ms, self.idle_ms = n, rate_threshold, slice_ms, idle_ms
        self.timers: set[int] = set()

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return super().frame(out).astype({"slot": "int32"})

    def step(self, owner, kept, first, rows, mark) -> tuple[list, list[tuple]]:
        memory, latest = kept or ([], None)
        out = []
        for found in rows:
            row = [found["time_stamp"], found["event_id"], bool(found.get("novel")), found.get("violations")]
            if self.idle_ms is not None and latest is not None and row[0] - latest >= self.idle_ms:
                memory = []
            memory, latest = [*memory, row][-self.n:], row[0]
            rate = sum(r[2] for r in memory) / float(self.n)
            if len(memory) == self.n and rate > self.rate_threshold:
                out += [(owner, *record) for record in self._records(row, rate, memory)]
        if self.idle_ms is not None:
            self.timers.add(self._idle_at(latest))
        return [memory[-(self.n - 1):] if self.n > 1 else [], latest], out

    def wake(self) -> None:
        for at in self.timers:
            self.handle.registerTimer(at)
        self.timers = set()

    def _idle_at(self, latest: int) -> int:
        """The end of the slice in which a user becomes idle: earlier rows have all come by then."""
        return ((latest + self.idle_ms) // self.slice_ms + 1) * self.slice_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        # a user with later rows has a later timer
        for at in [at for at, (kept,) in self.memory.iterator() if self._idle_at(json.loads(kept)[1]) <= mark]:
            self.memory.removeKey(at)
        return iter(())

    @staticmethod
    def _records(row: list, rate: float, memory: list) -> list[tuple]:
        return [
            (row[0], row[1], rate, row[2], t, e, slot, v["in_events"], v["out_event"], v["result_percentage"])
            for t, e, _, found in memory for slot, v in enumerate(json.loads(found))
        ]


def novelty_points_stream(stream: DataFrame, n: int, rate_threshold: float, slice_ms: int, idle_ms: int | None = None) -> DataFrame:
    """For each alarmed row the violations of its last ``n`` rows, itself among them.

    ``stream``: user_id, time_stamp, event_id, novel, violations and a watermarked event_time. Rows of
    one time go by event_id. ``idle_ms`` None keeps a user's memory for ever, as the batch form does;
    otherwise a gap of that length starts the user anew. Ids of table rows come from ``point_rows``.
    """
    rows = stream.select("user_id", "time_stamp", "event_id", "novel", F.to_json("violations").alias("violations"), "event_time")
    return by_owner(
        rows, "user_id", [], ["time_stamp", "event_id"], ["novel", "violations"], slice_ms,
        NoveltyPoints(n, rate_threshold, slice_ms, idle_ms), POINTS)


def point_rows(points: DataFrame) -> DataFrame:
    """Table rows of the alarmed rows' own violations, with the ids of the batch form."""
    own = points.where("time_stamp = point_time_stamp AND event_id = point_event_id")
    point = stable_id(F.col("user_id"), F.col("time_stamp"), F.col("event_id"))
    flat = own.withColumn("novel_point_id", point)
    return flat.select(
        stable_id(F.col("novel_point_id"), F.col("slot")).alias("row_id"),
        *[F.col("in_events")[i].alias(f"in_event_{i + 1}") for i in range(4)], "out_event",
        F.col("novel_point_id").alias("novel_event_id"), "novel_point_id", F.col("novel").alias("novel_flag"), "novel_rate",
        "result_percentage", F.col("time_stamp").alias("novel_time_stamp"), "user_id")
