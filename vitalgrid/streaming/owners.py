"""A memory per owner, kept for many owners under one state key.

Calling a keyed processor costs milliseconds a key, far more than the work on a day of one user. Owners are
therefore dealt to shards: a processor is called once per shard and batch, and reads and writes one map
entry for each owner that has rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalgrid.streaming.windows import closed_slices

SHARDS = 4096
SENT_ROWS = 10_000  # rows of one frame


class OwnerProcessor(StatefulProcessor):
    """``step`` turns an owner's memory and its closed slices into rows and the next memory, both JSON values."""

    columns: list[str]
    until: pd.Timestamp | None = None  # the end of the last slice that ``step`` is given

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getMapState("memory", "owner STRING", "kept STRING")

    def step(self, owner: str | None, kept, first, rows: Iterator[dict], mark: int) -> tuple[object, list[tuple]]:
        """``kept``: the memory or None; ``first``: the owner's first slice; ``rows``: of all its slices, in order."""
        raise NotImplementedError

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns)

    def wake(self) -> None:
        """Called after the owners of a batch."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        owners: dict[str | None, list] = {}
        for pdf in rows:
            for slice_ in pdf.itertuples(index=False):
                owners.setdefault(slice_.owner, []).append(slice_)
        out = []
        for owner, slices in owners.items():
            slices.sort(key=lambda s: s.slice)
            at = (json.dumps(owner),)
            held, self.until = self.memory.getValue(at), getattr(slices[-1], "event_time", None)
            kept, new = self.step(
                owner, json.loads(held[0]) if held else None, slices[0], (r for s in slices for r in json.loads(s.rows)), mark)
            text = json.dumps(kept)
            if held is None or text != held[0]:
                self.memory.updateValue(at, (text,))
            out += new
            if len(out) >= SENT_ROWS:
                yield self.frame(out)
                out = []
        self.wake()
        if out:
            yield self.frame(out)

    def close(self) -> None:
        pass


def by_owner(
    stream: DataFrame, owner: str, keys: list[str], order: list[str], carried: list[str], slice_ms: int,
    processor: OwnerProcessor, output: str, **options: str,
) -> DataFrame:
    """Closed slices of ``stream`` through ``processor``; ``keys`` are further columns that an owner fixes."""
    slices = closed_slices(stream.withColumnRenamed(owner, "owner"), ["owner", *keys], order, carried, slice_ms)
    dealt = slices.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(SHARDS)).cast("int"))
    return dealt.groupBy("shard").transformWithStateInPandas(processor, output, "Append", "EventTime", **options)
