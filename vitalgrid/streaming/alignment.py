"""Alignment of sensor streams with keyed state.

Events wait in Spark's aggregation state per user and epoch. An epoch is complete when the
watermark passes its end; then its events are aligned by the same rule as in the batch form,
many epochs at once. Epochs bound the state of a user, and spread a busy one over keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vitalgrid.streaming.owners import OwnerProcessor, by_owner
from vitalgrid.streaming.windows import closed_slices

OUTPUT = "userid STRING, epoch BIGINT, anchor BIGINT, sensor STRING, time_stamp BIGINT, eventId STRING, payload STRING"


def align_epochs(events: pd.DataFrame, sensors: list[str], reference: str, step_ms: int) -> pd.DataFrame:
    """Rows ``userid, epoch, anchor, sensor, time_stamp, eventId, payload`` of many whole epochs at once.

    ``events``: one per (userid, epoch, sensor, time_stamp). Every step runs over the events of all groups.
    """
    columns = ["userid", "epoch", "anchor", "sensor", "time_stamp", "eventId", "payload"]
    names = sorted(sensors)
    events = events.assign(_g=events.groupby(["userid", "epoch"], dropna=False, sort=False).ngroup(), _s=pd.Index(names).get_indexer(events["sensor"]))
    events = events.sort_values(["_g", "_s", "time_stamp"], kind="stable", ignore_index=True)
    group, sensor, t = (events[c].to_numpy(np.int64) for c in ("_g", "_s", "time_stamp"))
    n = np.bincount(group * len(names) + sensor, minlength=(group.max(initial=-1) + 1) * len(names)).reshape(-1, len(names))
    whole = (n > 0).all(1)
    if not whole.any():
        return pd.DataFrame(columns=columns)
    first = np.concatenate([[0], np.cumsum(n.ravel())])[:-1].reshape(n.shape)
    slow = n.argmin(1)  # of equal counts the smaller name
    t0 = np.where(whole, t[np.minimum(first[:, names.index(reference)], len(t) - 1)], 0)
    # Grid points up to each time; an event ends an anchor's interval when it has more.
    own = np.flatnonzero(whole[group] & (sensor == slow[group]))
    g, at = group[own], t[own]
    begins = np.diff(g, prepend=-1) != 0
    upto = np.maximum((at - t0[g]) // step_ms, 0)
    before = np.where(begins, 0, np.roll(upto, 1))
    previous = np.where(begins, at, np.roll(at, 1))
    hit = upto > before
    g, anchor = g[hit], previous[hit]
    fresh = (np.diff(g, prepend=-1) != 0) | (np.diff(anchor, prepend=0) != 0)
    g, anchor = g[fresh], anchor[fresh]
    floor = np.where(np.diff(g, prepend=-1) != 0, np.iinfo(np.int64).min, np.roll(anchor, 1))
    out = []
    # All times of a group lie within its span, so group, sensor and time are one number in order.
    low = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(low, group, t)
    span = int((t - low[group]).max()) + 2
    place = (group * len(names) + sensor) * span + t - low[group]
    for s in range(len(names)):
        f = np.searchsorted(place, (g * len(names) + s) * span + anchor - low[g], "left")
        start, end = first[g, s], first[g, s] + n[g, s]
        keep = f < end
        f, a, lo, start = f[keep], anchor[keep], floor[keep], start[keep]
        b = np.maximum(f - 1, start)
        use_before = (f > start) & (t[b] > lo) & ~((t[f] - a) < (a - t[b]))
        out.append(events.iloc[np.where(use_before, b, f)].assign(anchor=a))
    return pd.concat(out, ignore_index=True)[columns]


def align_epoch(events: pd.DataFrame, sensors: list[str], reference: str, step_ms: int) -> pd.DataFrame:
    """As ``align_epochs``, for one epoch whose events have no userid and epoch."""
    return align_epochs(events.assign(userid="", epoch=0), sensors, reference, step_ms).drop(columns=["userid", "epoch"])


def align_stream(
    stream: DataFrame, sensors: list[str], reference: str, step_ms: int, epoch_ms: int, payload: str | None = None
) -> DataFrame:
    """``stream``: userid, sensor, time_stamp, eventId and a watermarked event_time.

    A text column named as ``payload``, such as a predicted label, is carried along with
    its event. Epochs are whole seconds, since events are reduced in windows of a second.
    """
    if epoch_ms % 1000:
        raise ValueError(f"an epoch must be whole seconds, got {epoch_ms} ms")
    # Events of one sensor at one time are reduced to the last one first, with a
    # map-side step: however often a busy user repeats itself, a state holds at most
    # one event per sensor and millisecond of the epoch.
    unique = (
        stream.where(F.col("sensor").isin(sensors))
        .groupBy(F.window("event_time", "1 second").alias("_second"), "userid", "sensor", "time_stamp")
        .agg(F.max(F.struct("eventId", (F.col(payload) if payload else F.lit(None).cast("string")).alias("payload"))).alias("_e"))
    )
    keyed = unique.select("userid", "sensor", "time_stamp", "_e.eventId", "_e.payload", F.window_time("_second").alias("event_time"))
    epochs = closed_slices(keyed, ["userid"], ["sensor", "time_stamp"], ["eventId", "payload"], epoch_ms)

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(u, e, r["sensor"], r["time_stamp"], r.get("eventId"), r.get("payload"))
                    for u, e, text in zip(pdf["userid"], pdf["slice"], pdf["rows"]) for r in json.loads(text)]
            if rows:
                events = pd.DataFrame(rows, columns=["userid", "epoch", "sensor", "time_stamp", "eventId", "payload"])
                yield align_epochs(events, sensors, reference, step_ms)

    out = epochs.select("userid", "slice", "rows").mapInPandas(aligned, OUTPUT)
    return out.withColumnRenamed("payload", payload) if payload else out.drop("payload")


LIVE_OUTPUT = "userid STRING, anchor BIGINT, sensor STRING, time_stamp BIGINT, eventId STRING, payload STRING"
WHOLE_OUTPUT = "userid STRING, anchor BIGINT, events STRING, event_time TIMESTAMP"


class Walk:
    """One user's alignment so far: what later events still depend on, and no more.

    ``last``: latest event of each sensor. ``prior`` and ``next``: of each sensor the last event before
    the newest event of the slow sensor, and the first at or after it. ``open``: anchors that wait for a
    sensor's next event. All events are (time, id, payload) lists, so that a walk is kept as JSON.
    """

    def __init__(self, kept: str | None, slow: str = "", t0: int = 0):
        self.__dict__ = json.loads(kept) if kept else {
            "slow": slow, "t0": t0, "last": {}, "prior": {}, "next": {}, "open": {}, "newest": None, "anchor": None}

    def kept(self) -> str:
        return json.dumps(self.__dict__)

    def _upto(self, t: int, step_ms: int) -> int:
        return max((t - self.t0) // step_ms, 0)

    def _choose(self, sensor: str, anchor: int, floor: int | None, before: list | None, after: list) -> tuple:
        fresh = before is not None and (floor is None or before[0] > floor)
        event = after if not fresh or after[0] - anchor < anchor - before[0] else before
        return (anchor, sensor, *event)

    def take(self, t: int, events: dict[str, list], sensors: list[str], step_ms: int) -> list[tuple]:
        """The events of all sensors at the next time; returns (anchor, sensor, time, id, payload) that are now decided."""
        out = []
        if self.slow in events:
            first = self.newest is None
            done = 0 if first else self._upto(self.newest, step_ms)
            anchor = t if first else self.newest
            if self._upto(t, step_ms) > done and anchor != self.anchor:
                before, after = (self.last, {}) if first else (self.prior, self.next)
                for s in sensors:
                    if s in after:
                        out.append(self._choose(s, anchor, self.anchor, before.get(s), after[s]))
                    else:
                        self.open.setdefault(s, []).append([anchor, self.anchor, before.get(s)])
                self.anchor = anchor
            self.newest, self.prior, self.next = t, dict(self.last), {}
        for s, event in events.items():
            for anchor, floor, before in self.open.pop(s, []):
                out.append(self._choose(s, anchor, floor, before, event))
            if self.newest is not None:
                self.next.setdefault(s, event)
            self.last[s] = event
        return out

    def give_up(self, before: int) -> None:
        """Anchors older than this stop waiting for silent sensors."""
        self.open = {s: kept for s, waiting in self.open.items() if (kept := [w for w in waiting if w[0] >= before])}


class LiveAligner(OwnerProcessor):
    """Alignment as the watermark moves.

    Events come in closed buckets of time, which are walked in order. What remains of a user is the walk:
    some events per sensor and the anchors that a silent sensor keeps open, which ``give_up_ms`` bounds.
    """

    def __init__(self, sensors: list[str], step_ms: int, give_up_ms: int | None, whole: bool):
        self.sensors, self.step_ms = sensors, step_ms
        self.give_up_ms, self.whole = give_up_ms, whole
        self.columns = ["userid", "anchor", "events", "event_time"] if whole else ["userid", "anchor", "sensor", "time_stamp", "eventId", "payload"]

    def step(self, owner, kept, first, rows, mark) -> tuple[list, list[tuple]]:
        walk, partial = (Walk(kept[0]), kept[1]) if kept else (Walk(None, first.slow, int(first.t0)), {})
        out = []
        for t, events in groupby(rows, key=lambda e: e["time_stamp"]):
            at = {e["sensor"]: [t, e.get("eventId"), e.get("payload")] for e in events}  # the largest id stays
            out += walk.take(t, at, self.sensors, self.step_ms)
        if self.give_up_ms is not None:
            walk.give_up(mark - self.give_up_ms)
            partial = {a: v for a, v in partial.items() if int(a) >= mark - self.give_up_ms}
        if not self.whole:
            return [walk.kept(), partial], [(owner, *chosen) for chosen in out]
        for anchor, sensor, *event in out:
            partial.setdefault(str(anchor), {})[sensor] = event
        ready = sorted(int(a) for a, v in partial.items() if len(v) == len(self.sensors))
        # not late, as the slice has just closed, and never behind the last mark, as the watermark itself would be
        done = [(owner, a, json.dumps(partial.pop(str(a))), self.until) for a in ready]
        return [walk.kept(), partial], done


def align_live(
    stream: DataFrame, clock: DataFrame, sensors: list[str], step_ms: int, bucket_ms: int, payload: str | None = None,
    give_up_ms: int | None = None, whole: bool = False,
) -> DataFrame:
    """``stream``: userid, sensor, time_stamp, eventId and a watermarked event_time; ``clock``: userid, slow, t0.

    The same rows as the batch ``align`` with that clock, whatever the batches were, and no epochs: an
    anchor's rows leave as soon as the watermark has passed what decides them. The clock (the slowest
    sensor of each user and the start of its grid) is a table, for example ``group_clock`` of earlier
    data; users without one are left out. Events at one time of one sensor count once, with the largest
    id. With ``whole`` one row per anchor that all sensors have answered: ``events``, a JSON object of
    [time, id, payload] by sensor, and an event time for a further stateful step.
    """
    seen = stream.where(F.col("sensor").isin(sensors)).join(clock.select("userid", "slow", "t0"), "userid")
    rows = seen.select(
        "userid", "slow", "t0", "sensor", "time_stamp", "eventId",
        (F.col(payload) if payload else F.lit(None).cast("string")).alias("payload"), "event_time")
    out = by_owner(
        rows, "userid", ["slow", "t0"], ["time_stamp", "sensor", "eventId"], ["payload"], bucket_ms,
        LiveAligner(sensors, step_ms, give_up_ms, whole), WHOLE_OUTPUT if whole else LIVE_OUTPUT,
        **({"eventTimeColumnName": "event_time"} if whole else {}))
    if whole:
        return out
    return out.withColumnRenamed("payload", payload) if payload else out.drop("payload")
