"""Control messages that act on a stream: start, stop and status requests among the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitalgrid.streaming.owners import OwnerProcessor, by_owner

# Commands of control messages.
START, STOP, STATUS = "start_processor", "stop_processor", "get_processor_status"
STARTED, STOPPED = "STARTED", "STOPPED"
OUTPUT = "owner STRING, time_stamp BIGINT, event_id BIGINT, kind STRING, state STRING, payload STRING"


class Gate(OwnerProcessor):
    """Data passes while its owner is started; a status request is answered with the state of its time.

    Rows come in closed slices of time, so that a command acts on what is later than it and on nothing
    else, in whatever batch either of them came. Between slices an owner is one word.
    """

    columns = ["owner", "time_stamp", "event_id", "kind", "state", "payload"]

    def __init__(self, initial: str):
        self.initial = initial

    def step(self, owner, kept, first, rows, mark) -> tuple[str, list[tuple]]:
        state, out = kept or self.initial, []
        for row in rows:
            t, e, command = row["time_stamp"], row["event_id"], row.get("command")
            if command == START:
                state = STARTED
            elif command == STOP:
                state = STOPPED
            elif command == STATUS:
                out.append((owner, t, e, "status", state, None))
            elif command is None and state == STARTED:
                out.append((owner, t, e, "data", state, row.get("payload")))
        return state, out


def gated(stream: DataFrame, owner: str, slice_ms: int, initial: str = STARTED) -> DataFrame:
    """``stream``: ``owner``, time_stamp, event_id, value (JSON text) and a watermarked event_time.

    A message with a ``control_msg`` is a command for its owner, any other is data. Commands that are
    not known are dropped. Of one time the smaller event_id comes first.
    """
    rows = stream.select(
        F.col(owner).alias("owner"), "time_stamp", "event_id", F.get_json_object("value", "$.control_msg").alias("command"),
        F.col("value").alias("payload"), "event_time")
    return by_owner(rows, "owner", [], ["time_stamp", "event_id"], ["command", "payload"], slice_ms, Gate(initial), OUTPUT)
