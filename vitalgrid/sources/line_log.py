"""A stream source over append-only logs of lines, with offsets and consumer groups.

A topic is a folder ``<path>/<topic>`` of log files that writers append lines to or add
files to. An offset is the byte position in a file up to which lines are read, so a batch
is a byte range per file: the same range gives the same lines when a task is run again,
and nothing is read twice to find where a batch begins. A line counts once its newline is
written. Ranges are cut into pieces that tasks read in parallel.

A consumer group's position is kept in ``<path>/_groups/<group>``: what is committed, where
a new query of the group begins, and what is planned, which the rate limit counts from. A
query that is started again with its checkpoint goes on from the checkpoint. One query of
a group runs at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "topic string, log string, offset bigint, value string"
ARROW = pa.schema([("topic", pa.string()), ("log", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
PIECE_BYTES = 16 << 20
LOOK_BACK = 64 << 10


class LineLog(DataSource):
    """Options: ``path``, ``topics`` (comma-separated), ``group``, ``maxBytesPerTrigger``
    (needs a group), ``pieceBytes``."""

    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineLogReader:
        return LineLogReader(self.options)


@dataclass
class Piece(InputPartition):
    """Lines of a log that begin in ``[start, end)``."""

    log: str
    start: int
    end: int


class LineLogReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"].rstrip("/")
        self.topics = [t.strip() for t in options["topics"].split(",") if t.strip()]
        self.group = options.get("group")
        limit = options.get("maxBytesPerTrigger")
        self.limit = int(limit) if limit else None
        self.piece = int(options.get("pieceBytes", PIECE_BYTES))
        if self.limit and not self.group:
            raise ValueError("maxBytesPerTrigger needs a group, whose position it counts from")

    # --- driver -------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return self._position("committed")

    def latestOffset(self) -> dict:
        files, root = self._files()
        ends = self._position("planned") if self.group else {}
        todo = {log: files.size(f"{root}/{log}") for log in self._logs(files, root)}
        grown = {log: size - ends.get(log, 0) for log, size in todo.items() if size > ends.get(log, 0)}
        total = sum(grown.values())
        for log, new in grown.items():
            at = ends.get(log, 0)
            share = new if not self.limit or total <= self.limit else max(1, new * self.limit // total)
            ends[log] = files.line_end(f"{root}/{log}", at, at + share, at + new)
        if self.group:
            self._keep("planned", ends)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [
            Piece(log, at, min(at + self.piece, stop))
            for log, stop in sorted(end.items())
            for at in range(start.get(log, 0), stop, self.piece)
        ]

    def commit(self, end: dict) -> None:
        if self.group:
            self._keep("committed", end)

    def _files(self) -> tuple[_Files, str]:
        filesystem, root = fs.FileSystem.from_uri(self.path)
        return _Files(filesystem), root

    def _logs(self, files: _Files, root: str) -> list[str]:
        return [f"{t}/{name}" for t in self.topics for name in files.names(f"{root}/{t}")]

    def _position(self, kind: str) -> dict:
        if not self.group:
            return {}
        files, root = self._files()
        return files.read_json(f"{root}/_groups/{self.group}/{kind}.json")

    def _keep(self, kind: str, position: dict) -> None:
        files, root = self._files()
        files.replace_json(f"{root}/_groups/{self.group}", kind, position)

    # --- executors ----------------------------------------------------------------

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(self.path)
        with filesystem.open_input_file(f"{root}/{partition.log}") as f:
            at = max(0, partition.start - 1)
            f.seek(at)
            data = f.read(partition.end - at)
            # the last line may run on; its newline is within the batch, as that ends with a line
            while data and not data.endswith(b"\n"):
                more = f.read(LOOK_BACK)
                if not more:
                    break
                cut = more.find(b"\n") + 1
                data += more[:cut] if cut else more
        if partition.start:  # a line that began before belongs to the piece before
            cut = data.find(b"\n") + 1
            at, data = at + cut, data[cut:] if cut else b""
        offsets, values = [], []
        for line in _lines(data):
            if at >= partition.end:
                break
            offsets.append(at)
            values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            at += len(line)
        topic = partition.log.split("/", 1)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([topic] * len(values), pa.string()), pa.array([partition.log] * len(values), pa.string()),
             pa.array(offsets, pa.int64()), pa.array(values, pa.string())], schema=ARROW,
        )


def _lines(data: bytes) -> list[bytes]:
    """Lines end with a newline only; a carriage return alone ends none."""
    parts = data.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class _Files:
    """What the reader needs of a file system, whichever it is."""

    def __init__(self, filesystem: fs.FileSystem) -> None:
        self.fs = filesystem

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._")

    def size(self, path: str) -> int:
        return self.fs.get_file_info(path).size

    def line_end(self, path: str, start: int, wished: int, size: int) -> int:
        """The last line end in ``(start, wished]``, else the first one after it, else ``start``."""
        with self.fs.open_input_file(path) as f:
            at = wished
            while at > start:
                block = max(start, at - LOOK_BACK)
                f.seek(block)
                cut = f.read(at - block).rfind(b"\n")
                if cut >= 0:
                    return block + cut + 1
                at = block
            at = wished
            while at < size:
                f.seek(at)
                cut = f.read(min(LOOK_BACK, size - at)).find(b"\n")
                if cut >= 0:
                    return at + cut + 1
                at += LOOK_BACK
        return start

    def read_json(self, path: str) -> dict:
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return {}
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def replace_json(self, folder: str, name: str, value: dict) -> None:
        """Written beside and moved over, so that a reader sees the old or the new one."""
        self.fs.create_dir(folder, recursive=True)
        fresh = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(fresh) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(fresh, f"{folder}/{name}.json")
