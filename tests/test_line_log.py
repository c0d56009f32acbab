"""The log source: offsets, restarts, groups, rate limit, pieces, and a processing-time trigger."""

import os
import time

import pytest

from vitalgrid.session import scratch_path
from vitalgrid.sources import scans
from vitalgrid.sources.line_log import LineLogReader
from vitalgrid.streaming import runner


def append(path, topic, log, lines, end="\n"):
    os.makedirs(f"{path}/{topic}", exist_ok=True)
    with open(f"{path}/{topic}/{log}", "ab") as f:
        f.write(("\n".join(lines) + end).encode())


def run(spark, path, name, **options):
    stream = scans.read_log(spark, path, ["a", "b"], **options)
    runner.drain(runner.start_table(stream, f"{path}/_out_{name}", f"{path}/_checkpoint_{name}"))
    return sorted(r["value"] for r in spark.read.parquet(f"{path}/_out_{name}").collect())


def test_restart_goes_on_from_the_offsets(spark):
    path = scratch_path(spark, "log")
    append(path, "a", "0", ["one", "two"])
    append(path, "b", "0", ["three", "unfin"], end="")
    assert run(spark, path, "q") == ["one", "three", "two"]
    append(path, "b", "0", ["ished"])
    append(path, "a", "1", ["new log", ""])
    append(path, "c", "0", ["other topic"])
    assert run(spark, path, "q") == ["", "new log", "one", "three", "two", "unfinished"]
    assert run(spark, path, "q") == ["", "new log", "one", "three", "two", "unfinished"]


def test_a_group_goes_on_in_a_new_query(spark):
    path = scratch_path(spark, "log")
    append(path, "a", "0", ["1", "2"])
    first = run(spark, path, "q1", group="g")
    append(path, "a", "0", ["3"])
    assert first == ["1", "2"]
    assert run(spark, path, "q1", group="g") == ["1", "2", "3"]  # the batch before is committed now
    second = run(spark, path, "q2", group="g")
    assert set(second) <= {"1", "2", "3"} and "3" in second and "1" not in second
    assert run(spark, path, "q3", group="another") == ["1", "2", "3"]


def test_rate_limit_with_a_processing_time_trigger(spark):
    path = scratch_path(spark, "log")
    lines = [f"{i:04d}" for i in range(400)]
    append(path, "a", "0", lines[:200])
    append(path, "b", "0", lines[200:])
    stream = scans.read_log(spark, path, ["a", "b"], group="g", max_bytes=700)
    query = runner.start_table(stream, f"{path}/_out", f"{path}/_checkpoint", seconds=1)
    try:
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] > 0 for p in query.recentProgress) < 3:
            time.sleep(0.5)
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"] > 0]
        assert len(sizes) >= 3 and max(sizes) <= 140
    finally:
        query.stop()
    # started again without a limit, it reads the rest, every line once
    rest = scans.read_log(spark, path, ["a", "b"], group="g")
    runner.drain(runner.start_table(rest, f"{path}/_out", f"{path}/_checkpoint"))
    assert sorted(r["value"] for r in spark.read.parquet(f"{path}/_out").collect()) == lines


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_hold_every_line_once(tmp_path, piece):
    lines = ["", "a", "bb", "ééé", "x" * 50, "", "c\rd", "e\r"]
    append(tmp_path, "a", "0", lines)
    reader = LineLogReader({"path": str(tmp_path), "topics": "a", "pieceBytes": str(piece)})
    end = reader.latestOffset()
    assert end == {"a/0": os.path.getsize(tmp_path / "a" / "0")}
    rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"] for r in rows] == [line.rstrip("\r") for line in lines]
    assert [r["offset"] for r in rows] == sorted({r["offset"] for r in rows})


def test_limit_needs_a_group():
    with pytest.raises(ValueError):
        LineLogReader({"path": "/tmp", "topics": "a", "maxBytesPerTrigger": "10"})
