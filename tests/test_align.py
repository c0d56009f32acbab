import random

import pandas as pd
import pytest

from vitalgrid.operators import align
from vitalgrid.streaming.alignment import align_epoch

SENSORS = ["acc", "bar", "gyr"]


def walk(buffers: dict[str, list[int]], reference: str, step: int) -> set:
    """The rule as written down: walk the grid, pick, evict."""
    if set(buffers) != set(SENSORS):
        return set()
    buffers = {s: sorted(v) for s, v in buffers.items()}
    slow = min(buffers, key=lambda s: (len(buffers[s]), s))
    times = list(buffers[slow])
    at, out, done = buffers[reference][0], set(), set()
    while True:
        at += step
        if at > times[-1]:
            return out
        earlier = [t for t in times if t < at]
        anchor = earlier[-1] if earlier else times[0]
        if anchor in done:
            continue
        done.add(anchor)
        for s in buffers:
            left = buffers[s]
            if not left or anchor > left[-1]:
                continue
            before = [t for t in left if t < anchor]
            after = min(t for t in left if t >= anchor)
            pick = after if not before or after - anchor < anchor - before[-1] else before[-1]
            out.add((anchor, s, pick))
            buffers[s] = [t for t in left if t > anchor]


def cases():
    rng = random.Random(11)
    out = {}
    for i in range(60):
        span = rng.choice([200, 1000, 4000])
        out[f"u{i}"] = {s: rng.sample(range(span), rng.randrange(1, 25)) for s in SENSORS if rng.random() > 0.05}
    out["hot"] = {s: rng.sample(range(6000), 300) for s in SENSORS}
    return out


@pytest.mark.parametrize("piece_ms", [None, 150, 900])
def test_matches_the_walk(spark, piece_ms):
    data = cases()
    rows = [(u, s, t, f"{s}{t}") for u, b in data.items() for s, ts in b.items() for t in ts]
    df = spark.createDataFrame(rows, "userid string, sensor string, time_stamp long, eventId string").repartition(6)
    got = {}
    for r in align.align(df, ["userid"], SENSORS, "gyr", 100, piece_ms=piece_ms).collect():
        got.setdefault(r["userid"], set()).add((r["anchor"], r["sensor"], r["time_stamp"]))
        assert r["eventId"] == f"{r['sensor']}{r['time_stamp']}"
    for u, buffers in data.items():
        assert got.get(u, set()) == walk(buffers, "gyr", 100), u


def test_state_helper_matches_the_walk():
    for u, buffers in cases().items():
        rows = [(s, t, f"{s}{t}", f"label {t}") for s, ts in buffers.items() for t in ts]
        out = align_epoch(pd.DataFrame(rows, columns=["sensor", "time_stamp", "eventId", "payload"]), SENSORS, "gyr", 100)
        assert all(p == f"label {t}" for p, t in zip(out["payload"], out["time_stamp"]))
        assert set(zip(out["anchor"], out["sensor"], out["time_stamp"])) == walk(buffers, "gyr", 100), u


def test_a_wild_time_costs_nothing(spark):
    """A time far away must not build a grid up to it."""
    rows = [("u", s, t, f"{s}{t}") for s in SENSORS for t in (0, 50, 120, 10**14)]
    df = spark.createDataFrame(rows, "userid string, sensor string, time_stamp long, eventId string")
    got = align.align(df, ["userid"], SENSORS, "gyr", 10, piece_ms=1000).select("anchor").distinct().collect()
    assert {r["anchor"] for r in got} == {0, 50, 120}


def test_repeated_time_keeps_the_last_event(spark):
    rows = [("u", "acc", 5, "a"), ("u", "acc", 5, "b"), ("v", "acc", 5, "c")]
    df = spark.createDataFrame(rows, "userid string, sensor string, time_stamp long, eventId string")
    got = align.last_per_time(df, ["userid"], "sensor", "time_stamp", "eventId").collect()
    assert {(r["userid"], r["eventId"]) for r in got} == {("u", "b"), ("v", "c")}


def test_require_all(spark):
    rows = [("u", "gyr", t, f"g{t}") for t in (0, 10, 25)]
    df = spark.createDataFrame(rows, "userid string, sensor string, time_stamp long, eventId string")
    assert align.align(df, ["userid"], SENSORS, "gyr", 10, piece_ms=None).count() == 0
    some = align.align(df, ["userid"], SENSORS, "gyr", 10, require_all=False, piece_ms=None)
    assert {r["anchor"] for r in some.collect()} == {0, 10}
