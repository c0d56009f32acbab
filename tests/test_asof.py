import bisect
import random

import pytest

from vitalgrid.operators.asof import asof_join

TIMES = [1200, 1300, 1500, 1700]
CASES = [
    (1260, {"nearest": 1300, "backward": 1200, "forward": 1300}),
    (1500, {"nearest": 1500, "backward": 1300, "forward": 1500}),  # exact hit: backward is strict
    (1400, {"nearest": 1300, "backward": 1300, "forward": 1500}),  # tie: the earlier one
    (1000, {"nearest": 1200, "backward": 1200, "forward": 1200}),  # before the first
    (1701, {"nearest": None, "backward": None, "forward": None}),  # past the end
]


@pytest.mark.parametrize("mode", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("piece_ms", [None, 100, 250, 10_000])
def test_edges(spark, mode, piece_ms):
    events = spark.createDataFrame([("a", t) for t in TIMES], "k string, e long")
    probes = spark.createDataFrame([("a", p) for p, _ in CASES] + [("b", 1)], "k string, t long")
    got = {
        (r["k"], r["t"]): r["e"]
        for r in asof_join(probes, events, ["k"], "t", "e", mode, piece_ms=piece_ms).collect()
    }
    assert got == {**{("a", p): want[mode] for p, want in CASES}, ("b", 1): None}


def brute(times, t, mode):
    if not times or t > times[-1]:
        return None
    i = bisect.bisect_left(times, t)
    if i == 0:
        return times[0]
    before, after = times[i - 1], times[i]
    if mode == "nearest":
        return after if after - t < t - before else before
    return before if mode == "backward" else after


@pytest.mark.parametrize("mode", ["backward", "forward", "nearest"])
def test_random_with_a_hot_key(spark, mode):
    rng = random.Random(7)
    times = {k: sorted(rng.sample(range(20_000), n)) for k, n in (("hot", 900), ("x", 30), ("y", 1))}
    probes = [(k, rng.randrange(-50, 20_100)) for k in ("hot", "hot", "x", "y", "none") for _ in range(80)]
    probes = sorted(set(probes))
    ev = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, e long").repartition(7)
    pr = spark.createDataFrame(probes, "k string, t long").repartition(5)
    got = {(r["k"], r["t"]): r["e"] for r in asof_join(pr, ev, ["k"], "t", "e", mode, piece_ms=500).collect()}
    assert got == {(k, t): brute(times.get(k, []), t, mode) for k, t in probes}


def test_payload_and_inner(spark):
    ev = spark.createDataFrame([("a", 10, "p"), ("a", 10, "q"), ("a", 20, "r")], "k string, e long, v string")
    pr = spark.createDataFrame([("a", 15, 1), ("a", 99, 2)], "k string, t long, id int")
    rows = asof_join(pr, ev, ["k"], "t", "e", "backward", ["v"], piece_ms=4, how="inner").collect()
    assert [(r["id"], r["e"], r["v"]) for r in rows] == [(1, 10, "q")]
