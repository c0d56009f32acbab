"""A stream fed in several batches, out of order within the delay, equals the batch."""

import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import align, features, novelty
from vitalgrid.session import scratch_path
from vitalgrid.streaming import alignment, control, posts, runner, windows
from vitalgrid.streaming import novelty as novelty_stream

SENSORS = ["acc", "gyr"]


def feed(spark, rows, schema, delay_ms, parts, build):
    """Write ``rows`` in time order with jitter, one batch after the other."""
    rng = random.Random(5)
    jittered = sorted(rows, key=lambda r: r[1] + rng.randrange(0, delay_ms))
    path = scratch_path(spark, "feed")
    step = -(-len(jittered) // parts)
    for i in range(0, len(jittered), step):
        spark.createDataFrame(jittered[i:i + step], schema).write.mode("append").parquet(f"{path}/in")
        stream = runner.with_event_time(
            runner.prepare(spark).readStream.schema(schema).parquet(f"{path}/in"), "time_stamp", f"{delay_ms} milliseconds"
        )
        out = build(stream)
        runner.drain(runner.start_table(out, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema(out.schema).parquet(f"{path}/out"), max(r[1] for r in rows) - delay_ms


def bag(df, *cols):
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


@pytest.mark.parametrize("parts", [1, 3])
def test_alignment(spark, parts):
    rng = random.Random(1)
    rows = [(u, t, s, f"{s}{t}") for u in ("a", "b") for s in SENSORS for t in rng.sample(range(100_000), 80)]
    schema = "userid string, time_stamp long, sensor string, eventId string"
    got, mark = feed(spark, rows, schema, 5_000, parts, lambda s: alignment.align_stream(s, SENSORS, "gyr", 1_500, 20_000))
    batch = spark.createDataFrame(rows, schema).withColumn("epoch", F.floor(F.col("time_stamp") / 20_000).cast("long"))
    want = align.align(batch, ["userid", "epoch"], SENSORS, "gyr", 1_500, piece_ms=None).where((F.col("epoch") + 1) * 20_000 <= mark)
    cols = ["userid", "epoch", "anchor", "sensor", "time_stamp", "eventId"]
    assert bag(got, *cols) == bag(want, *cols) and got.count() > 50


@pytest.mark.parametrize("parts", [1, 3])
def test_novelty(spark, parts):
    rng = random.Random(2)
    rows = [(u, t, i, rng.random() < 0.5) for u in ("a", "b") for i, t in enumerate(rng.sample(range(50_000), 120))]
    schema = "user_id string, time_stamp long, event_id long, novel boolean"
    got, mark = feed(spark, rows, schema, 4_000, parts, lambda s: novelty_stream.trailing_rate_stream(s, 6, 0.6, 3_000))
    want = novelty.trailing_rate(spark.createDataFrame(rows, schema), ["user_id"], ["time_stamp", "event_id"], 6, 0.6, 7_000)
    want = want.where((F.floor(F.col("time_stamp") / 3_000) + 1) * 3_000 <= mark)
    cols = ["user_id", "time_stamp", "event_id", "novel_rate", "alarm"]
    assert bag(got, *cols) == bag(want, *cols) and got.count() > 100


@pytest.mark.parametrize("parts", [1, 3])
def test_features(spark, parts):
    rng = random.Random(3)
    rows = [(u, t, float(t % 5), float(t % 3), 1.0) for u in ("a", "b") for t in rng.sample(range(40_000), 150)]
    schema = "userid string, time_stamp long, x double, y double, z double"
    got, mark = feed(spark, rows, schema, 3_000, parts, lambda s: windows.axis_features(s, ["userid"], 5_000))
    want = features.axis_features(spark.createDataFrame(rows, schema), ["userid"], "time_stamp", 5_000)
    want = want.where((F.col("window") + 1) * 5_000 <= mark)
    shown = lambda d: d.select("userid", "window", "n", *[F.round(c, 9).alias(c) for c in features.AXIS_FEATURES])
    cols = ["userid", "window", "n", *features.AXIS_FEATURES]
    assert bag(shown(got), *cols) == bag(shown(want), *cols) and got.count() > 10


def test_a_replayed_batch_replaces_itself(spark):
    from vitalgrid.sources import sinks

    path = scratch_path(spark, "replay")
    rows = spark.createDataFrame([("e1", 1, "s"), ("e2", 2, "s")], "event_id string, time_stamp long, sensor string")
    for batch_id in (0, 1, 1):
        sinks.append_keyed(rows.withColumn("v", F.lit(batch_id)), path, batch_id, ["sensor"])
    assert spark.read.parquet(path).count() == 4
    assert bag(sinks.read_keyed(spark, path), "event_id", "v") == bag(rows.withColumn("v", F.lit(1)), "event_id", "v")
    sinks.compact_keyed(spark, path, path + "-small", ["sensor"])
    assert spark.read.parquet(path + "-small").count() == 2


def test_an_end_mark_closes_what_is_open(spark):
    runner.prepare(spark)
    rows = [("a", t, float(t % 5), float(t % 3), 1.0) for t in range(0, 40_000, 700)]
    schema = "userid string, time_stamp long, x double, y double, z double"
    path = scratch_path(spark, "ended")
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    got = runner.run_to_table(stream, "ended", lambda s: windows.axis_features(s, ["userid"], 5_000), delay="10 seconds")
    want = features.axis_features(spark.createDataFrame(rows, schema), ["userid"], "time_stamp", 5_000)
    assert bag(got, "userid", "window", "n") == bag(want, "userid", "window", "n") and got.count() == 8


def test_epochs_are_whole_seconds():
    with pytest.raises(ValueError):
        alignment.align_stream(None, SENSORS, "gyr", 1_500, 1_500)


def test_the_default_id_is_told_apart_by_sensor(spark):
    from vitalgrid.sources import sinks

    path = scratch_path(spark, "default-ids")
    rows = [("none", 1, "gsr", 1), ("none", 1, "uv", 2), ("none", 1, "uv", 3)]
    sinks.append_keyed(spark.createDataFrame(rows, "event_id string, time_stamp long, sensor string, v int"), path, 0, ["sensor"])
    first = bag(sinks.read_keyed(spark, path), "sensor", "v")
    assert len(first) == 2 and first == bag(sinks.read_keyed(spark, path), "sensor", "v")


def test_trigger():
    assert runner.trigger(10) == {"processingTime": "10 seconds"} and runner.trigger(None) == {"availableNow": True}


@pytest.mark.parametrize("parts", [1, 3])
def test_live_alignment(spark, parts):
    rng = random.Random(6)
    rows = [(u, t, s, f"{s}{t}") for u in ("a", "b") for s in SENSORS for t in rng.sample(range(60_000), 60 if s == "gyr" else 45)]
    rows += [("a", t, "acc", f"acc{t}x") for _, t, s, _ in rows[:5]]  # a second id at one time
    schema = "userid string, time_stamp long, sensor string, eventId string"
    batch = spark.createDataFrame(rows, schema)
    clock = align.group_clock(batch.select("userid", "sensor", "time_stamp").distinct(), ["userid"], "sensor", "time_stamp", "gyr", SENSORS).cache()
    got, mark = feed(spark, rows, schema, 5_000, parts, lambda s: alignment.align_live(s, clock, SENSORS, 1_500, 4_000))
    want = align.align(batch, ["userid"], SENSORS, "gyr", 1_500, piece_ms=7_000)
    cols = ["userid", "anchor", "sensor", "time_stamp", "eventId"]
    got, want = bag(got, *cols), bag(want, *cols)
    # what lies before the last closed bucket has left
    done = mark // 4_000 * 4_000 - 8_000
    assert set(got) <= set(want) and len(got) == len(set(got))
    assert {w for w in want if int(w.split(", ")[3]) < done and int(w.split(", ")[1]) < done} <= set(got) and len(got) > 60


def test_walk_stays_small():
    walk, sizes, n = alignment.Walk(None, "gyr", 0), [], 0
    for i in range(200_000):
        t = 7 * i
        n += len(walk.take(t, {"gyr": [t, f"g{i}", None]} if i % 3 == 0 else {"acc": [t, f"a{i}", None]}, SENSORS, 50))
        if i % 20_000 == 0:
            sizes.append(len(walk.kept()))
    assert n > 10_000 and max(sizes) < 1_000
    for i in range(1_000):  # a sensor falls silent
        t = 2_000_000 + 60 * i
        walk.take(t, {"gyr": [t, "g", None]}, SENSORS, 50)
    assert len(walk.open["acc"]) > 900
    walk.give_up(2_000_000 + 60 * 990)
    assert len(walk.open["acc"]) < 12


def points_want(rows, n, threshold, idle=None):
    out = []
    for u in sorted({r[0] for r in rows}):
        memory, latest = [], None
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
            if idle and latest is not None and r[1] - latest >= idle:
                memory = []
            memory, latest = [*memory, r][-n:], r[1]
            rate = sum(m[3] for m in memory) / n
            if len(memory) == n and rate > threshold:
                out += [str((u, r[1], r[2], m[1], m[2])) for m in memory if m[3]]
    return sorted(out)


@pytest.mark.parametrize("idle", [None, 6_000])
def test_novelty_points(spark, idle):
    rng = random.Random(8)
    times = [t for t in range(0, 60_000, 200) if not 20_000 < t < 30_000]
    rows = [(u, rng.choice(times), i, rng.random() < 0.6) for u in ("a", "b") for i in range(160)]
    schema = "user_id string, time_stamp long, event_id long, novel boolean"
    found = "CASE WHEN novel THEN array(named_struct('in_events', array('a', 'b', 'c', 'd'), 'out_event', 'o', 'result_percentage', 0.1D)) ELSE array() END"

    def build(s):
        with_found = s.withColumn("violations", F.expr(found))
        return novelty_stream.novelty_points_stream(with_found, 5, 0.6, 3_000, idle)

    got, mark = feed(spark, rows, schema, 4_000, 3, build)
    closed = mark // 3_000 * 3_000
    seen = sorted(str((r["user_id"], r["time_stamp"], r["event_id"], r["point_time_stamp"], r["point_event_id"])) for r in got.collect())
    want = [w for w in points_want(rows, 5, 0.6, idle) if int(w.split(", ")[1]) < closed]
    assert seen == want and len(want) > 100
    assert got.select("slot").distinct().count() == 1 and got.first()["in_events"] == ["a", "b", "c", "d"]
    assert novelty_stream.point_rows(got).count() == sum(eval(w)[1:3] == eval(w)[3:5] for w in want)


def test_commands_act_on_later_data(spark):
    rng = random.Random(12)
    kinds = [None] * 6 + [control.START, control.STOP, control.STATUS, "unknown"]
    rows = [(u, t, i, rng.choice(kinds)) for u in ("a", "b") for i, t in enumerate(rng.sample(range(40_000), 120))]
    sent = [(u, t, i, "{}" if c is None else '{"control_msg": "%s"}' % c) for u, t, i, c in rows]
    got, mark = feed(spark, sent, "userid string, time_stamp long, event_id long, value string", 4_000, 3, lambda s: control.gated(s, "userid", 2_000))
    want, closed = [], mark // 2_000 * 2_000
    for u in ("a", "b"):
        state = control.STARTED
        for _, t, i, c in sorted((r for r in rows if r[0] == u), key=lambda r: r[1:3]):
            state = {control.START: control.STARTED, control.STOP: control.STOPPED}.get(c, state)
            if t < closed and (c == control.STATUS or (c is None and state == control.STARTED)):
                want.append(str((u, t, i, "data" if c is None else "status", state)))
    assert bag(got, "owner", "time_stamp", "event_id", "kind", "state") == sorted(want) and len(want) > 80


def test_posts_fill_over_batches(spark):
    rng = random.Random(13)
    rows = [(f"m{rng.randrange(2)}", t, float(i), {"event_id": str(i)}) for i, t in enumerate(rng.sample(range(50_000), 300))]
    rows += [("quiet", 100, 1.0, None)]
    schema = "name string, time_stamp long, value double, tags map<string,string>"
    got, _ = feed(spark, rows, schema, 4_000, 4, lambda s: posts.post_stream(s.withColumn("timestamp", F.col("time_stamp")), 20, 6_000, 1, "tags['event_id']"))
    sent = {(r["name"], r["post_id"]): r["n_points"] for r in got.collect()}
    for m in ("m0", "m1"):
        own = [n for (name, _), n in sorted(sent.items()) if name == m]
        assert own == [20] * (sum(r[0] == m for r in rows) // 20)  # the remainder still waits
    assert sent["quiet", 0] == 1  # and a metric that fell silent has been flushed


class _Marked:
    def getCurrentWatermarkInMs(self):
        return 100


class _Memory(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value


def test_the_owners_of_a_shard_are_one_call():
    import json

    import pandas as pd

    gate = control.Gate(control.STARTED)
    gate.memory = _Memory()
    slices = [(owner, at, json.dumps([{"time_stamp": 10 * at, "event_id": i, "payload": "p"}, {"time_stamp": 10 * at + 1, "event_id": i, "command": c}]))
              for i, owner in enumerate(["a", "b", None]) for at, c in ((1, control.START), (0, control.STOP if i else control.STATUS))]
    frames = list(gate.handleInputRows((0,), iter([pd.DataFrame(slices, columns=["owner", "slice", "rows"])]), _Marked()))
    assert len(frames) == 1  # not one for each owner
    got = [(None if pd.isna(r.owner) else r.owner, r.time_stamp, r.kind) for r in frames[0].itertuples()]
    assert got == [("a", 0, "data"), ("a", 1, "status"), ("a", 10, "data"), ("b", 0, "data"), (None, 0, "data")]
    assert len(gate.memory) == 3 and set(gate.memory.values()) == {('"STARTED"',)}


def test_many_epochs_at_once_are_as_each_alone():
    import pandas as pd

    rng = random.Random(21)
    rows = {(u, e, s, e * 20_000 + rng.randrange(20_000)) for u in ("a", "b", None) for e in (-1, 0, 7) for s in SENSORS for _ in range(rng.randrange(1, 30))}
    rows |= {("lone", 0, "acc", 5)}
    events = pd.DataFrame([(*r, f"e{i}", None) for i, r in enumerate(sorted(rows, key=str))], columns=["userid", "epoch", "sensor", "time_stamp", "eventId", "payload"])
    whole = alignment.align_epochs(events, SENSORS, "gyr", 1_500)
    alone = [alignment.align_epochs(g, SENSORS, "gyr", 1_500) for _, g in events.groupby(["userid", "epoch"], dropna=False)]
    shown = lambda frames: sorted(str(tuple(r)) for f in frames for r in f.itertuples(index=False))
    assert shown([whole]) == shown(alone) and len(whole) > 50 and "lone" not in set(whole["userid"])
