"""Merges of keyed tables: rows, tombstones, and a plan that leaves the history where it is."""

import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.session import scratch_path
from vitalgrid.sources import keyed

KEY, ORDER, BUCKETS = ["k"], ["t", "seq"], 4
SCHEMA = "k string, t long, seq long, v string"


def best(writes):
    out = {}
    for k, t, seq, v in writes:
        if k not in out or (t, seq) > out[k][:2]:
            out[k] = (t, seq, v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_the_last_write(spark, seed):
    rng = random.Random(seed)
    writes = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(20), i, f"v{i}") for i in range(60)]
    path = scratch_path(spark, "keyed")
    table = keyed.write(spark.createDataFrame([], SCHEMA), f"{path}/v0", KEY, BUCKETS)
    for i in range(0, 60, 20):
        table = keyed.merge(table, spark.createDataFrame(writes[i:i + 20], SCHEMA), f"{path}/v{i + 1}", KEY, ORDER, BUCKETS)
    got = {r["k"]: (r["t"], r["seq"], r["v"]) for r in keyed.current(table).collect()}
    assert table.count() == len(got) and got == best(writes)


def test_tombstones(spark):
    path = scratch_path(spark, "keyed")
    table = keyed.write(spark.createDataFrame([("a", 1, 0, "x"), ("b", 1, 0, "y")], SCHEMA), f"{path}/v1", KEY, BUCKETS)
    gone = keyed.tombstones(spark.createDataFrame([("a",), ("z",)], "k string"), table, KEY, {"t": F.lit(5), "seq": F.lit(0)})
    table = keyed.merge(table, gone, f"{path}/v2", KEY, ORDER, BUCKETS)
    assert [r["k"] for r in keyed.current(table).collect()] == ["b"]
    late = spark.createDataFrame([("a", 3, 9, "late"), ("z", 7, 0, "after")], SCHEMA)
    table = keyed.merge(table, late, f"{path}/v3", KEY, ORDER, BUCKETS)
    assert sorted((r["k"], r["v"]) for r in keyed.current(table).collect()) == [("b", "y"), ("z", "after")]
    assert table.count() == 3 and keyed.expire(table, F.col("t") < 6).count() == 2


def test_history_is_not_shuffled(spark):
    path = scratch_path(spark, "keyed")
    rows = spark.range(2_000).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("t"),
                                     F.lit(0).cast("long").alias("seq"), F.lit("x").alias("v"))
    keyed.write(rows, f"{path}/v1", KEY, BUCKETS)
    table = keyed.open_version(spark, f"{path}/v1", KEY, BUCKETS)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keyed.merged(table, rows.limit(10).withColumn("t", F.lit(2).cast("long")), KEY, ORDER)
        plan = out._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "FileScan" in line)
        join = plan[plan.index("SortMergeJoin"):plan.index("FileScan")]  # the history's side of the join
        assert "Bucketed: true" in scan and "Exchange" not in join, plan
        assert out.where("t = 2").count() == 10 and out.count() == 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
