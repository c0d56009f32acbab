"""Lookups whose plan follows the size of the table and the heat of the keys."""

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def rows(spark):
    """A third of all rows belongs to one key."""
    return spark.range(3_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k")
    )


@pytest.fixture()
def large(spark):
    return spark.range(0, 3_000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


def test_hot_keys_are_found(spark, rows):
    hot = joins.hot_keys(rows, ["k"], key_rows=300).collect()
    want = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert [(r["_key"], r["_salts"]) for r in hot] == [(want, 4)]
    assert joins.hot_keys(rows, ["k"], key_rows=2_000).count() == 0
    assert joins.hot_keys(rows.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_all_ways_agree(rows, large, how, spark):
    rows = rows.unionByName(spark.createDataFrame([(9_000, None), (9_001, None)], "id long, k long"))
    large = large.unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    want = sorted(map(str, rows.join(large, "k", how).collect()))
    for options in ({"small_rows": 10_000}, {"key_rows": 1_000_000}, {"key_rows": 100}):
        out = joins.salted_lookup(rows, large, ["k"], ["id"], how, **options)
        assert sorted(map(str, out.select(rows.join(large, "k", how).columns).collect())) == want


def test_plan_follows_the_table(spark, rows, large):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan(joins.salted_lookup(rows, large, ["k"], ["id"], small_rows=10_000))
        assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small
        even = plan(joins.salted_lookup(rows, large, ["k"], ["id"]))
        assert "SortMergeJoin" in even and "Generate" not in even and "_salt" not in even
        hot = joins.salted_lookup(rows, large, ["k"], ["id"], key_rows=100)
        assert "_salt" in plan(hot) and "Generate" in plan(hot)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_only_hot_keys_are_copied(rows, large, spark):
    """The table goes into the join with one row per key, but for the hot one."""
    table = large.unionByName(spark.createDataFrame([(7, 70)], "k long, v long"))
    hot = joins.hot_keys(rows, ["k"], 100)
    extra = hot.agg(F.sum(F.col("_salts") - 1)).first()[0]
    assert hot.count() == 1 and extra == 10 and table.count() + extra < 1.01 * table.count() + 1
