"""Passes cut into pieces give what one plain window gives."""

import random

import pytest
from pyspark.sql import Window, functions as F

from vitalgrid.operators import novelty, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key, n in (("hot", 400), ("b", 30), ("c", 1)):
        for i in range(n):
            data.append((key, rng.randrange(0, 5000), i, rng.choice([None, float(i)]), rng.random() < 0.4))
    return spark.createDataFrame(data, "k string, t long, id long, v double, novel boolean").repartition(5).cache()


def bag(df, *cols):
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


@pytest.mark.parametrize("piece_ms", [None, 1, 70, 1000, 10**6])
def test_lag(rows, piece_ms):
    got = ordered.lagged(rows, ["k"], ["t", "id"], {"id": "prev"}, piece_ms)
    want = rows.withColumn("prev", F.lag("id").over(Window.partitionBy("k").orderBy("t", "id")))
    assert bag(got, "k", "id", "prev") == bag(want, "k", "id", "prev")


@pytest.mark.parametrize("piece_ms", [None, 1, 70, 1000])
def test_forward_fill(rows, piece_ms):
    got = ordered.forward_fill(rows, ["k"], ["t", "id"], ["v"], piece_ms)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("v", F.last("v", True).over(w))
    assert bag(got, "k", "id", "v") == bag(want, "k", "id", "v")


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_index(rows, keys):
    got = ordered.running_index(rows, keys, ["t", "k", "id"], 90)
    want = rows.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "k", "id")))
    assert bag(got, "k", "id", "idx") == bag(want, "k", "id", "idx")


@pytest.mark.parametrize("piece_ms", [None, 1, 60, 2000])
@pytest.mark.parametrize("n", [2, 7])
def test_trailing_rate(rows, piece_ms, n):
    got = novelty.trailing_rate(rows, ["k"], ["t", "id"], n, 0.5, piece_ms)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-(n - 1), 0)
    want = rows.withColumn("novel_rate", F.when(F.count(F.lit(1)).over(w) == n, F.sum(F.col("novel").cast("int")).over(w) / n))
    assert bag(got, "k", "id", "novel_rate") == bag(want, "k", "id", "novel_rate")


def test_trailing_rate_values(spark):
    df = spark.createDataFrame([(i, bool(v)) for i, v in enumerate([1, 0, 1, 1])], "t long, novel boolean")
    out = novelty.trailing_rate(df.withColumn("k", F.lit("u")), ["k"], ["t"], 3, 0.6, 1).orderBy("t").collect()
    assert [r["novel_rate"] for r in out] == [None, None, 2 / 3, 2 / 3]
    assert [r["alarm"] for r in out] == [False, False, True, True]


def test_fit_piece_narrows_for_a_full_key(rows):
    assert ordered.fit_piece_ms(rows, ["k"], "t", 10_000, target_rows=1000) == 10_000
    width = ordered.fit_piece_ms(rows, ["k"], "t", 10_000, target_rows=50)
    fullest = rows.groupBy("k", ordered.piece_of("t", width)).count().agg(F.max("count")).first()[0]
    assert width < 10_000 and fullest <= 50


def test_copies_are_cut_down_before_the_shuffle(rows):
    plan = ordered.latest_per_key(rows, ["k"], [F.desc("t"), F.desc("id")])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
