"""Order statistics by counting, against numpy on every kind of distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import selection

SHARES = [0.25, 0.5, 0.75]


def plain(values):
    s = np.sort(values)
    return [float(s[max(1, int(np.ceil(len(s) * q))) - 1]) for q in SHARES]


@pytest.mark.parametrize("finish, group_rows", [(0, 200_000), (5, 200_000), (100_000, 200_000), (5, 0)])
def test_quartiles_of_many_groups(spark, finish, group_rows, monkeypatch):
    monkeypatch.setattr(selection, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(selection, "GRID", 16)  # few probes, so that several rounds are needed
    monkeypatch.setattr(selection, "ACCURACY", 20)
    rng = np.random.default_rng(3)
    groups = {
        "even": rng.random(900), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "same": np.full(300, 7.5),
        "wide": np.concatenate([rng.random(400) * 1e-12, [1e300, -1e300]]), "ties": rng.integers(0, 4, 500).astype(float),
        "hot": np.concatenate([np.full(700, 3.25), rng.random(300) * 10]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in selection.order_statistics(df, ["g"], "v", SHARES, finish).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert (got[g]["n"], got[g]["low"], got[g]["high"]) == (len(vs), vs.min(), vs.max())
        assert got[g]["found"] == plain(vs), g


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert selection.order_statistics(df, ["g"], "v", SHARES).count() == 0


def test_no_window_over_a_hot_group(spark):
    """The counting pass has no sort and no window: a group of a third of all rows is pre-aggregated in every task."""
    rows = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    targets = spark.createDataFrame([("g", 0, 500, float("-inf"), float("inf"), 1000, 480.0, 520.0)],
                                    "g string, q int, rank long, after double, before double, inside long, lo double, hi double")
    plan = selection._count(rows, targets, ["g"], True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "partial_count" in plan
