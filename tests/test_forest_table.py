"""Forests walked as data beside the library's own predictions."""

from pyspark.sql import functions as F

from vitalgrid.operators import forest_table, forests
from vitalgrid.session import scratch_path

SMALL = {"numTrees": 7, "maxDepth": 5, "maxBins": 16}


def noisy(spark, n=600):
    x = F.rand(3) * 10
    rows = spark.range(n, numPartitions=3).select("id", x.alias("x"), F.when(F.rand(4) > 0.1, F.rand(5)).alias("y"), (F.col("id") % 4).alias("c"))
    return rows.withColumn("label_idx", (F.floor(F.col("x") + F.col("c") + F.rand(6) * 3) % 4).cast("double")).cache()


def compared(spark, rows, columns, model, owners):
    folder = scratch_path(spark, "forest-table")
    forests.save_model(model, f"{folder}/acc_u1_FEA_.MDL")
    nodes = forest_table.saved_nodes(spark, folder)
    assert [tuple(r) for r in nodes.select("sensor", "userid").distinct().collect()] == [("acc", "u1")]
    many = nodes.drop("userid").withColumn("owner", F.explode(F.array(*[F.lit(f"o{i}") for i in range(owners)])))
    trees = forest_table.forest_rows(many, "owner")
    mine = rows.withColumn("owner", F.concat(F.lit("o"), (F.col("id") % (owners + 1)).cast("string")))
    got = forest_table.score_with_owner(mine, trees, "owner", columns, ["id"], SMALL["maxDepth"])
    want = {r["id"]: r["prediction"] for r in model.transform(rows).select("id", "prediction").collect()}
    pairs = [(r["id"], r["prediction"]) for r in got.select("id", "prediction").collect()]
    assert len(pairs) == rows.where(F.col("id") % (owners + 1) < owners).count()
    assert all(want[i] == p for i, p in pairs) and len({p for _, p in pairs}) > 1


def test_numbers_and_nulls(spark):
    rows = noisy(spark)
    compared(spark, rows, ["x", "y"], forests.fit_forest(rows.where("y IS NOT NULL"), ["x", "y"], settings=SMALL), 500)


def test_categories(spark):
    rows = forests.nominal(noisy(spark), ["c"], 4)
    compared(spark, rows, ["c", "x"], forests.fit_forest(rows, ["c", "x"], settings=SMALL), 3)


def test_busy_owner_is_many_batches(spark):
    rows = noisy(spark, 3 * forest_table.BATCH_ROWS)
    compared(spark, rows, ["x"], forests.fit_forest(rows, ["x"], settings=SMALL), 1)
