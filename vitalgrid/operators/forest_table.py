"""Forests as data: the saved trees of any number of owners as one table, walked inside the JVM.

A saved forest is read as nodes, never loaded as a model. One plan scores the rows of all owners:
an owner's nodes are one row of arrays, bounded by the forest's settings, and meet the owner's
rows in batches, so that the arrays are copied once per batch and a busy owner is many batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitalgrid.sources.scans import parse_model_names

BATCH_ROWS = 512
NODES = "*/stages/*RandomForestClassifier*/data"


def saved_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(sensor, userid, tree, node) of every forest saved under ``folder`` by its sensor's and owner's names.

    One scan, however many models there are. A name that is no model's is left out.
    """
    raw = spark.read.parquet(f"{folder}/{NODES}").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"(?i)^(.*\.MDL)/stages/", 1).alias("path"), F.col("treeID").alias("tree"), F.col("nodeData").alias("node"))
    names = parse_model_names(raw.select("path").distinct())
    return raw.join(F.broadcast(names.where("kind = 'forest'").select("path", "sensor", "userid")), "path").drop("path")


def forest_rows(nodes: DataFrame, owner: str) -> DataFrame:
    """One row per owner: ``roots`` and, by node, feature, values, categories, left, right and the shares of classes.

    Nodes of a tree are numbered from 0 in the file; here they stand behind those of the trees before. A
    share is the leaf's class count over its total, which is what a tree votes with.
    """
    trees = nodes.groupBy(owner, "tree").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    whole = trees.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("tree", "nodes"))).alias("trees"))
    upto = F.aggregate(
        "trees", F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(t["nodes"]))))
    placed = whole.withColumn("upto", upto)
    total = lambda n: F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, v: a + v)
    child = lambda c, base: F.when(c < 0, F.lit(-1)).otherwise(c + base)
    flat = F.flatten(F.transform("trees", lambda t, i: F.transform(t["nodes"], lambda n: F.struct(
        n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("values"),
        n["split"]["numCategories"].alias("categories"),
        child(n["leftChild"], F.get("upto", i)).alias("left"), child(n["rightChild"], F.get("upto", i)).alias("right"),
        F.transform(n["impurityStats"], lambda v: F.when(total(n) > 0, v / total(n)).otherwise(F.lit(0.0))).alias("shares")))))
    return placed.select(owner, F.slice("upto", 1, F.size("trees")).alias("roots"), flat.alias("n")).select(
        owner, "roots", *[F.col(f"n.{c}").alias(c) for c in ("feature", "values", "categories", "left", "right", "shares")])


def _goes_left(at: Column, x: Column) -> Column:
    """Numbers: at most the threshold. Categories: the smaller side of the split is looked up."""
    values, categories = F.get("values", at), F.get("categories", at)
    value = F.get(x, F.get("feature", at))
    listed = F.array_contains(values, value)
    known = value.between(F.lit(0), categories - 1) & (value == F.floor(value))
    return F.when(categories < 0, value <= F.get(values, F.lit(0))).when(F.size(values) * 2 <= categories, listed).otherwise(listed | ~known)


def _votes(x: Column, depth: int) -> Column:
    steps = F.sequence(F.lit(1), F.lit(depth))
    leaf = lambda root: F.aggregate(
        steps, root, lambda at, _: F.when(F.get("left", at) < 0, at).otherwise(F.when(_goes_left(at, x), F.get("left", at)).otherwise(F.get("right", at))))
    zero = F.transform(F.get("shares", F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate("roots", zero, lambda acc, root: F.zip_with(acc, F.get("shares", leaf(root)), lambda a, b: a + b))


def score_with_owner(
    rows: DataFrame, forests: DataFrame, owner: str, features: list[str], spread: list[str], depth: int, out: str = "prediction",
) -> DataFrame:
    """Each row with the class its owner's forest votes for, the smallest of equal ones; owners without a forest drop out.

    ``forests`` comes from ``forest_rows`` and ``depth`` is the deepest tree's. A null feature counts as
    not a number and goes right. ``spread`` columns deal an owner's rows into batches of about BATCH_ROWS.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    counts = rows.groupBy(owner).agg(F.ceil(F.count("*") / BATCH_ROWS).alias("_batches"))
    keep = [c for c in rows.columns if c != owner]
    # counts has a row per owner: the join may be skewed on the rows' side only, which is split at run time
    dealt = rows.join(counts, owner).select(
        owner, F.pmod(F.xxhash64(*spread), F.col("_batches")).alias("_batch"), F.struct(*keep, x.alias("_x")).alias("_row"))
    batches = dealt.groupBy(owner, "_batch").agg(F.collect_list("_row").alias("_rows"))
    joined = batches.join(forests, owner)
    winner = lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("double")
    scored = F.transform("_rows", lambda r: F.struct(r.alias("row"), winner(_votes(r["_x"], depth)).alias("won")))
    flat = joined.select(owner, F.explode(scored).alias("_s"))
    return flat.select(owner, *[F.col(f"_s.row.{c}").alias(c) for c in keep], F.col("_s.won").alias(out))
