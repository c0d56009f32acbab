"""A row's score comes from models that never saw the row."""

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import forests
from vitalgrid.plans import training

DEEP = {"numTrees": 9, "maxDepth": 12, "maxBins": 256}


def test_noise_is_not_memorised(spark):
    """Labels are random: who has seen a row knows it, who has not can only guess."""
    name = F.element_at(F.array(*[F.lit(n) for n in ("SITTING", "WALKING", "WALKING_UP", "WALKING_DOWN")]), (F.floor(F.rand(1) * 4) + 1).cast("int"))
    rows = spark.range(400, numPartitions=2).select(F.col("id").cast("string").alias("eventId"), F.rand(2).alias("a"), F.rand(3).alias("b"), name.alias("activity"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    seen = forests.fit_forest(forests.with_label_index(rows), ["a", "b"], settings=DEEP).transform(forests.with_label_index(rows))
    assert seen.where("prediction = label_idx").count() > 300
    out = training.cross_fitted(rows, {"s1": ["a", "b"], "s2": ["b"]}, folds=3, settings=DEEP, stack_settings=DEEP)
    right = out.where("prediction = activity").count()
    assert out.count() == 400 and right < 180
    assert sorted(r["fold"] for r in out.select("fold").distinct().collect()) == [0, 1, 2]


def test_one_fold_is_refused(spark):
    with pytest.raises(ValueError):
        training.cross_fitted(spark.createDataFrame([], "eventId string, activity string, a double"), {"s": ["a"]}, folds=1)
