"""One activity per user and time from the predictions of several sensors.

Three ways to decide: a weighted vote, a forest over the sensors' codes, and naive
Bayes over their one-hot form. The first two work on aligned predictions, the third
on predictions joined by window.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.config import AlignSettings
from vitalgrid.functions.scalars import label_code, label_name, last_token, normalise_label, sorted_label_code, stable_id
from vitalgrid.functions.timekeys import floor_window, window_start
from vitalgrid.operators import align, decide, forests, metrics, naive_bayes
from vitalgrid.operators.joins import outer_by_pivot
from vitalgrid.operators.ordered import forward_fill
from vitalgrid.sources.registry import ENSEMBLE_SLOTS, LABELS

# Code of a silent sensor in the forest's slots: one past the labels.
SILENT = len(LABELS)


def decode(predictions: DataFrame) -> DataFrame:
    """``userid, sensor, time_stamp, eventId, label`` from prediction events."""
    return predictions.select(
        "userid", last_token("processor_name").alias("sensor"), "time_stamp", "eventId",
        normalise_label("result").alias("label"),
    )


def activity_rows(decided: DataFrame, method: str, time: Column) -> DataFrame:
    """``eventId, processor_name, userid, time_stamp, activity``."""
    name = f"activity_{method}"
    return decided.select(
        stable_id(F.lit(name), F.col("userid"), time).alias("eventId"), F.lit(name).alias("processor_name"),
        "userid", time.alias("time_stamp"), "activity",
    )


def aligned(decoded: DataFrame, sensors: list[str], settings: AlignSettings) -> DataFrame:
    return align.align(
        decoded, ["userid"], sensors, settings.reference_sensor, settings.step_ms,
        require_all=settings.require_all, piece_ms=settings.piece_ms,
    )


def by_vote(rows: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Vote over aligned predictions."""
    voted = decide.vote(rows, ["userid", "anchor"], "label", weights)
    return activity_rows(voted, "voting", F.col("anchor"))


def forest_slots(rows: DataFrame) -> DataFrame:
    """One category per sensor slot and anchor, silent sensors included."""
    coded = rows.withColumn("code", label_code("label"))
    wide = align.slots(coded, ["userid", "anchor"], "sensor", "code", ENSEMBLE_SLOTS)
    return wide.withColumns({s: F.coalesce(s, F.lit(SILENT)).cast("double") for s in ENSEMBLE_SLOTS})


def fit_forest(slots: DataFrame, label: str, settings: dict | None = None) -> PipelineModel:
    return forests.fit_stack(
        forests.with_label_index(slots, label), ENSEMBLE_SLOTS, size=SILENT + 1, settings=settings
    )


def by_forest(rows: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(forests.nominal(forest_slots(rows), ENSEMBLE_SLOTS, SILENT + 1))
    return activity_rows(scored.withColumn("activity", label_name("stack_prediction")), "randomforest", F.col("anchor"))


def by_naive_bayes(
    decoded: DataFrame, params: DataFrame, keys: list[str], sensors: list[str], width_ms: int,
    piece_windows: int, model_key: Column | None = None,
) -> DataFrame:
    """Join by window, fill gaps from earlier windows, then from the row's most
    frequent code, and take the most likely label of the user's model."""
    coded = decoded.where(F.col("sensor").isin(sensors)).withColumn("window", floor_window("time_stamp", width_ms))
    wide = outer_by_pivot(
        coded.withColumn("code", sorted_label_code("label")), ["userid", "window"], "sensor", "code", sensors
    )
    filled = forward_fill(wide, ["userid"], ["window"], sensors, piece_windows)
    whole = decide.impute_most_frequent(filled, sensors)
    if model_key is not None:
        whole = whole.withColumn(keys[0], model_key)
    scored = naive_bayes.score_multinomial(
        whole, params, keys, sensors, LABELS, decide.MISSING_CODE + 1, ["window"], "activity"
    )
    return activity_rows(scored, "naivebayes", window_start("window", width_ms))


def activity_points(rows: DataFrame) -> DataFrame:
    """Decisions as metric points with codes from 1."""
    return metrics.prediction_points(rows, "activity_prediction", label_code("activity", 1))
