"""Serving: readings of one sensor to published predictions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from vitalgrid.functions.scalars import label_name, stable_id
from vitalgrid.functions.timekeys import window_start
from vitalgrid.config import DAY_MS
from vitalgrid.operators import features, forests, joins, naive_bayes
from vitalgrid.operators.ordered import fit_piece_ms
from vitalgrid.sources.registry import LABELS


def result_rows(
    scored: DataFrame, sensor: str, width_ms: int, label, method: str = "forest", keys: tuple[str, ...] = ("userid",),
) -> DataFrame:
    """``eventId, processor_name, userid, time_stamp, result`` from windows scored per ``keys``, which all go into the id."""
    time = window_start("window", width_ms)
    name = f"{method}_{sensor}"
    return scored.select(
        stable_id(F.lit(name), *[F.col(k) for k in keys], time).alias("eventId"),
        F.lit(name).alias("processor_name"), "userid", time.alias("time_stamp"), label.alias("result"),
    )


def score_windows(
    readings: DataFrame, users: DataFrame, sensor: str, model: PipelineModel, width_ms: int,
    rounding: str = "floor",
) -> DataFrame:
    """Filter, features and forest for one three-axis sensor, as a single plan."""
    mine = joins.keep_known(readings.where(F.col("sensor") == sensor), users, "userid", ["eventId"])
    windows = features.axis_features(mine, ["deviceid", "userid"], "time_stamp", width_ms, rounding)
    scored = forests.score_all(windows, {sensor: model})
    return result_rows(scored, sensor, width_ms, label_name(f"{sensor}_prediction"), keys=("deviceid", "userid"))


def score_slopes(
    readings: DataFrame, params: DataFrame, width_ms: int, rounding: str = "floor",
    piece_ms: int | None = None,
) -> DataFrame:
    """Barometer windows against per-user Gaussian parameters: the lookup also drops
    users without a model. Windows of a busy user are cut into pieces no user overfills."""
    piece_ms = piece_ms or fit_piece_ms(readings, ["userid"], "time_stamp", DAY_MS)
    windows = features.slope_features(readings, ["userid"], "time_stamp", width_ms, rounding, piece_ms=piece_ms)
    scored = naive_bayes.score_gaussian(
        windows, params, ["userid"], features.SLOPE_FEATURES, LABELS, ["window"]
    )
    return result_rows(scored, "barometer", width_ms, F.col("prediction"), "naivebayes")
