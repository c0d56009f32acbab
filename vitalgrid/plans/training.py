"""Model generation: clean, balance, fit, stack."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from vitalgrid.config import DAY_MS
from vitalgrid.functions.scalars import label_name
from vitalgrid.operators import balance, decide, features, forests
from vitalgrid.operators.ordered import fit_piece_ms
from vitalgrid.session import stored
from vitalgrid.sources.registry import LABELS


def clean(labelled: DataFrame, columns: list[str], label: str = "activity") -> DataFrame:
    """Labelled rows with a signal, incomplete ones left out."""
    rows = labelled.where(F.col(label) != "NONE")
    return features.nonzero_rows(rows, columns).na.drop("any", subset=columns)


def fit_sensors(
    rows: DataFrame, columns: dict[str, list[str]], settings: dict | None = None
) -> dict[str, PipelineModel]:
    """One forest per sensor over its own columns."""
    indexed = forests.with_label_index(rows)
    return {
        s: forests.fit_forest(features.nonzero_rows(indexed, cols), cols, prefix=f"{s}_", settings=settings)
        for s, cols in columns.items()
    }


def stacked(
    rows: DataFrame, columns: dict[str, list[str]], key: str = "eventId", settings: dict | None = None,
    stack_settings: dict | None = None,
) -> DataFrame:
    """Sensor forests on one half, stacked forest on the other, all rows scored.

    Growing a forest reads its input once per level, so what it reads is stored.
    """
    rows = stored(rows, "labelled")
    first, second = balance.key_split(rows, [key], 1, 2)
    models = fit_sensors(first, columns, settings or forests.EARLIER_SENSOR_FOREST)
    names = [f"{s}_prediction" for s in columns]
    second_stage = forests.score_all(forests.with_label_index(second), models).select(*names, "label_idx")
    stack = forests.fit_stack(
        stored(second_stage, "second"), names, settings=stack_settings or forests.EARLIER_STACK_FOREST,
    )
    scored = forests.nominal(forests.score_all(rows, models), names, 4)
    return stack.transform(scored).withColumn("prediction", label_name("stack_prediction"))


def cross_fitted(
    rows: DataFrame, columns: dict[str, list[str]], key: str = "eventId", folds: int = 2, settings: dict | None = None,
    stack_settings: dict | None = None,
) -> DataFrame:
    """Every row scored by sensor forests and a stack that were fitted without it.

    Rows go to folds by a hash of ``key``. A fold's sensor predictions come from forests grown on the other
    folds; its stack is grown on the other folds' predictions, which were made in the same way. Adds
    ``fold``, one ``<sensor>_prediction`` per sensor and ``prediction``. Rows with an unknown label are not fitted on.
    """
    if folds < 2:
        raise ValueError(f"a row needs a fold that it is not in, got {folds} folds")
    rows = stored(forests.with_label_index(rows).withColumn("fold", balance.split_bucket([key], folds)), "folds")
    names = [f"{s}_prediction" for s in columns]
    known = F.col("label_idx").isNotNull()
    parts = []
    for fold in range(folds):
        models = {
            s: forests.fit_forest(rows.where(known & (F.col("fold") != fold)), cols, prefix=f"{s}_", settings=settings or forests.SENSOR_FOREST)
            for s, cols in columns.items()
        }
        parts.append(stored(forests.score_all(rows.where(F.col("fold") == fold), models), "out-of-fold"))
    held = reduce(DataFrame.unionByName, parts)
    out = []
    for fold, part in enumerate(parts):
        train = held.where(known & (F.col("fold") != fold)).select(*names, "label_idx")
        stack = forests.fit_stack(train, names, settings=stack_settings or forests.STACK_FOREST)
        scored = stack.transform(forests.nominal(part, names, len(LABELS)))
        out.append(scored.withColumn("prediction", label_name("stack_prediction")).drop("stack_features", "stack_raw", "stack_probability", "stack_prediction"))
    return reduce(DataFrame.unionByName, out)


def train_and_test(
    labelled: DataFrame, columns: list[str], sensor: str, order: list[str], group: str = "userid",
    key: str = "eventId", train: int = 3, parts: int = 4, settings: dict | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Clean, split, balance the training part per ``group``, fit; the model and its
    error on the part it has not seen."""
    rows = clean(labelled.where(F.col("sensor") == sensor), columns)
    first, second = balance.key_split(rows, [key], train, parts)
    piece = fit_piece_ms(first, [group, "activity"], order[0], DAY_MS)
    balanced = stored(balance.oversample(first, [group], "activity", order, piece), "balanced")
    model = forests.fit_forest(
        forests.with_label_index(balanced), columns, prefix=f"{sensor}_", settings=settings
    )
    scored = forests.score_all(second, {sensor: model})
    scored = scored.withColumn("prediction", label_name(f"{sensor}_prediction"))
    return model, decide.error_rate(scored, "activity", "prediction", [group])
