"""Random forests through Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Column

from vitalgrid.functions.scalars import label_code, label_name
from vitalgrid.sources.registry import LABELS

# Forest sizes (trees, depth, bins) for sensors and for the stack.
SENSOR_FOREST = {"numTrees": 40, "maxDepth": 10, "maxBins": 50}
STACK_FOREST = {"numTrees": 50, "maxDepth": 16, "maxBins": 60}
EARLIER_SENSOR_FOREST = {"numTrees": 11, "maxDepth": 6, "maxBins": 32}
EARLIER_STACK_FOREST = {"numTrees": 16, "maxDepth": 6, "maxBins": 32}
SEED = 5043


def with_label_index(df: DataFrame, label: str = "activity", out: str = "label_idx") -> DataFrame:
    """The label's code (SITTING first) as the class index."""
    return df.withColumn(out, label_code(label).cast("double"))


def fit_forest(
    df: DataFrame, columns: list[str], label_idx: str = "label_idx", prefix: str = "",
    settings: dict | None = None, seed: int = SEED, vector: str | None = None,
) -> PipelineModel:
    """Assemble ``columns`` (or take the ``vector`` column) and grow the forest.

    Output columns carry ``prefix`` so that several models can score one table in
    turn, each keeping the row: no join back by position.
    """
    features = vector or f"{prefix}features"
    assemble = [] if vector else [VectorAssembler(inputCols=columns, outputCol=features, handleInvalid="keep")]
    stages = [
        *assemble,
        RandomForestClassifier(
            labelCol=label_idx, featuresCol=features, predictionCol=f"{prefix}prediction",
            rawPredictionCol=f"{prefix}raw", probabilityCol=f"{prefix}probability",
            impurity="gini", seed=seed, **(settings or SENSOR_FOREST),
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def nominal(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Mark numeric codes as categories 0..size-1, so trees split on sets of them."""
    values = [str(i) for i in range(size)]
    meta = {"ml_attr": {"type": "nominal", "vals": values}}
    return df.withColumns({c: F.col(c).cast("double") for c in columns}).select(
        *[F.col(c).alias(c, metadata=meta) if c in columns else F.col(c) for c in df.columns]
    )


def fit_stack(
    df: DataFrame, columns: list[str], label_idx: str = "label_idx", size: int = len(LABELS),
    settings: dict | None = None, seed: int = SEED, prefix: str = "stack_",
) -> PipelineModel:
    """Second-stage forest over the sensors' predicted codes."""
    return fit_forest(nominal(df, columns, size), columns, label_idx, prefix, settings or STACK_FOREST, seed)


def score_all(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """One ``<sensor>_prediction`` column per model, in one pass over the rows."""
    out = df
    for sensor, model in models.items():
        out = model.transform(out).drop(f"{sensor}_features", f"{sensor}_raw", f"{sensor}_probability")
    return out


def predicted_label(prediction: str = "prediction") -> Column:
    return label_name(prediction)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_by_owner(rows: DataFrame, models: dict[str, PipelineModel], owner: str, out: str = "prediction") -> DataFrame:
    """Each row with the prediction of its owner's model; rows without one are left out.

    One pass over the rows, in which every model adds a column and the owner's is taken. It
    is meant for the tens of models that one process can hold; each model's output columns
    must carry its owner as prefix.
    """
    scored = score_all(rows.where(F.col(owner).isin(list(models))), models)
    own = F.coalesce(*[F.when(F.col(owner) == o, F.col(f"{o}_prediction")) for o in models])
    return scored.withColumn(out, own).drop(*[f"{o}_prediction" for o in models])
