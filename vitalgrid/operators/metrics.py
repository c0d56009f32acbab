"""Long metric points from wide sensor records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalgrid.operators.balance import split_bucket
from vitalgrid.operators.ordered import piece_of
from vitalgrid.operators.parse import typed
from vitalgrid.sources.registry import COMMON_FIELDS, SENSOR_FIELDS, sensor_columns, table_name

# Patterns that tell what a column becomes in a metric point.
NUMERIC_TYPE_PATTERN = "float|double|int|long|byte|bigint"
TIME_NAME_PATTERN = "^timestamp|time_stamp$"


def point_role(name: str | Column, type_: str | Column) -> Column:
    """``timestamp``, ``value`` or ``tags`` for a column, by name and type."""
    n = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    t = F.lower(F.trim(F.col(type_) if isinstance(type_, str) else type_))
    return (
        F.when(n.rlike(TIME_NAME_PATTERN), "timestamp")
        .when(t.rlike(NUMERIC_TYPE_PATTERN), "value")
        .otherwise("tags")
    )


def _numeric(type_: str) -> bool:
    return any(t in type_ for t in NUMERIC_TYPE_PATTERN.split("|"))


def metric_points(parsed: DataFrame, prefix: str = "raw_") -> DataFrame:
    """``name, timestamp, value, tags``: one row per numeric field that is present.

    All sensors are unpivoted in a single pass: each row picks the array of its
    own sensor and explodes it, instead of one scan and one union per sensor.
    """
    points = F.lit(None).cast("array<struct<name:string,value:double>>")
    for sensor in SENSOR_FIELDS:
        items = [
            F.struct(
                F.lit(f"{table_name(sensor, prefix)}_{c.column}").alias("name"),
                typed(c.json_name, c.type, c.default).cast("double").alias("value"),
            )
            for c in sensor_columns(sensor)
            if _numeric(c.type) and c.column != "time_stamp"
        ]
        points = F.when(F.col("sensor") == sensor, F.array(*items)).otherwise(points)
    tags = [(c, typed(j, t, d)) for j, c, t, d in COMMON_FIELDS if not _numeric(t)]
    handheld = typed("handheldActivity", "string", "NA")
    base = F.create_map(*[x for c, v in tags for x in (F.lit(c), v)])
    extra = F.create_map(F.lit("handheld_activity"), handheld)
    all_tags = F.when(F.col("sensor") == "hdhld", F.map_concat(base, extra)).otherwise(base)
    return (
        parsed.select(
            typed("timestamp", "bigint", None).alias("timestamp"), all_tags.alias("tags"),
            F.explode(points).alias("_p"),
        )
        .select(F.col("_p.name").alias("name"), "timestamp", F.col("_p.value").alias("value"), "tags")
        .where("value IS NOT NULL")
    )


def prediction_points(predictions: DataFrame, metric: str, code: Column) -> DataFrame:
    """A prediction as a metric point, tagged with the user."""
    return predictions.select(
        F.lit(metric).alias("name"),
        F.col("time_stamp").alias("timestamp"),
        code.cast("double").alias("value"),
        F.create_map(F.lit("userid"), F.col("userid")).alias("tags"),
    )


def number_posts(
    points: DataFrame, keys: list[str], order: list[str], size: int, piece_ms: int,
    shard: str | Column | None = None, shards: int = 1,
) -> DataFrame:
    """Adds ``piece``, ``shard`` and ``post_id``: points go out ``size`` at a time.

    Posts are filled per key, time piece and shard, and what is left of each goes out
    as a smaller post, as a flush does. So a key is never numbered by one task: it is
    split by time, and within a piece by a hash of ``shard``.
    """
    part = F.lit(0) if shard is None else split_bucket([shard], shards)
    cut = points.withColumn("piece", piece_of(order[0], piece_ms)).withColumn("shard", part.cast("int"))
    w = Window.partitionBy(*keys, "piece", "shard").orderBy(*order)
    numbered = cut.withColumn("idx", F.row_number().over(w))
    return numbered.withColumn("post_id", F.floor((F.col("idx") - 1) / F.lit(size)).cast("bigint"))


def posts(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON array per post; a post holds at most ``size`` points."""
    # a point becomes text before it is collected: its place is then the order of plain structs, without a comparator of its own
    point = F.struct("idx", F.to_json(F.struct("name", "timestamp", "value", "tags")).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(point)), lambda i: i["p"])
    return numbered.groupBy(*keys, "piece", "shard", "post_id").agg(
        F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("body"),
        F.count(F.lit(1)).alias("n_points"),
    )
