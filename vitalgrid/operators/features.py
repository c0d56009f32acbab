"""Window features of activity sensors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.functions.scalars import fill_numeric, safe_corr, total
from vitalgrid.functions.timekeys import window_key
from vitalgrid.operators.ordered import lagged
from vitalgrid.sources.registry import FEATURE_COLUMNS

# Feature names of a three-axis window.
AXIS_FEATURES = [
    "avg_x", "avg_y", "avg_z", "var_x", "var_y", "var_z",
    "std_x", "std_y", "std_z", "corr_xy", "corr_xz", "corr_yz",
]
SLOPE_FEATURES = ["avg_slope_pressure", "avg_slope_temperature"]


def distinct_readings(
    rows: DataFrame, keys: list[str], values: list[str], ts: str, width_ms: int,
    rounding: str = "floor",
) -> DataFrame:
    """Readings with ``window``, equal rows kept once. Raw time and event id are
    left out unless named in ``values``."""
    return rows.select(*keys, window_key(ts, width_ms, rounding).alias("window"), *values).distinct()


DECIMAL = "decimal(26,12)"


def mean_parts(column: str) -> list[Column]:
    """Aggregates that ``above_mean`` compares with: a mean of doubles hangs on the order of its sum,
    a sum of decimals does not. ``_exact``: whether every value is such a decimal."""
    value = F.col(column).try_cast(DECIMAL)
    return [
        F.avg(column).alias("_mean"), F.count(column).alias("_n"), F.try_sum(value).alias("_sum"),
        F.bool_and(F.coalesce(value.cast("double") == F.col(column), F.col(column).isNull())).alias("_exact"),
    ]


def above_mean(column: str) -> Column:
    """Whether a value is above its key's mean; one that equals it is not, in whatever order the mean was summed."""
    exact = F.col(column).try_cast(DECIMAL) * F.col("_n").cast("decimal(11,0)") > F.col("_sum")
    return F.when(F.col("_exact") & F.col("_sum").isNotNull(), exact).otherwise(F.col(column) > F.col("_mean"))


def axis_aggregates() -> list:
    axes = ["x", "y", "z"]
    return [
        *[F.avg(a).alias(f"avg_{a}") for a in axes],
        *[F.variance(a).alias(f"var_{a}") for a in axes],
        *[F.stddev(a).alias(f"std_{a}") for a in axes],
        safe_corr("x", "y").alias("corr_xy"),
        safe_corr("x", "z").alias("corr_xz"),
        safe_corr("y", "z").alias("corr_yz"),
    ]


def axis_features(
    rows: DataFrame, keys: list[str], ts: str, width_ms: int, rounding: str = "floor"
) -> DataFrame:
    """Twelve features per (keys, window) over the distinct (x, y, z) readings.

    Two shuffles: distinct rows, spread over all their values, then the partial
    aggregates, a few per map task. Neither collects a key's rows.
    """
    unique = distinct_readings(rows, keys, ["x", "y", "z"], ts, width_ms, rounding)
    out = unique.groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), *axis_aggregates())
    return fill_numeric(out)


def slopes(
    rows: DataFrame, keys: list[str], ts: str, values: list[str], piece_ms: int | None
) -> DataFrame:
    """Change per millisecond since the previous reading of the key; 0 for the first
    and for readings at the same time."""
    before = {c: f"_prev_{c}" for c in [ts, *values]}
    seen = lagged(rows, keys, [ts, *values], before, piece_ms)
    dt = (F.col(ts) - F.col(f"_prev_{ts}")).cast("double")
    out = seen.withColumns(
        {
            f"slope_{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_prev_{c}"), dt), F.lit(0.0))
            for c in values
        }
    )
    return out.drop(*before.values())


def slope_features(
    rows: DataFrame, keys: list[str], ts: str, width_ms: int, rounding: str = "floor",
    pressure: str = "air_pressure", temperature: str = "temperature",
    piece_ms: int | None = None,
) -> DataFrame:
    """Average slopes of pressure and temperature per (keys, window)."""
    unique = distinct_readings(rows, keys, [ts, pressure, temperature], ts, width_ms, rounding)
    sloped = slopes(unique, [*keys, "window"], ts, [pressure, temperature], piece_ms)
    return fill_numeric(
        sloped.groupBy(*keys, "window").agg(
            F.avg(f"slope_{pressure}").alias("avg_slope_pressure"),
            F.avg(f"slope_{temperature}").alias("avg_slope_temperature"),
        )
    )


def nonzero_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows whose features add up to zero."""
    return df.where(total(columns) != 0.0)


def feature_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def sensor_vectors(records: DataFrame, sensor: str, out: str = "features") -> DataFrame:
    """A sensor's records with a signal, and the vector of its feature columns."""
    columns = FEATURE_COLUMNS[sensor]
    numbers = records.withColumns({c: F.col(c).cast("double") for c in columns})
    return feature_vector(nonzero_rows(numbers, columns).na.drop("any", subset=columns), columns, out)
