"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from vitalgrid.sources.registry import LABELS, SENSOR_ALIASES, SENSOR_FIELDS

# The sorted five-class coding used by the stacked naive Bayes.
SORTED_CLASSES = ["SITTING", "WALKING", "WALKING_DOWN", "WALKING_UP", "Z"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    The optimizer copies an expression into every filter and column that uses it.
    For costly ones, such as parsing JSON, that multiplies the work and can outgrow
    generated code. A generator is not duplicated, so the value goes through one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lookup(key: Column, pairs: list[tuple[str | int, object]]) -> Column:
    """Constant lookup as a CASE chain, so no join and no UDF is planned."""
    out = F.lit(None)
    for k, v in reversed(pairs):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def label_code(label: str | Column, start: int = 0) -> Column:
    """SITTING, WALKING, WALKING_UP, WALKING_DOWN from ``start`` upwards."""
    return _lookup(_col(label), [(n, i + start) for i, n in enumerate(LABELS)]).cast("int")


def label_name(code: str | Column) -> Column:
    return _lookup(_col(code).cast("int"), list(enumerate(LABELS)))


def sorted_label_code(label: str | Column) -> Column:
    return _lookup(_col(label), [(n, i) for i, n in enumerate(SORTED_CLASSES)]).cast("int")


def normalise_label(result: str | Column) -> Column:
    """A result may be a label or its number as text; return the label."""
    text = F.trim(_col(result).cast("string"))
    return F.when(text.isin(LABELS), text).otherwise(label_name(text.try_cast("double")))


def one_hot(code: str | Column, size: int, prefix: str) -> list[Column]:
    return [(_col(code) == F.lit(k)).cast("int").alias(f"{prefix}_{k}") for k in range(size)]


def last_token(name: str | Column, sep: str = "_") -> Column:
    return F.substring_index(_col(name), sep, -1)


def normalise_sensor(name: str | Column) -> Column:
    """Trim and ignore case, resolve aliases; unknown names give null."""
    key = F.lower(F.trim(_col(name)))
    pairs = [(s.lower(), s) for s in SENSOR_FIELDS] + list(SENSOR_ALIASES.items())
    return _lookup(key, pairs)


def strip_quotes(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), '"', "")


def ascii_only(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"[^\x00-\x7F]", "")


def zero_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in columns})


def fill_numeric(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Null and NaN become ``value`` in all numeric columns."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs[f.name] = F.coalesce(F.nanvl(F.col(f.name), F.lit(value)), F.lit(value))
        elif isinstance(f.dataType, T.NumericType):
            exprs[f.name] = F.coalesce(F.col(f.name), F.lit(int(value)).cast(f.dataType))
    return df.withColumns(exprs)


def safe_corr(x: str, y: str) -> Column:
    """Correlation that is null, not an error, when an axis is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def stable_id(*parts: str | Column) -> Column:
    """A repeatable row id; ``uuid()`` would change when a task is retried."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(_col(c), digits) + F.lit(0.0)
