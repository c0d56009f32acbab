"""Gaussian and multinomial naive Bayes as aggregates and expressions.

A fitted model is one row per model key, so scoring is a lookup and an expression:
no row is multiplied by the number of classes and nothing reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.operators.joins import salted_lookup

VARIANCE_FLOOR = 1e-9


def _argmax(scores: list[Column], labels: list) -> Column:
    """Label of the largest score; the first on a tie, classes without rows skipped.

    A score that is null or not a number is unknown: a row with an unknown feature has no
    known score, and its label is null.
    """
    arr = F.array(*[F.when(~F.isnan(s), s) for s in scores])
    names = F.array(*[F.lit(n) for n in labels])
    top = F.array_max(arr)
    return F.when(top.isNotNull(), F.element_at(names, F.array_position(arr, top).cast("int")))


def fit_gaussian(
    df: DataFrame, keys: list[str], label: str, features: list[str], labels: list[str]
) -> DataFrame:
    """Per key: ``n`` and, per label, a struct of ``n``, means and variances."""
    stats = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"mean_{f}") for f in features],
        *[(F.var_pop(f) + F.lit(VARIANCE_FLOOR)).alias(f"var_{f}") for f in features],
    )
    body = F.struct(
        "n", *[F.col(f"mean_{f}") for f in features], *[F.col(f"var_{f}") for f in features]
    )
    return stats.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.max(F.when(F.col(label) == n, body)).alias(f"class_{n}") for n in labels],
    )


def gaussian_score(params_class: str, features: list[str]) -> Column:
    """Log of prior times densities for one class."""
    c = F.col(params_class)
    out = F.log(c["n"] / F.col("_model_n"))
    for f in features:
        var = c[f"var_{f}"]
        d = F.col(f) - c[f"mean_{f}"]
        out = out - F.log(F.lit(2 * math.pi) * var) / 2 - d * d / (var * 2)
    return out


def score_gaussian(
    df: DataFrame, params: DataFrame, keys: list[str], features: list[str], labels: list[str],
    spread: list[str], out: str = "prediction",
) -> DataFrame:
    """Rows of users that have a model, with the most likely label."""
    joined = salted_lookup(df, params.withColumnRenamed("n", "_model_n"), keys, spread)
    scores = [gaussian_score(f"class_{n}", features) for n in labels]
    return joined.withColumn(out, _argmax(scores, labels)).drop(
        "_model_n", *[f"class_{n}" for n in labels]
    )


def fit_multinomial(
    df: DataFrame, keys: list[str], label: str, columns: list[str], labels: list[str],
    n_codes: int, alpha: float = 1.0,
) -> DataFrame:
    """Naive Bayes over the one-hot form of integer codes.

    Per key: ``n`` and, per label, a struct of its rows ``n`` and ``logp``: the
    smoothed log share of each (column, code), columns first.
    """
    hits = [F.count_if(F.col(c) == k) for c in columns for k in range(n_codes)]
    stats = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*hits).alias("hits")
    )
    seen = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h)
    size = float(len(columns) * n_codes)
    body = F.struct(
        "n",
        F.transform("hits", lambda h: F.log((h + F.lit(alpha)) / (seen + F.lit(alpha * size)))).alias("logp"),
    )
    return stats.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.max(F.when(F.col(label) == n, body)).alias(f"class_{n}") for n in labels],
    )


def score_multinomial(
    df: DataFrame, params: DataFrame, keys: list[str], columns: list[str], labels: list[str],
    n_codes: int, spread: list[str], out: str = "prediction",
) -> DataFrame:
    joined = salted_lookup(df, params.withColumnRenamed("n", "_model_n"), keys, spread)
    scores = []
    for n in labels:
        c = F.col(f"class_{n}")
        s = F.log(c["n"] / F.col("_model_n"))
        for i, col in enumerate(columns):
            at = F.lit(i * n_codes) + F.col(col).cast("int") + 1
            s = s + F.element_at(c["logp"], at)
        scores.append(s)
    return joined.withColumn(out, _argmax(scores, labels)).drop(
        "_model_n", *[f"class_{n}" for n in labels]
    )
