"""Decisions from several sensors' predictions, and measures of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalgrid.sources.registry import LABELS

# Votes per label.
VOTE_WEIGHTS = {"SITTING": 3, "WALKING": 3, "WALKING_UP": 0, "WALKING_DOWN": 0}
EQUAL_WEIGHTS = {label: 1 for label in LABELS}
# Fixed value: code of a missing prediction in the stacked naive Bayes.
MISSING_CODE = 4


def vote(
    rows: DataFrame, keys: list[str], label: str, weights: dict[str, int] | None = None
) -> DataFrame:
    """Weighted majority per key: ``activity``, its ``score`` and ``n_top``, the
    number of labels sharing that score. Only labels that got a vote count; on a tie the
    first of them in ``LABELS`` wins. Without a known vote all is null and ``n_top`` 0.

    One conditional sum per label, so a key costs one row per map task; no join with
    a weight table and no ranking window.
    """
    weights = VOTE_WEIGHTS if weights is None else weights
    score = {
        n: F.sum(F.when(F.col(label) == n, F.lit(weights[n]))).cast("bigint") for n in LABELS
    }
    scored = rows.groupBy(*keys).agg(*[score[n].alias(f"_s_{n}") for n in LABELS])
    top = F.greatest(*[F.col(f"_s_{n}") for n in LABELS])
    names = F.array(*[F.lit(n) for n in LABELS])
    scores = F.array(*[F.col(f"_s_{n}") for n in LABELS])
    return scored.select(
        *keys,
        F.when(top.isNotNull(), F.element_at(names, F.array_position(scores, top).cast("int"))).alias("activity"),
        top.alias("score"),
        F.size(F.filter(scores, lambda s: s == top)).cast("bigint").alias("n_top"),
    )


def vote_in_row(columns: list[str], weights: dict[str, int] | None = None) -> Column:
    """The same decision over label columns of one row."""
    weights = VOTE_WEIGHTS if weights is None else weights
    votes = {n: sum((F.when(F.col(c) == n, 1).otherwise(0) for c in columns), F.lit(0)) for n in LABELS}
    scores = F.array(*[F.when(votes[n] > 0, votes[n] * weights[n]) for n in LABELS])
    names = F.array(*[F.lit(n) for n in LABELS])
    top = F.array_max(scores)
    return F.when(top.isNotNull(), F.element_at(names, F.array_position(scores, top).cast("int")))


def most_frequent(columns: list[str], missing: int = MISSING_CODE) -> Column:
    """Most frequent known code among ``columns``; the smallest code on a tie, null
    if all are missing."""
    known = F.array_sort(
        F.filter(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull() & (v != missing))
    )
    # Codes are small integers: rank by (count, -code) without any join.
    ranked = F.transform(
        F.array_distinct(known),
        lambda v: F.struct(F.size(F.filter(known, lambda w: w == v)).alias("n"), (-v).alias("neg")),
    )
    return -F.array_max(ranked)["neg"]


def impute_most_frequent(df: DataFrame, columns: list[str], missing: int = MISSING_CODE) -> DataFrame:
    """Replace missing codes in each row by the row's most frequent one."""
    fill = most_frequent(columns, missing)
    return df.withColumn("_fill", fill).withColumns(
        {
            c: F.when(F.col(c).isNull() | (F.col(c) == missing), F.col("_fill")).otherwise(F.col(c))
            for c in columns
        }
    ).drop("_fill")


def error_rate(df: DataFrame, label: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    wrong = (F.col(label) != F.col(prediction)).cast("double")
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error")
    )


def confusion(df: DataFrame, label: str, prediction: str, labels: list[str]) -> DataFrame:
    """Counts of predicted labels (columns) per true label (rows)."""
    return df.groupBy(label).agg(
        *[F.count_if(F.col(prediction) == n).alias(f"pred_{n}") for n in labels]
    )
