"""How filters act together: what each removes under every order of application.

Word counts come from the sparse document-term matrix: its row sums and nonzero cells decide the
two word filters, the other flags are attached, and documents are counted per part and set of
failed filters. All orders are then worked out from these counts, at most 128 per part.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.term_matrix import fingerprint, row_counts, term_matrix
from vitalgrid.session import stored

FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """A: fewer words; B: distinct words below this percentage; C: upper-case share above this percentage; D: holds a mark."""

    least_words: int = 200
    distinct_percent: int = 50
    upper_percent: int = 3
    marks: str = "#$%&*|"


def flagged(docs: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """Per document doc_id, ``part`` (null: empty string), ``text_id`` and ``mask``, bit i for failing filter i of A to D.

    A null text is an empty one: it fails A alone.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), fingerprint(F.col("text")).alias("text_id"))
    shards = stored(term_matrix(rows, "part", "text_id", marks=limits.marks), "term-matrix")
    counted = row_counts(shards, "part", "text_id", "n_chars_", "n_upper", "n_marks")
    failed = [
        F.col("n_words") < limits.least_words,
        100 * F.col("n_distinct") < limits.distinct_percent * F.col("n_words"),
        100 * F.col("n_upper") > limits.upper_percent * F.col("n_chars_"),
        F.col("n_marks") > 0,
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))
    return counted.select("doc_id", "part", "text_id", mask.cast("int").alias("mask"), "n_words", "n_distinct")


def outcome_table(spark) -> DataFrame:
    """For each set of failed filters (mask), order and step: whether the step's filter keeps, removes and so on.

    32 x 120 x 5 rows, whatever the input.
    """
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for mask in range(1 << len(FILTERS)):
            gone = False
            for step, f in enumerate(order, 1):
                fails = bool(mask >> f & 1)
                share = 120 // mask.bit_count() if fails else 0
                rows.append((mask, name, step, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == 1 << f), share))
                gone |= fails
    return spark.createDataFrame(
        rows, "mask int, filter_order string, step int, kept_ int, removed_ int, redundant_ int, only_ int, share_ int")


def class_counts(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) -> n, with filter E: the text equals that of a row with a smaller doc_id, in any part.

    Copies of a text agree in A to D, so they are counted before their smallest id is looked for:
    however many copies a text has, it is a few rows. A null id is neither smaller nor larger than
    another and does not fail E; rows that share id and text do not fail because of each other.
    Of several labels of one id, a 1 counts.
    """
    one = flagged(docs, limits, part)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = one.join(marked, "doc_id", "left").select(
        "doc_id", "part", "text_id", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    same = ["text_id", "part", "mask", "good", "toxic"]
    # rows of one id and text first, so that the smallest id knows how many rows it has
    by_id = known.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    held = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    least = held.groupBy("text_id").agg(F.min("first.doc_id").alias("least"))
    joined = held.join(least, "text_id")
    free = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = joined.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), free.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - free).alias("n")))).alias("c"))
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def filter_interactions(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Reads doc_id, text and ``part`` of ``docs``; doc_id, quality and toxic of ``labels``. An empty
    table has no parts and gives no rows. Ties and repeated rows count each; see ``class_counts``.
    """
    counts = stored(class_counts(docs, labels, limits, part), "filter-classes")
    joined = counts.join(F.broadcast(outcome_table(docs.sparkSession)), "mask")
    total = lambda what, name: F.sum(what * F.col("n")).cast("long").alias(name)
    removed = F.col("removed_")
    return joined.groupBy("part", "filter_order", "step").agg(
        total(F.col("kept_"), "kept"), total(removed, "removed"), total(F.col("redundant_"), "redundant"), total(F.col("only_"), "unique_fails"),
        total(removed * F.col("good"), "good_lost"), total(removed * F.col("toxic"), "toxic_lost"), total(F.col("share_"), "shapley"))
