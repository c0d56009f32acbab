"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.scalars import once

# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the of and to a in that is on for with as it be are by this was "
    "le la les de des un une et est que en du dans pour "
    "der die das und ist ein eine zu den von mit auf dem "
    "el los las y del con al por su no se"
).split()
SPACE = " \\t\\n\\x0B\\f\\r"
MIN_WORDS = 10
REPEAT_WINDOW = 5

ELLIPSIS = r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"
BULLET = r"^[\x20\x09-\x0D]*[•‣●▪◦*-][\x20\x09-\x0D]"
LETTER = r"\p{L}"

Rule = tuple[str, float | None, float | None, int]
# measure, least, most, words from which on the row counts (a short text may miss a word by chance):
# a text is kept when every measure lies between its bounds
THRESHOLDS: list[Rule] = [
    ("n_words", None, 100_000, 0),
    ("mean_word_chars", 1.5, 20.0, 0),
    ("symbols_per_word", None, 0.1, 0),
    ("dup_line_ratio", None, 0.5, 0),
    ("ellipsis_line_ratio", None, 0.3, 0),
    ("bullet_line_ratio", None, 0.9, 0),
    ("letter_word_ratio", 0.8, None, 0),
    ("n_stop_words", 2, None, 60),
    ("stop_word_ratio", 0.01, None, 60),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column, size: int = REPEAT_WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that the text holds twice or more.

    Equal windows meet by sorting (hash, place) pairs, so a text of n words takes n log n
    steps; the pairs are only built where some window repeats.
    """

    def places(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))),
            lambda x: x["i"])))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(size), p - F.get(at, j - 1)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        firsts = F.slice(hashes, F.lit(1), F.size(hashes) - (size - 1))
        grams = F.transform(firsts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long"))
                   .otherwise(let(places(g), covered)))

    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), count))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts and ratios that the rules use, beside ``keep``. A null text is measured as an empty one; ratios of nothing are null."""
    text = F.coalesce("text", F.lit(""))
    df = once(docs.select(*keep, text.alias("__text")), "__words", words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("lines"), F.size(F.array_distinct(x)).cast("long").alias("unlike"),
            F.size(F.filter(x, lambda y: y.rlike(ELLIPSIS))).alias("trailing"), F.size(F.filter(x, lambda y: y.rlike(BULLET))).alias("bullets"))).alias("__lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("__words", lambda w: w.rlike(LETTER))).cast("long").alias("n_letter_words"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.col("__lines.lines") - F.col("__lines.unlike")).alias("n_dup_lines"),
        "n_repeat_words", ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        F.try_divide(F.col("__lines.lines") - F.col("__lines.unlike"), F.col("__lines.lines")).alias("dup_line_ratio"),
        F.try_divide(F.col("__lines.trailing"), F.col("__lines.lines")).alias("ellipsis_line_ratio"),
        F.try_divide(F.col("__lines.bullets"), F.col("__lines.lines")).alias("bullet_line_ratio"),
        ratio("n_letter_words", "n_words").alias("letter_word_ratio"), "n_stop_words", ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
    )


def verdict(rules: list[Rule] = THRESHOLDS) -> Column:
    """The table as one boolean; a measure that is null passes, as it says nothing."""
    out = F.lit(True)
    for name, least, most, words in rules:
        for bound, test in ((least, F.col(name) >= F.lit(least)), (most, F.col(name) <= F.lit(most))):
            if bound is not None:
                out = out & (F.coalesce(test, F.lit(True)) | (F.col("n_words") < words))
    return out


def quality_rules(docs: DataFrame, rules: list[Rule] = THRESHOLDS) -> DataFrame:
    """Per document its measures, whether it fails the base rule, and whether all rules keep it.

    Reads ``doc_id`` and ``text`` only. Null and empty texts have zero counts and fail the
    base rule; repeated rows are judged each for itself.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, "doc_id").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def verdict_sql(rules: list[Rule] = THRESHOLDS) -> str:
    parts = []
    for name, least, most, words in rules:
        short = f" OR n_words < {words}" if words else ""
        parts += [f"(coalesce({name} >= {least}, true){short})"] if least is not None else []
        parts += [f"(coalesce({name} <= {most}, true){short})"] if most is not None else []
    return " AND ".join(parts) or "true"
