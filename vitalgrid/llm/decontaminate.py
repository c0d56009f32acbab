"""Benchmark passages in documents, over a distributed positional inverted index.

The index holds (term, document, place) for benchmark terms. Each window of benchmark words
is looked up from its rarest terms on: their lists, moved by the terms' offsets, are
intersected, and what is left is compared word by word with the document. Frequent terms
never need a list. All of it is DataFrame work.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.scalars import once
from vitalgrid.operators.joins import holds_at_most
from vitalgrid.session import stored

WINDOW = 10
LISTS = 3
TASK_POSTINGS = 100_000  # postings that one task moves and intersects
BROADCAST_ROWS = 500_000


def words_of(text: str | Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _row(key: str = "doc_id") -> Column:
    """What a row is known by in the index: rows share it only if their id and text are the same, so what is
    gathered for one name is bounded by one text, however many rows have that id or none."""
    return F.xxhash64(key, "text").alias("doc")


def _texts(df: DataFrame, *keep: str) -> DataFrame:
    return once(df.select(_row(), *keep, "text"), "words", words_of("text")).drop("text")


def benchmark_windows(items: DataFrame, size: int = WINDOW, key: str = "item_id") -> DataFrame:
    """Distinct windows (win, words) with the items (as strings) that hold them; a shorter item is one window."""
    texts = once(items.select(F.col(key).cast("string").alias("item"), "text"), "words", words_of("text")).where(F.size("words") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("start")
    windows = texts.select("item", "words", start).select("item", F.slice("words", F.col("start"), F.lit(size)).alias("words"))
    return windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("win", F.xxhash64("words"))


def tokens(docs: DataFrame) -> DataFrame:
    """Every word of every document: (doc, row, pos, term), places from 0. ``row`` tells repeated rows of one ``doc`` apart."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return _texts(rows, "row").select("doc", "row", F.posexplode("words").alias("pos", "term"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the given terms, stored in the shared folder. A term held by many documents is many rows, in many files."""
    wanted = stored(terms.select("term").distinct(), "index-terms")
    return stored(tokens(docs).join(wanted, "term").select("term", "doc", "row", "pos"), "postings")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each term stands in the documents; 0 where never."""
    # stored, so that the planner knows its size: a small one is broadcast and no token is shuffled
    wanted = stored(terms.select("term").distinct(), "wanted-terms")
    counts = tokens(docs).select("term").join(wanted, "term").groupBy("term").agg(F.count("*").alias("n"))
    return stored(wanted.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "term-counts")


def rarest_terms(windows: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(win, term, offset, lists): the rarest places of each window whose terms all occur."""
    places = windows.select("win", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    by_window = Window.partitionBy("win")  # a window has ``size`` places at most
    ranked = places.withColumn("rank", F.row_number().over(by_window.orderBy("n", "offset")))
    ranked = ranked.withColumn("least", F.min("n").over(by_window)).withColumn("size", F.count("*").over(by_window))
    return ranked.where((F.col("least") > 0) & (F.col("rank") <= lists)).select(
        "win", "term", "offset", F.least("size", F.lit(lists)).alias("lists"))


def intersect(index: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, win, start) where the lists of all chosen terms of a window meet at one start.

    ``index`` and ``places`` are stored tables. The postings, not the many more places they are moved to, are
    dealt by their document's row, in parts small enough that a task's moved places take little memory.
    """
    if holds_at_most(places, BROADCAST_ROWS):
        parts = min(20_000, index.count() // TASK_POSTINGS + 1)
        index, places = index.repartition(parts, "row"), F.broadcast(places)
    moved = index.join(places, "term").where(F.col("pos") >= F.col("offset")).select(
        "doc", "row", "win", (F.col("pos") - F.col("offset")).alias("start"), "lists")
    met = moved.groupBy("row", "doc", "win", "start").agg(F.count("*").alias("n"), F.first("lists").alias("lists")).where("n >= lists")
    return met.select("doc", "win", "start").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, lists: int = LISTS, keep: Sequence[str] = ()) -> DataFrame:
    """Per document its words, the words that lie in benchmark windows, and the items found.

    Reads ``doc_id`` and ``text`` of ``docs``, ``item_id`` and ``text`` of ``items``. Returns
    doc_id, n_words, n_hit, items (sorted strings) and ``hits`` (start and length in words of
    each match), with the columns named in ``keep``. Null and empty texts have no words; repeated rows are judged each by its own
    text; an empty benchmark matches nothing.
    """
    windows = stored(benchmark_windows(items, size), "benchmark-windows")
    terms = windows.select(F.explode("words").alias("term"))
    places = stored(rarest_terms(windows, term_counts(docs, terms), lists), "rarest-terms")
    index = build_index(docs, places)
    meets = stored(intersect(index, places), "meets")
    # windows of one document; no more than its places times the windows that begin there
    per_doc = meets.join(windows, "win").groupBy("doc").agg(F.collect_list(F.struct("start", "words", "items")).alias("meets"))
    kept = [c for c in keep if c not in ("doc_id", "text")]
    text = ["text"] if "text" in keep else []
    both = docs.select(_row(), "doc_id", "text", *kept).join(per_doc, "doc", "left").drop("doc")
    both = once(both, "words", words_of("text"))
    same = F.array_sort(F.filter(
        F.coalesce("meets", F.array().cast("array<struct<start:int,words:array<string>,items:array<string>>>")),
        lambda m: F.slice(F.col("words"), m["start"] + 1, F.size(m["words"])) == m["words"]))
    # used twice below, so it is computed in a step of its own
    both = once(both.select("doc_id", *text, *kept, F.size("words").cast("long").alias("n_words"), same.alias("same")), "found", F.col("same"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def grow(a: Column, m: Column) -> Column:
        end = m["start"] + F.size(m["words"])
        new = F.greatest(end - F.greatest(m["start"], a["end"]), F.lit(0))
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + new).alias("n"))

    return both.select(
        "doc_id", *text, *kept, "n_words", F.aggregate("found", zero, grow)["n"].alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda m: m["items"])))).alias("items"),
        F.transform("found", lambda m: F.struct(m["start"], F.size(m["words"]).alias("length"))).alias("hits"),
    )


def proximity_terms(items: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(item, term, needed): of each item the rarest distinct terms one of which every match must hold.

    ``needed`` is the share of all the item's distinct terms, rounded up. A stretch that lacks
    all of the ``terms - needed + 1`` rarest has fewer than ``needed``, so no match is missed.
    """
    words = once(items.select(F.col("item_id").cast("string").alias("item"), "text"), "words", words_of("text"))
    terms = words.select("item", F.explode("words").alias("term")).distinct()
    by_item = Window.partitionBy("item")  # an item's distinct terms: one benchmark text at most
    ranked = terms.join(counts, "term").select(
        "item", "term", F.row_number().over(by_item.orderBy("n", "term")).alias("rank"), F.count("*").over(by_item).alias("terms"))
    needed = F.greatest(F.ceil(F.col("terms") * share), F.lit(1)).cast("int")
    return ranked.select("item", "term", needed.alias("needed"), (F.col("rank") <= F.col("terms") - needed + 1).alias("anchor"))


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = 20, share: float = 0.6) -> DataFrame:
    """(doc_id, item, start, n_terms): every stretch of ``span`` words, beginning at a word of the item, that
    holds at least ``share`` of the item's distinct terms, in any order.

    Exact: places of the terms that every match must hold choose the regions, ``span`` words to either
    side, and within these the places of all the item's terms are counted. Items of one id are one
    item. Null and empty texts, of documents or items, match nothing; an item with more than ``span / share``
    distinct terms fits no stretch, and one without an id matches nothing. Rows alike in id and text are counted once, others each by their own
    text. Stretches that hold equally many terms are all returned.
    """
    words = items.select(F.explode(words_of("text")).alias("term"))
    chosen = stored(proximity_terms(items, term_counts(docs, words), share).where(F.col("needed") <= span), "proximity-terms")
    anchors = build_index(docs, chosen.where("anchor")).join(chosen.where("anchor"), "term")
    # regions in blocks of ``span`` places, so that they meet the other terms by equality; a region touches three at most
    block = F.floor(F.col("pos") / span)
    regions = stored(
        anchors.select("doc", "item", F.explode(F.sequence(block - 1, block + 1)).alias("block")).distinct(), "regions")
    near = docs.select(_row(), "text").join(regions.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    at = once(near, "words", words_of("text")).select("doc", F.posexplode("words").alias("pos", "term"))
    places = at.join(chosen.select("item", "term", "needed"), "term").withColumn("block", block).join(regions, ["doc", "item", "block"])
    # whole regions were kept, so a stretch that holds an anchor has all its places here; a partition is what
    # one text holds of one item, and a frame ``span`` places
    ahead = Window.partitionBy("doc", "item").orderBy("pos").rangeBetween(0, span - 1)
    found = places.withColumn("n_terms", F.size(F.collect_set("term").over(ahead))).where("n_terms >= needed")
    ids = docs.select(_row(), "doc_id").distinct()
    return found.join(ids, "doc").select("doc_id", "item", F.col("pos").alias("start"), F.col("n_terms").cast("long").alias("n_terms"))
