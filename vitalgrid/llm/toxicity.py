"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding maps homoglyphs and digit substitutions to plain letters and sets a space before each
word, so an entry " stem" matches at word starts only. Entries and weights are learned from
labelled rows: word starts that toxic texts hold much more often, weighted by log odds.
Words that begin like an entry, yet stand in clean texts no less often, become exception
phrases that cancel the matches they cover. The matched weight is divided by the length of
the text in words and turned into a score by a curve fitted to the labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.exchange import small_batches
from vitalgrid.session import stored

# fixed values: letters that look like Latin ones, and digits and signs written for letters
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнɡɑοαεικνρτυχ", "aeopcyxijsdhlkmtbhgaoaeiknptux", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

SAMPLE_ROWS = 20_000
STEMS = range(4, 11)
TWICE = "\t"  # marks a start that two words of a text share
MIN_DOCS = 4
MIN_SHARE = 0.005  # of the toxic texts, that an entry must be in
MIN_ODDS = math.log(8)
MAX_ENTRIES = 5_000
CURVE_STEPS = 400
_WORD = re.compile(r"[^\W_]+")
_LEET_SIGN = re.compile("[0-9@$!]")
_LEET_WORD = re.compile(r"(?<![\w@$!])[@$]?[^\W_]+(?:[@$!]+[^\W_]+)*")
_LEET = str.maketrans(LEET)
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "＀-￯\U0001d400-\U0001d7ff​-‍⁠﻿­]")
_HIDDEN = re.compile("[​-‍⁠﻿­]")


def fold(text: str) -> str:
    """Lower case words with look-alikes folded, each after one space; other signs go."""
    text = text.lower()
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower().translate(str.maketrans(HOMOGLYPHS))
    if _LEET_SIGN.search(text):
        text = _LEET_WORD.sub(lambda m: m[0] if m[0].isdigit() else m[0].translate(_LEET), text)
    return " " + " ".join(_WORD.findall(text)) + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (an exception has weight 0), and the curve from rate to score."""

    weights: dict[str, float]
    slope: float = 1.0
    middle: float = 1.0

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        out.make_automaton()
        return out


def rate(automaton: ahocorasick.Automaton, folded: str) -> tuple[float, int]:
    """Matched weight per root of length, and the number of matches; of matches with one start only the longest counts."""
    longest: dict[int, tuple[int, float]] = {}
    if len(automaton):
        for end, (size, weight) in automaton.iter(folded):
            start = end + 1 - size
            if start not in longest or longest[start][0] < size:
                longest[start] = size, weight
    total = sum(w for _, w in longest.values())
    n = folded.count(" ") - 1
    return (total / math.sqrt(max(n, 1) / 100 + 0.5) if total else 0.0), sum(w > 0 for _, w in longest.values())


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from the rows of ``sample``; without both labels it is empty and scores the share of label 1.

    Entries are counted in the tasks; the driver gets those that pass the odds, MAX_ENTRIES at
    most, their exceptions, and one matched weight per sampled row.
    """
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({}, 0.0, -_logit(n.get(1, 0) / sum(n.values()) if n else 0.0))
    least = max(MIN_DOCS, int(MIN_SHARE * n[1]))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))

    def starts(words: set[str]) -> set[str]:
        n = Counter(w[:k] for w in words for k in STEMS if len(w) >= k)
        return {*n, *(w for w in words if len(w) < STEMS[-1]), *(e + TWICE for e, k in n.items() if k > 1)}

    found = (
        _counted(rows, starts).where(F.col("n1") >= least).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
        .orderBy(F.desc(F.col("odds") * F.log1p("n1")), "entry").limit(MAX_ENTRIES).collect()
    )
    weighed: dict[str, float] = {}
    for r in found:  # what two words with one start tell is shared by both
        entry, odds_ = (r["entry"][:-1], r["odds"] / 2) if r["entry"].endswith(TWICE) else (r["entry"], r["odds"])
        weighed[entry] = max(odds_, weighed.get(entry, 0.0))
    entries: dict[str, float] = {}
    for e in sorted(weighed, key=lambda e: (len(e), e)):  # a longer entry must say more than its own start
        if not any(entries.get(e[:k], -math.inf) + 0.7 >= weighed[e] for k in range(len(e))):
            entries[e] = weighed[e]

    def like_entries(words: set[str]) -> set[str]:
        return {w for w in words if any(w[:k] in entries for k in range(1, len(w) + 1))}

    exceptions = (
        _counted(rows, like_entries).where((F.col("n0") >= least) & (odds < math.log(2)))
        .orderBy(F.desc("n0"), "entry").limit(MAX_ENTRIES).collect()
    )
    weights = {f" {e}": w for e, w in entries.items()} | {f" {r['entry']} ": 0.0 for r in exceptions}
    got = _rates(rows, Lexicon(weights)).collect()  # two numbers for each sampled row
    return Lexicon(weights, *_curve(np.array([r["rate"] for r in got]), np.array([r["y"] for r in got])))


def _counted(rows: DataFrame, entries_of: Callable[[set[str]], set[str]]) -> DataFrame:
    """For each entry the number of texts of either label that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update(entries_of(set(text.split())))
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["entry", "n0", "n1"])

    parts = rows.mapInArrow(run, "entry string, n0 bigint, n1 bigint")
    return parts.groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _rates(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [rate(automaton, t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column(1)], ["rate", "y"])

    return rows.mapInArrow(run, "rate double, y int")


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve, by Newton steps with a small ridge."""
    scale = max(float(x.max()), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(CURVE_STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(-w[1])


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Folded labelled texts for fitting: at most ``rows`` labels, chosen by a hash of the id, each text once per label.

    Only the fit reads this sample; it and the scoring read whole texts. Rows without a label
    or id are not used.
    """
    small_batches(docs.sparkSession)
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [fold(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(folded, pa.string()), batch.column(1)], ["folded", "y"])

    # ``rows`` ids and labels, some hundred kilobytes whatever the input
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y").mapInArrow(run, "folded string, y int")
    return stored(got.distinct(), "toxic-sample")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document ``score`` from 0 to 1 and ``n_matches``. Null and empty texts have no match and get the curve's lowest score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [rate(automaton, fold(t or "")) for t in batch.column(1).to_pylist()]
            z = lexicon.slope * np.array([r for r, _ in got]) - lexicon.middle
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-z))), pa.array([n for _, n in got], pa.int64())],
                ["doc_id", "score", "n_matches"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_matches bigint")
