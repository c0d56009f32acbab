"""Personal data: fixed patterns, and candidates that boosted trees select.

Generators with high recall propose spans that may overlap; each candidate gets small whole-
number features of its format and its surroundings. Trees are boosted on all distinct
candidates, whose labels come from strict checks; thresholds are set per generator on a part of
them that the trees never saw, and the trees are compiled into CASE expressions. Spans are
found inside the row: matches are fenced by two control characters, the text is cut at them,
and offsets are sums of lengths. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.scalars import once
from vitalgrid.llm.quality_rules import let
from vitalgrid.session import stored

OPEN, CLOSE = "\x01", "\x02"
KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns; possessive forms of the same languages, so that long runs take linear time
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}"

GENERATORS = {
    "email": r"(?:\G|(?<![^\s@<>\x22\x27]))[^\s@<>\x22\x27]++@[^\s@<>\x22\x27]{2,}[^\s@<>\x22\x27.,;:!?()\[\]]",
    "number": r"[+(]?[0-9][0-9 ().-]{5,}[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
}
NAMES = tuple(GENERATORS)
LOCAL = r"^[\p{L}\p{M}0-9._%+-]+@"
DOMAIN = r"@[\p{L}\p{M}0-9-]+(?:\.[\p{L}\p{M}0-9-]+)*\.\p{L}{2,}$"
NATIONAL = r"^(?:\([0-9]{2,5}\)[ -]?|[0-9]{2,5}[ .-])[0-9]{2,5}(?:[ .-][0-9]{2,5})*$"
# what a candidate adds beside a base span inside it: the characters next to it, no words and no quotes
OUTER = r"^[\p{L}\p{M}0-9._%+-]*[\p{L}0-9][\p{L}\p{M}0-9._%+-]*$"
FEATURES = (
    "generator", "length", "digits", "letters", "separators", "dots", "plus", "hex", "capitals", "switches",
    "assigned", "quoted", "keyword", "ended", "luhn", "domain", "national",
)
BINS = 16
ROUNDS = 10
RATE = 0.5
RIDGE = 1.0
PRECISION = 0.95
AROUND = 24


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Sum of the values before each; block sums keep a list of k values below k * (block + k / block**2) steps."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), zero, add))
    starts = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(starts, lambda s: F.transform(values, lambda _, i: F.get(s, F.floor(i / block).cast("int")) + F.aggregate(
        F.slice(values, F.floor(i / block).cast("int") * block + 1, i % block), zero, add)))


def fenced(text: Column, pattern: str, around: int = 0) -> Column:
    """All matches, left to right: text, start and end in code points, and what stands before and after."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)

    def cut(p: Column) -> Column:
        lengths = F.transform(p, lambda x, i: (F.length(x) - F.when(i == 0, 0).otherwise(1)).cast("long"))
        return let(lengths, lambda n: let(prefix_sums(n), lambda at: F.transform(
            F.sequence(F.lit(1), F.size(p) - 1), lambda i: let(F.substring_index(F.get(p, i), CLOSE, 1), lambda m: F.struct(
                m.alias("text"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"),
                F.right(F.get(p, i - 1), F.lit(around)).alias("before"),
                F.left(F.substring_index(F.get(p, i), CLOSE, -1), F.lit(around)).alias("after"))))))

    kind = "array<struct<text:string,start:bigint,end:bigint,before:string,after:string>>"
    return let(parts, lambda p: F.when(F.size(p) > 1, cut(p)).otherwise(F.array().cast(kind)))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def weigh(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def _valid(kind: str, text: Column) -> Column:
    n = F.length(digits_of(text))
    if kind == "ip":
        return text.rlike(IP)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(text))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _passing(kind: str, matches: Column) -> Column:
    return F.filter(matches, lambda m: _valid(kind, m["text"]))


def fence_free(text: Column) -> Column:
    """The text with the two fences replaced by another control character, so that offsets stay."""
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, "\x03\x03")).otherwise(text)


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end) of the fixed patterns whose matches pass their checks, by kind, then start."""
    out = []
    for kind in KINDS:
        might = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            might = might & text.rlike("[0-9]")
        shaped = F.transform(_passing(kind, fenced(text, PATTERNS[kind])), lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))  # noqa: B023
        out.append(F.when(might, shaped).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    return F.concat(*out)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _features(name: str) -> Callable[[Column], Column]:
    """A generator's match as a candidate with its bins; every feature is a whole number below BINS."""
    return lambda m: _candidate(name, m)


def _candidate(name: str, m: Column) -> Column:
    text, before, after = m["text"], m["before"], m["after"]
    flag = lambda c: c.cast("int")
    n_digits = _count(text, "[0-9]")
    keyword = F.lit(0)
    for k, words in enumerate(("token|key|secret|passw|api", "mail|contact", "phone|tel|call|fax", "host|addr|server", "card|visa|pay"), 1):
        keyword = F.when(before.rlike(f"(?i)(?:{words})"), F.lit(k)).otherwise(keyword)
    bins = (
        F.lit(NAMES.index(name)), F.length(text) / 4, n_digits, _count(text, "[A-Za-z]") / 2, _count(text, "[ ()-]"),
        _count(text, r"\."), flag(text.startswith("+")), flag(text.rlike("^[0-9a-f]+$")), _count(text, "[A-Z]"),
        _count(F.regexp_replace(text, "(?<=[A-Za-z])(?=[0-9])", CLOSE), CLOSE),
        flag(before.rlike("[=:][^A-Za-z0-9]{0,3}$")), flag(before.rlike("[\\x22\\x27(<\\[]$")), keyword,
        flag((after == "") | after.rlike("^[\\s\\x22\\x27)>\\].,;!]")),
        F.when(n_digits.between(13, 19), flag(luhn(digits_of(text)))).otherwise(F.lit(0)),
        flag(text.rlike(DOMAIN)), flag(text.rlike(NATIONAL)),
    )
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), text.alias("text"),
                    F.array(*[F.least(F.floor(b).cast("int"), F.lit(BINS - 1)) for b in bins]).alias("bins"))


def candidates(text: Column) -> Column:
    """All proposals of all generators with their features; proposals may overlap."""
    out = []
    for name, pattern in GENERATORS.items():
        might = text.contains("@") if name == "email" else text.rlike("[0-9]")
        found = F.transform(fenced(text, pattern, AROUND), _features(name))
        out.append(F.when(might, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string,bins:array<int>>>")))
    return F.concat(*out)


def _label(c: Column) -> Column:
    """Labels for the fit, from format and what stands before: a whole address in any letters; a number that passes
    a check, or in groups after a word for phones or contact; a value given to a secret's name."""
    text, bins = c["text"], c["bins"]
    bin_of = lambda name: F.get(bins, FEATURES.index(name))
    n = F.length(digits_of(text))
    email = (bin_of("generator") == 0) & (bin_of("domain") == 1) & text.rlike(LOCAL)
    called = (bin_of("national") == 1) & n.between(7, 15) & bin_of("keyword").isin(2, 3)
    number = (bin_of("generator") == 1) & (
        text.rlike(IP) | (bin_of("luhn") == 1) | (text.startswith("+") & n.between(9, 15)) | called)
    secret = (bin_of("generator") == 2) & (bin_of("keyword") == 1) & (bin_of("assigned") == 1)
    return (email | number | secret).cast("double")


@dataclass(frozen=True)
class Tree:
    """Splits at the root and on both sides (feature, largest bin of the left side), and four leaves."""

    root: tuple[int, int]
    sides: tuple[tuple[int, int], tuple[int, int]]
    leaves: tuple[float, float, float, float]

    def value(self, bins: Column) -> Column:
        left = lambda s: F.get(bins, s[0]) <= s[1]
        a, b, c, d = map(F.lit, self.leaves)
        return F.when(left(self.root), F.when(left(self.sides[0]), a).otherwise(b)).otherwise(
            F.when(left(self.sides[1]), c).otherwise(d))


@dataclass(frozen=True)
class Selector:
    """The boosted trees and the least margin of each generator (none: it selects nothing)."""

    trees: tuple[Tree, ...] = ()
    start: float = 0.0
    least: tuple[float | None, ...] = (None,) * len(NAMES)

    def margin(self, bins: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.value(bins)
        return out

    def selects(self, bins: Column) -> Column:
        margin = self.margin(bins)
        out = F.lit(False)
        for k, least in enumerate(self.least):
            if least is not None:
                out = out | ((F.get(bins, 0) == k) & (margin >= least))
        return out


def _sums(rows: DataFrame, side: Column) -> dict[int, dict[tuple[int, int], tuple[float, float]]]:
    """Gradient and curvature by (side, feature, bin): a few hundred rows, whatever the number of candidates."""
    cells = rows.select(side.alias("side"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
    out: dict[int, dict] = {0: {}, 1: {}}
    for r in cells.groupBy("side", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[r["side"]][r["feature"], r["bin"]] = r["g"], r["h"]
    return out


def _split(cells: dict[tuple[int, int], tuple[float, float]]) -> tuple[tuple[int, int], float, float]:
    """The split with the largest gain, the earliest of equals, and both leaves."""
    gain = lambda g, h: g * g / (h + RIDGE)
    leaf = lambda g, h: RATE * g / (h + RIDGE)
    best = (-1.0, (0, BINS), 0.0, 0.0)
    for f in range(len(FEATURES)):
        total = [sum(v[k] for (f2, _), v in cells.items() if f2 == f) for k in (0, 1)]
        g = h = 0.0
        for b in range(BINS - 1):
            dg, dh = cells.get((f, b), (0.0, 0.0))
            g, h = g + dg, h + dh
            won = round(gain(g, h) + gain(total[0] - g, total[1] - h) - gain(*total), 9)
            if won > best[0] + 1e-9:
                best = (won, (f, b), round(leaf(g, h), 12), round(leaf(total[0] - g, total[1] - h), 12))
    return best[1:]


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Selector:
    """Boost on all distinct candidates, told apart by a hash of their text and features and counted by features.

    A quarter of them, by that hash, only sets the thresholds. Without candidates of both labels
    nothing is selected.
    """
    found = _prepared(docs).select(F.explode(candidates(F.col("clean"))).alias("c"))
    picked = found.select(_label(F.col("c")).alias("y"), F.col("c.bins").alias("bins"), F.xxhash64("c.text", "c.bins").alias("h"))
    cells = picked.dropDuplicates(["h"]).groupBy("y", "bins", (F.pmod("h", F.lit(4)) == 0).alias("held")).agg(F.count(F.lit(1)).alias("n"))
    every = stored(cells, "pii-candidates")
    train = every.where("NOT held")
    share = train.agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y")).first()["y"]
    if share is None or share in (0.0, 1.0):
        return Selector()
    share = min(max(share, 0.01), 0.99)
    model = Selector((), math.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin(F.col("bins"))))
        now = train.select("bins", ((F.col("y") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
        root = _split(_sums(now, F.lit(0))[0])[0]
        sides = _sums(now, (F.get("bins", root[0]) > root[1]).cast("int"))
        (a, al, ar), (b, bl, br) = _split(sides[0]), _split(sides[1])
        model = Selector((*model.trees, Tree(root, (a, b), (al, ar, bl, br))), model.start)
    return Selector(model.trees, model.start, _thresholds(every.where("held"), model))


def _thresholds(held: DataFrame, model: Selector) -> tuple[float | None, ...]:
    """Per generator the least margin from which on held-out candidates are right often enough; without ``n`` each row is one candidate."""
    held = held if "n" in held.columns else held.withColumn("n", F.lit(1))
    margin = F.floor(model.margin(F.col("bins")) * 4) / 4
    got = held.select(F.get("bins", 0).alias("k"), margin.alias("m"), (F.col("y") * F.col("n")).alias("y"), "n").groupBy("k", "m").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()
    out: list[float | None] = []
    for k in range(len(NAMES)):
        right = total = 0.0
        least = None
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: -r["m"]):
            right, total = right + r["y"], total + r["n"]
            if r["m"] >= 0 and right >= PRECISION * total:
                least = r["m"]
        out.append(least)
    return tuple(out)


def _prepared(docs: DataFrame, *keep: str) -> DataFrame:
    own = [c for c in keep if c != "text"]
    df = once(docs.select("doc_id", "text", *own), "clean", fence_free(F.coalesce("text", F.lit(""))))
    return df if "text" in keep else df.drop("text")


def _outside(c: Column, base: Column) -> Column:
    """A candidate's stretches that no base span covers: all of it, or, round base spans, those of its own characters."""
    zero = F.struct(c["start"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    gap = lambda a, end: F.when(end > a["at"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"))))).otherwise(a["out"])
    hits = F.array_sort(F.transform(
        F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    gaps = F.aggregate(
        hits, zero, lambda a, h: F.struct(F.greatest(a["at"], h["end"]).alias("at"), gap(a, h["start"]).alias("out")),
        lambda a: gap(a, c["end"]))
    whole = lambda g: (g["start"] == c["start"]) & (g["end"] == c["end"])
    return F.filter(gaps, lambda g: whole(g) | F.substring(
        c["text"], (g["start"] - c["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")).rlike(OUTER))


def _added(base: Column, proposed: Column, model: Selector) -> Column:
    """What selected candidates hold outside base spans; of stretches that overlap each other the earliest, longest stays."""
    chosen = F.array_sort(F.flatten(F.transform(
        F.filter(proposed, lambda c: model.selects(c["bins"])), lambda c: F.transform(
            _outside(c, base), lambda g: F.struct(g["start"].alias("start"), (-g["end"]).alias("back"), F.get(c["bins"], 0).alias("k"))))))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    names = F.array(*map(F.lit, NAMES))
    return F.aggregate(chosen, empty, lambda a, c: F.when(
        (F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] > c["start"]), a).otherwise(
        F.concat(a, F.array(F.struct(F.get(names, c["k"]).alias("kind"), c["start"].alias("start"), (-c["back"]).alias("end"))))))


def find(docs: DataFrame, model: Selector, *keep: str) -> DataFrame:
    """Per document ``base`` and ``spans``: (kind, start, end), code points, end exclusive; and the columns in ``keep``.

    Reads ``doc_id`` and whole ``text``. ``spans`` holds the base spans and those the model
    adds, by kind (email, ip, card, phone, number, secret), then start. Null and empty texts
    have none; repeated rows are searched each for itself.
    """
    df = once(_prepared(docs, *keep), "base", base_spans(F.col("clean")))
    if not any(x is not None for x in model.least):
        return df.select("doc_id", *keep, "base", F.col("base").alias("spans"))
    df = once(df, "added", let(candidates(F.col("clean")), lambda c: _added(F.col("base"), c, model)))
    everything = F.concat("base", "added")
    of_kind = lambda k: F.array_sort(F.filter(everything, lambda s: s["kind"] == k))
    return df.select("doc_id", *keep, "base", F.concat(*map(of_kind, (*KINDS, "number", "secret"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: Callable[[Column], Column] = lambda kind: F.concat(F.lit("<"), kind, F.lit(">"))) -> Column:
    """The text with every span replaced by its mask; of spans that overlap the earliest stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        piece = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["end"].alias("at"), F.concat(a["out"], F.array(piece, mask(s["kind"]))).alias("out")))

    def finish(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, zero, step, finish))
