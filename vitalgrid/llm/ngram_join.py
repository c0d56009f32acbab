"""Near duplicates by Jaccard similarity of word shingles, filtered under several token orders.

Two sets with similarity t share, under any order of all tokens, a token among the first
n - ceil(t n) + 1 of each (n: the set's size). Four orders are used. The first, by hash, needs no
statistics: a longer prefix of it must hold several tokens that other documents also have
there, which drops texts that only share a passage. The others put rare tokens first and
differ in how they break ties; documents are grouped by the components that shared prefix
tokens make under each order, and only documents together in all of them are compared.
Comparison is exact, by products of incidence matrices of bounded blocks. For the number of
links of each document all pairs of a group's blocks are compared; components alone need fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import exchange as ex
from vitalgrid.llm.components import components
from vitalgrid.llm.words import Words, flat, found, lists, mix, windows
from vitalgrid.session import stored

SHINGLE = 5
ORDERS = (11, 12, 13)
BLOCK = 256
PIVOTS = 32
COLUMNS = 4096
EXTRA = 10  # a tenth of the set's size lengthens the prefix of the first order


class Measure:
    """Similarity of at least part / whole, in whole numbers."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """Tokens that a set of n shares at least with any set it links to."""
        return -(-self.part * n // self.whole)

    def first_prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n - self.overlap(n) + np.maximum(1, n // EXTRA))

    def first_needed(self, n: np.ndarray) -> np.ndarray:
        """Shared tokens in the longer prefix; the partner may be smaller, and so may its share."""
        return np.maximum(1, self.overlap(n) // EXTRA)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.overlap(n) + 1


def _shingles(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin."""
    words = Words(column, lower=True)
    grams = windows(words.hashes, size, 5)
    out, counts = [], np.zeros(len(words.counts), np.int64)
    for i, (a, n) in enumerate(zip(words.first.tolist(), words.counts.tolist(), strict=False)):
        if n:
            own = grams[a : a + n - size + 1] if n >= size else windows(words.hashes[a : a + n], n, 5)
            out.append(np.unique(own))
            counts[i] = len(out[-1])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def _owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _rank(bounds: np.ndarray) -> np.ndarray:
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


def shingle_sets(docs: DataFrame, size: int, measure: Measure, sizes: ex.Sizes) -> DataFrame:
    """Per document its set's size and two sums that name the set; the set itself only where a partner is possible."""
    groups = ex.dealt(docs, sizes.chunks, "doc_id", "text").groupBy("chunk")
    bits = sizes.bits

    def send(table: pa.Table) -> pa.Table:
        hashes, bounds = _shingles(table["text"], size)
        n = np.repeat(np.diff(bounds), np.diff(bounds))
        some = _rank(bounds) < measure.first_prefix(n)
        return ex.send_narrow(table["chunk"][0].as_py(), hashes[some], _owners(bounds)[some], bits)

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, bounds = _shingles(table["text"], size)
        n, owner = np.diff(bounds), _owners(bounds)
        shared = np.zeros(len(hashes), bool)
        if len(answers):
            shared = found(ex.narrow(hashes, bits), ex.keyed(answers)[0])[0] & (_rank(bounds) < measure.first_prefix(n)[owner])
        keep = (np.bincount(owner[shared], minlength=len(n)) >= measure.first_needed(n)) & (n > 0)
        sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
        for k in (0, 1):
            np.add.at(sums[k], owner, mix(hashes, 21 + k))
        # of equal sets in a chunk one carries the tokens
        name = np.stack([*sums, n.astype(np.uint64)], 1)
        first = np.zeros(len(n), bool)
        first[np.unique(name, axis=0, return_index=True)[1] if len(n) else []] = True
        carried = keep & first
        kept = np.where(carried, n, 0)
        return pa.table({
            "doc_id": table["doc_id"], "n_shingles": pa.array(n, pa.int64()),
            "name_a": pa.array(sums[0].view(np.int64)), "name_b": pa.array(sums[1].view(np.int64)),
            "possible": pa.array(keep),
            "tokens": lists(hashes[carried[owner]].view(np.int64), np.concatenate(([0], np.cumsum(kept))), pa.int64()),
        })

    answers = ex.shared_narrow(groups.applyInArrow(send, ex.NARROW_SCHEMA))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(
        choose, f"doc_id {kind}, n_shingles bigint, name_a bigint, name_b bigint, possible boolean, tokens array<bigint>")


def _postings(sets: DataFrame, measure: Measure) -> DataFrame:
    """(ord, token, doc) for prefix tokens that another set also has, under each rare-first order."""
    spark = sets.sparkSession
    n = sets.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0
    sizes = ex.divide(spark, 8 * n, n)
    bits = sizes.bits
    groups = ex.chunked(sets, sizes.chunks, "doc", "tokens", key="doc").groupBy("chunk")

    def send(table: pa.Table) -> pa.Table:
        tokens = flat(table["tokens"])[0].view(np.uint64)
        keys, counts = np.unique(tokens, return_counts=True)
        return ex.packed(table["chunk"][0].as_py(), keys, bits, {"keys": (keys.view(np.int64), pa.int64()), "n": (counts, pa.int64())})

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, owner = flat(table["tokens"])
        tokens = tokens.view(np.uint64)
        df = np.ones(len(tokens), np.int64)
        if len(answers):
            hit, at = found(tokens, ex.keyed(answers)[0])
            df[hit] = ex.keyed(answers, "n")[1][at[hit]]
        n = np.bincount(owner, minlength=len(table))
        bounds = np.concatenate(([0], np.cumsum(n)))
        doc = table["doc"].to_numpy()
        out = []
        for order in ORDERS:
            by = np.lexsort((mix(tokens, order), df, owner))
            early = by[_rank(bounds) < measure.prefix(n)[owner[by]]]
            early = early[df[early] > 1]
            out.append((np.full(len(early), order, np.int32), tokens[early].view(np.int64), doc[owner[early]]))
        return pa.table(dict(zip(("ord", "token", "doc"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    answers = ex.totals(groups.applyInArrow(send, ex.TOTAL_SCHEMA), least=2)
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(prefixes, "ord int, token bigint, doc bigint")


def _groups(sets: DataFrame, measure: Measure) -> DataFrame:
    """doc -> grp: documents in one group share prefix tokens, in steps, under every order."""
    postings = stored(_postings(sets, measure), "postings")
    least = postings.groupBy("ord", "token").agg(F.min("doc").alias("least"))
    edges = postings.join(least, ["ord", "token"]).where("doc <> least").select("ord", F.col("doc").alias("a"), F.col("least").alias("b"))
    roots = components(edges, "ord")
    one = roots.groupBy(F.col("v").alias("doc")).agg(
        *[F.max(F.when(F.col("ord") == o, F.col("root"))).alias(f"r{o}") for o in ORDERS])
    # a document without a partner under one order has none at all
    one = one.where(F.expr(" AND ".join(f"r{o} IS NOT NULL" for o in ORDERS)))
    return one.select("doc", F.xxhash64(*[f"r{o}" for o in ORDERS]).alias("grp"))


def _links(tokens: np.ndarray, owner: np.ndarray, count: int, measure: Measure) -> np.ndarray:
    """Which of ``count`` sets link, from exact overlaps."""
    values, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
    place = np.cumsum(df > 1) - 1
    shared = df[inverse] > 1
    row, column = owner[shared], place[inverse[shared]]
    overlap = np.zeros((count, count), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((count, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        overlap += part @ part.T
    n = np.bincount(owner, minlength=count)
    overlap = np.rint(overlap).astype(np.int64)
    return measure.whole * overlap >= measure.part * (n[:, None] + n[None, :] - overlap)


def _forest(linked: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each set to the smallest of its component in the block."""
    label = np.arange(len(doc))
    while True:
        new = np.where(linked, label[None, :], len(doc)).min(1, initial=len(doc))
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(doc)))
    return doc[at], doc[label[at]]


EDGES = "a bigint, b bigint"


def _compare(rows: DataFrame, measure: Measure, by: str) -> DataFrame:
    """Links among the rows of each block (doc, root, tokens); sets known to be connected need no link."""

    def run(table: pa.Table) -> pa.Table:
        doc = table["doc"].to_numpy()
        root = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        order = np.argsort(doc)
        tokens, owner = flat(table["tokens"])
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc))
        linked = _links(tokens, rank[owner], len(doc), measure)
        root = root[order]
        linked |= root[:, None] == root[None, :]
        a, b = _forest(linked, doc[order])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(by).applyInArrow(run, EDGES)


def _blocked(sets: DataFrame) -> DataFrame:
    """Each group's sets in blocks of about BLOCK by a hash of the id, and its pivots."""
    size = sets.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    return sets.join(size, "grp").withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn(
        "pivot", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("members")) < PIVOTS)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, part: int = 75, whole: int = 100) -> DataFrame:
    """Per document the size of its shingle set and the smallest id reachable over links.

    Reads ``doc_id`` (a whole number) and ``text``. Two documents link when whole times the shingles in common reach
    part times those in either. A text under ``size`` words is one shingle; a null or empty
    text has none and links with nothing, so its component is its own id. Repeated rows are
    returned each; a null id keeps a null component and takes no part. Pairs of sets that are
    known to be connected are not compared; ``jaccard_links`` compares them too.
    """
    return _joined(docs, Measure(part, whole), size, every=False)


def jaccard_links(docs: DataFrame, size: int = SHINGLE, part: int = 75, whole: int = 100) -> DataFrame:
    """As ``jaccard_components``, and n_links, the exact number of other rows that each row links to.

    Rows with equal sets link to each other, repeated rows among them. A null id has null links.
    """
    return _joined(docs, Measure(part, whole), size, every=True)


def _joined(docs: DataFrame, measure: Measure, size: int, every: bool) -> DataFrame:
    spark = docs.sparkSession
    ex.small_batches(spark)
    known = docs.where(F.col("doc_id").isNotNull())
    sizes = ex.sizes(known, keys_per_byte=0.08)
    sets = stored(shingle_sets(known, size, measure, sizes), "shingle-sets")
    names = ["name_a", "name_b", "n_shingles"]
    classes = sets.where("possible").groupBy(*names).agg(
        F.count("*").alias("copies"), F.min("doc_id").cast("long").alias("first"), F.min(F.when(F.size("tokens") > 0, F.col("doc_id"))).alias("doc_id"))
    carriers = stored(
        sets.where(F.size("tokens") > 0).select("doc_id", "tokens", *names).join(classes, ["doc_id", *names])
        .dropDuplicates(names).select(F.col("first").alias("doc"), "name_a", "copies", "tokens"), "sets")
    grouped = stored(_blocked(carriers.join(_groups(carriers, measure), "doc")), "groups")
    if every:
        found_ = stored(_all_links(grouped, measure), "links")
        links = found_.where("b IS NOT NULL").select("a", "b")
        others = found_.where("b IS NULL").groupBy(F.col("a").alias("first"), "name_a").agg(F.sum("n").alias("others"))
        classes = classes.join(others, ["first", "name_a"], "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    else:
        links = stored(_first_links(grouped, measure), "links")
        known_roots = components(links)
        links = links.unionByName(stored(_other_links(grouped, known_roots, measure), "links"))
    roots = stored(components(links), "roots")
    # equal sets follow their class; both joins may meet one class with very many copies
    counted = ["n_links"] if every else []
    linked = classes.join(roots, classes["first"] == roots["v"], "left").select(
        *names, F.coalesce("root", "first").alias("component_id"), *counted)
    out = sets.select("doc_id", *names, "possible").join(linked.withColumn("possible", F.lit(True)), [*names, "possible"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", F.col("doc_id").cast("long")).alias("component_id"),
                     *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted])
    unknown = docs.where(F.col("doc_id").isNull())
    none = shingle_sets(unknown, size, measure, sizes).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"),
                                                          *[F.lit(None).cast("long").alias(c) for c in counted])
    return out.unionByName(none)


def _first_links(grouped: DataFrame, measure: Measure) -> DataFrame:
    """Links inside blocks; a few pivots stand in every block of their group and tie the blocks together."""
    own = grouped.where(~F.col("pivot") | (F.col("blocks") == 1)).select("grp", "block", "doc", "tokens")
    pivots = grouped.where(F.col("pivot") & (F.col("blocks") > 1)).select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "doc", "tokens")
    rows = own.unionByName(pivots).select(F.xxhash64("grp", "block").alias("cell"), "doc", F.col("doc").alias("root"), "tokens")
    return _compare(rows, measure, "cell")


def _other_links(grouped: DataFrame, roots: DataFrame, measure: Measure) -> DataFrame:
    """Links that the blocks could not see: sets outside their group's largest component meet all others once."""
    large = grouped.where("blocks > 1")
    with_root = large.join(roots.select(F.col("v").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    counts = with_root.groupBy("grp", "root").agg(F.count("*").alias("n"))
    major = counts.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("members"), F.max("n").alias("most"))
    rows = with_root.select("grp", "doc", "name_a", "root", "tokens", "blocks").join(major.where("most < members"), "grp")
    rows = rows.withColumn("queries", F.ceil((F.col("members") - F.col("most")) / BLOCK))
    query = rows.where("root <> major").withColumn("q", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("queries")))
    half = F.pmod(F.xxhash64("doc", F.lit(2)), F.col("blocks"))
    every = rows.withColumn("b", half)
    all_b = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b")
    all_q = F.explode(F.sequence(F.lit(0).cast("long"), F.col("queries") - 1)).alias("q")
    cells = query.select("grp", "q", all_b, "doc", "name_a", "root", "tokens").unionByName(
        every.select("grp", all_q, "b", "doc", "name_a", "root", "tokens"))
    rows = cells.select(F.xxhash64("grp", "q", "b").alias("cell"), "doc", "name_a", "root", "tokens").dropDuplicates(["cell", "doc", "name_a"])
    return _compare(rows, measure, "cell")


def _all_links(grouped: DataFrame, measure: Measure) -> DataFrame:
    """Every pair of a group's sets, compared once in the cell of their two blocks.

    Rows with a null ``b`` count, for a set, the documents of the sets it links to in the cell;
    the others are edges. A block travels as one row, so that rows grow with the blocks only.
    """
    of = F.pmod(F.xxhash64("doc", "name_a", F.lit(4)), F.col("blocks")).alias("block")
    one = grouped.where("blocks = 1").select(
        "grp", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("block"),
        F.array("doc").alias("doc"), F.array("name_a").alias("name_a"), F.array("copies").alias("copies"),
        F.array(F.size("tokens")).alias("sizes"), "tokens")
    packed = grouped.where("blocks > 1").select("grp", "blocks", of, F.struct("doc", "name_a", "copies", "tokens").alias("s")).groupBy(
        "grp", "blocks", "block").agg(F.collect_list("s").alias("s"))
    many = packed.select(
        "grp", "block", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(
        "grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
        F.col("s.doc").alias("doc"), F.col("s.name_a").alias("name_a"), F.col("s.copies").alias("copies"),
        F.transform("s.tokens", F.size).alias("sizes"), F.flatten("s.tokens").alias("tokens"))

    def run(table: pa.Table) -> pa.Table:
        doc, row = flat(table["doc"])
        name, copies, n = flat(table["name_a"])[0], flat(table["copies"])[0], flat(table["sizes"])[0]
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        block = table["block"].to_numpy()[row]
        # flat keeps the order of rows and of the sets within each
        linked = _links(flat(table["tokens"])[0], np.repeat(np.arange(len(doc)), n), len(doc), measure)
        if lo == hi:
            np.fill_diagonal(linked, False)
        else:
            linked &= block[:, None] != block[None, :]
        others = linked @ copies
        some = np.flatnonzero(others)
        order = np.argsort(doc, kind="stable")
        a, b = _forest(linked[np.ix_(order, order)], doc[order])
        nothing = np.zeros(len(a), np.int64)
        return pa.table({
            "a": pa.array(np.concatenate((doc[some], a)), pa.int64()), "name_a": pa.array(np.concatenate((name[some], nothing)), pa.int64()),
            "b": pa.array([None] * len(some) + b.tolist(), pa.int64()), "n": pa.array(np.concatenate((others[some], nothing)), pa.int64())})

    return one.unionByName(many).groupBy("grp", "lo", "hi").applyInArrow(run, "a bigint, name_a bigint, b bigint, n bigint")
