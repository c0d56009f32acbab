"""Near duplicates by fast similarity sketches, bands and exact verification.

A sketch has T coordinates. In round i every element of a set is thrown into one bin by a hash
of the round and offers i + (a hash in [0, 1)); a bin keeps its smallest offer. A set stops when
all its bins are filled, which takes about T ln T throws in all; from round T on, round i throws
everything into bin i - T, so that none stays empty. Two sets agree in a coordinate with the
probability of their similarity, and the share of equal coordinates is as concentrated as with
independent draws. BANDS x ROWS coordinates make band keys: sets with similarity 0.8 miss each
other in all bands once in 4 x 10^7 pairs.

Sets that share a band key are verified on their full sets, in steps that never list all pairs
of a key: first all against the smallest id of the key; then, where a key still joins sets of
several components, the sets outside a group's largest component against the whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import exchange as ex
from vitalgrid.llm.components import components
from vitalgrid.llm.ngram_join import Measure, _compare
from vitalgrid.llm.words import Words, flat, found, lists, mix, windows
from vitalgrid.session import stored

SHINGLE = 4
BANDS, ROWS = 96, 8
T = BANDS * ROWS
CELL_SETS, CELL_TOKENS = 256, 1 << 21
TEXT_BYTES = 1 << 20
SLICE_SETS, SLICE_TOKENS = 256, 1 << 18
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
HEAVY = 1000  # classes with more than this part of all rows are at most this many
NAME = ["name_a", "name_b", "n_shingles"]


def sketches(tokens: np.ndarray, bounds: np.ndarray, t: int = T) -> np.ndarray:
    """One row of ``t`` coordinates per set of distinct 64-bit tokens; an empty set's stay EMPTY."""
    n = len(bounds) - 1
    out = np.full(n * t, EMPTY, np.uint64)
    rows = out.reshape(n, t)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    unfilled = np.unique(owner)
    for i in range(2 * t):
        if not len(unfilled):
            break
        h = mix(tokens, 1000 + i)
        offer = (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, offer)
        full = (rows[unfilled] != EMPTY).all(1)
        if full.any():
            unfilled = unfilled[~full]
            going = np.zeros(n, bool)
            going[unfilled] = True
            going = going[owner]
            tokens, owner = tokens[going], owner[going]
    return rows


def band_keys(tokens: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One row of ``bands`` keys per set; sets of like size are sketched together."""
    size = np.diff(bounds)
    out = np.zeros((len(size), bands), np.uint64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        upto = np.searchsorted(np.cumsum(size[order[at : at + SLICE_SETS]]), SLICE_TOKENS, "right")
        some = order[at : at + max(1, int(upto))]
        at += len(some)
        own = np.concatenate([tokens[bounds[i] : bounds[i + 1]] for i in some])
        sketch = sketches(own, np.concatenate(([0], np.cumsum(size[some]))), bands * rows).reshape(len(some), bands, rows)
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(some), 1))
        for r in range(rows):
            key = key * np.uint64(0xD6E8FEB86659FD93) + sketch[:, :, r]
        out[some] = mix(key, 77)
    return out


def shingle_tokens(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and where each text's begin; texts are hashed about a megabyte at a time."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    length = np.array([0 if v is None else v for v in pa.compute.binary_length(column).to_pylist()], np.int64)
    out, counts, at = [], np.zeros(len(length), np.int64), 0
    while at < len(length):
        upto = at + max(1, int(np.searchsorted(np.cumsum(length[at:]), TEXT_BYTES, "right")))
        words = Words(column.slice(at, upto - at), lower=True)
        grams = windows(words.hashes, size, 5)
        for i, (a, n) in enumerate(zip(words.first.tolist(), words.counts.tolist(), strict=False)):
            if n:
                own = grams[a : a + n - size + 1] if n >= size else windows(words.hashes[a : a + n], n, 5)
                out.append(np.unique(own))
                counts[at + i] = len(out[-1])
        at = upto
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def sketched_sets(docs: DataFrame, size: int, sizes: ex.Sizes) -> DataFrame:
    """Per row its set's size and name; where another row has one of its band keys also ``keys``, those
    keys, and, for the first of equal sets in a chunk, ``tokens``."""
    groups = ex.dealt(docs, sizes.chunks, "doc_id", "text").groupBy("chunk")
    bits = sizes.bits

    def send(table: pa.Table) -> pa.Table:
        tokens, bounds = shingle_tokens(table["text"], size)
        some = np.flatnonzero(np.diff(bounds))
        keys = band_keys(tokens, bounds)[some]
        return ex.send_narrow(table["chunk"][0].as_py(), keys.ravel(), np.repeat(some, BANDS), bits)

    def choose(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, bounds = shingle_tokens(table["text"], size)
        n, owner = np.diff(bounds), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = band_keys(tokens, bounds)
        shared = np.zeros(keys.shape, bool)
        if len(answers):
            shared = found(ex.narrow(keys.ravel(), bits), ex.keyed(answers)[0])[0].reshape(keys.shape)
        shared &= (n > 0)[:, None]
        sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
        for k in (0, 1):
            np.add.at(sums[k], owner, mix(tokens, 31 + k))
        first = np.zeros(len(n), bool)
        first[np.unique(np.stack([*sums, n.astype(np.uint64)], 1), axis=0, return_index=True)[1] if len(n) else []] = True
        carried = shared.any(1) & first
        upto = lambda c: np.concatenate(([0], np.cumsum(c)))
        return pa.table({
            "doc_id": table["doc_id"], "n_shingles": pa.array(n, pa.int64()),
            "name_a": pa.array(sums[0].view(np.int64)), "name_b": pa.array(sums[1].view(np.int64)), "possible": pa.array(shared.any(1)),
            "keys": lists(keys[carried][shared[carried]].view(np.int64), upto(np.where(carried, shared.sum(1), 0)), pa.int64()),
            "tokens": lists(tokens[carried[owner]].view(np.int64), upto(np.where(carried, n, 0)), pa.int64()),
        })

    answers = ex.shared_narrow(groups.applyInArrow(send, ex.NARROW_SCHEMA))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(
        choose, f"doc_id {kind}, n_shingles bigint, name_a bigint, name_b bigint, possible boolean, keys array<bigint>, tokens array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Of pairs (a, b: structs of set, doc, carrier and n) those whose full sets link; each ``a`` meets its ``b`` in cells of bounded size."""
    weight = pairs.groupBy(F.col("a.set").alias("hub_set")).agg(
        F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("b.n") / CELL_TOKENS)).alias("cells"))
    dealt = pairs.withColumn("hub_set", F.col("a.set")).join(weight, "hub_set").select(
        "hub_set", F.pmod(F.xxhash64("b.set"), F.col("cells")).alias("cell"), "a", "b")
    # members and hubs fetch their tokens in one join
    wanted = dealt.select("hub_set", "cell", F.lit(False).alias("hub"), "b.*").unionByName(
        dealt.select("hub_set", "cell", F.lit(True).alias("hub"), "a.*").distinct())
    rows = wanted.join(sets, ["set", "carrier"]).select("hub_set", "cell", "hub", "doc", "tokens")

    def run(table: pa.Table) -> pa.Table:
        tokens, owner = flat(table["tokens"])
        doc, hub = table["doc"].to_numpy(), int(np.flatnonzero(table["hub"].to_numpy())[0])
        n = np.bincount(owner, minlength=len(doc))
        overlap = np.bincount(owner[found(tokens, np.sort(tokens[owner == hub]))[0]], minlength=len(doc))
        linked = measure.whole * overlap >= measure.part * (n + n[hub] - overlap)
        linked[hub] = False
        b = doc[linked]
        return pa.table({"a": pa.array(np.full(len(b), doc[hub]), pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("hub_set", "cell").applyInArrow(run, "a bigint, b bigint")


def _rest(postings: DataFrame, roots: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Links that verification against the hubs could not see.

    Keys whose other members lie in several components tie their sets into groups; the sets outside a
    group's largest component then meet the whole group, block by block.
    """
    root = roots.select(F.col("v").alias("doc"), "root")
    placed = postings.select("key", F.col("a.set").alias("hub"), "b.*").join(root, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    split = placed.where("set <> hub").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_ = stored(placed.join(split, "key").drop("key").distinct(), "open-keys")
    groups = components(open_.where("set <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b")))
    members = stored(open_.drop("hub").distinct().join(groups.select(F.col("v").alias("set"), F.col("root").alias("grp")), "set"), "open-groups")
    by_root = members.groupBy("grp", "root").agg(F.count("*").alias("count"), F.sum("n").alias("tokens"))
    total = by_root.groupBy("grp").agg(
        F.max_by("root", F.struct("count", "root")).alias("major"), F.max("count").alias("most"), F.sum("count").alias("members"), F.sum("tokens").alias("tokens"))
    load = lambda part: F.greatest(F.lit(1), F.ceil(part / CELL_SETS), F.ceil(F.col("tokens") * part / F.col("members") / CELL_TOKENS))
    rows = members.join(total.where("most < members"), "grp").select(
        "grp", "set", "carrier", "doc", "root", (F.col("root") != F.col("major")).alias("outside"),
        load(F.col("members")).alias("blocks"), load(F.col("members") - F.col("most")).alias("queries"))
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    block = F.pmod(F.xxhash64("set", F.lit(2)), F.col("blocks"))
    query = F.pmod(F.xxhash64("set", F.lit(1)), F.col("queries"))
    asked = rows.where("outside").select("grp", "set", "carrier", "doc", "root", query.alias("q"), up_to("blocks").alias("b"))
    every = rows.select("grp", "set", "carrier", "doc", "root", up_to("queries").alias("q"), block.alias("b"))
    cells = asked.unionByName(every).select(F.xxhash64("grp", "q", "b").alias("cell"), "set", "carrier", "doc", "root").distinct()
    return _compare(cells.join(sets, ["set", "carrier"]).select("cell", "doc", "root", "tokens"), measure, "cell")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, part: int = 80, whole: int = 100) -> DataFrame:
    """Per row ``n_shingles``, the size of its shingle set, and ``component_id``, the smallest id reachable over links.

    Reads ``doc_id`` (a whole number) and ``text``. Texts are lower-cased in A-Z; words are maximal
    runs without space and 0x09-0x0D. Two rows link when ``whole`` times the shingles in common reach
    ``part`` times those in either; no link counts unless the full sets confirm it. A text under ``size``
    words is one shingle; a null or empty text has none and its component is its own id. Equal sets
    are one class and follow their smallest id; repeated rows are returned each. Rows that share an id
    are one vertex. A null id takes no part and keeps a null component.
    """
    spark = docs.sparkSession
    ex.small_batches(spark)
    measure = Measure(part, whole)
    known = docs.where(F.col("doc_id").isNotNull())
    total = known.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    sizes = ex.divide(spark, total["bytes"] or 0, BANDS * total["rows"])
    rows = stored(sketched_sets(known, size, sizes), "sketched")
    # a class is named by its smallest id; its set is read where the carrier, one of its rows, has it
    carrier = F.when(F.size("tokens") > 0, F.col("doc_id"))
    classes = stored(rows.where("possible").groupBy(*NAME).agg(
        F.count("*").alias("copies"), F.min("doc_id").cast("long").alias("doc"), F.min(carrier).cast("long").alias("carrier"),
        F.min_by("keys", carrier).alias("keys"),
    ).withColumn("set", F.xxhash64(*NAME)), "set-classes")
    sets = rows.where(F.size("tokens") > 0).select(F.xxhash64(*NAME).alias("set"), F.col("doc_id").cast("long").alias("carrier"), "tokens")
    member = F.struct("set", "carrier", "doc", F.col("n_shingles").alias("n")).alias("b")
    postings = classes.select(F.explode("keys").alias("key"), "set", "carrier", "doc", "n_shingles").select("key", member)
    # the member with the smallest id is the hub of its key
    hubs = postings.groupBy("key").agg(F.min_by("b", F.struct("b.doc", "b.set")).alias("a"), F.count("*").alias("m")).where("m > 1")
    postings = stored(postings.join(hubs, "key").select("key", "a", "b"), "band-postings")
    near = whole * F.least("a.n", "b.n") >= part * F.greatest("a.n", "b.n")
    pairs = stored(postings.where("a.set <> b.set").where(near).select("a", "b").distinct(), "hub-pairs")
    links = stored(_verified(pairs, sets, measure), "hub-links")
    roots = components(links)
    links = links.unionByName(stored(_rest(postings, roots, sets, measure), "other-links"))
    roots = stored(components(links), "roots")
    placed = classes.join(roots, classes["doc"] == roots["v"], "left").select(*NAME, F.coalesce("root", "doc").alias("root"), "copies")
    placed = stored(placed.where("copies > 1 OR root <> doc"), "placed")
    return _followed(rows.select("doc_id", *NAME), placed, total["rows"]).unionByName(_unknown(docs, size, sizes))


def _followed(rows: DataFrame, placed: DataFrame, count: int) -> DataFrame:
    """Rows beside their class's root. The few classes with very many rows are broadcast, the others joined."""
    heavy = F.col("copies") * HEAVY > count
    most = F.broadcast(placed.where(heavy).select(*NAME, F.col("root").alias("heavy_root")))
    rest = placed.where(~heavy).select(*NAME, "root")
    first = rows.join(most, NAME, "left")
    done = first.where("heavy_root IS NOT NULL").withColumnRenamed("heavy_root", "root")
    out = done.unionByName(first.where("heavy_root IS NULL").drop("heavy_root").join(rest, NAME, "left"))
    return out.select("doc_id", "n_shingles", F.coalesce("root", F.col("doc_id").cast("long")).alias("component_id"))


def _unknown(docs: DataFrame, size: int, sizes: ex.Sizes) -> DataFrame:
    """Rows without an id: sizes only."""

    def run(batches):
        for batch in batches:
            bounds = shingle_tokens(pa.chunked_array([batch.column(1)]), size)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.nulls(batch.num_rows, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("doc_id").isNull()).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, component_id bigint")
