"""Ranked lexical search over K2-treaps of the term-document grid.

The documents of a task are taken in runs of some megabytes; each run becomes one shard. A
shard's grid has a row per term, frequent ones first, and a column per document; a cell with a
posting holds the term's impact there, without the term's weight. The grid is cut into square
quadtrees (K = 4: sixteen children a cell) that share their columns. Only cells with postings
exist: level by level a bitmap of each one's children and the drop of its largest impact below
its parent's, so places of children follow by counting bits.

A query descends the paths of all its terms together. A range of documents is bounded by the sum
of weight x largest impact over the cells its terms reach; ranges are opened best first, some at
a time, and left when the bound is below the k-th score found so far, in this shard or in an
earlier one of the same task. Scores are whole numbers, so the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm import exchange as ex
from vitalgrid.llm.words import Words, found
from vitalgrid.session import stored

SHARD_BYTES = 8 << 20
ITEM_BYTES = 4 << 20  # of query texts that travel with the tasks at once
WAVE = 64  # ranges opened together
TOP = 20

_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[65:91] = _PARTS[97:123] = _PARTS[128:] = False
_ONES = np.array([i.bit_count() for i in range(1 << 16)], np.int64)

SHARD = (
    "docs array<bigint>, terms array<bigint>, dfs array<int>, levels array<int>, kids binary, low binary, middle binary, high binary")


def _terms(column: pa.Array) -> Words:
    """ASCII letters and digits and everything beyond ASCII; A-Z lower-cased."""
    return Words(column, lower=True, space=_PARTS)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows (doc_id, text) gathered to about ``most`` bytes of text; a longer text is a run of its own."""
    held, size = [], 0
    for batch in batches:
        length = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(size + np.cumsum(length[at:]), most, "right"))
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(at, n))
                size += int(length[at : at + n].sum())
                at += n
            if at < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for table in _runs(batches, SHARD_BYTES):
            counts = _terms(table["text"]).counts
            n, total = n + int((counts > 0).sum()), total + int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    row = docs.select("doc_id", "text").mapInArrow(run, "n bigint, total bigint").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def _height(columns: int) -> int:
    h = 1
    while 4**h < columns:
        h += 1
    return h


def _codes(rows: np.ndarray, columns: np.ndarray, h: int) -> np.ndarray:
    """The quadtree's number, then the digits of row and column from the top, four bits a level."""
    code = rows >> (2 * h)
    for level in range(h - 1, -1, -1):
        code = (code << 4) | (((rows >> (2 * level)) & 3) << 2) | ((columns >> (2 * level)) & 3)
    return code


def build_shard(ids: np.ndarray, words: Words, n_docs: int, n_terms: int) -> dict:
    """The K2-treaps of one run of documents."""
    # a document without terms has no column
    some = np.flatnonzero(words.counts)
    hashes, row = np.unique(words.hashes, return_inverse=True)
    column = np.repeat(np.arange(len(some)), words.counts[some])
    cell, tf = np.unique(row * len(some) + column, return_counts=True)
    row, column = cell // len(some), cell % len(some)
    df = np.bincount(row, minlength=len(hashes))
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    m = 75 + (25 * words.counts[some].astype(np.int64) * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[column])
    h = _height(len(some))
    codes = _codes(place[row], column, h)
    by = np.argsort(codes)
    codes, best = codes[by], impact[by]
    kids, drops, levels = [], [], [len(codes)]
    for _ in range(h):
        first = np.flatnonzero(np.diff(codes >> 4, prepend=-1))
        top = np.maximum.reduceat(best, first)
        drops.append(np.repeat(top, np.diff(np.append(first, len(codes)))) - best)
        kids.append(np.bitwise_or.reduceat(1 << (codes & 15), first))
        codes, best = codes[first] >> 4, top
        levels.append(len(codes))
    drop = np.concatenate([best, *drops[::-1]]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return {
        "docs": ids[some], "terms": hashes[order].view(np.int64), "dfs": df[order], "levels": levels[::-1],
        "kids": np.concatenate(kids[::-1]).astype("<u2").tobytes(),
        "low": drop[:, 0].tobytes(), "middle": drop[:, 1].tobytes(), "high": drop[:, 2].tobytes(),
    }


def index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row per shard of the term-document grid, over every document with a term.

    Reads doc_id (a whole number) and whole text. Null and empty texts have no terms and no column; a
    null id is kept as the largest number. Repeated rows are columns each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, SHARD_BYTES):
            words = _terms(table["text"])
            if len(words.hashes):
                shard = build_shard(ex.ids(table["doc_id"]), words, n_docs, n_terms)
                yield pa.RecordBatch.from_pydict({k: pa.array([v], _KINDS[k]) for k, v in shard.items()})

    ex.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD)


_KINDS = {
    "docs": pa.list_(pa.int64()), "terms": pa.list_(pa.int64()), "dfs": pa.list_(pa.int32()), "levels": pa.list_(pa.int32()),
    **{k: pa.binary() for k in ("kids", "low", "middle", "high")},
}


class Treap:
    """A shard opened for search."""

    def __init__(self, shard: dict):
        self.docs = shard["docs"]
        self.terms = shard["terms"]
        self.by_term = np.argsort(self.terms)
        levels = shard["levels"]
        self.h = len(levels) - 1
        self.kids = np.frombuffer(shard["kids"], "<u2").astype(np.int64)
        ones = _ONES[self.kids]
        self.first = levels[0] + np.concatenate(([0], np.cumsum(ones)))[:-1]
        planes = [np.frombuffer(shard[k], np.uint8).astype(np.int64) for k in ("low", "middle", "high")]
        best = planes[0] | planes[1] << 8 | planes[2] << 16
        starts = np.concatenate(([0], np.cumsum(levels)))
        for level in range(self.h):
            a, b, c = starts[level : level + 3]
            best[b:c] = np.repeat(best[a:b], ones[a:b]) - best[b:c]
        self.best = best
        # leaves have no children
        self.kids = np.concatenate((self.kids, np.zeros(levels[-1], np.int64)))
        self.first = np.concatenate((self.first, np.zeros(levels[-1], np.int64)))

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """Row of each term, -1 where the shard has none."""
        hit, at = found(terms, self.terms[self.by_term])
        return np.where(hit, self.by_term[at], -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (scores, ids) and this shard's documents; larger scores, then smaller ids first."""
        nodes = rows >> (2 * self.h)
        heap = [(-int((weights * self.best[nodes]).sum()), 0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64), nodes[None, :])]
        heap[0][3][0] = -heap[0][0]
        made = 1
        while heap:
            least = int(scores[-1]) if len(scores) == k else 1
            bound, _, level, bounds, start, nodes = heapq.heappop(heap)
            if -bound < max(1, least):
                break
            if len(bounds) > WAVE:
                heapq.heappush(heap, (-int(bounds[WAVE]), made, level, bounds[WAVE:], start[WAVE:], nodes[WAVE:]))
                made += 1
                bounds, start, nodes = bounds[:WAVE], start[:WAVE], nodes[:WAVE]
            ok = bounds >= max(1, least)
            start, nodes = start[ok], nodes[ok]
            shift = 2 * (self.h - 1 - level)
            slot = ((rows >> shift) & 3) << 2
            there = nodes >= 0
            kids = np.where(there, self.kids[nodes], 0)
            first = self.first[nodes]
            new_bounds, new_nodes = [], []
            for j in range(4):
                has = (kids >> (slot + j)) & 1 > 0
                child = np.where(has, first + _ONES[kids & ((1 << (slot + j)) - 1)], -1)
                new_bounds.append((np.where(has, self.best[child], 0) * weights).sum(1))
                new_nodes.append(child)
            bounds = np.concatenate(new_bounds)
            start = np.concatenate([4 * start + j for j in range(4)])
            keep = np.flatnonzero(bounds >= max(1, least))
            if not len(keep):
                continue
            if level + 1 == self.h:
                scores = np.concatenate((scores, bounds[keep]))
                ids = np.concatenate((ids, self.docs[start[keep]]))
                by = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[by], ids[by]
            else:
                keep = keep[np.argsort(-bounds[keep], kind="stable")]
                heapq.heappush(heap, (-int(bounds[keep[0]]), made, level + 1, bounds[keep], start[keep], np.concatenate(new_nodes)[keep]))
                made += 1
        return scores, ids


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                value = column[i]
                one[name] = value.as_buffer() if pa.types.is_binary(column.type) else value.values.to_numpy()
            yield one


def _items(queries: DataFrame, blocks: int) -> DataFrame:
    """Distinct (item_id, text) with their terms, dealt into blocks."""
    kind = queries.schema["item_id"].dataType.simpleString()
    rows = queries.select("item_id", "text").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    rows = rows.select("item_id", "text", "key", F.pmod("key", F.lit(blocks)).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _terms(batch.column(1))
            own = [words.hashes[a:b].view(np.int64) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(own, pa.list_(pa.int64()))], ["item_id", "key", "block", "terms"])

    return rows.mapInArrow(run, f"item_id {kind}, key bigint, block int, terms array<bigint>")


def _document_counts(shards: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the terms of a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for one in _opened(batches):
            hit, at = found(one["terms"].view(np.uint64), terms)
            np.add.at(total, at[hit], one["dfs"][hit])
        yield pa.RecordBatch.from_pydict({"term": terms.view(np.int64), "df": total})

    rows = shards.select("terms", "dfs").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r["term"]: r["df"] for r in rows}


def search(shards: DataFrame, n_docs: int, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For each query item the k documents with the highest score above 0: item_id, rank, doc_id, score.

    Reads item_id and text of ``queries``. Each distinct (item_id, text) is an item; null texts and texts
    without terms find nothing. Equal scores go by ascending doc_id, documents without an id last. Queries
    travel to the tasks in blocks of about ITEM_BYTES of text, one pass over the index for each.
    """
    size = queries.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = size // ITEM_BYTES + 1
    items = stored(_items(queries, blocks), "search-items")
    out = None
    for block in range(blocks):
        found_ = _block(shards, n_docs, items.where(F.col("block") == block), k)
        out = found_ if out is None else out.unionByName(found_)
    last = Window.partitionBy("item_id", "key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block(shards: DataFrame, n_docs: int, items: DataFrame, k: int) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    rows = sorted(((r["item_id"], r["key"], np.array(r["terms"], np.int64)) for r in items.collect() if r["terms"]), key=lambda r: r[1])
    terms = np.unique(np.concatenate([r[2].view(np.uint64) for r in rows])) if rows else np.zeros(0, np.uint64)
    df = _document_counts(shards, terms) if rows else {}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(int(t), 0) + 1))) for t in terms.view(np.int64)], np.int64)
    asked = []
    for item_id, key, own in rows:
        values, times = np.unique(own.view(np.uint64), return_counts=True)
        at = np.searchsorted(terms, values)
        asked.append((item_id, key, at, times * weight[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for one in _opened(batches):
            treap = Treap(one | {"terms": one["terms"].view(np.uint64)})
            row = treap.rows(terms)
            for i, (_, _, at, weights) in enumerate(asked):
                own = row[at]
                here = (own >= 0) & (weights > 0)
                if here.any():
                    best[i] = treap.search(own[here], weights[here], *best[i], k)
        counts = [len(s) for s, _ in best]
        if sum(counts):
            spread = lambda values, kind_: pa.array([v for v, n in zip(values, counts, strict=True) for _ in range(n)], kind_)
            ids = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays(
                [spread([a[0] for a in asked], arrow_kind), spread([a[1] for a in asked], pa.int64()),
                 pa.array(ids, pa.int64(), mask=ids == ex.NO_ID), pa.array(np.concatenate([s for s, _ in best]), pa.int64())],
                ["item_id", "key", "doc_id", "score"])

    return shards.mapInArrow(run, f"item_id {kind}, key bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` over a new index of all ``docs``, stored in the shared folder."""
    n_docs, n_terms = corpus_size(docs)
    return search(stored(index(docs, n_docs, max(1, n_terms)), "search-index"), n_docs, queries, k)
