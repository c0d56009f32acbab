"""Removal of repeated passages, found over difference-cover anchors.

Positions modulo 7 that lie in the cover {1, 2, 4} are anchors: for any two positions some
shift below 7 moves both into the cover. An anchor is the hash of 7 words, so two equal
windows of 13 words hold an equal anchor at the same shift, although only 3 of 7 positions
are hashed. Anchors that two documents hold are extended to the windows around them; each
window then learns the smallest document that has it.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalgrid.llm import exchange as ex
from vitalgrid.llm.words import Words, flat, found, lists, windows

PERIOD = 7
COVER = (1, 2, 4)  # every difference modulo 7 is one between two of these


def _anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in the chunk's words, and their hashes."""
    length = size - PERIOD + 1
    place = words.places()
    count = np.repeat(words.counts, words.counts)
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + length <= count) & (count >= size))
    hashes = windows(words.hashes, length, 1)
    return at, hashes[at] if len(at) else np.zeros(0, np.uint64)


def _extended(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """First words of all windows that hold one of the anchors."""
    n = len(words.hashes)
    steps = np.zeros(n + 1, np.int64)
    first = np.repeat(words.first[:-1], words.counts)
    np.add.at(steps, np.maximum(at - PERIOD + 1, first[at]), 1)
    np.add.at(steps, at + 1, -1)
    fits = words.places() + size <= np.repeat(words.counts, words.counts)
    return np.flatnonzero((np.cumsum(steps[:n]) > 0) & fits)


def repeated_passages(docs: DataFrame, size: int = 13, sizes: ex.Sizes | None = None) -> DataFrame:
    """Per document its words but for those in passages that a smaller document has.

    Reads ``doc_id`` and ``text`` only, so other columns may have any name. Returns doc_id,
    n_words, n_removed, ``removed`` (spans of word numbers, end exclusive) and ``kept_text``
    (the kept words joined by one space). A word goes when some window of ``size`` words
    covers it whose words also start in a document with a smaller id; windows are judged on
    the input. Null and empty texts have no words; texts under ``size`` words lose none;
    rows of one id never remove each other's words; a null id counts as larger than any.
    """
    if size < PERIOD + 1:
        raise ValueError(f"a window holds an anchor of two words or more only from {PERIOD + 1} words on")
    ex.small_batches(docs.sparkSession)
    sizes = sizes or ex.sizes(docs, keys_per_byte=0.08)
    bits = sizes.bits
    chunks = ex.dealt(docs, sizes.chunks, "doc_id", "text")

    def send_anchors(table: pa.Table) -> pa.Table:
        words = Words(table["text"])
        at, hashes = _anchors(words, size)
        owner = np.unique(ex.ids(table["doc_id"]), return_inverse=True)[1]
        return ex.send_narrow(table["chunk"][0].as_py(), hashes, owner[words.texts()[at]], bits)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return ex.packed(0, np.zeros(0, np.uint64), bits, {k: (np.zeros(0, np.int64), pa.int64()) for k in ("keys", "ids")} | {"many": (np.zeros(0, bool), pa.bool_())})
        words = Words(table["text"])
        at, hashes = _anchors(words, size)
        at = at[found(ex.narrow(hashes, bits), ex.keyed(answers)[0])[0]]
        starts = _extended(words, at, size)
        keys = windows(words.hashes, size, 2)[starts]
        owners = ex.ids(table["doc_id"])[words.texts()[starts]]
        order = np.lexsort((owners, keys))
        keys, owners, starts = keys[order], owners[order], starts[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        last = np.append(new[1:], len(keys)) - 1
        # a second hash names the bucket, so a window is told apart by more than 64 bits
        other = windows(words.hashes, size, 3)[starts[new]] if len(new) else np.zeros(0, np.uint64)
        by = np.argsort(other)
        return ex.packed(table["chunk"][0].as_py(), other[by], bits, {
            "keys": (keys[new][by].view(np.int64), pa.int64()),
            "ids": (owners[new][by], pa.int64()),
            "many": ((owners[last] > owners[new])[by], pa.bool_()),
        })

    def smallest(table: pa.Table) -> pa.Table:
        keys, rows = flat(table["keys"])
        owners, _ = flat(table["ids"])
        many, _ = flat(table["many"], bool)
        values, inverse = np.unique(keys, return_inverse=True)
        least = np.full(len(values), ex.NO_ID)
        np.minimum.at(least, inverse, owners)
        keep = many | (least[inverse] < owners)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(rows[keep], minlength=len(table)))))
        out = pa.table({"chunk": table["chunk"], "keys": lists(keys[keep], bounds, pa.int64()), "ids": lists(least[inverse][keep], bounds, pa.int64())})
        return out.filter(pa.array(np.diff(bounds) > 0))

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table["text"])
        covered = np.zeros(len(words.hashes) + 1, np.int64)
        if len(answers) and len(words.hashes) >= size:
            keys, least = ex.keyed(answers, "ids")
            fits = np.flatnonzero(words.places() + size <= np.repeat(words.counts, words.counts))
            hit, where = found(windows(words.hashes, size, 2)[fits], keys)
            hit &= (least[where] if len(least) else 0) < ex.ids(table["doc_id"])[words.texts()[fits]]
            np.add.at(covered, fits[hit], 1)
            np.add.at(covered, fits[hit] + size, -1)
        gone = np.cumsum(covered[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[words.first[1:]] - total[words.first[:-1]]
        kept, spans = [], []
        for i in range(len(table)):
            mine = words.words(i)
            span = []
            if removed[i]:
                out = gone[words.first[i] : words.first[i + 1]]
                mine = list(compress(mine, (~out).tolist()))
                edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0)).tolist()
                span = [{"first": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            kept.append(b" ".join(mine))
            spans.append(span)
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    groups = chunks.groupBy("chunk")
    candidates = ex.shared_narrow(groups.applyInArrow(send_anchors, ex.NARROW_SCHEMA))
    sent = groups.cogroup(candidates.groupBy("chunk")).applyInArrow(
        send_windows, "bucket int, chunk int, keys array<bigint>, ids array<bigint>, many array<boolean>"
    )
    answers = sent.groupBy("bucket").applyInArrow(smallest, "chunk int, keys array<bigint>, ids array<bigint>")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(
        cut, f"doc_id {kind}, n_words bigint, n_removed bigint, removed array<struct<first:bigint,end:bigint>>, kept_text string"
    )
