"""A sparse document-term matrix in CSR shards, with words encoded by one global dictionary.

Documents are dealt into chunks of some megabytes. A chunk sends each of its distinct words
once to the word's bucket; a bucket sorts what it got, numbers it, and answers each chunk with
numbers in the order of its words. Numbers are (place in bucket) x buckets + bucket, which is
the same for every chunk, near dense, and the same again when a lost task is repeated. A chunk
then becomes one shard: row bounds, column numbers and counts. No dictionary visits the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import exchange as ex
from vitalgrid.llm.words import Words, lists

WORDS_PER_BYTE = 0.02  # distinct words that chunks send, for the number of buckets
ANSWER = "chunk int, bucket int, numbers array<bigint>"


def fingerprint(text: Column) -> Column:
    """32 bytes that stand for a whole text; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _bytes(words: Words, at: np.ndarray) -> pa.Array:
    """The words at these places as one binary array."""
    starts, sizes = words.starts[at], words.ends[at] - words.starts[at]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    where = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(words.data[where].tobytes())]
    ).cast(pa.binary())


def _send(bits: int):
    def run(table: pa.Table) -> pa.Table:
        words = Words(table["text"])
        keys, at = np.unique(words.hashes, return_index=True)
        buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(buckets, prepend=-1))
        bounds = np.append(first, len(keys)).astype(np.int32)
        return pa.table({
            "bucket": pa.array(buckets[first], pa.int32()), "chunk": pa.array(np.full(len(first), table["chunk"][0].as_py()), pa.int32()),
            "words": pa.ListArray.from_arrays(pa.array(bounds), _bytes(words, at)),
        })

    return run


def _number(bits: int):
    def run(table: pa.Table) -> pa.Table:
        sent = table["words"].combine_chunks()
        sent = sent if isinstance(sent, pa.ListArray) else pa.concat_arrays(sent.chunks)
        coded = sent.flatten().dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        bucket = table["bucket"][0].as_py()
        numbers = (place[coded.indices.to_numpy()] << bits) + bucket
        sizes = pc.list_value_length(sent).to_numpy()
        return pa.table({
            "chunk": table["chunk"], "bucket": table["bucket"],
            "numbers": lists(numbers, np.concatenate(([0], np.cumsum(sizes))), pa.int64()),
        })

    return run


def _tally(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(positions, bounds))


def term_matrix(docs: DataFrame, *keep: str, marks: str = "") -> DataFrame:
    """CSR shards of the words of whole texts.

    Reads ``doc_id`` and ``text``; words are maximal runs without space and 0x09-0x0D. A row is one
    shard: ``doc_id`` (array; its rows), ``indptr``, ``indices`` and ``counts`` of the matrix, the
    columns in ``keep`` as arrays beside the rows, and per row ``n_chars_`` (code points),
    ``n_upper`` ([A-Z]) and ``n_marks`` (bytes of ``marks``, ASCII). Null and empty texts are
    empty rows. Repeated rows and null ids are rows each; rows are dealt by id and text, so a
    repeated id is spread while its texts differ. Words of a chunk are told apart by 64-bit hashes,
    words of different chunks by their bytes.
    """
    if clash := {"chunk", "shard", "indptr", "indices", "counts", "n_chars_", "n_upper", "n_marks"} & {*keep}:
        raise ValueError(f"the matrix has columns of these names: {sorted(clash)}")
    keep = tuple(c for c in dict.fromkeys(keep) if c != "doc_id")
    ex.small_batches(docs.sparkSession)
    sizes = ex.sizes(docs, keys_per_byte=WORDS_PER_BYTE)
    bits = sizes.bits
    dealt = ex.dealt(docs, sizes.chunks, *dict.fromkeys(("doc_id", "text", *keep)))
    groups = dealt.groupBy("chunk")  # with the same columns as below: one exchange for both
    sent = groups.applyInArrow(_send(bits), "bucket int, chunk int, words array<binary>")
    answers = sent.groupBy("bucket").applyInArrow(_number(bits), ANSWER)
    wanted = np.frombuffer(marks.encode("ascii"), np.uint8)

    def build(table: pa.Table, got: pa.Table) -> pa.Table:
        words = Words(table["text"])
        n = len(words.counts)
        _, inverse = np.unique(words.hashes, return_inverse=True)
        order = np.argsort(got["bucket"].to_numpy(), kind="stable")
        taken = got.take(pa.array(order))["numbers"] if len(got) else None
        numbers = np.concatenate([c.flatten().to_numpy() for c in taken.chunks]) if taken is not None else np.zeros(0, np.int64)
        # columns ascend within a row, as CSR has them
        by_number = np.argsort(numbers)
        rank = np.empty(len(numbers), np.int64)
        rank[by_number] = np.arange(len(numbers))
        width = max(1, len(numbers))
        cells, counts = np.unique(words.texts() * width + rank[inverse], return_counts=True)
        indptr = np.concatenate(([0], np.cumsum(np.bincount(cells // width, minlength=n))))
        data, bounds = words.data, words.bounds
        chars = np.diff(bounds) - _tally(np.flatnonzero((data & 0xC0) == 0x80), bounds)
        upper = _tally(np.flatnonzero((data >= 65) & (data <= 90)), bounds)
        marked = _tally(np.flatnonzero(np.isin(data, wanted)), bounds)
        row = lambda values, kind: lists(values, np.array([0, len(values)]), kind)
        whole = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(table[c].chunks))
        return pa.table({
            "shard": table["chunk"].slice(0, 1), "doc_id": whole("doc_id"), "indptr": row(indptr, pa.int64()),
            "indices": row(numbers[by_number][cells % width] if len(cells) else np.zeros(0, np.int64), pa.int64()),
            "counts": row(counts, pa.int32()), "n_chars_": row(chars, pa.int64()), "n_upper": row(upper, pa.int64()),
            "n_marks": row(marked, pa.int64()), **{c: whole(c) for c in keep},
        })

    kinds = {c: docs.select(c).schema[c].dataType.simpleString() for c in ("doc_id", *keep)}
    schema = (
        f"shard int, doc_id array<{kinds['doc_id']}>, indptr array<bigint>, indices array<bigint>, counts array<int>, "
        "n_chars_ array<bigint>, n_upper array<bigint>, n_marks array<bigint>" + "".join(f", `{c}` array<{kinds[c]}>" for c in keep))
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(build, schema)


def row_counts(shards: DataFrame, *keep: str) -> DataFrame:
    """One row per document: ``n_words`` (row sum), ``n_distinct`` (nonzero cells) and the kept columns.

    Column numbers are not read.
    """
    columns = ["doc_id", *keep]
    spark_schema = shards.select(*columns).schema
    names = ["indptr", "counts", *columns]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = [batch.column(k).slice(i, 1).flatten() for k in range(batch.num_columns)]
                indptr = one[0].to_numpy()
                if len(indptr) < 2:
                    continue
                upto = np.concatenate(([0], np.cumsum(one[1].to_numpy(), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*one[2:], pa.array(upto[indptr[1:]] - upto[indptr[:-1]], pa.int64()), pa.array(np.diff(indptr), pa.int64())],
                    [*columns, "n_words", "n_distinct"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.elementType.simpleString()}" for f in spark_schema)
    return shards.select(*names).mapInArrow(run, f"{kinds}, n_words bigint, n_distinct bigint")
