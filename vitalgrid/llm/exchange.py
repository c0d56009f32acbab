"""Exchange of key lists between chunks of documents and buckets of keys.

Documents are dealt into chunks of some megabytes by a hash of their id. A chunk sends each
of its distinct keys once, packed into one row per bucket; a bucket joins what all chunks
sent and answers each chunk. A key that a third of all documents hold is therefore one entry
per chunk, never one row per document, and no list of keys visits the driver.

The text shuffle is one exchange in the plan: all passes over the chunks read it again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.words import flat, lists

CHUNK_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
BUCKET_KEYS = 4 << 20
MAX_BITS = 18
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Sizes:
    """How many chunks, and how many bits of a key name its bucket."""

    chunks: int
    bits: int

    @property
    def shift(self) -> int:
        return 64 - self.bits


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python tasks get few texts at a time, and few bytes, so that long ones fit in memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sizes(docs: DataFrame, text: str = "text", keys_per_byte: float = 0.1) -> Sizes:
    """Measured once over the whole input; only the work's division depends on it."""
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return divide(spark, n, n * keys_per_byte)


def divide(spark: SparkSession, n_bytes: float, n_keys: float) -> Sizes:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * parts, int(n_bytes / CHUNK_BYTES) + 1)
    buckets = max(2 * parts, n_keys / BUCKET_KEYS)
    return Sizes(chunks, min(MAX_BITS, max(1, int(np.ceil(np.log2(buckets))))))


def chunked(docs: DataFrame, n: int, *columns: str, key: str = "doc_id") -> DataFrame:
    """The columns beside their chunk, dealt so that a chunk's rows stand together."""
    chunk = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("chunk")
    return docs.select(chunk, *columns).repartition(min(n, 20_000), "chunk")


def dealt(docs: DataFrame, n: int, *columns: str, by: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """As ``chunked``, dealt by id and text, so that a repeated or null id is spread while its texts differ."""
    chunk = F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("chunk")
    return docs.select(chunk, *columns).repartition(min(n, 20_000), "chunk")


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids as long; a null id sorts behind all others and is never the smaller one."""
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy()


def packed(chunk: int, keys: np.ndarray, bits: int, columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.Table:
    """One row per bucket of sorted 64-bit keys, with each column's values as a list."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(buckets, prepend=-1))
    bounds = np.append(at, len(keys))
    return pa.table({
        "bucket": pa.array(buckets[at], pa.int32()),
        "chunk": pa.array(np.full(len(at), chunk), pa.int32()),
        **{name: lists(values, bounds, kind) for name, (values, kind) in columns.items()},
    })


def narrow(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket and 32 bits more; enough to pick candidates, never to decide."""
    return keys >> np.uint64(32 - bits)


NARROW_SCHEMA = "bucket int, chunk int, keys array<int>, many array<boolean>"


def send_narrow(chunk: int, keys: np.ndarray, texts: np.ndarray, bits: int) -> pa.Table:
    """Distinct narrow keys of a chunk, each with whether two of its texts hold it."""
    key = narrow(keys, bits)
    order = np.lexsort((texts, key))
    key, texts = key[order], texts[order]
    new = np.diff(key, prepend=np.uint64(0)) != 0
    if len(new):
        new[0] = True
    other = ~new & (np.diff(texts, prepend=-1) != 0)
    at = np.flatnonzero(new)
    many = np.add.reduceat(other, at) > 0 if len(at) else np.zeros(0, bool)
    key = key[at]
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return packed(chunk, key << np.uint64(32 - bits), bits, {"keys": (low, pa.int32()), "many": (many, pa.bool_())})


def shared_narrow(sent: DataFrame) -> DataFrame:
    """To each chunk, those of its narrow keys that at least two texts hold."""

    def meet(table: pa.Table) -> pa.Table:
        keys, rows = flat(table["keys"], np.int32)
        many, _ = flat(table["many"], bool)
        values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[inverse[many]] = True
        keep = shared[inverse]
        bucket = np.uint64(table["bucket"][0].as_py()) << np.uint64(32)
        out = bucket | keys[keep].view(np.uint32).astype(np.uint64)
        n = np.bincount(rows[keep], minlength=len(table))
        bounds = np.concatenate(([0], np.cumsum(n)))
        return pa.table({"chunk": table["chunk"], "keys": lists(out.view(np.int64), bounds, pa.int64())}).filter(pa.array(n > 0))

    return sent.groupBy("bucket").applyInArrow(meet, "chunk int, keys array<bigint>")


TOTAL_SCHEMA = "bucket int, chunk int, keys array<bigint>, n array<bigint>"


def totals(sent: DataFrame, least: int = 1) -> DataFrame:
    """To each chunk, its keys with their sums over all chunks, where these reach ``least``."""

    def meet(table: pa.Table) -> pa.Table:
        keys, rows = flat(table["keys"])
        n, _ = flat(table["n"])
        values, inverse = np.unique(keys, return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, inverse, n)
        total = total[inverse]
        keep = total >= least
        bounds = np.concatenate(([0], np.cumsum(np.bincount(rows[keep], minlength=len(table)))))
        out = pa.table({"chunk": table["chunk"], "keys": lists(keys[keep], bounds, pa.int64()), "n": lists(total[keep], bounds, pa.int64())})
        return out.filter(pa.array(np.diff(bounds) > 0))

    return sent.groupBy("bucket").applyInArrow(meet, "chunk int, keys array<bigint>, n array<bigint>")


def keyed(table: pa.Table, value: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The answers a chunk got: sorted keys, and the value of each."""
    keys = flat(table["keys"])[0].view(np.uint64)
    order = np.argsort(keys)
    return keys[order], flat(table[value])[0][order] if value else None

