"""Shards of near-equal bytes by histogram sort.

Rows are sorted by (hash of the text, id), so equal texts stand together while a group of
copies can still be cut between two ids. Probes between known keys are counted exactly, all
rows at once: each round gives the bytes and rows below every probe, and the next round
probes only inside intervals that still hide a wanted splitter. When every splitter is
within tolerance of its share, one exchange moves the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.exchange import small_batches
from vitalgrid.session import stored

PROBES = 16_384
TOLERANCE = 0.001  # of a shard's bytes
CELL_ROWS = 1_000_000
CELLS_PER_SHARD = 32
TOP = (1 << 128) - 1  # beyond all keys but one that no row has in practice; that one would be counted in the last interval


@dataclass
class Histogram:
    """Exact bytes and rows below each probed key, keys rising from the least to beyond the largest."""

    keys: list[int]
    bytes_below: list[int]
    rows_below: list[int]


def _sort_key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two signed longs as 16 bytes that compare as the pair does."""
    out = np.empty((len(high), 2), ">u8")
    out[:, 0] = high.view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = low.view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view("S16").ravel()


def _probe_keys(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))


def _count(rows: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Bytes and rows from each probe up to the next, summed in the tasks and then by key."""
    table = _probe_keys(probes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        for batch in batches:
            high, low, weight = _columns(batch)
            at = np.searchsorted(table, _sort_key(high, low), "right") - 1
            np.add.at(size, at, weight)
            n += np.bincount(at, minlength=len(table))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(n[some])], ["probe", "size", "n"])

    found = (
        rows.select("high", "low", "size").mapInArrow(partial, "probe bigint, size bigint, n bigint")
        .groupBy("probe").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    ).collect()  # one row per probe at most
    size, n = [0] * len(probes), [0] * len(probes)
    for r in found:
        size[r["probe"]], n[r["probe"]] = r["size"], r["n"]
    return size, n


def histogram(rows: DataFrame, wanted: list[int], tolerance: float, cell_rows: int) -> Histogram:
    """Probe until each wanted byte count is met within tolerance, or lies inside a single key, and no cell has too many rows."""
    h, open_ = Histogram([0, TOP], [0, 0], [0, 0]), {0}
    while open_:
        inside = {i: list(range(h.keys[i], h.keys[i + 1], max(1, (h.keys[i + 1] - h.keys[i]) // max(16, PROBES // len(open_))))) for i in open_}
        probes = sorted({0, *(p for some in inside.values() for p in some), *(h.keys[i + 1] for i in open_ if h.keys[i + 1] < TOP)})
        counted = dict(zip(probes, zip(*_count(rows, probes), strict=True), strict=True))
        new = Histogram([], [], [])
        for i in range(len(h.keys) - 1):
            size, n, before = h.bytes_below[i], h.rows_below[i], True
            for p in inside.get(i, [h.keys[i]]):
                more = counted[p] if i in inside else (0, 0)
                if p == h.keys[i] or before or more[1]:  # the ends of empty intervals are not kept
                    new.keys.append(p), new.bytes_below.append(size), new.rows_below.append(n)
                size, n, before = size + more[0], n + more[1], more[1] > 0
        last = (size, n) if i in inside else (h.bytes_below[-1], h.rows_below[-1])
        new.keys.append(TOP), new.bytes_below.append(last[0]), new.rows_below.append(last[1])
        h, open_ = new, set(_unsettled(new, wanted, tolerance, cell_rows))
    return h


def _unsettled(h: Histogram, wanted: list[int], tolerance: float, cell_rows: int) -> list[int]:
    out = {i for i in range(len(h.keys) - 1) if h.rows_below[i + 1] - h.rows_below[i] > cell_rows}
    for w in wanted:
        i = int(np.searchsorted(h.bytes_below, w, "right")) - 1
        if i < len(h.keys) - 1 and min(w - h.bytes_below[i], h.bytes_below[i + 1] - w) > tolerance:
            out.add(i)
    return [i for i in out if h.keys[i + 1] - h.keys[i] > 1 and h.rows_below[i + 1] - h.rows_below[i] > 1]


def splitters(h: Histogram, wanted: list[int]) -> list[int]:
    """For each wanted byte count the place in the histogram whose bytes below come nearest."""
    below = np.array(h.bytes_below, dtype=np.float64)
    out = [int(np.argmin(np.abs(below - w))) for w in wanted]
    return list(np.maximum.accumulate(out)) if out else []


def histogram_shards(
    docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, keep: tuple[str, ...] = ("text",)
) -> DataFrame:
    """Deal all rows into shards whose sizes differ by little more than one text.

    Reads ``doc_id`` and ``text``; returns doc_id, the columns of ``keep``, size (UTF-8 bytes
    plus 1; null counts as 1), text_crc32 (of the UTF-8 bytes; a null text as an empty one),
    shard and slot, the place in the shard's order from 0. The kept columns go through the
    exchange with their row: a partition holds whole cells, runs of a shard's slots. Rows are
    ordered by text hash, then id, so copies are neighbours. An empty table gives no rows; rows alike in id and text share one key and
    cannot be cut apart. A null id sorts first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("high"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("low"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept"),
    ).withColumn("size", F.col("bytes") + 1).drop("bytes")
    rows = stored(keyed.drop("kept"), "shard-keys")
    got = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    total, n = got["size"] or 0, got["n"]
    wanted = [total * (i + 1) // shards for i in range(shards - 1)]
    cell_rows = min(CELL_ROWS, max(1, n // (shards * CELLS_PER_SHARD)))
    h = histogram(rows, wanted, tolerance * total / shards, cell_rows)
    cut = splitters(h, wanted)
    # a cell is a run of intervals inside one shard with about cell_rows rows
    starts, shard_of, offset = [], [], []
    shard = first_row = cell_row = 0
    for i in range(len(h.keys) - 1):
        moved = False
        while shard < len(cut) and i >= cut[shard]:
            shard, moved, first_row = shard + 1, True, h.rows_below[i]
        if moved or not starts or h.rows_below[i + 1] - cell_row > cell_rows:
            starts.append(h.keys[i]), shard_of.append(shard), offset.append(h.rows_below[i] - first_row)
            cell_row = h.rows_below[i]
    table, shard_of, offset = _probe_keys(starts), np.array(shard_of, np.int32), np.array(offset, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, _ = _columns(batch)
            at = np.searchsorted(table, _sort_key(high, low), "right") - 1
            columns = [batch.column(i) for i in (0, 1, 3, 4, 5, 2, 6, 7)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at, pa.int32()), pa.array(shard_of[at]), pa.array(offset[at])], names)

    # the texts are read again here and go through one exchange, by cell
    moved_rows = keyed.select(
        "high", "low", "size", F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "text_crc32",
        F.xxhash64("kept").alias("tie"), "kept")
    schema = moved_rows.select(
        "high", "low", "has_id", "doc_id", "text_crc32", "size", "tie", "kept", F.lit(0).alias("cell"), F.lit(0).alias("shard"),
        F.lit(0).cast("long").alias("offset")).schema
    names = schema.fieldNames()
    placed = moved_rows.mapInArrow(place, schema)
    order = Window.partitionBy("cell").orderBy("high", "low", "has_id", "text_crc32", "size", "tie")
    slot = (F.col("offset") + F.row_number().over(order) - 1).alias("slot")
    return placed.select("doc_id", *[F.col("kept")[c].alias(c) for c in keep], "size", "text_crc32", "shard", slot)
