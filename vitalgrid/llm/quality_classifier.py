"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of its words, word shapes and pairs of shapes; weighted by idf
and projected onto the leading singular vectors of a labelled sample. The labelled vectors,
SAMPLE_ROWS of a few numbers each, travel with the tasks. Each document's cosines with all of
them are computed exactly, in blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vitalgrid.llm.exchange import small_batches
from vitalgrid.llm.words import Words, mix

SAMPLE_ROWS = 4_000
NEIGHBOURS = 15
LATENT = 24
BLOCK = 256
WORD_DIMS, SHAPE_DIMS, PAIR_DIMS = 1024, 512, 512
DIMS = WORD_DIMS + SHAPE_DIMS + PAIR_DIMS

_CLASS = np.full(256, 5, np.int64)  # other signs
_CLASS[128:] = 0  # letters beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:"]] = 3
_CLASS[[ord(c) for c in "!?"]] = 4


def features(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """One row of DIMS counts per text."""
    words = Words(column)
    n, text = len(words.counts), words.texts()
    out = np.zeros((n, DIMS), np.float32)
    if not len(words.hashes):
        return out
    upper = np.concatenate(([0], np.cumsum(_CLASS[words.data] == 1)))
    size = words.ends - words.starts
    caps = (upper[words.ends] - upper[words.starts]) * 2 > size
    same = np.concatenate(([False], (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])))
    shape = _CLASS[words.data[words.starts]] * 6 + _CLASS[words.data[words.ends - 1]]
    shape = ((shape * 2 + caps) * 2 + same) * 3 + np.digitize(size, (2, 8))
    pair = mix((shape[:-1] * 512 + shape[1:]).astype(np.uint64)) % np.uint64(PAIR_DIMS)
    inside = text[1:] == text[:-1]

    def count(dims: int, of: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.bincount(of * dims + value.astype(np.int64), minlength=n * dims).reshape(n, dims)

    out[:, :WORD_DIMS] = count(WORD_DIMS, text, words.hashes % np.uint64(WORD_DIMS))
    out[:, WORD_DIMS : WORD_DIMS + SHAPE_DIMS] = count(SHAPE_DIMS, text, shape)
    out[:, WORD_DIMS + SHAPE_DIMS :] = count(PAIR_DIMS, text[1:][inside], pair[inside])
    return out


@dataclass(frozen=True)
class Neighbours:
    """The space and the labelled vectors in it; ``prior`` scores texts that point nowhere."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.axes)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts) if k and self.axes.size else 0, BLOCK):
            points = self.project(counts[at : at + BLOCK])
            near = points @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, 1), 0.0) ** 4
            total = weight.sum(1)
            some = (np.abs(points).sum(1) > 0) & (total > 0)
            votes = (weight * self.labels[top]).sum(1) + 0.5 * self.prior
            out[at : at + BLOCK][some] = (votes / (total + 0.5))[some]
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf; words, shapes and pairs weigh alike."""
    x = np.sqrt(counts) * idf
    for a, b in ((0, WORD_DIMS), (WORD_DIMS, WORD_DIMS + SHAPE_DIMS), (WORD_DIMS + SHAPE_DIMS, DIMS)):
        x[:, a:b] = _unit(x[:, a:b])
    return x


def fit(counts: np.ndarray, labels: np.ndarray) -> Neighbours:
    """The latent space of the sample by randomised subspace iteration, and the sample in it."""
    n = len(labels)
    prior = float(labels.mean()) if n else 0.5
    df = (counts > 0).sum(0)
    idf = np.where(df > 0, np.log((n + 1) / (df + 0.5)) + 0.1, 0.0).astype(np.float32)
    if n < 2:
        return Neighbours(idf, np.zeros((DIMS, 0), np.float32), np.zeros((n, 0), np.float32), labels, prior)
    x = _weighted(counts, idf)
    basis = np.random.default_rng(7).standard_normal((DIMS, min(LATENT + 8, n))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ axes[:LATENT].T).astype(np.float32)
    space = Neighbours(idf, axes, np.zeros((0, 0)), labels, prior)
    return Neighbours(idf, axes, space.project(counts).astype(np.float32), labels.astype(np.float32), prior)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Neighbours:
    """Fit on a bounded sample: ``rows`` labelled ids at most, chosen by a hash of the id, their texts read whole.

    An id counts once, whatever it owns: where several rows share it, the text with the smallest
    hash stands for it. Copies of a hot id neither reach the driver nor fill the neighbours.
    """
    small_batches(docs.sparkSession)
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["doc_id", "x", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ``rows`` ids and labels, some ten kilobytes whatever the input
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    got = own.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, x binary, y int").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, DIMS)
    return fit(x, np.array([r["y"] for r in got], np.float32))


def score(docs: DataFrame, model: Neighbours, *keep: str) -> DataFrame:
    """Per document ``score`` from 0 to 1 for label 1, beside doc_id and the columns named in ``keep``.

    Reads ``doc_id`` and whole ``text``. Null and empty texts have no direction and get the
    share of label 1 in the sample (0.5 without one); equal texts get equal scores.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", *keep) if "text" in keep else docs.select("doc_id", *keep, "text")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(model.vote(features(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("score", DoubleType())])).select("doc_id", *keep, "score")


def score_of(text: Column, model: Neighbours) -> Column:
    """The same score as a column: only the text goes to Python and only the score comes back."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.vote(features(column)), pa.float64())

    return run(text)
