"""Word hashes of Arrow text columns, computed with numpy over the raw UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its 64-bit hash is a
polynomial over random byte values, finished by a mixer; words never cross a text's end.
Slices of the byte buffer end between words, so memory does not grow with a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE), _powers(_BASE_INVERSE, SLICE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finisher: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _slices(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE):
    """Slices of about SLICE bytes that end before a space or a text's first byte."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end >= len(data):
            end = len(data)
        else:
            next_text = bounds[np.searchsorted(bounds, end)]
            step = SLICE
            while end < next_text:
                spaces = np.flatnonzero(space[data[end : min(end + step, next_text)]])
                if len(spaces):
                    end += int(spaces[0])
                    break
                end = min(end + step, int(next_text))
        yield at, int(end)
        at = int(end)


class Words:
    """Words of a column of texts: ``hashes``, byte ``starts`` and ``ends``, and ``first``, where each text's words begin.

    ``space`` marks the bytes that part words.
    """

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        self.data, self.bounds = text_bytes(column)
        value = _VALUE_LOWER if lower else _VALUE
        hashes, starts, ends = [], [], []
        for a, b in _slices(self.data, self.bounds, space):
            part = self.data[a:b]
            inside = ~space[part]
            cut = self.bounds[np.searchsorted(self.bounds, a) : np.searchsorted(self.bounds, b, "right")] - a
            first = np.zeros(b - a + 1, bool)
            first[cut] = True
            before = np.concatenate(([False], inside[:-1]))
            after = np.concatenate((inside[1:], [False]))
            s = np.flatnonzero(inside & (~before | first[:-1]))
            e = np.flatnonzero(inside & (~after | first[1:])) + 1
            n = b - a
            up, down = (_UP, _DOWN) if n <= SLICE else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[part] * up[:n], dtype=np.uint64)))
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + a)
            ends.append(e + a)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hashes, self.starts, self.ends = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def places(self) -> np.ndarray:
        """For each word its place in its text, from 0."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], self.counts)

    def words(self, text: int) -> list[bytes]:
        return self.data[self.bounds[text] : self.bounds[text + 1]].tobytes().split()


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Order-dependent hash of each run of ``size`` hashes, by its first; runs over a text's end are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    factor = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0xA0761D6478BD642F) % (1 << 64))
    for k in range(size):
        out *= factor
        out += hashes[k : k + n]
    return mix(out, seed)


def found(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per pair of neighbouring bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def flat(column: pa.ChunkedArray, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in a row, and for each value the number of its row."""
    parts, rows, at = [], [], 0
    for chunk in column.chunks:
        values = chunk.flatten()
        parts.append(values.to_numpy(zero_copy_only=False))
        lengths = pc.fill_null(pc.list_value_length(chunk), 0).to_numpy(zero_copy_only=False)
        rows.append(np.repeat(np.arange(at, at + len(chunk)), lengths))
        at += len(chunk)
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts).astype(kind, copy=False), np.concatenate(rows)
