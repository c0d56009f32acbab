"""Text scores of a maximum-entropy model with class-factored softmax.

Log probability of a word = log P(class | features of the words before) + log P(word | class).
Classes are the end of text, the most frequent words, and hashed word endings. The class
softmax adds a row of weights per feature: the classes of the two words before, the word
before, the two before, and the one two before.

The rows of the classes are few. They start from exact counts of the whole training text and
are improved by gradient steps: tasks step through their part of a slice of the training
documents, and their changes are averaged, slice by slice, until every training document was
in one slice. The rows of words and pairs are as many as the text has, each distinct one a key
of its own. They are learned from all training text too: every pair of words before a token is
a context, held once with the classes that followed it, in a cell of a grid by both words.
A word's row starts at a step from the class model towards its counts; then each round sums
what the whole model expects after the word, over all its contexts, and steps by how far the
counts are from that. A pair's row meets one context only and is solved there, given the
others. Where a feature was never followed by a class, that weight is 0, so a row is a few
classes. Chunks of documents ask the cells for the scores of their contexts. Word counts of all
training documents travel in the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import exchange as ex
from vitalgrid.llm.words import Words, flat, found, lists, mix
from vitalgrid.session import stored

CLASSES = 32
FREQUENT = 11  # classes 1 to 11; 0 is the end of text, the rest are word endings
PAIRS = (CLASSES + 1) ** 2  # classes of the two words before; CLASSES stands for the start of a text
FEATURES = 2 * (CLASSES + 1)  # rows of the class model
CODE_BITS, CLASS_BITS = 11, 5  # a feature's key ends with the classes it implies and room for the class that follows
WORD_BITS = 40  # of a word's hash that its feature's key keeps
PAIR_PRIOR = 2.0  # tokens by which the other rows outweigh the counts after both words
# features by the word before, by the word two before
PRIOR = np.array([5.0, 5.0])  # tokens by which the class model outweighs a feature's counts at the start
SCALE = np.array([0.3, 0.2])  # length of the step the weights start with; the two meet in every token
STEP = 0.5  # of how far counts and what is expected are apart, as a logarithm
DAMP = 5.0  # added to both
PARTS_OF_STEP = 32  # a step travels in such parts
EXACT, OCTAVE = 96, 6  # sums up to the one travel as they are, larger ones in so many steps to a doubling
STEP_TOKENS = 4096
CONTEXTS = 1 << 14  # met at a time
DECADES, FINE = 15, 4096  # class scores travel as such parts of a decade and end at so many
ROUNDS = 3  # each steps through its own slice of the training documents; the slices together are all of them
RATE = 0.1
SMOOTH = 0.1
LN10 = np.log(10.0)
_START = np.uint64(0x5851F42D4C957F2D)
_CUT = np.uint64(64 - WORD_BITS)
_CLASS = np.uint64((1 << CLASS_BITS) - 1)
_LOW = np.uint64(CODE_BITS + CLASS_BITS)
HELD_WORDS = 2_000_000  # of a task's words that are counted before they are sent
HELD_TOKENS = 1_000_000  # of a task's tokens whose contexts are met before they are sent


def _endings(words: Words) -> np.ndarray:
    """Class of each word by its last three bytes, were it not frequent."""
    h = np.zeros(len(words.starts), np.uint64)
    for k in (1, 2, 3):
        at = words.ends - k
        byte = words.data[np.maximum(at, 0)].astype(np.uint64)
        upper = (byte >= 65) & (byte <= 90)
        byte = np.where(at >= words.starts, byte + np.where(upper, np.uint64(32), np.uint64(0)), np.uint64(0))
        h = h * np.uint64(257) + byte
    return (mix(h, 31) % np.uint64(CLASSES - 1 - FREQUENT)).astype(np.int64) + 1 + FREQUENT


@dataclass(frozen=True)
class Classes:
    """Frequent words (sorted keys, class of each) and per class the log10 of its total mass."""

    keys: np.ndarray
    number: np.ndarray
    mass: np.ndarray

    def of(self, words: Words, endings: np.ndarray) -> np.ndarray:
        hit, at = found(words.hashes, self.keys)
        return np.where(hit, self.number[at] if len(self.keys) else 0, endings)


@dataclass(frozen=True)
class Examples:
    """A token for each word and for each text's end: its class, its text, the classes of the two words
    before as one number, and the keys of its features (word before, word two before, both)."""

    kind: np.ndarray
    text: np.ndarray
    pair: np.ndarray
    keys: tuple[np.ndarray, ...] = ()


def _examples(words: Words, classes: np.ndarray, keys: bool = True) -> Examples:
    n = len(words.counts)
    total = len(words.hashes) + n
    is_end = np.zeros(total, bool)
    is_end[words.first[1:] + np.arange(n)] = True
    kind = np.zeros(total, np.int64)
    kind[~is_end] = classes
    text = np.repeat(np.arange(n), words.counts + 1)
    place = np.arange(total) - np.repeat(words.first[:-1] + np.arange(n), words.counts + 1)
    one_kind, two_kind = np.roll(kind, 1), np.roll(kind, 2)
    one_kind[place < 1], two_kind[place < 2] = CLASSES, CLASSES
    pair = one_kind * (CLASSES + 1) + two_kind
    if not keys:
        return Examples(kind, text, pair)
    key = np.zeros(total, np.uint64)
    key[~is_end] = words.hashes
    one, two = np.roll(key, 1), np.roll(key, 2)
    one[place < 1], two[place < 2] = _START, _START
    one, two = _coded(mix(one, 41) >> _CUT << _CUT, PAIRS + one_kind), _coded(mix(two, 43) >> _CUT << _CUT, PAIRS + CLASSES + 1 + two_kind)
    return Examples(kind, text, pair, (one, two, _pair(one, two)))


def _coded(hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (hashes >> _LOW << _LOW) | (code.astype(np.uint64) << np.uint64(CLASS_BITS))


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Key of the feature of both words, from those of each."""
    code = (_codes(one) - PAIRS) * (CLASSES + 1) + _codes(two) - PAIRS - CLASSES - 1
    return _coded(mix((one >> _CUT << _CUT) * np.uint64(0x9E3779B97F4A7C15) + (two >> _CUT << _CUT), 42), code)


def _codes(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(CLASS_BITS) & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)


def _first(values: np.ndarray) -> np.ndarray:
    """Where each of the sorted values comes first."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _distinct(values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their numbers, or the sums of ``n``, by one sort."""
    if n is None:
        values = np.sort(values)
        first = _first(values)
        return values[first], np.diff(first, append=len(values))
    order = np.argsort(values)
    first = _first(values[order])
    return values[order[first]], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _features(found_: Examples, train: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature keys, sorted; of each how many classes follow it in training texts; these classes, key by key, and how often each does.

    ``n``: how often each example is there, once if not given.
    """
    own = train[found_.text]
    kind = found_.kind[own].astype(np.uint64)
    cells, n = _distinct(np.concatenate([k[own] | kind for k in found_.keys]), None if n is None else np.tile(n[own], len(found_.keys)))
    seen, many = _distinct(cells & ~_CLASS)
    keys, _ = _distinct(np.concatenate([seen, *(k[~own] for k in found_.keys)]))
    followers = np.zeros(len(keys), np.int64)
    followers[np.searchsorted(keys, seen)] = many
    return keys, followers, (cells & _CLASS).astype(np.int64), n


@dataclass(frozen=True)
class Contexts:
    """Distinct pairs of words before a token, sorted by ``pair`` (cell of the grid, part of the pair's key, code); keys of the
    two words; how many classes follow in training texts; these classes, context by context, and how often each does."""

    pair: np.ndarray
    one: np.ndarray
    two: np.ndarray
    followers: np.ndarray
    kind: np.ndarray
    n: np.ndarray

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, class and number of each entry, and one of class 0 and number 0 for every context without."""
        left = np.flatnonzero(self.followers == 0)
        none = np.zeros(len(left), np.int64)
        return np.append(np.repeat(np.arange(len(self.pair)), self.followers), left), np.append(self.kind, none), np.append(self.n, none)


def _placed(keys: tuple[np.ndarray, ...], bits: int) -> np.ndarray:
    """The pairs' keys behind their cells; a cell is named by the first bits of both words."""
    one, two, pair = keys
    a = (bits + 1) // 2
    cell = (one >> np.uint64(64 - a) << np.uint64(bits - a)) | (two >> np.uint64(1) >> np.uint64(63 - bits + a))
    return (cell << np.uint64(64 - bits)) | (pair >> _LOW >> np.uint64(bits) << _LOW) | (pair & ((np.uint64(1) << _LOW) - np.uint64(1)))


def _contexts(keys: tuple[np.ndarray, ...], kind: np.ndarray, n: np.ndarray, bits: int) -> Contexts:
    """Of examples, each of which is there ``n`` times in training texts, maybe 0."""
    cells = _placed(keys, bits) | kind.astype(np.uint64)
    order = np.argsort(cells)
    first = _first(cells[order])
    cells, n = cells[order[first]], np.add.reduceat(n[order], first) if len(first) else n[:0]
    pair = cells & ~_CLASS
    new, keep = _first(pair), n > 0
    followers = np.add.reduceat(keep.astype(np.int64), new) if len(new) else new
    at = order[first[new]]
    return Contexts(pair[new], keys[0][at], keys[1][at], followers, (cells[keep] & _CLASS).astype(np.int64), n[keep])


def _pick(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows, one row after another, and which of ``rows`` each belongs to."""
    n = bounds[rows + 1] - bounds[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[rows], n), of


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def _class_shares(weights: np.ndarray) -> np.ndarray:
    """P(class | classes of the two words before)."""
    return _softmax(weights[: CLASSES + 1, None] + weights[None, CLASSES + 1 :])


@dataclass(frozen=True)
class Rows:
    """Of words before and two before: keys, and of their entries key, class and weight."""

    keys: np.ndarray
    key: np.ndarray
    kind: np.ndarray
    weight: np.ndarray


def _met(model: Model, contexts: Contexts, rows: Rows) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Block by block: the first context, P(class | context), training tokens of each, and the places of the two words' rows."""
    plain, weights = np.log(model.shares[:PAIRS]).astype(np.float32), np.zeros((len(rows.keys), CLASSES), np.float32)
    weights[rows.key, rows.kind] = rows.weight
    bounds = np.concatenate(([0], np.cumsum(contexts.followers)))
    for at in range(0, len(contexts.pair), CONTEXTS):
        met = [np.searchsorted(rows.keys, key[at : at + CONTEXTS]) for key in (contexts.one, contexts.two)]
        share = _softmax(plain[_codes(contexts.pair[at : at + CONTEXTS])] + weights[met[0]] + weights[met[1]])
        entry, of = _pick(bounds, np.arange(at, at + len(share)))
        n = np.bincount(of, contexts.n[entry], len(share))
        # the pair's row, solved: what the model expects after the pair is what was counted and PAIR_PRIOR tokens without that row
        share *= PAIR_PRIOR
        share[of, contexts.kind[entry]] += contexts.n[entry]
        share /= (n + PAIR_PRIOR)[:, None]
        yield at, share, n, met


def expected(model: Model, contexts: Contexts, rows: Rows) -> np.ndarray:
    """For each entry of the words' rows how often the model expects its class after the word, over these contexts."""
    out = np.zeros((len(rows.keys), CLASSES))
    for _, share, n, met in _met(model, contexts, rows):
        share *= n[:, None]
        for at in met:
            order = np.argsort(at)
            first = _first(at[order])
            out[at[order[first]]] += np.add.reduceat(share[order], first, axis=0)
    return out[rows.key, rows.kind]


def class_scores(model: Model, contexts: Contexts, rows: Rows) -> np.ndarray:
    """-log10 P(class | context) for all classes, in FINE parts."""
    out = np.empty((len(contexts.pair), CLASSES), np.uint16)
    for at, share, _, _ in _met(model, contexts, rows):
        out[at : at + len(share)] = np.rint(-FINE * np.log10(np.clip(share, 10.0**-DECADES, 1)))
    return out


def _descend(weights: np.ndarray, square: np.ndarray, pair: np.ndarray, kind: np.ndarray) -> None:
    """One pass of scaled gradient steps over the examples, in place."""
    for at in range(0, len(kind), STEP_TOKENS):
        cell = pair[at : at + STEP_TOKENS] * CLASSES + kind[at : at + STEP_TOKENS]
        n = np.bincount(cell, minlength=PAIRS * CLASSES).reshape(CLASSES + 1, CLASSES + 1, CLASSES)
        off = n.sum(2, keepdims=True) * _class_shares(weights) - n
        grad = np.concatenate((off.sum(1), off.sum(0)))
        square += (grad * grad).mean(1)
        weights -= RATE * grad / np.sqrt(square + 1.0)[:, None]


def word_counts(docs: DataFrame, train: Column, sizes: ex.Sizes) -> DataFrame:
    """(bucket, keys, n, ending) of all training words, one row per bucket, stored."""
    bits = sizes.bits

    def pack(hashes: list[np.ndarray], endings: list[np.ndarray]) -> list[pa.RecordBatch]:
        keys, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        return ex.packed(0, keys, bits, {
            "keys": (keys.view(np.int64), pa.int64()), "n": (n, pa.int64()),
            "ending": (np.concatenate(endings)[first], pa.int8())}).to_batches()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, endings, held = [], [], 0
        for batch in batches:
            words = Words(batch.column(0), lower=True)
            hashes.append(words.hashes), endings.append(_endings(words).astype(np.int8))
            held += len(words.hashes)
            if held >= HELD_WORDS:
                yield from pack(hashes, endings)
                hashes, endings, held = [], [], 0
        if held:
            yield from pack(hashes, endings)

    def meet(table: pa.Table) -> pa.Table:
        keys, _ = flat(table["keys"])
        n, _ = flat(table["n"])
        ending, _ = flat(table["ending"], np.int8)
        values, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, inverse, n)
        bounds = np.array([0, len(values)])
        return pa.table({
            "bucket": table["bucket"][:1], "keys": lists(values, bounds, pa.int64()),
            "n": lists(total, bounds, pa.int64()), "ending": lists(ending[first], bounds, pa.int8())})

    sent = docs.where(train).select("text").mapInArrow(send, "bucket int, chunk int, keys array<bigint>, n array<bigint>, ending array<tinyint>")
    return _kept(sent.groupBy("bucket").applyInArrow(meet, "bucket int, keys array<bigint>, n array<bigint>, ending array<tinyint>"), "word-counts")


@dataclass(frozen=True)
class Model:
    classes: Classes
    shares: np.ndarray  # P(class) by a feature's code: after two classes, after one, one after the next word
    tokens: int
    words: int
    texts: int

    @property
    def mass(self) -> float:
        """Of all tokens, with the smoothing."""
        return self.tokens + SMOOTH * (self.words + 1)


def _classes(counts: DataFrame, texts: int) -> tuple[Classes, int, int]:
    """Classes, and the number of training tokens and distinct ones."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, n = flat(table["keys"])[0], flat(table["n"])[0]
            best = np.lexsort((keys, -n))[:FREQUENT]
            yield pa.RecordBatch.from_arrays([pa.array(keys[best]), pa.array(n[best])], ["key", "n"])

    best = counts.select("keys", "n").mapInArrow(top, "key bigint, n bigint").orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent, number = keys[order], np.arange(1, len(keys) + 1)[order]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, n, kind = flat(table["keys"])[0].view(np.uint64), flat(table["n"])[0], flat(table["ending"], np.int8)[0].astype(np.int64)
            hit, at = found(keys, frequent)
            kind = np.where(hit, number[at] if len(number) else 0, kind)
            sums = np.zeros(CLASSES, np.int64)
            np.add.at(sums, kind, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums), pa.array(np.bincount(kind, minlength=CLASSES))], ["kind", "n", "words"])

    got = counts.select("keys", "n", "ending").mapInArrow(add, "kind bigint, n bigint, words bigint").groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    n, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in got:
        n[r["kind"]], words[r["kind"]] = r["n"], r["words"]
    n[0], words[0] = texts, texts > 0
    return Classes(frequent, number, np.log10(n + SMOOTH * (words + 1))), int(n.sum()), int(words.sum())


def _summed(parts: DataFrame) -> np.ndarray:
    """Sum of task vectors that come as (task, values): first over some tasks, then over all."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.float64) for v in table["values"])
        return pa.table({"values": pa.array([total.tobytes()], pa.binary())})

    some = parts.withColumn("some", F.pmod(F.xxhash64("task"), F.lit(64))).groupBy("some").applyInArrow(add, "values binary")
    got = some.groupBy().applyInArrow(add, "values binary").collect()  # one row
    return np.frombuffer(bytes(got[0]["values"]), np.float64) if got else np.zeros(0)


def _part(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_task()], pa.int64()), pa.array([values.astype(np.float64).tobytes()], pa.binary())], ["task", "values"])


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


PARTS = "task bigint, values binary"


def learn(docs: DataFrame, train: Column, counts: DataFrame) -> Model:
    """From the counts of all training documents, and gradient rounds that meet each of them once, in slices by a hash of the id."""
    texts = docs.where(train).count()
    classes, tokens, words = _classes(counts, texts)
    shape = (FEATURES, CLASSES)

    def examples(column: pa.Array) -> Examples:
        own = Words(column, lower=True)
        return _examples(own, classes.of(own, _endings(own)), keys=False)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            own = examples(batch.column(0))
            n = np.bincount(own.pair * CLASSES + own.kind, minlength=PAIRS * CLASSES).reshape(CLASSES + 1, CLASSES + 1, CLASSES)
            out += np.concatenate((n.sum(1), n.sum(0)))
        yield _part(out)

    seen = _summed(docs.where(train).select("text").mapInArrow(counted, PARTS))
    seen = seen.reshape(shape) if len(seen) else np.zeros(shape)
    # each feature starts at a part of its own log ratio to the classes' shares; the shares enter once
    whole = seen[: CLASSES + 1].sum(0) + 1.0
    share = whole / whole.sum()
    after = (seen + 20 * share) / (seen.sum(1, keepdims=True) + 20)
    weights = 0.35 * (np.log(after) - np.log(share))
    weights[: CLASSES + 1] += np.log(share)

    for step in range(ROUNDS):
        part = train & (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(ROUNDS)) == step)

        def descend(batches: Iterator[pa.RecordBatch], start: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            own, square, n = start.copy(), np.zeros(FEATURES), 0
            for batch in batches:
                met = examples(batch.column(0))
                _descend(own, square, met.pair, met.kind)
                n += len(met.kind)
            if n:  # weighted by its tokens; the weight itself is the last value
                yield _part(np.append((own - start).ravel() * n, n))

        total = _summed(docs.where(part).select("text").mapInArrow(descend, PARTS))
        if len(total):
            weights = weights + (total[:-1] / total[-1]).reshape(shape)
    return Model(classes, np.concatenate((_class_shares(weights).reshape(PAIRS, CLASSES), after)), tokens, words, texts)


def _byte(n: np.ndarray) -> np.ndarray:
    return np.where(n <= EXACT, n, np.minimum(255, EXACT + OCTAVE * np.log2(np.maximum(n, EXACT) / EXACT))).round().astype(np.uint8)


def _count(byte: np.ndarray) -> np.ndarray:
    return np.where(byte <= EXACT, byte, EXACT * 2.0 ** ((byte.astype(np.float64) - EXACT) / OCTAVE))


def _zipped(*columns: np.ndarray) -> bytes:
    """The columns' lowest bytes, then the next ones, so that small numbers take little."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unzipped(blob: bytes, *columns: tuple[int, type]) -> list[np.ndarray]:
    """The columns, of which length and kind are given."""
    sizes = [n * np.dtype(kind).itemsize for n, kind in columns]
    got = np.frombuffer(pa.decompress(blob, sum(sizes), codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum(sizes)
    return [
        np.ascontiguousarray(got[end - size : end].reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()
        for end, size, (n, kind) in zip(ends, sizes, columns, strict=True)]


def _runs(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.append(np.searchsorted(at, places), len(at))


SENT = "bucket int, chunk int, words array<bigint>, keys int, followers int, packed binary"


def _sent(chunk: int, words: np.ndarray, keys: np.ndarray, followers: np.ndarray, kind: np.ndarray, n: np.ndarray, bits: int) -> pa.Table:
    """One row per bucket: distinct words; distinct feature keys (32 bits beside the bucket's) with the classes that follow each and their counts."""
    shift = np.uint64(64 - bits)
    word_at, key_at = (words >> shift).astype(np.int64), (keys >> shift).astype(np.int64)
    buckets = np.union1d(word_at, key_at)
    narrow, some = ex.narrow(keys, bits).astype(np.uint32), _runs(key_at, buckets)
    of = np.concatenate(([0], np.cumsum(followers)))[some]
    packed = [
        _zipped(np.diff(narrow[a:b], prepend=np.uint32(0)), followers[a:b].astype(np.uint8), (np.diff(kind[c:d], prepend=0) % CLASSES).astype(np.uint8), n[c:d].astype(np.uint64))
        for a, b, c, d in zip(some[:-1], some[1:], of[:-1], of[1:], strict=True)]
    return pa.table({
        "bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(np.full(len(buckets), chunk), pa.int32()),
        "words": lists(words.view(np.int64), _runs(word_at, buckets), pa.int64()), "keys": pa.array(np.diff(some), pa.int32()),
        "followers": pa.array(np.diff(of), pa.int32()), "packed": pa.array(packed, pa.binary())})


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows the keys as numbers, in each row's order; bounds of each key's entries, and of all entries the classes and their counts over all rows."""
    keys, followers, kind, n = [], [], [], []
    for m, e, blob in zip(*(table[c].to_pylist() for c in ("keys", "followers", "packed")), strict=True):
        key, many, cls, count = _unzipped(blob, (m, np.uint32), (m, np.uint8), (e, np.uint8), (e, np.uint64))
        keys.append(np.cumsum(key, dtype=np.uint32)), followers.append(many), kind.append(np.cumsum(cls, dtype=np.int64) % CLASSES), n.append(count)
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    cells, total = _distinct(np.repeat(inverse, np.concatenate(followers)) * CLASSES + np.concatenate(kind), np.concatenate(n))
    return np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]), np.searchsorted(cells, np.arange(len(values) + 1) * CLASSES), cells % CLASSES, total.astype(np.float64)


def _totals(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """To each row of a bucket, for its keys in their order, how many classes follow, which, and how often, over all rows."""
    if not len(table):
        return [], []
    rows, bounds, kinds, total = _merged(table)
    total = _byte(total)
    sizes, packed = [], []
    for row in rows:
        entry, _ = _pick(bounds, row)
        sizes.append(len(entry))
        packed.append(_zipped((bounds[row + 1] - bounds[row]).astype(np.uint8), (np.diff(kinds[entry], prepend=0) % CLASSES).astype(np.uint8), total[entry]))
    return sizes, packed


def _answered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all buckets in order: of each key of a chunk how many classes follow; the classes; their counts."""
    followers, kind, n = [], [], []
    for m, e, blob in zip(*(answers[c].to_pylist() for c in ("features", "followers", "packed")), strict=True):
        many, cls, count = _unzipped(blob, (m, np.uint8), (e, np.uint8), (e, np.uint8))
        followers.append(many), kind.append(np.cumsum(cls, dtype=np.int64) % CLASSES), n.append(_count(count))
    return np.concatenate(followers).astype(np.int64), np.concatenate(kind), np.concatenate(n)


def _steps(table: pa.Table, sums: pa.Table) -> list[bytes]:
    """To each row of a bucket, for its entries as ``_totals`` gave them, the step from what the model expects to what was counted."""
    rows, bounds, kinds, total = _merged(table)
    entries = [_pick(bounds, row)[0] for row in rows]
    of = dict(zip(sums["chunk"].to_pylist(), sums["packed"].to_pylist(), strict=True))
    expect = np.zeros(len(kinds))
    for chunk, entry in zip(table["chunk"].to_pylist(), entries, strict=True):  # of one row no entry comes twice
        expect[entry] += (_unzipped(of[chunk], (len(entry), np.uint16))[0].astype(np.uint32) << np.uint32(16)).view(np.float32)
    step = np.rint(np.log((total + DAMP) / (expect + DAMP)) * PARTS_OF_STEP).clip(-127, 127).astype(np.int8)
    return [_zipped(step[entry]) for entry in entries]


def _half(values: np.ndarray) -> np.ndarray:
    """The higher half of each float, rounded."""
    return (values.astype(np.float32).view(np.uint32) + np.uint32(1 << 15) >> np.uint32(16)).astype(np.uint16)


HELD = "bucket int, contexts int, ones int, twos int, followers int, packed binary"


def _held(contexts: Contexts, bits: int) -> pa.Table:
    """One row per cell: its distinct words before, those two before, and the contexts by their places there."""
    cell = (contexts.pair >> np.uint64(64 - bits)).astype(np.int64)
    places = _distinct(cell)[0]
    some, bounds = _runs(cell, places), np.concatenate(([0], np.cumsum(contexts.followers)))
    sizes, packed = [], []
    for a, b in zip(some[:-1], some[1:], strict=True):
        order = a + np.argsort(contexts.one[a:b], kind="stable")
        one, two = contexts.one[order], contexts.two[order]
        first = _first(one)
        twos, place = np.unique(two, return_inverse=True)
        entry, _ = _pick(bounds, order)
        new = np.zeros(len(one), np.uint8)
        new[first[1:]] = 1
        sizes.append((len(one), len(first), len(twos), len(entry)))
        packed.append(_zipped(
            np.diff(one[first] >> np.uint64(CLASS_BITS), prepend=np.uint64(0)), np.diff(twos >> np.uint64(CLASS_BITS), prepend=np.uint64(0)),
            new, place.astype(np.uint32), contexts.followers[order].astype(np.uint8), contexts.kind[entry].astype(np.uint8), contexts.n[entry].astype(np.uint64)))
    sizes = np.array(sizes, np.int64).reshape(-1, 4).T
    return pa.table({
        "bucket": pa.array(places + (1 << bits), pa.int32()),
        **{c: pa.array(n, pa.int32()) for c, n in zip(("contexts", "ones", "twos", "followers"), sizes, strict=True)}, "packed": pa.array(packed, pa.binary())})


def _opened(table: pa.Table, bits: int) -> Contexts:
    """The contexts of a cell's rows, each once."""
    got: list[tuple[np.ndarray, ...]] = []
    for m, p, q, e, blob in zip(*(table[c].to_pylist() for c in ("contexts", "ones", "twos", "followers", "packed")), strict=True):
        ones, twos, new, place, many, kind, n = _unzipped(
            blob, (p, np.uint64), (q, np.uint64), (m, np.uint8), (m, np.uint32), (m, np.uint8), (e, np.uint8), (e, np.uint64))
        one = (np.cumsum(ones, dtype=np.uint64) << np.uint64(CLASS_BITS))[np.cumsum(new, dtype=np.int64)]
        two = (np.cumsum(twos, dtype=np.uint64) << np.uint64(CLASS_BITS))[place]
        at = np.append(np.repeat(np.arange(m), many), np.flatnonzero(many == 0))
        none = np.zeros(len(at) - e, np.int64)
        got.append((one[at], two[at], np.append(kind, none).astype(np.int64), np.append(n.view(np.int64), none)))
    one, two, kind, n = (np.concatenate(c) for c in zip(*got, strict=True))
    return _contexts((one, two, _pair(one, two)), kind, n, bits)


def _weights(model: Model, contexts: Contexts, told: pa.Table) -> Rows:
    """Of the words of a cell's contexts, from their counts and all steps so far."""
    keys = _distinct(np.concatenate((contexts.one, contexts.two)))[0]
    told = told.sort_by([("step", "ascending"), ("at", "ascending")])  # the keys' own order
    step = told["step"].to_numpy()
    followers, kind, n = _answered(told.filter(pa.array(step == 0)))
    key = np.repeat(np.arange(len(keys)), followers)
    code = _codes(keys)[key]
    group = (code >= PAIRS + CLASSES + 1).astype(np.int64)
    weight = SCALE[group] * np.log1p(n / (PRIOR[group] * model.shares[code, kind]))
    for k in range(1, int(step.max()) + 1):
        own = told.filter(pa.array(step == k))
        weight += STEP / PARTS_OF_STEP * np.concatenate([_unzipped(b, (e, np.int8))[0] for e, b in zip(own["followers"].to_pylist(), own["packed"].to_pylist(), strict=True)])
    return Rows(keys, key, kind, weight)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Stored, and the shuffles it took are removed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def held_contexts(docs: DataFrame, classes: Classes, sizes: ex.Sizes) -> DataFrame:
    """All contexts of all texts with what followed in training texts, one row per cell, stored."""
    bits = sizes.bits

    def pack(met: list[tuple[np.ndarray, ...]]) -> list[pa.RecordBatch]:
        one, two, pair, kind, n = (np.concatenate(c) for c in zip(*met, strict=True))
        return _held(_contexts((one, two, pair), kind, n.astype(np.int64), bits), bits).to_batches()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = [], 0
        for batch in batches:
            words = Words(batch.column(0), lower=True)
            own = _examples(words, classes.of(words, _endings(words)))
            met.append((*own.keys, own.kind.astype(np.uint8), batch.column(1).to_numpy(zero_copy_only=False)[own.text]))
            held += len(own.kind)
            if held >= HELD_TOKENS:
                yield from pack(met)
                met, held = [], 0
        if held:
            yield from pack(met)

    def meet(table: pa.Table) -> pa.Table:
        return _held(_opened(table, bits), bits)

    return _kept(docs.select("text", "train").mapInArrow(send, HELD).groupBy("bucket").applyInArrow(meet, HELD), "contexts")


TOLD = "bucket int, step int, at int, features int, followers int, packed binary"


def learn_words(model: Model, held: DataFrame, sizes: ex.Sizes) -> DataFrame:
    """(cell as bucket, step, bucket of words as at, ...): to each cell the counts of its words' rows, and the steps of all rounds, stored.

    A round sums over all contexts, so the rows do not depend on how the text is divided.
    """
    bits = sizes.bits

    def send(table: pa.Table) -> pa.Table:
        contexts = _opened(table, bits)
        at, kind, n = contexts.entries()
        keys = (contexts.one[at], contexts.two[at])
        return _sent(table["bucket"][0].as_py(), _NONE[0], *_features(Examples(kind, np.arange(len(at)), _codes(contexts.pair[at]), keys), n > 0, n), bits)

    def told(table: pa.Table, step: int, sizes_: pa.Array, packed: list[bytes]) -> pa.Table:
        return pa.table({
            "bucket": table["chunk"], "step": pa.array(np.full(len(table), step), pa.int32()), "at": table["bucket"], "features": table["keys"],
            "followers": sizes_, "packed": pa.array(packed, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        followers, packed = _totals(table)
        return told(table, 0, pa.array(followers, pa.int32()), packed)

    def expect(table: pa.Table, past: pa.Table) -> pa.Table:
        contexts = _opened(table, bits)
        first = past.filter(pa.array(past["step"].to_numpy() == 0)).sort_by("at")
        sums = _half(expected(model, contexts, _weights(model, contexts, past)))
        ends = np.cumsum(first["followers"].to_numpy())
        return pa.table({
            "bucket": first["at"], "chunk": first["bucket"], "followers": first["followers"],
            "packed": pa.array([_zipped(x) for x in np.split(sums, ends[:-1])], pa.binary())})

    def round_(step: int):
        def answer(table: pa.Table, sums: pa.Table) -> pa.Table:
            sizes_ = dict(zip(sums["chunk"].to_pylist(), sums["followers"].to_pylist(), strict=True))
            return told(table, step, pa.array([sizes_[c] for c in table["chunk"].to_pylist()], pa.int32()), _steps(table, sums))

        return answer

    sent = _kept(held.groupBy("bucket").applyInArrow(send, SENT), "word-features")
    out = _kept(sent.groupBy("bucket").applyInArrow(count, TOLD), "word-rows")
    for step in range(1, ROUNDS + 1):
        sums = held.groupBy("bucket").cogroup(out.groupBy("bucket")).applyInArrow(expect, "bucket int, chunk int, followers int, packed binary")
        out = out.union(_kept(sent.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(round_(step), TOLD), "word-rows"))
    return out


def _asked(chunk: int, cells: np.ndarray, bits: int) -> pa.Table:
    """One row per cell: a chunk's distinct contexts (32 bits beside the cell's) and the classes that follow each."""
    pair, followers = _distinct(cells & ~_CLASS)
    at, kind = (pair >> np.uint64(64 - bits)).astype(np.int64), (cells & _CLASS).astype(np.int64)
    places, narrow = _distinct(at)[0], ex.narrow(pair, bits).astype(np.uint32)
    some = _runs(at, places)
    of = np.concatenate(([0], np.cumsum(followers)))[some]
    packed = [
        _zipped(np.diff(narrow[a:b], prepend=np.uint32(0)), followers[a:b].astype(np.uint8), (np.diff(kind[c:d], prepend=0) % CLASSES).astype(np.uint8))
        for a, b, c, d in zip(some[:-1], some[1:], of[:-1], of[1:], strict=True)]
    return pa.table({
        "bucket": pa.array(places + (1 << bits), pa.int32()), "chunk": pa.array(np.full(len(places), chunk), pa.int32()),
        "words": lists(np.zeros(0, np.int64), np.zeros(len(places) + 1, np.int32), pa.int64()), "keys": pa.array(np.diff(some), pa.int32()),
        "followers": pa.array(np.diff(of), pa.int32()), "packed": pa.array(packed, pa.binary())})


def _scored(table: pa.Table, scores: np.ndarray, contexts: Contexts, bits: int) -> list[bytes]:
    """To each row of a cell, for the classes it asked for in their order, the score."""
    narrow, out = ex.narrow(contexts.pair, bits).astype(np.uint32), []
    for m, e, blob in zip(*(table[c].to_pylist() for c in ("keys", "followers", "packed")), strict=True):
        key, many, kind = _unzipped(blob, (m, np.uint32), (m, np.uint8), (e, np.uint8))
        at = np.repeat(np.searchsorted(narrow, np.cumsum(key, dtype=np.uint32)), many)
        out.append(_zipped(scores[at, np.cumsum(kind, dtype=np.int64) % CLASSES]))
    return out


def score_texts(docs: DataFrame, train: Column, sizes: ex.Sizes | None = None) -> DataFrame:
    """Per document n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    Reads ``doc_id`` and whole ``text``; ``train`` says which rows may be learned from. A null
    text counts as an empty one: its only token is the end. Repeated rows are scored and
    learned each for itself. Without training rows every token is unknown.
    """
    ex.small_batches(docs.sparkSession)
    sizes = sizes or ex.sizes(docs, keys_per_byte=0.25)
    bits = sizes.bits
    slim = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    counts = word_counts(slim, F.col("train"), sizes)
    model = learn(slim, F.col("train"), counts)
    held = held_contexts(slim, model.classes, sizes)
    known = counts.select("bucket", "keys", "n").unionByName(held, allowMissingColumns=True).unionByName(learn_words(model, held, sizes), allowMissingColumns=True)
    end_count = model.texts

    def met(words: Words) -> Examples:
        return _examples(words, model.classes.of(words, _endings(words)))

    def cells(examples: Examples) -> np.ndarray:
        return _placed(examples.keys, bits) | examples.kind.astype(np.uint64)

    def send(table: pa.Table) -> pa.Table:
        words, chunk = Words(table["text"], lower=True), table["chunk"][0].as_py()
        return pa.concat_tables([_sent(chunk, np.unique(words.hashes), *_NONE, bits), _asked(chunk, _distinct(cells(met(words)))[0], bits)])

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, rows = flat(table["words"])
        n = np.zeros(len(keys), np.int64)
        packed: list[bytes | None] = [None] * len(table)
        if len(table) and table["bucket"][0].as_py() >> bits:  # a cell
            contexts = _opened(known.filter(pc.is_valid(known["contexts"])), bits)
            told = known.filter(pc.is_valid(known["step"]))
            packed = _scored(table, class_scores(model, contexts, _weights(model, contexts, told)), contexts, bits)
        elif len(known):
            values, counts_ = flat(known["keys"])[0], flat(known["n"])[0]
            hit, at = found(keys, values)
            n[hit] = counts_[at[hit]]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(table)))))
        return pa.table({
            "chunk": table["chunk"], "bucket": table["bucket"], "n": lists(n, bounds, pa.int64()),
            "followers": table["followers"], "packed": pa.array(packed, pa.binary())})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table["text"], lower=True)
        answers = answers.sort_by("bucket")  # the keys' own order
        count = flat(answers["n"])[0][np.unique(words.hashes, return_inverse=True)[1]]
        examples = met(words)
        asked = zip(answers["followers"].to_pylist(), answers["packed"].to_pylist(), strict=True)
        scores = np.concatenate([_unzipped(blob, (e, np.uint16))[0] for e, blob in asked if blob])
        own = np.log10(count + SMOOTH)
        size = words.counts + 1
        known = np.bincount(words.texts(), count > 0, len(size)) + (end_count > 0)
        base = np.bincount(words.texts(), own, len(size)) + np.log10(end_count + SMOOTH) - size * np.log10(model.mass)
        inside = np.full(len(examples.kind), np.log10(end_count + SMOOTH))
        inside[examples.kind > 0] = own
        each = inside - model.classes.mass[examples.kind] - scores[np.unique(cells(examples), return_inverse=True)[1]] / FINE
        return pa.table({
            "doc_id": table["doc_id"], "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(size), model.tokens)), "base_score": pa.array(base), "score": pa.array(np.bincount(examples.text, each, len(size)))})

    groups = ex.dealt(slim, sizes.chunks, "doc_id", "text", "train").groupBy("chunk")
    sent = groups.applyInArrow(send, SENT)
    answers = sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "chunk int, bucket int, n array<bigint>, followers int, packed binary")
    kind_ = docs.schema["doc_id"].dataType.simpleString()
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(
        score, f"doc_id {kind_}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
