"""Subword encoding with byte offsets, and decoding.

A text is normalised by the model's compiled character map: at each place the longest entry
that is a prefix of the rest is replaced, and every output byte keeps the source byte it came
from. Pieces cover the normalised text without gaps, so sums of their widths are places in it,
and these are projected back to source bytes. With a map that changes nothing, the sums are the ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from vitalgrid.llm.exchange import small_batches

SPACE = "▁"
_loaded: dict[str, Encoder] = {}


class CharacterMap:
    """Longest-prefix replacement from a compiled map: a double-array trie and a pool of outputs."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that starts here, and its replacement."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        node ^= _offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.pool.index(b"\0", best[1])
        return best[0], self.pool[best[1] : end]

    def prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """How many source bytes are taken here, and what stands for them: an entry's output, or the character itself."""
        hit = self.longest(text, at)
        if hit is not None:
            return hit
        end = at + 1
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        return end - at, text[at:end]

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised bytes, and for each (and the end) where the source entry or character begins that it stands for."""
        out, source, at = bytearray(), [], 0
        while at < len(text):
            step, new = self.prefix(text, at)
            out += new
            source += [at] * len(new)
            at += step
        return bytes(out), [*source, len(text)]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Encoder:
    """One model, with its character map and piece widths."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.squeezed = spec.remove_extra_whitespaces
        self.space = SPACE.encode() if spec.escape_whitespaces else b" "
        self.suffix = spec.add_dummy_prefix and proto.trainer_spec.treat_whitespace_as_suffix
        self.leading = spec.add_dummy_prefix and not self.suffix
        # symbols the user defined are taken as they stand, before the map
        self.kept = sorted((q.piece.encode() for q in proto.pieces if q.type == q.USER_DEFINED), key=len, reverse=True)
        self.plain = not spec.precompiled_charsmap and self.leading and not self.squeezed and not self.kept and self.space != b" "
        n = self.model.get_piece_size()
        self.bytes = np.array([self.model.is_byte(i) for i in range(n)], bool)
        self.width = np.array([self._width(i) for i in range(n)], np.int32)
        self.narrow = np.array([w if w < 0 or self.bytes[i] else len(self.model.id_to_piece(i).replace(SPACE, " ").encode())
                                for i, w in enumerate(self.width)], np.int32)

    def _width(self, i: int) -> int:
        """Bytes of normalised text that a piece covers; -1: told by the text only."""
        if self.bytes[i]:
            return 1
        if self.model.is_unknown(i) or self.model.is_control(i):
            return -1
        return len(self.model.id_to_piece(i).encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids as the library gives them for whole texts."""
        return self.model.encode(texts, num_threads=1)

    def _prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.kept:
            if text.startswith(symbol, at):
                return len(symbol), symbol
        return self.map.prefix(text, at)

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """The bytes that the model cuts into pieces, and for each (and the end) its place in the source.

        Beside the map: a space put before or after the text, runs of spaces made one and
        spaces at both ends dropped, where the model says so.
        """
        out, source, at = bytearray(), [], 0

        def add(new: bytes) -> None:
            new = new.replace(b" ", self.space)
            out.extend(new)
            source.extend([at] * len(new))

        while self.squeezed and at < len(text):
            step, new = self._prefix(text, at)
            if new != b" ":
                break
            at += step
        if at == len(text):
            return b"", [at]
        if self.leading:
            add(b" ")
        spaced = self.squeezed
        while at < len(text):
            step, new = self._prefix(text, at)
            new = new.lstrip(b" ") if spaced else new
            add(new)
            spaced = self.squeezed and (new.endswith(b" ") if new else spaced)
            at += step
        while self.squeezed and out.endswith(self.space):
            del out[-len(self.space) :]
            at = source[len(out)]
            del source[len(out) :]
        if self.suffix:
            add(b" ")
        return bytes(out), [*source, at]

    def ends(self, text: str, ids: list[int]) -> np.ndarray:
        """For each piece the source byte where it ends; it begins where the one before ends.

        Pieces follow each other in the normalised text without a gap, so their widths sum up to
        places in it, and these are projected to the source. A piece that ends inside a character
        or inside what an entry of the map put there ends where that character or entry begins.
        """
        if not len(ids):
            return np.zeros(0, np.int32)
        if self.plain and SPACE not in text:
            ends = np.cumsum(self.narrow[ids], dtype=np.int32) - 1  # the space put before the text has no source
            if self.bytes[ids].any():
                raw = np.frombuffer(text.encode(), np.uint8)
                begins = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw), dtype=np.int32), 0))
                ends = np.append(begins, np.int32(len(raw)))[ends]
            return ends
        widths = self.width[ids]
        if (widths < 0).any():
            widths = np.where(widths < 0, [len(p.encode()) for p in self.model.encode(text, out_type=str)], widths)
        return np.array(self.normalise(text.encode())[1], np.int32)[np.cumsum(widths)]


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, keep_text: bool = False, decoded: bool = False) -> DataFrame:
    """Per document ``ids`` and ``ends``, the source byte (exclusive) at which each piece ends, and on wish the text and ``decoded``.

    Reads ``doc_id`` and ``text``. A null or empty text has no pieces and decodes to an empty text;
    repeated rows are encoded each for itself. Executors must find the model under the same path.
    ``decoded`` is what ``decode`` gives, from the same pass.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = encoder.encode(texts)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            rows = [np.array(x, np.int32) for x in ids]
            ends = [encoder.ends(t, x) for t, x in zip(texts, rows, strict=True)]
            list_of = lambda parts: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))
            out = [pa.array(encoder.model.decode(ids, num_threads=1), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_text], list_of(rows), list_of(ends), *out], names)

    kept = docs.select("doc_id", "text") if keep_text else docs.select("doc_id")
    new = [*(StructField(n, ArrayType(IntegerType())) for n in ("ids", "ends")), *([StructField("decoded", StringType())] if decoded else [])]
    names = [*kept.columns, *(f.name for f in new)]
    return docs.select("doc_id", "text").mapInArrow(run, StructType([*kept.schema, *new]))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with ``decoded``, the text that the library makes of ``ids``; null or no ids give an empty text."""
    small_batches(encoded.sparkSession)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            texts = encoder.model.decode([x or [] for x in batch.column(at).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    names = [*encoded.columns, "decoded"]
    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", StringType())]))
