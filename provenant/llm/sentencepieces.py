"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map.
The replacement records, for every normalised byte, the source byte it came from. The model, with its
own normaliser switched off, segments the normalised text, and every piece is projected back to its
byte span in the source.

Defined results: null text counts as empty; an empty text has no pieces. Rows are independent, so
repeated ids and ties keep one result per row. Columns other than the id and the text are ignored.
The model path is a parameter; each Python worker reads it from its own disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6

SPANS = "array<struct<id:int,start:int,end:int>>"


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double array, then its replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.replacements = compiled[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of source[at:] and its replacement."""
        if not self.units:
            return None
        units, node, found = self.units, self._step(self.units[0]), None
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(units) or units[node] & 0x800000FF != source[i]:
                break
            unit = units[node]
            node ^= self._step(unit)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


class Normaliser:
    """The model's normalisation, returning the text and the source byte of each of its bytes."""

    def __init__(self, spec, user_symbols: list[str] = (), suffix_marks: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.lead = len(MARK.encode()) if self.prefix and not suffix_marks else 0
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix_marks = suffix_marks
        self.symbols = sorted((s.encode() for s in user_symbols), key=len, reverse=True)
        self.plain = not (self.map.units or self.squeeze or self.symbols or suffix_marks) and self.escape

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        source = text.encode("utf-8", "replace")
        return self._plain(text, source) if self.plain else self._mapped(source)

    def _plain(self, text: str, source: bytes) -> tuple[str, np.ndarray]:
        """Without a map every byte is itself, but a space becomes the three bytes of the mark."""
        if not source:
            return "", np.zeros(1, np.int64)
        width = np.where(np.frombuffer(source, np.uint8) == 32, 3, 1)
        origin = np.repeat(np.arange(len(source)), width)
        origin = np.concatenate([np.zeros(self.lead, np.int64), origin, [len(source)]])
        return (MARK if self.lead else "") + text.replace(" ", MARK), origin

    def _one(self, source: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.symbols:
            if source.startswith(symbol, at):
                return len(symbol), symbol
        if mapped := self.map.longest(source, at):
            return mapped
        lead = source[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, source[at : at + size]

    def _mapped(self, source: bytes) -> tuple[str, np.ndarray]:
        space, mark = b" ", MARK.encode() if self.escape else b" "
        at, end = 0, len(source)
        while self.squeeze and at < end:
            used, made = self._one(source, at)
            if made != space:
                break
            at += used
        if at == end:
            return "", np.zeros(1, np.int64)
        out, origin = bytearray(), []

        def put(what: bytes, where: int) -> None:
            out.extend(what)
            origin.extend([where] * len(what))

        if self.prefix and not self.suffix_marks:
            put(mark, at)
        after_space = self.squeeze
        while at < end:
            used, made = self._one(source, at)
            while after_space and made.startswith(space):
                made = made[1:]
            if made:
                put(made.replace(space, mark), at)
                after_space = self.squeeze and made.endswith(space)
            at += used
        if self.squeeze:
            while out.endswith(mark):
                at = origin[-len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        if self.prefix and self.suffix_marks:
            put(mark, at)
        return out.decode(), np.array([*origin, at], np.int64)


class Encoder:
    """One model in one Python worker."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_path, "rb") as f:
            serialized = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(serialized)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.normalise = Normaliser(
            model.normalizer_spec,
            [p.piece for p in model.pieces if p.type == USER_DEFINED],
            model.trainer_spec.treat_whitespace_as_suffix,
        )
        # Bytes of the normalised text that a piece covers; -1 where only its surface tells.
        self.widths = np.array([
            1 if p.type == BYTE else -1 if p.type == UNKNOWN else len(p.piece.encode()) for p in model.pieces
        ], np.int64)
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.names = [str(i) for i in range(len(model.pieces))]

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the start and end of each piece in the bytes of the source."""
        normalised, origin = self.normalise(text or "")
        ids = self.segment.encode(normalised)
        widths = self.widths[ids] if ids else np.zeros(0, np.int64)
        if (widths < 0).any():
            pieces = self.segment.encode(normalised, return_type=str)
            widths = np.array([len(p.encode()) for p in pieces], np.int64)
        ends = np.cumsum(widths)
        first, last = origin[ends - widths], origin[ends]
        # Pieces of one replaced character share its span; the mark put in front has an empty one.
        inside = (last == first) & (ends > self.normalise.lead)
        if inside.any():
            after = np.searchsorted(origin, first[inside], "right")
            last[inside] = origin[np.minimum(after, len(origin) - 1)]
        return ids, first, last

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


@lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    return Encoder(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``pieces``, each with id, first byte and end byte."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = encoder(model_path)
        for frame in frames:
            sizes, ids, starts, ends = [0], [], [], []
            for text in frame.column(1).to_pylist():
                i, s, e = sp.encode(text)
                sizes.append(sizes[-1] + len(i))
                ids.append(i), starts.append(s), ends.append(e)
            flat = [pa.array(np.concatenate(x or [[]]).astype("int32")) for x in (ids, starts, ends)]
            structs = pa.StructArray.from_arrays(flat, ["id", "start", "end"])
            pieces = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([frame.column(0), pieces], [id_col, "pieces"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, pieces {SPANS}")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text, keeping counts and digests instead of the pieces.

    ``spans_sha256`` digests the byte spans as little-endian 32-bit pairs, and ``covered_bytes`` is
    the number of source bytes that lie in some span.
    """
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = encoder(model_path)
        names = sp.names
        for frame in frames:
            rows = []
            for text in frame.column(1).to_pylist():
                ids, starts, ends = sp.encode(text)
                joined = ",".join([names[i] for i in ids])
                reached = np.maximum.accumulate(ends) if len(ends) else ends
                before = np.concatenate([[0], reached[:-1]]) if len(ends) else ends
                rows.append((
                    len(ids),
                    hashlib.sha256(joined.encode()).hexdigest(),
                    hashlib.sha256(sp.decode(ids).encode()).hexdigest(),
                    hashlib.sha256(np.stack([starts, ends], 1).astype("<i4").tobytes()).hexdigest(),
                    int(np.maximum(ends - np.maximum(starts, before), 0).sum()),
                ))
            n, i, d, s, c = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string()),
                 pa.array(s, pa.string()), pa.array(c, pa.int64())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, (
        f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, "
        "spans_sha256 string, covered_bytes long"))
