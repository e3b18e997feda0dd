"""SentencePiece encoding and decoding with the original byte span of every piece.

Normalisation walks the compiled character map (a double-array trie of prefixes and their
replacements) by longest prefix and notes for every output byte where it came from, so that each
piece, whose length in normalised bytes is known from the vocabulary, projects to a span of original bytes. Ids
come from the sentencepiece library; the spans are checked against them, since the pieces' lengths must add up to the
normalised text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.common import only

SPACE = "▁".encode()  # the mark that stands for a space in pieces
#: Piece kinds in the model's own numbering.
UNKNOWN, CONTROL, BYTE = 2, 3, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; nested messages stay bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            if kind == 2:
                n, i = varint(i)
            else:
                n = {5: 4, 1: 8}[kind]
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix replacement by a compiled character map; an empty map replaces nothing."""

    def __init__(self, compiled: bytes = b""):
        n = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + n], dtype="<u4").tolist()
        self.texts = compiled[4 + n :]
        self.first = set()
        if self.units:
            root = self._below(0, self.units[0])
            self.first = {c for c in range(1, 256) if self.units[root ^ c] & 0x800000FF == c}

    @staticmethod
    def _below(at: int, unit: int) -> int:
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that ``data`` has at ``i``."""
        units, best = self.units, None
        at = self._below(0, units[0])
        for k in range(i, len(data)):
            c = data[k]
            if not c:
                break
            at ^= c
            unit = units[at]
            if unit & 0x800000FF != c:
                break
            at = self._below(at, unit)
            if unit >> 8 & 1:
                best = k + 1 - i, units[at] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1] : end]


class Aligner:
    """Normalises text as a model does and keeps, for each normalised byte, its original byte offset."""

    def __init__(self, spec: bytes = b"", suffix: bool = False):
        own = dict(fields(spec))
        self.map = CharacterMap(own.get(2, b""))
        self.prefix, self.trim, self.mark = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and len + 1 offsets into ``data``."""
        out, source, end = self._mapped(data) if self.map.units else (data, None, len(data))
        if source is None:
            source = np.arange(len(data) + 1)
        if self.trim:
            out, source = self._trimmed(out, source)
        if not out:
            return b"", source[-1:]
        space = SPACE if self.mark else b" "
        if len(space) > 1:
            flat = np.frombuffer(out, dtype=np.uint8)
            times = np.where(flat == 32, len(space), 1)
            source = np.append(np.repeat(source[:-1], times), source[-1])
            out = out.replace(b" ", space)
        if self.prefix and not self.suffix:
            out, source = space + out, np.concatenate([np.full(len(space), source[0]), source])
        elif self.prefix:
            out, source = out + space, np.concatenate([source, np.full(len(space), source[-1])])
        return out, source

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray, int]:
        out, source, i, n = bytearray(), [], 0, len(data)
        while i < n:
            c = data[i]
            hit = self.map.longest(data, i) if c in self.map.first else None
            if hit:
                used, text = hit
            else:
                used = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                text = data[i : i + used]
            out += text
            source += [i] * len(text) if hit else range(i, i + len(text))
            i += used
        return bytes(out), np.array([*source, n]), n

    @staticmethod
    def _trimmed(out: bytes, source: np.ndarray) -> tuple[bytes, np.ndarray]:
        flat = np.frombuffer(out, dtype=np.uint8)
        space = flat == 32
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]  # the first of a run
        if keep.any():
            last = int(np.nonzero(~space)[0][-1]) + 1 if (~space).any() else 0
            keep[last:] = False
        end = source[last] if keep.any() else source[0]
        return flat[keep].tobytes(), np.append(source[:-1][keep], end)


class Pieces:
    """A sentencepiece model with piece lengths, for encoding with spans and for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds, lengths = [], []
        for number, value in model:
            if number == 1:
                piece = dict(fields(value))
                kinds.append(piece.get(3, 1))
                lengths.append(1 if kinds[-1] == BYTE else 0 if kinds[-1] == CONTROL else len(piece.get(1, b"")))
        trainer = dict(fields(next((v for k, v in model if k == 2), b"")))
        self.align = Aligner(next((v for k, v in model if k == 3), b""), bool(trainer.get(24, 0)))
        self.kinds, self.lengths = np.array(kinds), np.array(lengths, dtype=np.int64)
        self.end = self.library.eos_id()
        self.decimal = [str(i) for i in range(len(kinds))]

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans [start, stop) of the ids of a text, the end id (an empty span) included."""
        text, source = self.align(data)
        lengths = self.lengths[ids]
        unknown = self.kinds[ids] == UNKNOWN
        if unknown.any():
            lengths = self._with_unknown(text, ids, lengths, unknown)
        ends = np.cumsum(lengths)
        if (ends[-1] if len(ends) else 0) != len(text):
            raise ValueError(f"pieces cover {ends[-1] if len(ends) else 0} of {len(text)} normalised bytes")
        return source[ends - lengths], source[ends]

    def _with_unknown(self, text: bytes, ids, lengths, unknown) -> np.ndarray:
        lengths, at = lengths.copy(), 0
        pieces = self.library.id_to_piece(ids.tolist())
        for k, piece in enumerate(pieces):
            if unknown[k]:  # up to the next known piece
                known = next((p for p, u in zip(pieces[k + 1 :], unknown[k + 1 :], strict=True) if not u and p), None)
                stop = text.index(known.encode(), at + 1) if known and lengths[k + 1] else len(text)
                lengths[k] = stop - at
            at += lengths[k]
        return lengths


def encode_decode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = True
) -> DataFrame:
    """doc_id, ids (end id last), starts and stops (original byte spans), decoded, and digests of every row.

    Whole texts are encoded as the library does, without sampling; null counts as the empty
    text, whose only id is the end id. n_tokens counts all ids, ids_sha256 is of the decimal ids joined by one space,
    decoded_sha256 of the decoded text, n_bytes is the original text's and spanned the bytes inside spans. ``keep_spans`` off leaves
    the arrays and the decoded text out of the result, not out of the work. Repeated rows are all kept; other
    columns are ignored. ``model`` is a path that exists on every executor.
    """
    narrow = only(docs, doc_id=id_col, text=text_col)
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()),
             ("n_bytes", T.LongType()), ("spanned", T.LongType())]
    if keep_spans:
        longs = T.ArrayType(T.IntegerType(), False)
        kinds += [("ids", longs), ("starts", longs), ("stops", longs), ("decoded", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType)] + [T.StructField(n, t) for n, t in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_row(pieces, x.as_py() or "", keep_spans) for x in part.column(1)]
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [f.name for f in schema])

    many = pa.list_(pa.int32())
    arrow = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [many, many, many, pa.string()] * keep_spans
    return narrow.mapInArrow(run, schema)


def _row(pieces: Pieces, text: str, keep: bool) -> tuple:
    data = text.encode()
    ids = pieces.library.encode(text, num_threads=1)
    starts, stops = pieces.spans(data, np.array(ids, dtype=np.int64))
    ids.append(pieces.end)
    decoded = pieces.library.decode(ids)
    name = pieces.decimal
    digests = (hashlib.sha256(" ".join([name[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    out = (len(ids), *digests, len(data), int((stops - starts).sum()))
    if keep:
        n = len(data)
        out += (ids, [*starts.tolist(), n], [*stops.tolist(), n], decoded)
    return out
