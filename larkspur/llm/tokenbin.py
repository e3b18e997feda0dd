"""Token ids as directly addressable codes in binary segments.

A segment holds a run of whole documents. Each id is cut into 8-bit chunks, the lowest first: level 0
has a chunk of every id, level k + 1 one of every id that goes on after level k. A level's bitmap tells which of its
ids go on, and its rank directory counts the set bits before every 512th, so the place of an id's next chunk is one
directory entry and one popcount away: any token is read without decoding the rest.

Layout of a segment, little-endian: magic ``DAC1``, number of levels, of ids and of documents (4 bytes, three u32), the document
starts (u32 each, and the end), then for each level: its number of chunks (u32), the chunks, and unless it is the last
level its bitmap (bits from the lowest, whole bytes, padded to 64) and its directory (u32 each).

Segments are rows of a Parquet table (part, segment, first_row, n_docs, n_tokens, doc_ids, payload), written by Spark's committer, so that the
table may lie in any store and a lost executor's files are written anew.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import only, written

MAGIC, RANK_BITS = b"DAC1", 512
#: What makes a chunk odd: characters outside these, among them numbers that aren't digits, and the start of a special token.
ODD = r"[^!-~¡-±´-¸º»¿-ĮĲ-ňŊ-ǃǍ-ǰǴ-ɏ‐-‧€]|<\|"
#: The pre-tokenizer's pattern in the tokenizer file, for lower-case chunks that aren't odd.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A segment of ``ids`` with documents at ``starts`` (their first ids, and the end)."""
    out, rest, level = [], np.asarray(ids, dtype=np.uint32), 0
    while True:
        more = rest > 255
        last = not more.any()
        out += [np.uint32(len(rest)).tobytes(), (rest & 255).astype(np.uint8).tobytes()]
        level += 1
        if last:
            break
        bits = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, dtype=bool)
        bits[: len(rest)] = more
        counts = bits.reshape(-1, RANK_BITS).sum(axis=1)
        out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]
        rest = rest[more] >> 8
    head = MAGIC + np.array([level, len(ids), len(starts) - 1], dtype="<u4").tobytes()
    return head + np.asarray(starts, dtype="<u4").tobytes() + b"".join(out)


class Segment:
    """Reads a segment: any one id by address, or all of them."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment")
        n_levels, self.n_ids, self.n_docs = np.frombuffer(payload, "<u4", 3, 4).tolist()
        at = 16
        self.starts = np.frombuffer(payload, "<u4", self.n_docs + 1, at).astype(np.int64)
        at += 4 * (self.n_docs + 1)
        self.levels = []
        for k in range(n_levels):
            n = int.from_bytes(payload[at : at + 4], "little")
            chunks, at, bits, ranks = np.frombuffer(payload, np.uint8, n, at + 4), at + 4 + n, None, None
            if k + 1 < n_levels:
                blocks = -(-n // RANK_BITS)
                bits = np.frombuffer(payload, np.uint8, blocks * RANK_BITS // 8, at)
                ranks = np.frombuffer(payload, "<u4", blocks, at + len(bits))
                at += len(bits) + 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            own = int.from_bytes(bits[block * RANK_BITS // 8 : (i >> 3) + 1].tobytes(), "little")
            own &= (1 << i - block * RANK_BITS) - 1
            i, shift = int(ranks[block]) + own.bit_count(), shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id, as u32."""
        below = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if bits is not None:
                more = np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)
                value[more] |= below << np.uint32(8)
            below = value
        return below


# What a tokenizer file must say for the short way of WordIds; any other file's texts go through the library whole.
SHORT_WAY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None, "padding": None, "post_processor": None,
}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def has_short_way(spec: dict) -> bool:
    """Is a tokenizer file one whose texts may be encoded word by word: its stages as above, and added tokens that all begin as ODD knows them?"""
    added = all(t["content"].startswith("<|") and {k: t[k] for k in PLAIN_TOKEN} == PLAIN_TOKEN for t in spec.get("added_tokens") or [])
    model = spec["model"]
    return added and model["type"] == "BPE" and not model.get("dropout") and all(spec.get(k) == v for k, v in SHORT_WAY.items())


class WordIds:
    """Ids of whole texts as the tokenizers library gives them.

    Where the tokenizer's file allows the short way, each word's ids are kept: the pre-tokenizer never joins characters across white space, so the distinct
    chunks between white space are encoded once a batch and
    gathered by their numbers. A chunk is cut into the pattern's words, and a new word goes through the library's model. Chunks with
    a special token's string, or characters for which Unicode tables might differ, go through the library whole. With any other
    file all texts do.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.short = has_short_way(json.load(f))
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        self.kind = np.dtype("<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.find = re.compile(PATTERN + r"|\n").findall
        self.bytes = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.words: dict[str, bytes] = {"\n": b""}
        self.most = most

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and len + 1 offsets of each text's first."""
        if not self.short:
            found = [e.ids for k in range(0, len(texts), 64) for e in self.library.encode_batch_fast(texts.slice(k, 64).to_pylist(), add_special_tokens=False)]
            ids = np.fromiter((i for x in found for i in x), dtype=self.kind, count=sum(map(len, found)))
            return ids, np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, lengths = self._ids_of(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy()
        own = lengths[index]
        ends = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(starts[index] - ends[:-1], own) + np.arange(ends[-1])]
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct chunks end to end, and how many each has."""
        if len(self.words) > self.most:
            self.words = {"\n": b""}
        odd = pc.match_substring_regex(chunks, ODD)
        plain = chunks.filter(pc.invert(odd))
        # Composed letters only: normalisation changes nothing but case.
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py()
        words = self.find(lines.lower())
        known, model, code, table = self.words, self.model, self.code, self.bytes
        for word in set(words).difference(known):
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(table)
            known[word] = array(code, [t.id for t in model(letters)]).tobytes()
        each = list(map(known.__getitem__, words))
        flat = np.frombuffer(b"".join(each), dtype=self.kind)
        counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // self.kind.itemsize
        stops = np.nonzero(np.fromiter((w == "\n" for w in words), dtype=bool, count=len(words)))[0]
        totals = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.concatenate([[0], totals[stops], [totals[-1]]])
        lengths = np.zeros(len(chunks), dtype=np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        lengths[~is_odd] = np.diff(cuts)[: len(plain)]
        if not is_odd.any():
            return flat, lengths
        whole = [e.ids for e in self.library.encode_batch_fast(chunks.filter(odd).to_pylist(), add_special_tokens=False)]
        lengths[is_odd] = [len(x) for x in whole]
        out = np.empty(lengths.sum(), dtype=self.kind)
        place = np.repeat(is_odd, lengths)
        out[~place] = flat
        out[place] = np.array([i for x in whole for i in x], dtype=self.kind)
        return out, lengths


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


SEGMENTS = "part int, segment int, n_docs long, n_tokens long, doc_ids array<long>, payload binary"


def write_segments(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    tokens_per_segment: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
) -> DataFrame:
    """Encode every row, write the segments in ascending doc_id order and return the table as read back.

    ``path`` is the table's place, which must not exist; without one it is an intermediate in the shared folder.

    Null counts as the empty text, whose only id is the end id; null doc_ids come first, repeated doc_ids by their texts' hashes, and rows alike in both spread over parts as
    others do. Ids are numbers, or texts of numbers.
    Segments don't span Arrow batches. A document is never cut: one of more ids than ``tokens_per_segment`` has a segment to itself.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # The last key cuts rows alike in id and text, however many, into ranges too.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "tie", "at").sortWithinPartitions("doc_id", "tie", "at").select("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = WordIds(tokenizer), 0
        for batch in batches:
            ids, cuts = encode(batch.column(1))
            ids = np.insert(ids, cuts[1:], end_id)
            cuts = cuts + np.arange(len(cuts))
            doc_ids, part, first = batch.column(0).to_pylist(), batch.column(2)[0].as_py(), 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + tokens_per_segment, side="right")) - 1)
                payload = pack(ids[cuts[first] : cuts[last]], cuts[first : last + 1] - cuts[first])
                row = [[part], [number], [last - first], [int(cuts[last] - cuts[first])], [doc_ids[first:last]], [payload]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)
                first, number = last, number + 1

    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    found = rows.mapInArrow(run, SEGMENTS)
    if path is None:
        return written(found, "token-segments")
    found.write.parquet(path)
    return spark.read.schema(SEGMENTS).parquet(path)


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, position and id for every row of ``wanted`` (doc_id, position from 0), read by address from the segments.

    Only the segments that hold a wanted document are opened, and only the wanted ids decoded. A position that its document doesn't have, an unknown
    doc_id and a null position give no row; a null doc_id is looked up like any other, repeated doc_ids give a row for each document.
    """
    places = segments.select("part", "segment", F.posexplode("doc_ids").alias("nth", "_doc"))
    asked = only(wanted, doc_id="doc_id", position="position").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"))
    hits = places.join(asked.where("position >= 0"), F.col("_doc").eqNullSafe(F.col("doc_id"))).select(F.col("part").alias("_part"), F.col("segment").alias("_segment"), "nth", "doc_id", "position")

    def read(key: tuple, payloads: pa.Table, rows: pa.Table) -> pa.Table:
        if not payloads.num_rows or not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "position": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        own = Segment(payloads.column("payload")[0].as_py())
        nth, at = (rows.column(c).to_numpy() for c in ("nth", "position"))
        inside = at < own.starts[nth + 1] - own.starts[nth]
        ids = [own[int(i)] for i in (own.starts[nth] + at)[inside]]
        kept = rows.filter(pa.array(inside))
        return pa.table({"doc_id": kept.column("doc_id"), "position": kept.column("position"), "id": pa.array(ids, pa.int64())})

    opened = segments.select("part", "segment", "payload").join(hits, (F.col("part") == F.col("_part")) & (F.col("segment") == F.col("_segment")), "left_semi")
    own, asked = opened.select(F.col("part").alias("p"), F.col("segment").alias("s"), "payload"), hits.select(F.col("_part").alias("q"), F.col("_segment").alias("t"), "nth", "doc_id", "position")
    return own.groupBy("p", "s").cogroup(asked.groupBy("q", "t")).applyInArrow(read, "doc_id long, position long, id long")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the segments.

    Starts are summed over parts (a bounded number) and, within a part, over its segments.
    """
    sizes = segments.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    at, bases = 0, []
    for r in parts:
        bases.append((r.part, at))
        at += r.n
    table = F.broadcast(segments.sparkSession.createDataFrame(bases, "part int, base long"))
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(table, "part").select(
        "part", "segment", (F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, number, doc_ids, payload = (batch.column(c)[k].as_py() for c in range(4))
                own = Segment(payload)
                ids, cuts = own.all().astype("<u4", copy=False), own.starts.tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                n = len(crcs)
                columns = [([part] * n, pa.int32()), ([number] * n, pa.int32()), (doc_ids, pa.int64()), (cuts[:-1], pa.int64()), (np.diff(own.starts), pa.int64()), (crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], ["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    kinds = "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    found = segments.select("part", "segment", "doc_ids", "payload").mapInArrow(run, kinds)
    return found.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
