"""SimHash near-duplicates by covering locality-sensitive hashing.

A table keeps those of the 64 bits that its mask has. The masks come from a covering code: bit i
gets a vector m(i) of radius + 1 bits, and table v (any nonzero vector) keeps the bits with
<m(i), v> = 1 (mod 2). For any ``radius`` positions some v is orthogonal to all of their vectors, so every
pair within the radius agrees on all kept bits of some table: no pair is missed.

Only distinct fingerprints are hashed, so exact copies cost nothing. A bucket with more than
``bucket`` of them is split again: its free bits are cut into radius + 1 blocks, and a pair within the
radius agrees on one block at least. After a few such cuts a bucket has at most ``floor`` free bits, thus at most
2**floor distinct fingerprints. Each bucket yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import cleared, only, written
from larkspur.llm.components import connected_components

BITS = 64


def fingerprint_of(text: str | None, seed: int = 42) -> int:
    """64-bit SimHash of a text's 3-word shingles, unsigned; 0 without a word.

    A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``, shingles are joined by one space and count as often as they
    occur; fewer than three words make one shingle. A bit is 1 if set in over half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [digest(line, seed)]
    else:
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[2:], strict=False)]
    bits = np.zeros(BITS, dtype=np.int64)
    every = np.array(hashes, dtype="<u8")
    for i in range(0, len(every), 1 << 16):
        bits += np.unpackbits(every[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row, and the column ``extra``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names)

    narrow = only(docs, doc_id=id_col, text=text_col, **({extra: extra} if extra else {}))
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType), T.StructField("fp", T.LongType()), *narrow.schema.fields[2:]])
    names = schema.names
    return narrow.mapInArrow(run, schema)


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """The 2**(radius + 1) - 1 masks; bit i has the vector 1 + i mod (2**(radius + 1) - 1)."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % n) & v).bit_count() & 1) for v in range(1, n + 1)]


def blocks_of(mask: int, radius: int = 3, bits: int = BITS) -> list[int]:
    """``mask`` with each one of radius + 1 equal blocks of its free bits added."""
    free = [i for i in range(bits) if not mask >> i & 1]
    cuts = [round(k * len(free) / (radius + 1)) for k in range(radius + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(one of its component, member) for the links within the radius among distinct values."""
    left, out = np.sort(values.view(np.uint64)), []  # bitwise_count takes the absolute value of signed numbers
    while len(left):
        root, front, left = left[:1].view(np.int64)[0], left[:1], left[1:]
        while len(front) and len(left):
            near = (np.bitwise_count(left[:, None] ^ front[None, :64]) <= radius).any(axis=1)
            front = np.concatenate([front[64:], left[near]])
            out += [(int(root), int(x)) for x in left[near].view(np.int64)]
            left = left[~near]
    return out


def links(distinct: DataFrame, radius: int = 3, bucket: int = 1024, floor: int = 11) -> DataFrame:
    """Edges (a, b) whose components are those of all links within ``radius`` bits among the column fp."""
    spark = distinct.sparkSession

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for x in batch.column(0) for e in forest(np.array(x.as_py(), dtype=np.int64), radius)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

    masks = covering_masks(radius)
    level = [(k, m) for k, m in enumerate(masks)]
    keyed = _keyed(distinct.select("fp"), level)
    found = []
    while True:
        last = all(BITS - m.bit_count() <= floor for _, m in level)
        sizes = written(
            keyed.groupBy("path", "key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .where("n > 1"),
            "simhash-buckets",
        )
        found.append(sizes.where((F.col("n") == 2) & near(F.col("a"), F.col("b"), radius)).select("a", "b"))
        several = sizes.where("n > 2").select("path", "key", "n")
        if not last:
            several = several.where(F.col("n") <= bucket)
        listed = keyed.join(several, ["path", "key"]).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(listed.select("fps").mapInArrow(edges, "a long, b long"))
        if last or sizes.where(F.col("n") > bucket).isEmpty():
            break
        over = sizes.where(F.col("n") > bucket).select("path", "key")
        members = written(keyed.join(over, ["path", "key"]).select("path", "fp"), "simhash-members")
        level = [(p * (radius + 1) + k, p, m) for p, mask in level for k, m in enumerate(blocks_of(mask, radius))]
        # Bounded: (radius + 1) times as many masks a level, a handful of levels.
        children = spark.createDataFrame([(p, c, _signed(m)) for c, p, m in level], "path long, child long, mask long")
        keyed = members.join(F.broadcast(children), "path").select(
            F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
        ).distinct()
        level = [(c, m) for c, _, m in level]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _keyed(fps: DataFrame, level: list[tuple[int, int]]) -> DataFrame:
    at = F.explode(
        F.array(*(F.struct(F.lit(p).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for p, m in level))
    )
    return fps.select(at.alias("at"), "fp").select("at.path", "at.key", "fp")


def components_of(fps: DataFrame, radius: int = 3, bucket: int = 1024) -> DataFrame:
    """fp and root (the least signed fingerprint reachable) of every distinct value of the column fp."""
    with cleared(fps.sparkSession) as keep:
        distinct = written(fps.select("fp").distinct(), "simhash-distinct")
        roots = connected_components(links(distinct, radius, bucket))
        table = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
        # Written, so that both sides of joins with it are plain exchanges, whose large parts Spark can split.
        return keep(table, "simhash-table")


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = 1024) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``.

    component_id is the smallest doc_id that is reachable over fingerprints that differ in at most ``radius`` bits.
    Null and empty texts have fingerprint 0, linked like any other. Null ids take part but are
    never a component's name unless it has no other. Repeated rows stay, an empty table gives an empty one. Other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col), "simhash-fps")
    table = components_of(fps, radius, bucket)
    # One row a component and one a fingerprint, each aggregated map-side; written for the same reason as above.
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(table, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(table.join(written(firsts, "simhash-firsts"), "root").select("fp", "component_id"), "simhash-names")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the smallest doc_id, null last, then the smallest hash of its text.

    Null and empty texts are one component. Of rows alike in doc_id and text one stays, whichever. An empty table stays empty. All columns of
    ``docs`` are returned.
    """
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")), docs[text_col].isNull())
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), key.alias("key"))
    fps = written(fingerprints(narrow, extra="key"), "simhash-fps")
    table = components_of(fps, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # Two steps: the least row of a fingerprint, of which copies hold few, and then that of a component.
    each = fps.groupBy("fp").agg(F.min(order).alias("least")).join(table, "fp")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  never null, so that join and repeats share one exchange
    chosen = each.groupBy("root").agg(F.min("least").alias("least")).select(named(F.col("least.doc_id")).alias("_id"), F.col("least.key").alias("_key"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), named(docs[id_col]).alias("_id"), key.alias("_key"))
    kept = rows.join(written(chosen, "simhash-chosen"), ["_id", "_key"], "left_semi")
    return kept.dropDuplicates(["_id", "_key"]).select("_row.*")
