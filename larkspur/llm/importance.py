"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Documents are read once and turned into blocks: a block of at most ``BLOCK_DOCS`` rows holds, for each hash bucket, the list of its
documents and counts. The lists of both corpora meet by bucket, where the bucket's gain is computed from its two totals; the lists go on
with the gain to their block, where contributions are summed by document. A list is packed, so a posting costs some bytes and not a row, and
neither a bucket nor a block grows without bound in a task: a bucket's lists are dealt over ``salts`` parts, and a block has one list a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import only, written

BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Lists of one bucket in a block: positions of documents as 16-bit and counts as 32-bit little-endian numbers.
POSTINGS = "array<struct<bucket: int, docs: binary, counts: binary>>"
#: A-Z become a-z, and all of ASCII but letters and digits becomes a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of a feature by its UTF-8 bytes: their crc32 modulo ``n``. Emptied when it gets large."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.n
        return found


def features(text: str | None, longest: int = 1) -> list[bytes]:
    """Runs of 1 to ``longest`` consecutive words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, joined by one space, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    out = list(words)
    for k in range(2, longest + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def blocks(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """block, ids, n_words, n_features (arrays in step, one item a row of doc_id, text) and postings (an item a bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first = Buckets(buckets), TaskContext.get().partitionId() << 32
        ids: list[pa.Scalar] = []
        words, sizes, found, held = [], [], [], 0
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                own = features(text.as_py(), longest)
                ids.append(batch.column(0)[k])
                sizes.append(len(own))
                # Of m words there are m - k + 1 runs of k, so the words come first.
                words.append(len(features(text.as_py())) if longest > 1 else len(own))
                found.append(np.fromiter((number[x] for x in own), dtype=np.int64, count=len(own)))
                held += 8 * len(own)
                if len(ids) == BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield block(first, ids, words, sizes, found)
                    first, held = first + 1, 0
                    ids, words, sizes, found = [], [], [], []
        if ids:
            yield block(first, ids, words, sizes, found)

    def block(number: int, ids: list, words: list, sizes: list, found: list) -> pa.RecordBatch:
        where = np.repeat(np.arange(len(sizes)), sizes)
        keys, counts = np.unique(np.concatenate(found) * BLOCK_DOCS + where, return_counts=True)
        at, where, counts = keys // BLOCK_DOCS, (keys % BLOCK_DOCS).astype("<u2").tobytes(), counts.astype("<u4").tobytes()
        own, starts = np.unique(at, return_index=True)
        ends = [*starts[1:].tolist(), *([len(keys)] * bool(len(keys)))]
        lists = [{"bucket": b, "docs": where[2 * s : 2 * e], "counts": counts[4 * s : 4 * e]} for b, s, e in zip(own.tolist(), starts.tolist(), ends, strict=True)]
        columns = [[number], [[x.as_py() for x in ids]], [words], [sizes], [lists]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kind = docs.schema["doc_id"].dataType
    names = ["block", "ids", "n_words", "n_features", "postings"]
    ids = pa.schema(_arrow(kind)).field(0).type
    lists = pa.struct([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary())])
    types = [pa.int64(), pa.list_(ids), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(lists)]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(f"n_words array<long>, n_features array<long>, postings {POSTINGS}").fields])
    return docs.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [("x", to_arrow_type(kind))]


def _total(lists: DataFrame, name: str) -> DataFrame:
    """bucket and, as ``name``, the sum of its counts; sums of a task come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x.as_py(), "<u4").sum(dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["bucket", "n"])

    return lists.select("bucket", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(ours: DataFrame, theirs: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for the buckets of ``ours``.

    ``ours`` and ``theirs`` are posting lists; s and t are a bucket's counts in them, S and T the sums over all. Both corpora's partial
    sums meet by bucket, a row a bucket at most; the driver gets the two sums alone.
    """
    both = _total(ours, "s").join(_total(theirs, "t"), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"))
    both = written(both, "importance-totals")
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first().s
    target = _total(theirs, "t").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first().t
    top = (F.col("t") + 1).cast("double") * F.lit(float(whole + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(target + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(top / below)).cast("long").alias("gain"))


def _sums(lists: DataFrame) -> DataFrame:
    """block and sums (an item a document): gain times count, summed over a block's lists (block, gain, docs, counts)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BLOCK_DOCS, dtype=np.int64)
        for batch in batches:
            for gain, docs, counts in zip(*(batch.column(c) for c in ("gain", "docs", "counts")), strict=True):
                # A document is in a list once, so plain indexing adds all.
                sums[np.frombuffer(docs.as_py(), "<u2")] += gain.as_py() * np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["block", "sums"])

    return lists.groupBy("block").applyInArrow(run, "block long, sums array<long>")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths by the digest of ``seed:doc_id``, floored; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """doc_id, n_words, n_features, weight, block and at (the row's place in its block) of every row of ``docs``; ``target`` has the column text."""
    held = written(blocks(only(docs, doc_id=id_col, text=text_col), buckets, longest), "importance-blocks")
    aim = blocks(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)
    lists = held.select("block", F.inline("postings"))
    theirs = written(aim.select("block", F.inline("postings")), "importance-target")
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    dealt = gains(lists, theirs, buckets).select("bucket", "gain", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = lists.withColumn("salt", salt).join(dealt.hint("merge"), ["bucket", "salt"]).select("block", "gain", "docs", "counts")
    sums = _sums(met)
    rows = held.select("block", "ids", "n_words", "n_features").join(sums, "block", "left")
    each = F.transform("ids", lambda x, i: F.struct(x.alias("doc_id"), F.get("n_words", i).alias("n_words"), F.get("n_features", i).alias("n_features"), F.coalesce(F.get("sums", i), F.lit(0)).alias("total"), i.alias("at")))
    out = rows.select("block", F.inline(each))
    n = F.col("n_features")
    mean = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "n_features", mean.alias("weight"), "block", "at")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = 10_000, longest: int = 1,
    id_col: str = "doc_id", text_col: str = "text", salts: int = 8,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    weight is the floored mean gain of a text's features (none: 0), score adds Gumbel noise by the id, and of the rows with ``least_words``
    or more the best ``percent`` are drawn: rank counts them from 1, ties to the smaller id, and is null for all others.

    Null and empty texts have no feature. Null ids share one noise and come last among ties. Repeated rows are rows of their own, and alike but for their
    rank. Empty tables give no rows; an empty ``target`` gives gains by the documents alone. Other columns play no part.
    """
    rows = weights(docs, target, buckets, longest, id_col, text_col, salts).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = F.col("n_words") >= least_words
    # A global sort over narrow rows: partitions hold ranges in order, so a place is the partition's offset and the place in it.
    ordered = rows.orderBy(able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "at")
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_able", able), "importance-ranked")
    part = F.shiftright("_at", 33)
    parts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_able").alias("able")).collect()  # a row a partition
    offsets, total = {}, 0
    for r in sorted(parts):
        offsets[r["_part"]] = total
        total += r["n"]
    most = percent * sum(r["able"] for r in parts) // 100
    base = F.element_at(F.create_map(*(F.lit(x) for p in offsets.items() for x in p)), part) if offsets else F.lit(0)
    place = (base + F.col("_at") - F.shiftleft(part, 33) + 1).cast("long")
    return ordered.select("doc_id", "n_features", "weight", "score", F.when(F.col("_able") & (place <= most), place).alias("rank"))


_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWERED.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BYTE = "instr('0123456789ABCDEF', substr(x, CAST(2 * i + {} AS INTEGER), 1)) - 1"
#: The same rows in SQL, with crc32 spelled out over the bytes of each different word.
ORACLE = f"""WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
dw AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
hx AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bt AS (SELECT w, list_transform(range(length(x) // 2), lambda i: CAST(({_BYTE.format(1)}) * 16 + {_BYTE.format(2)} AS BIGINT)) AS b FROM hx),
cr AS (SELECT w, xor(list_reduce(b, lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS k FROM bt, tab),
dk AS (SELECT doc_id, k FROM dw JOIN cr USING (w)),
bk AS (SELECT k, count(*) AS t FROM bw JOIN cr USING (w) GROUP BY 1),
sk AS (SELECT k, count(*) AS s FROM dk GROUP BY 1),
gn AS (
  SELECT k, CAST(floor(1000.0::DOUBLE * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) + 10000 FROM dk) AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) + 10000 FROM bw) AS DOUBLE)))) AS BIGINT) AS gain
  FROM sk LEFT JOIN bk USING (k)),
sm AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS x FROM dk JOIN gn USING (k) GROUP BY 1),
wt AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((x - (x % n + n) % n) // n, 0) AS weight FROM documents d LEFT JOIN sm USING (doc_id)),
sc AS (
  SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM wt),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM sc WHERE n_features >= 20)
SELECT sc.*, CASE WHEN r <= 10 * able // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)"""
