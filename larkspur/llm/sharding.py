"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts form a group. Every group is placed where the dot product of its (bytes, tokens,
rows) vector with the shard's residual capacity is highest, in order of falling size.
Groups of under 1/(shards * ``grain``) of the corpus are first bundled by a hash of the text, so that the
packing itself sees a bounded table of at most ``bundles`` bundles and 3 * shards * ``grain``
large groups, however many documents there are. A large group stays in one shard as long as it fits there, which is up to
``whole`` shares of a shard in each dimension; one that no shard can hold is dealt out in chunks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import n_words, only, written

UNIT_SCHEMA = "unit long, shard int, base long"


def place(vectors: np.ndarray, shards: int, weights: tuple[float, float, float]) -> np.ndarray:
    """Shard of every row of ``vectors`` (shares of the corpus per dimension).

    Falling order of the weighted size; ties keep the given order, and equal dot products
    go to the lowest shard.
    """
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.empty(len(vectors), dtype=np.int64)
    scale = np.asarray(weights)
    for i in np.argsort(-(vectors @ scale), kind="stable"):
        best = int(np.argmax(residual @ (vectors[i] * scale)))
        out[i] = best
        residual[best] -= vectors[i]
    return out


def pack_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    bundles: int = 8192,
    grain: int = 32,
    weights: tuple[float, float, float] = (30.0, 1.0, 1.0),
    whole: float = 1.0,
) -> DataFrame:
    """Assign every row a shard and a slot (gapless from 0 in its shard).

    Returns doc_id, size (UTF-8 bytes plus 16), tokens (words), text_crc32, shard, slot.
    Null texts count as empty ones; null ids are numbered first. Repeated rows are all kept and
    numbered next to each other, but for those of an id that alone has a chunk's share of the corpus: they are dealt one by one, so that rows alike
    spread over shards as other rows do. Empty input gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        only(docs, doc_id=id_col, text=text_col).select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            n_words(text).alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "shard-rows",
    )
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    total = rows.agg(*sums).first()
    every = np.maximum(np.array([total.b or 0, total.t or 0, total.r or 0], dtype=float), 1.0)
    share = F.greatest(*(F.col(c) / float(n) for c, n in zip("btr", every, strict=True)))
    least = 1.0 / (shards * grain)
    groups = rows.groupBy("key").agg(*sums).withColumn("share", share)
    # At most 3 * shards * grain groups can hold over 1/(shards * grain) of one of three totals.
    large = sorted((r.key, int(np.ceil(r.share / least))) for r in groups.where(F.col("share") > least).collect())
    first, at = {}, bundles
    for key, n in large:
        first[key] = at
        at += n
    split = spark.createDataFrame([(k, n, first[k]) for k, n in large], "key long, chunks int, first long")
    # As few again: ids that hold so much of a large group.
    alike = rows.join(F.broadcast(split.select("key")), "key").groupBy("key", "doc_id").agg(*sums).where((share > least) & (F.col("r") > 1)).select(F.col("key").alias("k"), F.col("doc_id").alias("d"))
    rows = rows.join(F.broadcast(alike.withColumn("one", F.lit(True))), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    dealt = F.when(F.col("one"), F.xxhash64("at")).otherwise(F.xxhash64("doc_id", "size", F.lit(7)))
    units = (
        rows.join(F.broadcast(split), "key", "left")
        .withColumn(
            "unit",
            F.when(F.col("chunks").isNull(), F.pmod(F.col("key"), F.lit(bundles)).cast("long")).otherwise(F.col("first") + F.pmod(dealt, F.col("chunks"))),
        )
        .select("doc_id", "size", "tokens", "text_crc32", "unit")
    )
    # Bounded: one row per bundle or chunk.
    seen = sorted((r.unit, r.b, r.t, r.r) for r in units.groupBy("unit").agg(*sums).collect())
    placed = _shards_of_units(seen, large, first, every, shards, weights, bundles, whole)
    table = F.broadcast(spark.createDataFrame(placed, UNIT_SCHEMA))
    in_unit = Window.partitionBy("unit").orderBy("doc_id", "size", "text_crc32")
    return units.withColumn("rank", F.row_number().over(in_unit)).join(table, "unit").select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot")
    )


def _shards_of_units(seen, large, first, every, shards, weights, bundles, whole) -> list[tuple[int, int, int]]:
    """(unit, shard, slot of its first row): the packing of the bounded table of units."""
    by_unit = {u: np.array([b, t, r], dtype=float) / every for u, b, t, r in seen}
    counts = {u: r for u, _, _, r in seen}
    items: list[list[int]] = [[u] for u, *_ in seen if u < bundles]
    for key, n in large:
        own = [u for u in range(first[key], first[key] + n) if u in by_unit]
        items += [own] if sum(by_unit[u] for u in own).max() <= whole / shards else [[u] for u in own]
    if not items:
        return []
    vectors = np.array([sum(by_unit[u] for u in own) for own in items])
    base, out = [0] * shards, []
    for own, shard in zip(items, place(vectors, shards, weights).tolist(), strict=True):
        for u in own:
            out.append((u, shard, base[shard]))
            base[shard] += counts[u]
    return out
