"""Connected components by alternating star contractions, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cleared, written


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the least node reachable. ``most`` bounds the edges' number, where it is known.

    A round links each larger neighbour to its node's least neighbour, then each smaller neighbour likewise; it
    ends when no edge changes, after some log(nodes) rounds in practice. The least neighbours are aggregated map-side and written, so
    that both sides of the join back are plain scans or exchanges: the edges of a node with very many neighbours are then a skewed
    partition that Spark splits (or, next to a small table, no partition at all), never one task's work. Loops and repeated edges
    are harmless; no edges give no rows. What a round wrote goes when the next is written.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with cleared(spark) as keep:
        pairs = written(pairs, "components", most)
        now, before = _mark(pairs), None
        while now != before:
            pairs, before = _round(pairs, None if most is None else 2 * now[0]), now
            now = _mark(pairs)
        return keep(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")


def _round(pairs: DataFrame, most: int | None) -> DataFrame:
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least", most)
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = written(large.distinct(), "components-large", most)
    least = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-least", most)
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "components", most)


def _mark(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0
