"""Mixing sources to target weights with a low-discrepancy schedule.

The van der Corput points of slots 0, 1, 2, ... are mapped through the sources' cumulative targets, so every prefix
of the schedule is close to the targets. A slot's rank within its source has a closed form: a source's
interval is a union of dyadic intervals, and the points of one are the slots with given low bits; so no window
or shuffle is needed for the ranks. Slot r of a source takes block r of its token stream: the
documents in an order shuffled by a hash, end to end, repeated up to ``most`` times and cut into blocks of
``block`` tokens. A source stops at its target, so what is taken is the target's whole part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import n_words, only, written

POINT_BITS = 48


def few(spark: SparkSession, rows: list[tuple], schema: str, most: int = 20_000) -> DataFrame:
    """A table of facts about sources: broadcast while it has at most ``most`` rows (some 1.5 kB each), joined by exchange beyond.

    The planner takes a table from the driver for a huge one, and would deal the corpus by its few keys to join it.
    """
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= most else made


def targets_of(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size, the excess reshared by weight."""
    total, capped = sum(sizes), set()
    while True:
        left = [i for i in range(len(sizes)) if i not in capped]
        unit = (total - sum(most * sizes[i] for i in capped)) / sum(weights[i] for i in left) if left else 0.0
        above = [i for i in left if unit * weights[i] > most * sizes[i]]
        if not above:
            return [float(most * sizes[i]) if i in capped else unit * weights[i] for i in range(len(sizes))]
        capped.update(above)


def dyadic(low: int, high: int, bits: int = POINT_BITS) -> list[tuple[int, int]]:
    """(r, step): [low, high) of the points scaled by 2**bits holds the slots r, r + step, ... for each."""
    out = []
    while low < high:
        k = min(low & -low if low else 1 << bits, 1 << ((high - low).bit_length() - 1)).bit_length() - 1
        lead = bits - k
        out.append((int(f"{low >> k:0{lead}b}"[::-1], 2) if lead else 0, 1 << lead))
        low += 1 << k
    return out


def slots_before(slot: int, parts: list[tuple[int, int]]) -> int:
    """How many slots under ``slot`` the parts hold."""
    return sum(max(0, (slot - r + step - 1) // step) for r, step in parts)


def _point(slot: Column, bits: int = POINT_BITS) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("long")


def plan(rows: DataFrame, cycle: tuple[int, ...], most: int, block: int, most_sources: int) -> list[dict]:
    """One entry per source in code-point order, null last: size, target, limit, slots, interval."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources; raise most_sources if the driver can hold them")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in found]
    goals = targets_of(sizes, [cycle[i % len(cycle)] for i in range(len(found))], most)
    out = [
        {"sid": i, "source": r.source, "source_size": s, "target": t, "limit": int(t), "slots": -(-int(t) // block)}
        for i, (r, s, t) in enumerate(zip(found, sizes, goals, strict=True))
    ]
    every = sum(x["slots"] for x in out)
    cuts = [0, *accumulate(x["slots"] for x in out)]
    for x, a, b in zip(out, cuts, cuts[1:], strict=False):
        x["low"], x["high"] = ((c << POINT_BITS) // max(every, 1) for c in (a, b))
        x["parts"] = dyadic(x["low"], x["high"])
    return out


def schedule(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """slot, sid, block: which block of which source each slot takes; each needed block has one slot.

    Sources that the points leave short of their last blocks get these in slots at the end; there are
    at most about 2 * POINT_BITS of them a source.
    """
    every = sum(x["slots"] for x in sources)
    cells = max(1, 4 * len(sources)).bit_length()
    table, short = [], []
    for x in sources:
        if x["high"] > x["low"]:
            reach = range(x["low"] >> POINT_BITS - cells, (x["high"] - 1 >> POINT_BITS - cells) + 1)
            table += [(c, x["sid"], x["low"], x["high"], x["slots"], [{"r": r, "step": s} for r, s in x["parts"]]) for c in reach]
        short += [(x["sid"], k) for k in range(slots_before(every, x["parts"]), x["slots"])]
    kinds = "cell long, sid int, low long, high long, slots long, parts array<struct<r: long, step: long>>"
    guide = few(spark, table, kinds)
    points = spark.range(every).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", POINT_BITS - cells))
    rank = F.aggregate(
        "parts",
        F.lit(0).cast("long"),
        lambda n, p: n + F.greatest(F.lit(0).cast("long"), F.floor((F.col("slot") - p.r + p.step - 1) / p.step)),
    )
    dealt = (
        points.join(guide, "cell")
        .where("low <= point and point < high")
        .select("slot", "sid", rank.alias("block"), "slots")
        .where("block < slots")
        .select("slot", "sid", "block")
    )
    rest = spark.createDataFrame([(every + i, *x) for i, x in enumerate(short)], "slot long, sid int, block long")
    return dealt.unionAll(rest)


def order_key(seed: str, doc_id: Column, text: Column) -> Column:
    """Place of a row in its source's shuffled order: a digest of id and text, so that rows without an id spread too."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def placed_rows(docs: DataFrame, cycle=(1, 2, 3), most: int = 3, block: int = 256, most_sources: int = 100_000,
                seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, list[dict]]:
    """(doc_id, source, size, sid, key, nth, start) with each row's first token in its source's stream, and the plan.

    Rows alike in source, id and text are one entry until they are numbered (nth, from 1), so a group of them is no window's burden.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), order_key(seed, F.col("doc_id"), F.col("text")).alias("key")
    )
    rows = written(rows, "mix-rows")
    sources = plan(rows, cycle, most, block, most_sources)
    ids = few(spark, [(x["sid"], x["source"]) for x in sources], "sid int, named string")
    # 4096 parts of each source by the order's first digits, so that no window holds a whole source.
    rows = rows.join(ids, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("part", F.substring("key", 1, 3))
    alike = rows.groupBy("sid", "part", "key", "size", "doc_id", "source").agg(F.count(F.lit(1)).alias("times"))
    parts = rows.groupBy("sid", "part").agg(F.sum("size").alias("own"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(inside), F.lit(0))
    first = alike.join(parts, ["sid", "part"]).select("doc_id", "source", "size", "sid", "key", "times", start.alias("first"))
    each = first.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    start = (F.col("first") + (F.col("nth") - 1) * F.col("size")).alias("start")
    return written(each.select("doc_id", "source", "size", "sid", "key", "nth", start), "mix-placed"), sources


def mixed_stream(rows: DataFrame, sources: list[dict], most: int = 3, block: int = 256) -> DataFrame:
    """The mix: slot, sid, doc_id, key, nth, size, start, epoch, first (word of the document) and n (words), a row per piece.

    ``rows`` are those of ``placed_rows``. Ordered by slot, epoch and start, the pieces are the mixed token stream. Documents without a word (null and
    empty texts), and those that the mix leaves out, have no row; repeated rows have pieces of their own, rows without an id or a source too.
    No rows give no pieces.
    """
    spark = rows.sparkSession
    limits = few(spark, [(x["sid"], x["source_size"], x["limit"]) for x in sources], "sid int, whole long, limit long")
    low = F.col("start") + F.col("epoch") * F.col("whole")
    copies = (
        rows.where("size > 0")
        .join(limits, "sid")
        .withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(most)))))
        .withColumn("low", low)
        .withColumn("high", F.least(F.col("low") + F.col("size"), F.col("limit")))
        .where("low < high")
    )
    pieces = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    a = F.greatest(F.col("low"), F.col("block") * block)
    b = F.least(F.col("high"), (F.col("block") + 1) * block)
    pieces = pieces.select("sid", "block", "doc_id", "key", "nth", "size", "start", "epoch", (a - F.col("low")).alias("first"), (b - a).alias("n"))
    return pieces.join(schedule(spark, sources), ["sid", "block"])


def mix_counts(docs: DataFrame, cycle=(1, 2, 3), most: int = 3, block: int = 256, **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row: the words that the mix takes of it.

    The i-th source by code point (null last) weighs cycle[i mod len(cycle)]. Null texts have no word; rows
    without a word are taken 0 times. The shuffled order is that of a digest of id and text: rows without an id spread by their texts, and
    only rows alike in both tie, so reruns agree. An empty table gives an empty one.
    """
    rows, sources = placed_rows(docs, cycle, most, block, **columns)
    taken = (
        mixed_stream(rows, sources, most, block)
        .groupBy("sid", "start")
        .agg(F.sum("n").alias("taken"))
        .withColumn("size_is", F.lit(True))
    )
    some = rows.where("size > 0").join(taken, ["sid", "start"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(None).cast("long")).withColumn("size_is", F.lit(None).cast("boolean"))
    every = some.unionByName(none).drop("size_is")
    facts = few(rows.sparkSession, [(x["sid"], x["source_size"], x["target"]) for x in sources], "sid int, source_size long, target double")
    return every.join(facts, "sid").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, cycle=(1, 2, 3), most: int = 3, block: int = 256, seed: str = "mix:",
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, up to ``most`` of each; its columns are kept.

    A copy counts if the mix takes at least half of its words; at most one document a source is taken in part. Documents
    that the mix leaves out, and those without a word (null and empty texts), go. Null ids and null sources take part as any other. Of rows alike in id, text
    and source the first ones by their other columns get the more copies. An empty table stays empty.
    """
    rows, sources = placed_rows(docs, cycle, most, block, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    names = few(docs.sparkSession, [(x["sid"], x["source"]) for x in sources], "sid int, named string")
    whole = mixed_stream(rows, sources, most, block).groupBy("sid", "key", "nth", "size", "epoch").agg(F.sum("n").alias("n")).where("2 * n >= size")
    # Rows alike follow each other in the stream, so a pass through it takes the first so many of them.
    copies = whole.groupBy("sid", "key", "epoch").agg(F.max("nth").alias("upto")).groupBy("sid", "key").agg(F.collect_list("upto").alias("upto"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  never null, so that join and window share one exchange
    copies = written(copies.join(names, "sid").select(named(F.col("named")).alias("_source"), F.col("key").alias("_key"), "upto"), "mix-copies")
    # The row travels as one column, so that its names can't meet those used here.
    own = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"), named(docs[source_col]).alias("_source"), order_key(seed, docs[id_col], docs[text_col]).alias("_key")
    )
    own = own.join(copies, ["_key", "_source"])
    rest = [f.name for f in docs.schema if f.name != text_col and f.dataType.typeName() not in ("map", "variant")]
    alike = Window.partitionBy("_key", "_source").orderBy(*(F.col("_row").getField(c) for c in rest), F.lit(0))
    times = F.size(F.filter("upto", lambda n: n >= F.col("_nth")))
    return own.withColumn("_nth", F.row_number().over(alike)).withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where("_copy > 0").select("_row.*")


#: The same rows in DuckDB. The block schedule takes each source's stream up to its limit, so taken has a closed form.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k,
         coalesce(sum(3 * s) OVER (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
         sum(s) OVER () AS total
  FROM s),
u AS (
  SELECT *, CAST(total - capped AS DOUBLE) / CAST(left_w AS DOUBLE) AS unit FROM o),
l AS (
  SELECT k AS k0, unit AS u0 FROM u WHERE unit * w <= 3 * s ORDER BY k LIMIT 1),
t AS (
  SELECT source, s, CASE WHEN k0 IS NULL OR k < k0 THEN CAST(3 * s AS DOUBLE) ELSE u0 * w END AS target FROM u LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.source, d.size, t.s, t.target, CAST(floor(t.target) AS BIGINT) AS lim,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, s AS source_size, target,
       CAST(greatest(0, least(size, lim - a)) + greatest(0, least(size, lim - a - s)) + greatest(0, least(size, lim - a - 2 * s)) AS BIGINT) AS taken
FROM p
"""
