"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For each of ``samples`` draws a term of weight w gets, from a hash of term and
draw alone, r and c from Gamma(2, 1) and b from [0, 1); with t = floor(ln w / r + b) its value is
ln c - r (t - b + 1), and the draw's sample is the (term, t) of the least value. Two texts have the same sample with a
probability equal to the generalised Jaccard similarity of their weights, so the share of equal samples estimates it.

A Gamma(2, 1) variate is -ln(u v) of two uniform ones. The value and the sample are packed in one long (value above, hash of the sample below), so that a draw is a plain minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import let, only, words_of

BITS = 21


def _uniform(h: Column, shift: int) -> Column:
    """One of 2**21 values inside (0, 1) from the hash bits above ``shift``."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND((1 << BITS) - 1).cast("double") + 0.5) / float(1 << BITS)


def draws(term: Column, logs: tuple[Column, ...], draw: int) -> list[Column]:
    """The packed (value, sample) of a hashed term for each of its weights' logarithms, null where there is none."""
    h = F.xxhash64(term, F.lit(draw))
    g = F.xxhash64(h)
    r = -F.ln(_uniform(h, 0) * _uniform(h, BITS))
    c = F.ln(-F.ln(_uniform(g, 0) * _uniform(g, BITS)))
    b = F.shiftrightunsigned(g, 2 * BITS).cast("double") / float(1 << (64 - 2 * BITS))
    out = []
    for w in logs:
        t = F.floor(w / r + b)
        # For any weight that a text can have the value is within 2**12 of 0: with 2**26 steps a unit it fits above 24 bits of sample.
        steps = F.floor((c - r * (t - b + 1)) * float(1 << 26))
        sample = F.shiftrightunsigned(h, 33).bitwiseXOR(t).bitwiseAND((1 << 24) - 1)
        out.append(F.shiftleft(steps, 24).bitwiseOR(sample))
    return out


def _at_or_below(cuts: list[int], x: Column) -> Column:
    """How many of the rising ``cuts`` are at or below ``x``: first among every s-th cut, then among the s after it, so some 2 sqrt(n) comparisons."""
    s = max(1, int(len(cuts) ** 0.5))
    count = lambda some: F.size(F.filter(some, lambda c: c <= x))
    block = F.greatest(count(F.array(*map(F.lit, cuts[::s]))) - 1, F.lit(0)) * s
    return let(block, lambda b: b + count(F.slice(F.array(*map(F.lit, cuts)), b + 1, F.lit(s))))


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, tie, part) in the order of doc_id (null first) and tie, a hash of the text; part rises with that order.

    Each part also gets a copy, marked ``ahead``, of the one row that comes after its last; the last part gets the first row of all.
    Cuts are quantiles of doc_id. The ids between two of them are in parts of equal width; an id that is several quantiles
    at once, and null ids, which may be many, are in parts by ranges of the hash. All cuts are values, so a part never depends on how
    rows are spread. At most some parts * 64 numbers go to the driver.
    """
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.agg(
        F.percentile_approx("doc_id", [k / parts for k in range(parts + 1)], 10000).alias("q"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")
    ).first()
    fine, quantiles = 32, seen.q or [0]
    cuts = sorted(set(quantiles))
    by_hash = lambda times: times * fine if times > 1 else 1
    none = by_hash(-(-parts * (seen.n - seen.named) // max(seen.n, 1)) + 1) if seen.named < seen.n else 0
    # Of each cut: the first part and number of parts of that very id, and the first part of the ids up to the next cut.
    at, table = none, []
    for c in cuts:
        same = by_hash(quantiles.count(c))
        table.append((at, same, at + same))
        at += same + fine
    pick = lambda k, i: F.get(F.array(*(F.lit(t[k]) for t in table)), i)
    place = F.greatest(_at_or_below(cuts, F.col("doc_id")) - 1, F.lit(0))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.coalesce(place, F.lit(0)))
    low, high = F.get(F.array(*map(F.lit, cuts)), F.col("place")), F.get(F.array(*map(F.lit, [*cuts[1:], cuts[-1] + 1])), F.col("place"))
    unit = (F.shiftright("tie", 32) + F.lit(1 << 31)).cast("double") / float(1 << 32)  # rises with the hash
    within = F.floor((F.col("doc_id") - low).cast("double") / F.greatest(high - low, F.lit(1)) * fine)
    between = pick(2, F.col("place")) + F.least(F.greatest(within, F.lit(0)), F.lit(fine - 1))
    part = (
        F.when(F.col("doc_id").isNull(), F.floor(unit * none))
        .when(F.col("doc_id") == low, pick(0, F.col("place")) + F.floor(unit * pick(1, F.col("place"))))
        .otherwise(between)
    )
    rows = rows.withColumn("part", part.cast("int")).select("doc_id", "text", "tie", "part")
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie")
    firsts = sorted(rows.select("doc_id", "tie", "part").groupBy("part").agg(F.min(order).alias("first")).collect())
    before = [(*r.first[1:], r.part, firsts[k - 1].part) for k, r in enumerate(firsts)]
    table = F.broadcast(docs.sparkSession.createDataFrame(before, "first long, hash long, own int, earlier int"))
    ahead = rows.join(table, (F.col("part") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("hash")))
    # One of the rows alike, however many there are.
    ahead = ahead.groupBy(F.col("earlier").alias("part")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min("tie").alias("tie"))
    return rows.withColumn("ahead", F.lit(0)).unionByName(ahead.withColumn("ahead", F.lit(1)))


def fingerprints(docs: DataFrame, samples: int = 32, parts: int = 64) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n/4) code points replaced by as many first ones, or all, of the next document's (ascending
    doc_id, null first, ties by a hash of the text; after the last comes the first). Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (8 hex digits a draw), near_edited, near_next. Null texts count as empty. Texts without a word have a
    fingerprint of their own, alike only to each other. Repeated rows are all kept, an empty table gives an empty one; other columns play no part. One shuffle by part holds all
    steps, as everything of a document and its successor is in one part.
    """
    order = Window.partitionBy("part").orderBy("ahead", F.col("doc_id").asc_nulls_first(), "tie", "text")
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the word counts of a task stay in memory
    rows = _in_order(docs, max(parts, tasks // 2)).repartition(tasks, "part").select(
        "part", "ahead", "doc_id", "text", F.row_number().over(order).alias("nth"), F.lead("text", 1, "").over(order).alias("next")
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    # The facts of a document travel as numbered longs among its words, so that one grouping holds both and nothing is joined.
    sha = F.sha2("edited", 256)
    facts = [F.col("doc_id"), n.cast("long"), F.col("ahead").cast("long")]
    facts += [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(4)]
    none = F.array(F.lit(None).cast("string"))
    kinds = [(0, F.lit(None).cast("long"), words_of(F.col("text"))), (1, F.lit(None).cast("long"), words_of(F.col("edited")))]
    kinds += [(k + 2, value, none) for k, value in enumerate(facts)]
    kind = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value"), w.alias("words")) for k, v, w in kinds)))
    rows = rows.select("part", "nth", kind.alias("x")).select("part", "nth", "x.kind", "x.value", F.explode_outer("x.words").alias("word"))
    term = F.when(F.col("word").isNotNull(), F.xxhash64("word")).otherwise(F.col("value"))
    rows = rows.select("part", "nth", F.greatest("kind", F.lit(1)).alias("fact"), term.alias("term"), (F.col("kind") == 0).cast("int").alias("own"), (F.col("kind") == 1).cast("int").alias("new"))
    rows = rows.groupBy("part", "nth", "fact", "term").agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    word = (F.col("fact") == 1) & F.col("term").isNotNull()
    logs = [F.when(word & (F.col(c) > 0), F.ln(F.col(c).cast("double"))).alias(c) for c in ("own", "new")]
    rows = rows.select("part", "nth", "fact", "term", *logs)
    least = [F.max(F.when(F.col("fact") == k + 2, F.col("term"))).alias(f"fact{k}") for k in range(len(facts))]
    for k in range(samples):
        own, new = draws(F.col("term"), (F.col("own"), F.col("new")), k)
        least += [F.min(own).alias(f"own{k}"), F.min(new).alias(f"new{k}")]
    found = rows.groupBy("part", "nth").agg(*least)
    # The lower half of a draw: its sample and the last bits of its value; all ones where the text has no word.
    code = lambda name: F.array(*(F.coalesce(F.col(f"{name}{k}"), F.lit(-1)).bitwiseAND(0xFFFFFFFF) for k in range(samples)))
    names = [f"fact{k}" for k in range(len(facts))]
    found = found.select("part", "nth", *names, code("own").alias("own"), code("new").alias("new"))
    found = found.withColumn("following", F.lead("own").over(Window.partitionBy("part").orderBy("nth")))
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    text_of = lambda name: F.array_join(F.transform(name, lambda x: hexed(x, 8)), "")
    alike = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / float(samples)
    return found.where("fact2 = 0").select(
        F.col("fact0").alias("doc_id"), F.col("fact1").alias("n_chars"), F.concat(*(hexed(F.col(x), 16) for x in names[3:])).alias("edited_sha256"),
        text_of("own").alias("fingerprint"), text_of("new").alias("edited_fingerprint"),
        alike("own", "new").alias("near_edited"), F.coalesce(alike("own", "following"), F.lit(1.0)).alias("near_next"),
    )
