"""Rows alike spread, samples are samples, and plans hold at any number of partitions."""

import bisect
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing, quality, sharding, tokenbin, weighted_sampling


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_alike_spread_over_shards(spark, doc_id):
    """Half of the rows are one text under one id, or none: shards hold as many bytes and rows as ever, but for a row."""
    rows = [(i + 100, f"text number {i}") for i in range(1000)] + [(doc_id, "the same short text")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.pack_shards(df).collect()
    sizes, counts, slots = [0] * 40, [0] * 40, [set() for _ in range(40)]
    for r in found:
        sizes[r.shard] += r.size
        counts[r.shard] += 1
        slots[r.shard].add(r.slot)
    row = max(r.size for r in found)
    assert len(found) == 2000 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 40 + row
    assert all(s == set(range(n)) for s, n in zip(slots, counts, strict=True))


def test_quality_learns_from_a_sample_where_ids_repeat(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(400):
        good = k % 100 >= 50
        rows.append((k % 100, " ".join(word() for _ in range(60)) + "." if good else " ".join("#$%" for _ in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 50)) for i in range(100)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, most_rows=100)
    assert model.rules
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert min(scores[i] for i in range(50, 100)) > max(scores[i] for i in range(50))


def test_sources_deal_no_rows(spark):
    """Tables of a row a source are broadcast whatever the threshold, so no join deals the corpus by its sources."""
    docs = spark.createDataFrame([(i, "some words " * (i % 7), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        plan = mixing.mix_counts(docs)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[(sid|cell|source)#\d+\],", plan)
        assert plan.count("BroadcastHashJoin") >= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hint" not in mixing.few(spark, [(1,)] * 5, "a int", most=4)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 400])
def test_places_among_cuts(spark, n):
    rng = random.Random(n)
    cuts = sorted(rng.sample(range(-2000, 2000), n))
    rows = spark.createDataFrame([(x,) for x in [*cuts, *(c - 1 for c in cuts), -5000, 5000]], "x long")
    for x, k in rows.select("x", weighted_sampling._at_or_below(cuts, F.col("x"))).collect():
        assert k == bisect.bisect_right(cuts, x)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_alike_spread_over_parts(spark, doc_id):
    rows = [(i + 100, f"text number {i}") for i in range(1000)] + [(doc_id, "the same short text")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    segments = tokenbin.write_segments(df, public_tokenizers.path("word_bpe_49k.json"))
    parts = [r.n for r in segments.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(parts) == 2000 and max(parts) <= 1.5 * 2000 / len(parts) and len(parts) == 4
    found = sorted((r.start, r.n_tokens) for r in tokenbin.read_documents(segments).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False)) and found[0][0] == 0
