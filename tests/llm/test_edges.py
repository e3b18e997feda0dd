"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest

from larkspur.llm import divergence, html_text, importance, mixing, periodic, quality, sentencepieces, sharding, shingle_join, simhash, tokenbin, toxicity, weighted_sampling

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = "words, key, fp, size, part, score, shard, unit, term, label, own, sid, start, lines, _text, _words, tokens".split(", ")
LONG = "some words of a long text " * 20_000

ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "b", 1), (1, "one two three four five six seven eight nine ten eleven", "en", "b", 1), (1, "another text of the same id", "en", "b", 1),
    (2, None, None, None, None), (3, "", "xx", "a", 0), (4, " \t\n", "en", "a", 3), (None, "no id here", "de", None, 1), (None, None, None, None, None), (None, "no id here", "de", None, 1),
    (5, LONG, "en", "a", len(LONG)), (6, "é" * 5000, "fr", "ü", 5000), (7, "a\U0001f600b 中文", "zh", "b", 5), (-8, "negative", "en", "b", 8),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES))


OPERATORS = {
    "sharding": lambda d, s: sharding.pack_shards(d, shards=3),
    "sentencepieces": lambda d, s: sentencepieces.encode_decode(d, PIECES),
    "quality": lambda d, s: quality.scored(d, quality.fit_quality(d, labels(s))),
    "tokenbin": lambda d, s: tokenbin.read_documents(tokenbin.write_segments(d, WORDS)),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "mixing": lambda d, s: mixing.mix_counts(d, block=4),
    "divergence": lambda d, s: divergence.judged(d),
    "toxicity": lambda d, s: toxicity.passages(d, toxicity.fit_toxicity(d, labels(s))),
    "weighted": lambda d, s: weighted_sampling.fingerprints(d, samples=4),
    "shingle_join": lambda d, s: shingle_join.joined(d),
    "periodic": lambda d, s: periodic.digests(periodic.find_runs(d)),
    "importance": lambda d, s: importance.resampled(d, s.createDataFrame([("one two",), (None,), ("",)], "text string")),
}


def labels(spark, rows=((1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_give_a_row_each(spark, name):
    found = OPERATORS[name](frame(spark, ROWS), spark).collect()
    assert len(found) == len(ROWS)
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](frame(spark, []), spark).collect() == []


def test_defined_values(spark):
    df = frame(spark, ROWS)
    null = {r.doc_id: r for r in sharding.pack_shards(df, shards=3).collect()}[2]
    assert (null.size, null.text_crc32) == (16, 0)
    assert {r.n_tokens for r in sentencepieces.encode_decode(df, PIECES).collect() if r.doc_id in (2, 3)} == {1}
    near = simhash.near_duplicates(df).collect()
    assert {r.component_id for r in near if r.doc_id in (2, 3, 4)} == {2} and {r.fp for r in near if r.doc_id in (2, 3)} == {0}
    mixed = {r.doc_id: r for r in mixing.mix_counts(df, block=4).collect()}
    assert mixed[2].taken == 0 and mixed[5].taken <= 3 * mixed[5]["size"]
    segments = tokenbin.read_documents(tokenbin.write_segments(df, WORDS)).orderBy("start").collect()
    assert [r.doc_id for r in segments][:4] == [None, None, None, -8] and segments[0].start == 0
    alike = weighted_sampling.fingerprints(df, samples=4).collect()
    assert {r.fingerprint for r in alike if r.doc_id in (2, 3, 4)} == {"f" * 32}
    assert {r.kept for r in divergence.judged(df).collect() if r.doc_id in (2, 3, 4, -8)} == {False}


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>text in a paragraph that is long enough to be kept as content by all means</p>"), (3, "u", "<article>" + "<p>word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = {r.page_id: r for r in html_text.extract(df).collect()}
    assert found[1].text == "" and found[1].n_chars == 0 and found[2].text == "" and found[None].n_chars > 50 and found[3].text.count("\n") == 49_999
    assert html_text.extract(df.where("1 = 0")).collect() == []


@pytest.mark.parametrize("lead", ['<svg class="i" />', "<math/>", "<SVG/>", "<button>", "<select>", "<object data='x'>", "<button>" * 3 + "<select>"])
def test_elements_without_an_end(lead):
    prose = "A paragraph of plain words that is long enough to be taken for the content of this page by all means."
    page = f"<article><p>{prose}</p>{lead}<p>{prose}</p><button>Press</button><p>{prose}</p></article>"
    if "button" in lead:
        page = page.replace("<button>Press</button>", "")
    assert html_text.main_text(page, html_text.trained_tree()).count(prose) == 3
    assert "Press" not in html_text.main_text(page, html_text.trained_tree())


@pytest.mark.parametrize("start, kept", [
    ('<div class="content-sidebar-wrap"><main>', True), ('<div id="search-page"><div role="main">', True), ('<div class="header-fixed"><main>', True), ('<header><main>', False),
    ('<div class="sidebar"><div>', False), ('<div class="related"><article>', False), ('<nav class="menu"><main>', False), ('<div class="sidebar" hidden><main>', False),
    ('<div class="sidebar"><aside><main>', False),
])
def test_main_inside_a_name(start, kept):
    prose = "A paragraph of plain words that is long enough to be taken for the content of this page by all means."
    assert (prose in html_text.main_text(f"{start}<p>{prose}</p><p>{prose}</p>", html_text.trained_tree())) == kept


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    labels(spark, [] if empty else ((1, 1, 0), (2, 0, 1))).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([] if empty else ROWS, KINDS).selectExpr("*", "'x' AS key", "2 AS size")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        if k < 4:
            assert out.columns == docs.columns, name
        docs = spark.read.parquet(path)
        assert not empty or docs.count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    ids = [i for i, _ in kept]
    # One row of each component: both texts of id 1, and of the rows without an id only the text that no other row has.
    assert sorted(i for i in ids if i is not None) == [-8, 1, 1, 2, 5, 6, 7] and [t for i, t in kept if i is None] == ["no id here"]
    assert len({t for i, t in kept if i == 1}) == 2


def test_mixed_documents(spark):
    df = frame(spark, [(i, "w " * (5 + i % 3), "en", "a" if i % 4 else "b", 0) for i in range(40)])
    counts = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_counts(df, block=4).collect()}
    copies = {r.doc_id: r["count"] for r in mixing.mix_documents(df, block=4).groupBy("doc_id").count().collect()}
    for i, (size, taken) in counts.items():
        assert abs(copies.get(i, 0) - taken / size) <= 0.5
    assert mixing.mix_documents(df, block=4).columns == df.columns


def test_pipeline_decisions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_id = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf).cache()
        by_id[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            bad = toxicity.passages(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("predicted = 1")
            assert by_id[name] == {r.doc_id for r in docs.collect()} - {r.doc_id for r in bad.collect()}
        if name == "simhash":
            own = simhash.near_duplicates(docs).where("doc_id = component_id")
            assert by_id[name] == {r.doc_id for r in own.collect()}
        docs = out
    assert by_id["simhash"] <= by_id["quality"] <= by_id["toxicity"]
