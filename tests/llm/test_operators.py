"""Each operator against brute force, the library it follows, or DuckDB."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from larkspur.llm import divergence, html_text, labelled, mixing, quality, queries, sentencepieces, sharding, simhash, tokenbin, toxicity, weighted_sampling
from larkspur.llm.components import connected_components

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- sharding


def test_place_is_the_greedy_rule():
    rng = np.random.default_rng(1)
    vectors = rng.random((60, 3)) / 60
    weights = (2.0, 1.0, 1.0)
    residual, want = np.full((5, 3), 0.2), {}
    for i in sorted(range(60), key=lambda i: (-(vectors[i] * weights).sum(), i)):
        dots = [sum(vectors[i][d] * weights[d] * residual[s][d] for d in range(3)) for s in range(5)]
        want[i] = dots.index(max(dots))
        residual[want[i]] -= vectors[i]
    assert sharding.place(vectors, 5, weights).tolist() == [want[i] for i in range(60)]


def test_shards_are_even_whole_and_gapless(spark, docs):
    many = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10_000 + k, "the same text") for k in range(300)], "doc_id long, text string"))
    rows = sharding.pack_shards(many, shards=8, bundles=64).toPandas()
    assert len(rows) == many.count()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    by = rows.groupby("shard")["size"].sum()
    assert (by.max() - by.min()) / by.mean() < 0.1
    assert rows[rows.doc_id >= 10_000].shard.nunique() > 1  # a group of over half a shard is split


def test_small_groups_stay_together(spark, docs):
    pairs = docs.select("doc_id", "text").unionAll(docs.selectExpr("doc_id + 5000", "text"))
    rows = sharding.pack_shards(pairs, shards=4).toPandas()
    assert (rows.groupby("text_crc32").shard.nunique() == 1).mean() > 0.99


# --- sentencepiece


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_normalisation_equals_library(rule, trim):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=trim)
    spec = next(v for k, v in sentencepieces.fields(library.serialized_model_proto()) if k == 3)
    align = sentencepieces.Aligner(spec)
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("aB Ａﬁ①㍿　 \t\né각カﾞ½…x") for _ in range(rng.randrange(10)))
        data, source = align(text.encode())
        assert data.decode() == library.normalize(text)
        assert len(source) == len(data) + 1 and (np.diff(source) >= 0).all()


def test_ids_spans_and_round_trip(spark, docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = sentencepieces.encode_decode(docs, PIECES).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = [*library.encode(texts[r.doc_id]), 2]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        data = texts[r.doc_id].encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.stops, strict=True)) == data
    r = found[0]
    for i, a, b in zip(r.ids[1:50], r.starts[1:50], r.stops[1:50], strict=True):
        if library.is_byte(i):
            continue
        assert library.id_to_piece(i).replace("▁", " ") == texts[r.doc_id].encode()[a:b].decode()


# --- quality


def test_compiled_rules_equal_the_model(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    columns = [f"_f_{k}" for k in quality.FEATURES]
    rows = quality.with_statistics(docs.select("doc_id", docs.text.alias("_text"))).select("doc_id", *columns, model.score().alias("score")).toPandas()
    assert np.allclose(rows.score, model.predict(rows[columns].to_numpy()))


def test_lasso_rules_learn_a_conjunction():
    rng = np.random.default_rng(4)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.4) & (x[:, 2] <= 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.97 and len(model.rules) < 60
    assert quality.fit_rules(x, np.ones(600)).rules == []


def _held_out(spark, query, label, sf="/root/testdata/sf0.01"):
    found = query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    own = found[found.held_out]
    return (own.predicted == own[label]).mean(), found


def test_quality_on_held_out_rows(spark):
    right, found = _held_out(spark, queries.op3_quality, "quality")
    assert right > 0.95 and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()


# --- html


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<script>var x = "<p>no</p>";</script><div class="cookie-notice">We use cookies so that this page can be better for all of its many readers today.</div>
<main><article><h2>Title &amp; more</h2><p>First  paragraph&nbsp;with <b>bold</b> and <a href="x">a link</a> inside of it.</p><p>Of.</p><!-- <p>no</p> -->
<aside>Related stories that readers of this one also liked a lot last week.</aside><p>Last<br>words</p></article></main>
<section id="comments"><article class="comment"><p>A reader's long comment that says many things and none of them matters here.</p></article></section>
<form><label>Mail</label><button>Go</button></form><footer>&copy; 2024</footer></body></html>"""


def test_page(spark):
    text = html_text.main_text(PAGE, html_text.trained_tree())
    assert text == "Title & more\nFirst paragraph with bold and a link inside of it.\nOf.\nLast words"


def test_broken_pages():
    tree = html_text.trained_tree()
    for page in ("", "plain words only", "<", "<p", "<!--", "<script>x", "<p><b><i>a" * 50, "</div></p>" * 20, '<div class="' + "x" * 10_000):
        assert isinstance(html_text.main_text(page, tree), str)
    cut = PAGE[: PAGE.index("Last")]
    assert html_text.main_text(cut, tree).startswith("Title & more")


def test_tree_learns_its_table():
    pages = html_text.training_pages()
    x = np.vstack([html_text.features([b[:-1] for b in page]) for page in pages])
    y = [b[-1] for page in pages for b in page]
    tree = html_text.trained_tree()
    assert sum(tree(r) == bool(v) for r, v in zip(x.tolist(), y, strict=True)) / len(y) > 0.95


# --- token binary


def test_random_access():
    rng = random.Random(5)
    ids = np.array([rng.choice([0, 1, 255, 256, 49_000, 65_536, 2**31]) for _ in range(3000)], dtype=np.uint32)
    segment = tokenbin.Segment(tokenbin.pack(ids, np.array([0, 10, 3000])))
    assert (segment.all() == ids).all() and [segment[i] for i in range(3000)] == ids.tolist()
    with pytest.raises(IndexError):
        segment[3000]
    with pytest.raises(ValueError):
        tokenbin.Segment(b"nothing here....")


def test_ids_equal_library(texts):
    import pyarrow as pa

    rng = random.Random(6)
    odd = ["".join(rng.choice(["a", "É", "é", "ǅ", "İ", "½", " ", "\x1c", "\xa0", "\n", "'s", "!", "中", "<|endoftext|>", "<|", "Σ", "ς", "👍"]) for _ in range(rng.randrange(20))) for _ in range(800)]
    every = [*texts.values(), *odd, "", " "]
    encode = tokenbin.WordIds(WORDS)
    ids, cuts = encode(pa.array(every))
    for k, e in enumerate(Tokenizer.from_file(WORDS).encode_batch_fast(every, add_special_tokens=False)):
        assert e.ids == ids[cuts[k] : cuts[k + 1]].tolist()


def test_files_hold_every_document(spark, docs, texts):
    segments = tokenbin.write_segments(docs, WORDS, tokens_per_segment=500)
    found = {r.doc_id: r for r in tokenbin.read_documents(segments).collect()}
    library, at = Tokenizer.from_file(WORDS), 0
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# --- simhash


def test_fingerprint_by_hand():
    def plain(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\n", " ").replace("\t", " ").split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ("", " ", "a", "A b", "a b c", "a b c d a b c", "É x\ty\nz É x y"):
        assert simhash.fingerprint_of(text) == plain(text)
    assert simhash.fingerprint_of(None) == 0


def test_masks_cover_every_triple():
    masks = simhash.covering_masks(3)
    rng = random.Random(7)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & flips for m in masks)
    for m in masks[:3]:
        assert all(any(not b & f for b in simhash.blocks_of(m)) for f in (sum(1 << b for b in rng.sample([i for i in range(64) if not m >> i & 1], 3)) for _ in range(300)))


@pytest.mark.parametrize("bucket", [2, 1000])
def test_links_equal_brute_force(spark, bucket):
    rng = random.Random(8)
    values = {0, 1, 3, 7, 15, 31, 2**63, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values.add(centre)
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    root = {s: s for s in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = find(signed[i]), find(signed[j])
                root[max(x, y)] = min(x, y)
    want = {}
    for s in signed:
        want.setdefault(find(s), set()).add(s)
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket=bucket)
    groups = {}
    for r in connected_components(edges).collect():
        groups.setdefault(r.root, {r.root}).add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 901: 900}


# --- mixing


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(mixing.ORACLE + " ORDER BY doc_id").fetchall()}
    found = {r.doc_id: tuple(r)[1:] for r in queries.op7_mixing(spark, SF).collect()}
    assert found == want


def test_targets_and_dyadic_intervals():
    assert mixing.targets_of([10, 10, 1], [1, 2, 3]) == [6.0, 12.0, 3.0]
    assert mixing.targets_of([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets_of([], []) == []
    rng = random.Random(9)
    for _ in range(20):
        low, high = sorted(rng.sample(range(1 << 10), 2))
        parts = mixing.dyadic(low, high, 10)
        points = [int(f"{s:010b}"[::-1], 2) for s in range(1 << 10)]
        inside = [low <= p < high for p in points]
        for s in (0, 1, 77, 500, 1023):
            assert mixing.slots_before(s, parts) == sum(inside[:s])


def test_prefixes_of_the_schedule_are_near_the_targets(spark, docs):
    rows, sources = mixing.placed_rows(docs, block=16)
    stream = mixing.mixed_stream(rows, sources, block=16).toPandas()
    goal = {x["sid"]: x["slots"] for x in sources}
    every = sum(goal.values())
    slots = stream[["slot", "sid"]].drop_duplicates().sort_values("slot")
    assert slots.slot.is_unique and len(slots) == every
    for n in (every // 7, every // 3):
        counts = slots.head(n).sid.value_counts()
        assert all(abs(counts.get(s, 0) - g * n / every) < 12 for s, g in goal.items())


# --- divergence


def plain_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for own in grams.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, docs, texts):
    made = {-1: "a b c d e a b c d e", -2: "a a a a a a", -3: "x\n \nx\nx\r\n", -4: "", -5: "a b c d e f a b c d e f g\vh", -6: "#*$%&|<>^~ é ÉÜ"}
    extra = spark.createDataFrame([(k, v, "en") for k, v in made.items()], "doc_id long, text string, lang string")
    rows = divergence.judged(docs.select("doc_id", "text", "lang").unionAll(extra)).collect()
    for r in rows:
        text = texts.get(r.doc_id, made.get(r.doc_id))
        n = plain_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, text[:80]
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_distance(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "p array<double>, q array<double>")

    def plain(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return float(np.sqrt((kl(p) + kl(q)) / 2))

    for r in one.select("p", "q", divergence.distance(F.col("p"), F.col("q")).alias("d")).collect():
        assert abs(r.d - plain(r.p, r.q)) < 1e-12


def test_clean_documents_are_kept(spark):
    found = queries.op8_divergence(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    clean = found[(found.quality == 1) & ~found.base_failed]
    assert clean.kept.mean() > 0.98 and found[found.quality == 0].kept.mean() < 0.2


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rare_languages_have_their_own_reference(spark, threshold):
    rng = random.Random(11)
    make = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    english = "the of and to Some plain words, in that house it was here. with for a long day by".split()
    greek = "και το της να με την από Ένα σπίτι, που είναι στο χωριό μας. για τους ανθρώπους εδώ".split()
    russian = "и в не на что Этот дом, который был здесь. как это для они мы его день люди".split()
    rows = [(i, make(english, 60), "en") for i in range(2100)]
    rows += [(9001, make(greek, 80), "el"), (9002, make(greek, 80), "el"), (9003, make(greek, 30), "el"), (9004, make(russian, 80), "ru"), (9005, make(russian, 30), "xx")]
    assert 2 * 1000 < 2100  # neither holds a thousandth of the texts
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {r.doc_id: r for r in divergence.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == len(rows) and all(found[i].kept for i in (9001, 9002, 9003, 9004))
    # Against the mean over all: a language without a text of 50 words.
    assert not found[9005].kept and found[9005].class_distance > 0.8
    assert found[9004].class_distance == 0 and found[9004].common_distance == 0

    def plain(text):
        kinds = [*divergence.CLASSES.values(), divergence.LOWER]
        counts = [sum(c in k for c in text) for k in kinds]
        return np.array([*counts, len(text) - sum(counts)]) / len(text)

    mean = (plain(rows[2100][1]) + plain(rows[2101][1])) / 2
    for i, text, _ in rows[2100:2103]:
        p = plain(text)
        m = (p + mean) / 2
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        assert abs(found[i].class_distance - np.sqrt((kl(p) + kl(mean)) / 2)) < 1e-9


# --- toxicity


def plain_segments(scores):
    """All maximal segments by their recursive definition: the best one, then left and right of it."""

    def best(low, high):
        top, found = 0.0, None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > top + 1e-12:
                    top, found = total, (i, j + 1)
        return [] if found is None else [*best(low, found[0]), found, *best(found[1], high)]

    return best(0, len(scores))


def test_segments_are_maximal():
    rng = random.Random(10)
    for _ in range(200):
        scores = np.array([rng.choice([-3.0, -1.0, -0.3, 0.7, 2.1]) for _ in range(rng.randrange(25))])
        found = toxicity.segments(scores)
        assert [round(s, 6) for *_, s in found] == [round(float(scores[a:b].sum()), 6) for a, b, _ in found]
        assert [(a, b) for a, b, _ in found] == plain_segments(scores.tolist())


def test_toxicity_on_held_out_rows(spark):
    found = queries.op9_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    right, found = _held_out(spark, queries.op9_toxicity, "toxic")
    assert right > 0.9 and found.score.between(0, 1).all()
    clean = found[(found.toxic == 0)]
    assert (clean.predicted == 0).mean() > 0.97


def test_planted_passage(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{filler(4)} {'idiot you scum moron' if i % 4 == 0 else 'you are so fine'} {filler(8)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    found = toxicity.passages(docs, model).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in found)
    hit = next(r for r in found if r.doc_id == 4)
    assert (hit.passages[0].start, hit.passages[-1].stop) == (4, 8)


def test_toxic_rows_stay_in_a_sample_of_repeated_ids(spark):
    rng = random.Random(7)
    made = []
    for i in range(120):
        for _ in range(4):  # four texts an id, so that there are four times as many rows as labels
            words = [rng.choice("river stone garden window market letter bread music".split()) for _ in range(30)]
            if i % 4 == 0:
                words[10:14] = ["vilescum", "drossling", "vilescum", "grubheart"]
            made.append((i, " ".join(words)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, most_rows=120)
    assert model.slope > 0
    found = toxicity.passages(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in found)


# --- weighted sampling


def plain_code(words, draw):
    least = None
    for word, n in words.items():
        h = signed(xxhash.xxh64_intdigest(word.encode(), 42))
        a = xxhash.xxh64_intdigest(struct.pack("<i", draw), xxhash.xxh64_intdigest(struct.pack("<q", h), 42))
        g = xxhash.xxh64_intdigest(struct.pack("<q", signed(a)), 42)
        u = lambda x, s: ((x >> s & (1 << 21) - 1) + 0.5) / (1 << 21)
        r, c, b = -np.log(u(a, 0) * u(a, 21)), np.log(-np.log(u(g, 0) * u(g, 21))), (g >> 42) / (1 << 22)
        t = int(np.floor(np.log(n) / r + b))
        steps = int(np.floor((c - r * (t - b + 1)) * (1 << 26)))
        value = steps * (1 << 24) + (((a >> 33) ^ t) & (1 << 24) - 1)
        least = value if least is None else min(least, value)
    return (-1 if least is None else least) & 0xFFFFFFFF


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_samples_by_hand(spark):
    made = {1: "a b a c", 2: "", 3: "x y z", 4: "a b a c", 5: "é ü é"}
    rows = weighted_sampling.fingerprints(spark.createDataFrame(list(made.items()), "doc_id long, text string"), samples=8).collect()
    ids = sorted(made)
    for r in rows:
        text, after = made[r.doc_id], made[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        code = lambda t: [plain_code(Counter(t.split()), k) for k in range(8)]
        got = [int(r.fingerprint[8 * k : 8 * k + 8], 16) for k in range(8)]
        alike = lambda a, b: sum(x == y for x, y in zip(code(a), code(b), strict=True)) / 8
        assert got == code(text)
        assert (r.near_next, r.near_edited) == (alike(text, after), alike(text, edited))
    assert {r.doc_id: r.fingerprint for r in rows}[1] == {r.doc_id: r.fingerprint for r in rows}[4]


def test_likeness_follows_generalised_jaccard(spark, docs, texts):
    def jaccard(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        whole = sum((a | b).values())
        return sum((a & b).values()) / whole if whole else 1.0

    rows = weighted_sampling.fingerprints(docs, samples=32).collect()
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    errors = []
    for r in rows:
        text, nxt = texts[r.doc_id], texts[after[r.doc_id]]
        m = len(text) // 4
        edited = text[: len(text) - m] + nxt[:m]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, nxt)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.1


# --- labelled rows


def test_training_rows_are_bounded_and_fixed(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = [sorted(r.doc_id for r in labelled.training_rows(docs, labels, "quality", 5, 0, 20).collect()) for _ in range(2)]
    assert some[0] == some[1] and len(some[0]) == 20
    assert all(zlib.crc32(str(i).encode()) % 5 for i in some[0])
