"""Whole queries, hot ids and hubs, and the pipeline's rows against plain Python."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import mixing, quality, queries, sharding, simhash, tokenbin, toxicity, weighted_sampling
from larkspur.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    for c in BLANKS[1:]:
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def groups_of(prints, radius=3):
    """{fingerprint: its component}, by all pairs."""
    some, root = sorted(set(prints)), {}
    for x in some:
        root[x] = x

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in some}


def plain_print(text):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)] * bool(own)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_rows(spark):
    docs = documents(spark)
    prints = {r.doc_id: plain_print(r.text) for r in docs}
    group = groups_of(prints.values())
    least = {}
    for i, p in prints.items():
        least[group[p]] = min(i, least.get(group[p], i))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, SF).collect()}
    assert found == {i: (f"{p:016x}", least[group[p]]) for i, p in prints.items()}


def test_op1_rows(spark):
    """The whole packing: groups, bundles, chunks, the greedy rule and the slots."""
    docs = documents(spark)
    shards, bundles, weights = 40, 8192, np.array([30.0, 1.0, 1.0])
    rows = [(r.doc_id, len((r.text or "").encode()) + 16, len(words(r.text)), zlib.crc32((r.text or "").encode()), signed(xxhash.xxh64_intdigest((r.text or "").encode(), 42))) for r in docs]
    total = [sum(r[1] for r in rows), sum(r[2] for r in rows), len(rows)]
    share = lambda own: np.array([sum(r[1] for r in own), sum(r[2] for r in own), len(own)], dtype=float) / total
    by_key = {}
    for r in rows:
        by_key.setdefault(r[4], []).append(r)
    chunks, first, at = {}, {}, bundles
    for key in sorted(k for k, own in by_key.items() if share(own).max() > 1 / 1280):
        chunks[key] = math.ceil(share(by_key[key]).max() * 1280)
        first[key], at = at, at + chunks[key]
    units = {}
    for r in rows:
        if r[4] in chunks:
            h = 42
            for part in (struct.pack("<q", r[0]), struct.pack("<q", r[1]), struct.pack("<i", 7)):
                h = xxhash.xxh64_intdigest(part, h)
            unit = first[r[4]] + signed(h) % chunks[r[4]]
        else:
            unit = r[4] % bundles
        units.setdefault(unit, []).append(r)
    items = [[u] for u in sorted(units) if u < bundles]
    for key in sorted(chunks):
        own = [u for u in range(first[key], first[key] + chunks[key]) if u in units]
        items += [own] if share(by_key[key]).max() <= 1 / shards else [[u] for u in own]
    sizes = [sum(share(units[u]) for u in own) for own in items]
    left, base, want = np.full((shards, 3), 1 / shards), [0] * shards, {}
    placed = {}
    for i in np.argsort(-(np.array(sizes) @ weights), kind="stable"):
        placed[i] = int(np.argmax(left @ (sizes[i] * weights)))
        left[placed[i]] -= sizes[i]
    for i, own in enumerate(items):
        for u in own:
            for k, r in enumerate(sorted(units[u], key=lambda r: (r[0], r[1], r[3]))):
                want[r[0]] = (r[1], r[3], placed[i], base[placed[i]] + k)
            base[placed[i]] += len(units[u])
    found = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in queries.op1_sharding(spark, SF).collect()}
    assert found == want


def test_a_group_that_fits_stays_whole(spark):
    """A group of 0.8 of a shard is in one shard, one of three shards is not."""
    rng = random.Random(3)
    rows = [(i, f"text {rng.random()} of its own") for i in range(2000)] + [(10_000 + i, "the same text, all over again") for i in range(200)] + [(20_000 + i, "copies beyond number, in all shards") for i in range(900)]
    found = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).toPandas()
    assert found[(found.doc_id >= 10_000) & (found.doc_id < 20_000)].shard.nunique() == 1 and found[found.doc_id >= 20_000].shard.nunique() > 1
    sizes = found.groupby("shard")["size"].sum()
    assert (sizes.max() - sizes.min()) / sizes.mean() < 0.05


def test_star_of_many_leaves(spark):
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    found = connected_components(edges)
    assert found.count() == 100_000 and found.where("root <> 0").count() == 0


HOT = [(None if i % 2 else (7 if i % 3 == 0 else i), f"text {i % 700} of a row {'x' * (i % 13)} end") for i in range(3000)]


def test_sampling_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame(HOT, "doc_id long, text string")
    rows = weighted_sampling._in_order(df, 64).toPandas()
    own = rows[rows.ahead == 0]
    parts = own.groupby("part").size()
    assert len(own) == 3000 and parts.max() < 60 and own[own.doc_id.isna()].part.nunique() > 100 and own[own.doc_id == 7].part.nunique() > 50
    assert rows[rows.ahead == 1].groupby("part").size().max() == 1
    order = sorted(HOT, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))
    want = Counter()
    for k, (i, text) in enumerate(order):
        after, m = order[(k + 1) % len(order)][1], len(text) // 4
        want[(i, len(text), hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in weighted_sampling.fingerprints(df, samples=4).collect()) == want


def test_mixing_with_null_ids(spark):
    df = spark.createDataFrame([(i, t, str(i % 3) if i is not None else None) for i, t in HOT], "doc_id long, text string, source string")
    placed, _ = mixing.placed_rows(df, block=16)
    rows = placed.toPandas()
    none = rows[rows.source.isna()]
    assert none.key.str[:3].nunique() > 500 and len(rows) == 3000
    for _, own in rows.groupby("source", dropna=False):  # end to end, without gap or overlap
        own = own.sort_values(["start", "size"])
        assert (own.start + own["size"]).tolist()[:-1] == own.start.tolist()[1:] and own.start.min() == 0
    counts = mixing.mix_counts(df, block=16).toPandas()
    for _, own in counts.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) < 1
    assert (counts.taken <= 3 * counts["size"]).all()


def test_other_tokenizer_files_go_through_the_library(spark, tmp_path):
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    assert tokenbin.has_short_way(spec)
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    texts = ["Hello World again", "", "it's 12 o'clock", "Ünïcode ÉÉ"]
    for file in (path, public_tokenizers.path("byte_bpe_50k.json")):
        encode, library = tokenbin.WordIds(file), Tokenizer.from_file(file)
        ids, cuts = encode(pa.array(texts))
        assert not encode.short
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_by_address(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    segments = tokenbin.write_segments(docs, WORDS, tokens_per_segment=500, path=str(tmp_path / "segments"))
    library, some = Tokenizer.from_file(WORDS), documents(spark)[:30]
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in some}
    asked = [(i, p) for i in ids for p in (0, 3, len(ids[i]) - 1, len(ids[i]))] + [(-5, 0), (some[0].doc_id, None), (some[0].doc_id, -1)]
    found = tokenbin.tokens_at(segments, spark.createDataFrame(asked, "doc_id long, position long")).collect()
    want = Counter((i, p, ids[i][p]) for i, p in asked if i in ids and p is not None and 0 <= p < len(ids[i]))
    assert Counter((r.doc_id, r.position, r.id) for r in found) == want


def test_op9_scores(spark):
    """Scores of texts by the model's numbers alone: segments by their definition, the evidence and the curve."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    made = [(1, "you idiot"), (2, "a plain text of no harm at all"), (3, ""), (4, None), (5, "trash " * 6), (6, "the clown and the loser were here, said the stupid man to the clown")]

    def best(scores, low, high):
        top, found = 0.0, None
        for i in range(low, high):
            for j in range(i + 1, high + 1):
                if sum(scores[i:j]) > top + 1e-12:
                    top, found = sum(scores[i:j]), (i, j)
        return [] if found is None else [*best(scores, low, found[0]), top, *best(scores, found[1], high)]

    found = {r.doc_id: r for r in toxicity.passages(spark.createDataFrame(made, "doc_id long, text string"), model).collect()}
    for i, text in made:
        tokens = [w.strip(",").lower() for w in (text or "").split()]
        scores = [next((model.lexicon[k] for k in (w, *(w[:n] + "*" for n in (8, 7, 6, 5, 4) if len(w) > n)) if k in model.lexicon), model.other) for w in tokens]
        chance = [1 - math.exp(-model.k * len(tokens) * math.exp(-model.rate * s)) for s in best(scores, 0, len(scores))]
        want = 1 / (1 + math.exp(-(model.intercept - model.slope * sum(map(math.log, chance)))))
        assert abs(found[i].score - want) < 1e-6 and found[i].predicted == (want >= 0.3)


def test_pipeline_rows(spark):
    """run() against plain Python: verdicts row by row, components by all pairs, the mix in closed form, the library's ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.passages(docs, toxicity.fit_toxicity(docs, labels)).where("score >= 0.3").collect()}
    rows = {i: r for i, r in rows.items() if i not in bad}
    left = docs.where(~F.col("doc_id").isin(list(bad) or [-1]))
    model = quality.fit_quality(left, labels)
    columns = [f"_f_{k}" for k in quality.FEATURES]
    seen = quality.with_statistics(left.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))).select("doc_id", *columns).collect()
    good = {r.doc_id for r, p in zip(seen, model.predict(np.array([list(r)[1:] for r in seen], dtype=float)), strict=True) if p >= 0.3}
    rows = {i: r for i, r in rows.items() if i in good}
    prints = {i: plain_print(r.text) for i, r in rows.items()}
    group, chosen = groups_of(prints.values()), {}
    for i in sorted(rows):
        chosen.setdefault(group[prints[i]], i)
    rows = {i: rows[i] for i in chosen.values()}
    size = {i: len(words(r.text)) for i, r in rows.items()}
    sources = sorted({r.source for r in rows.values()}, key=lambda s: (s is None, s or ""))
    whole = [sum(size[i] for i, r in rows.items() if r.source == s) for s in sources]
    goals = mixing.targets_of(whole, [(1, 2, 3)[k % 3] for k in range(len(sources))])
    copies = Counter()
    key = lambda i: hashlib.md5(f"mix:{i}:{hashlib.md5((rows[i].text or '').encode()).hexdigest()}".encode()).hexdigest()
    for s, total, goal in zip(sources, whole, goals, strict=True):
        at = 0
        for i in sorted((i for i, r in rows.items() if r.source == s), key=key):
            for epoch in range(3):
                taken = max(0, min(size[i], int(goal) - at - epoch * total))
                copies[i] += size[i] > 0 and 2 * taken >= size[i]
            at += size[i]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, n in copies.items():
        ids = [*library.encode(rows[i].text), 2]
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += n
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == +want and len(found) > 50


def test_keep_one_keeps_one_row_of_each_component(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: plain_print(r.text) for r in documents(spark)}
    group, least = groups_of(prints.values()), {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(least.values())
