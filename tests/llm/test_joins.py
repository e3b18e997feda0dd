"""The shingle join, periodic runs and importance resampling against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, importance, periodic, queries, shingle_join

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_shingle_join", "op13_importance"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    mine = sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    assert mine == sorted(con.sql(queries.ORACLES[name]).select(*(duckdb.ColumnExpression(c) for c in sorted(df.columns))).fetchall())


# --- links


def plain_set(text, width=5):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain_components(sets, share=80):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= share * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def families(seed, n=160, families=5, words=40, edits=3):
    """Texts in families of near copies, chained so that members may be unlike, that all hold one passage."""
    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(30)]
    bases = [[f"b{f}_{k}" for k in range(words)] for f in range(families)]
    for i in range(n):
        f = rng.randrange(families + 1)
        if f == families:
            own = [f"u{i}_{k}" for k in range(rng.randrange(0, 9))]
            rows.append((i, " ".join(own + passage)))
            continue
        text = list(bases[f])
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(9)}"
        if rng.random() < 0.2:
            bases[f] = text
        rows.append((i, " ".join(text + passage * (f % 2)).upper() if i % 7 == 0 else " ".join(text + passage * (f % 2))))
    return rows


@pytest.mark.parametrize(("rounds", "chunk"), [(6, 2048), (0, 3), (0, 2048), (1, 4)])
def test_links_of_families(spark, rounds, chunk):
    rows = families(rounds + chunk)
    want = plain_components({i: plain_set(t) for i, t in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in shingle_join.joined(df, rounds=rounds, chunk=chunk).collect()}
    assert found == {i: (want[i], len(plain_set(t))) for i, t in rows}
    assert 1 < len(set(want.values())) < len(rows)


def test_likeness_at_the_limit(spark):
    words = [f"w{k}" for k in range(12)]
    # 8 shingles, and 8 of 10: exactly 0.8; 7 and 7 of 9: under it.
    rows = [(5, " ".join(words)), (3, " ".join([*words, "x", "y"])), (4, " ".join(["z", *words[:11]])), (9, ""), (8, None), (7, "a  b\tA"), (6, "A b a"), (2, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.joined(df).collect()}
    want = plain_components({i: plain_set(t) for i, t in rows})
    assert {i: c for i, (_, c) in found.items()} == want
    assert found[9] == (0, 9) and found[8] == (0, 8) and found[7] == (1, 6) and found[2] == (1, 2) and found[5][1] == found[3][1] == 3 and found[4] == (8, 4)


def test_tree_leaves_no_pair_out():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 6, size=(200, shingle_join.GROUPS))
    vectors = np.abs(base[rng.integers(0, 200, 900)] + rng.integers(-1, 2, size=(900, shingle_join.GROUPS)) * (rng.random((900, shingle_join.GROUPS)) < 0.2))
    sizes, roots = vectors.sum(axis=1), np.arange(900) % 300
    want = {
        (i, j) for i in range(900) for j in range(i + 1, 900)
        if roots[i] != roots[j] and shingle_join.linked(int(np.minimum(vectors[i], vectors[j]).sum()), int(sizes[i]), int(sizes[j]), 80)
    }
    both = np.ones(900, dtype=bool)
    assert set(shingle_join.tree_pairs(sizes, vectors, roots, both, 80)) == want != set()
    sides = np.arange(900) % 5 == 0
    assert sorted(shingle_join.tree_pairs(sizes, vectors, roots, sides, 80)) == sorted(p for p in want if sides[p[0]] != sides[p[1]])
    best = set(shingle_join.tree_pairs(sizes, vectors, roots, both, 80, best=True))
    assert best <= want and {x for p in best for x in p} == {x for p in want for x in p}


def test_hot_group_emits_no_pairs(spark):
    """Four hundred near copies: one leader links them, so a few rows a text are compared, not all pairs."""
    rows = [(i, " ".join([*(f"w{k}" for k in range(60)), f"end{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in shingle_join.joined(df).collect()} == {0}


def test_small_steps_have_few_files_and_rounds(spark, monkeypatch):
    """However many shuffle partitions are held, tables of a few rows are one file each, and what few pairs are left is tested at once."""
    files, names = [], []

    def seen(df, name, *most, w=shingle_join.written):
        out = w(df, name, *most)
        names.append(name)
        if name.startswith("components") or name in ("shingle-inside", "shingle-leaders", "shingle-needed", "shingle-own", "shingle-links"):
            files.append(len(out.inputFiles()))
        return out

    for module in (shingle_join, components):
        monkeypatch.setattr(module, "written", seen)
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = families(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = {r.doc_id: r.component_id for r in shingle_join.joined(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain_components({i: plain_set(t) for i, t in rows})
    assert max(files) == 1
    assert names.count("shingle-open") <= 3


def test_few_pairs_are_all_given():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 6, size=(40, shingle_join.GROUPS))
    vectors = base[np.arange(80) % 40]
    sizes, roots, both = vectors.sum(axis=1), np.arange(80), np.ones(80, dtype=bool)
    more: list = []
    assert sorted(shingle_join.tree_pairs(sizes, vectors, roots, both, 80, best=True, few=1, more=more)) == [(i, i + 40) for i in range(40)] and more == []
    vectors = base[np.arange(80) % 4]
    pairs = set(shingle_join.tree_pairs(vectors.sum(axis=1), vectors, roots, both, 80, best=True, few=4, more=more))
    assert set(more) == pairs and len(pairs) <= 80


# --- runs


def plain_runs(w, least=24, times=3):
    """All maximal runs by definition: for each period the longest stretches that repeat at that distance."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 2), (5, 3), (24, 4)])
def test_runs_by_definition(least, times):
    rng = random.Random(least * times)
    some = 0
    for _ in range(300):
        w = []
        for _ in range(rng.randrange(1, 6)):
            u = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 14))]
            w += u * rng.randrange(1, 9) + u[: rng.randrange(len(u))]
        want = plain_runs(w, least, times)
        some += bool(want)
        assert periodic.runs_of(w, least, times) == want
    assert some > 30


def test_overlap():
    assert periodic.overlap(24, 3) == 16
    flags = periodic.repeated(np.array([1, 2, 3, 9, 1, 2, 3, 4]), 3)
    assert flags.tolist() == [True, True, True, False, True, True, True, False]


def test_op12_rows(spark):
    found = {r.doc_id: r for r in queries.op12_periodic(spark, SF).collect()}
    some = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 3000 else periodic.runs_of(w)
        some += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = found[d.doc_id]
        assert (r.n_runs, r.start, r["length"], r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert some > 10


def test_runs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a " * 30), (3, "a " * 30), (None, "x y\t" * 12), (4, "ab " * 23)]
    found = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert got == sorted([("1", [], ""), ("2", [], ""), ("3", [(0, 30, 1)], "a"), ("3", [(0, 30, 1)], "a"), ("None", [(0, 24, 2)], "x y"), ("4", [], " ".join(["ab"] * 23))])


# --- importance


def test_importance_of_odd_rows(spark):
    """Longer features, repeated rows, null ids and texts, against plain counts."""
    texts = ["the cat sat on the mat " * 4, "ÄB cd-99 cd 99", None, "", "the cat sat on the mat " * 4, "dog " * 30]
    ids = [1, 2, 3, 4, 1, None]
    aim = ["the cat", None, "mat the CAT"]

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [" ".join(w[i : i + k]) for k in (1, 2) for i in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % 50
    ours = Counter(bucket(g) for t in texts for g in grams(t)[1])
    theirs = Counter(bucket(g) for t in aim for g in grams(t)[1])
    s, t = sum(ours.values()), sum(theirs.values())
    gain = {b: math.floor(1000.0 * math.log(float(theirs[b] + 1) * float(s + 50) / (float(n + 1) * float(t + 50)))) for b, n in ours.items()}
    want = []
    for i, text in zip(ids, texts, strict=True):
        words, g = grams(text)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(words), len(g), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((-r[4], math.inf if r[0] is None else r[0]) for r in want if r[1] >= 4)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "bucket", "rank", "ids")})
    target = spark.createDataFrame([(x,) for x in aim], "text string")
    found = importance.resampled(docs.repartition(3), target, percent=75, least_words=4, seed=7, buckets=50, longest=2).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in found), key=key) == sorted(((r[0], *r[2:]) for r in want), key=key)
    drawn = sorted((r["rank"], -r.score, math.inf if r.doc_id is None else r.doc_id) for r in found if r["rank"] is not None)
    assert drawn == [(k + 1, *x) for k, x in enumerate(able[: 75 * len(able) // 100])] and len(drawn) == 3


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resampled(none, one).collect() == []
    assert [r["rank"] for r in importance.resampled(one, none, percent=100, least_words=1).collect()] == [1]
