"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words of letters, lower-cased; a word that is not in the lexicon falls back on its first 8 to 4 letters. What is counted is
a word once a document, and of a prefix each of its different words once a document, so that repetition tells nothing. Log-odds
of toxic against clean documents use an informative Dirichlet prior (the background share of a token times
``strength``), and a token enters the lexicon if its z-score is high and its share beyond chance. The linear-time scan of Ruzzo and Tompa finds all maximal
segments of a text. A segment of score S in n tokens is expected K n exp(-lambda S) times by chance: lambda
solves sum p exp(lambda s) = 1 for the shares p at which clean training texts match the lexicon, K comes from the segments found in them. The summed
-log p of a text's segments, through a logistic curve fitted to the training rows, is the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import only, words_of, written
from larkspur.llm.labelled import training_rows

WORD = r"[^\W\d_]+"
PREFIXES = (8, 7, 6, 5, 4)
STRENGTH = 0.1


def keys_of(word: str) -> list[str]:
    """The word, and its prefixes as ``abcde*``, the longest first."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of a sequence, in order, in linear time."""
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, stop, total before, total after, nearest earlier segment with a smaller total before
    for i in np.nonzero(scores > 0)[0].tolist():
        new = [i, i + 1, totals[i], totals[i + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


@dataclass
class ToxicModel:
    """Scores of the lexicon's tokens, of any other token, and the calibration."""

    lexicon: dict[str, float] = field(default_factory=dict)
    other: float = -0.05
    rate: float = 1.0
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def known(self) -> KnownScores:
        return KnownScores(self)

    def match(self, word: str) -> str | None:
        """The word's own entry in the lexicon, or that of its longest prefix."""
        return next((k for k in keys_of(word) if k in self.lexicon), None)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Sum of -log of the chance of a segment as good in ``n`` tokens."""
        total = 0.0
        for _, _, s in found:
            log_e = math.log(self.k * max(n, 1)) - self.rate * s
            total -= math.log(-math.expm1(-math.exp(log_e))) if log_e > -30 else log_e
        return total

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * evidence)))


class KnownScores(dict):
    """Score of each word met so far; emptied when it has grown too large."""

    def __init__(self, model: ToxicModel, most: int = 500_000):
        super().__init__()
        self.model, self.most, self.find = model, most, re.compile(WORD).findall

    def __missing__(self, word: str) -> float:
        key = self.model.match(word)
        value = self[word] = self.model.other if key is None else self.model.lexicon[key]
        return value

    def read(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal segments of a text."""
        if len(self) > self.most:
            self.clear()
        words = self.find(text.lower())
        scores = np.fromiter(map(self.__getitem__, words), dtype=float, count=len(words))
        return len(words), segments(scores) if len(words) and scores.max() > 0 else []


def _least_shingle(words: str) -> Column:
    w = F.col(words)
    ends = F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0)))
    return F.coalesce(F.array_min(F.transform(ends, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5))))), F.lit(0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, different words with it summed over documents, those of toxic ones) of each batch of (text, label)."""
    find = re.compile(WORD).findall
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            keys = [k for w in set(find(text.as_py().lower())) for k in keys_of(w)]
            every.update(keys)
            if label:
                toxic.update(keys)
        yield _table(every, toxic)


def _table(every: Counter, toxic: Counter) -> pa.RecordBatch:
    names = list(every)
    columns = [pa.array(names, pa.string()), pa.array([every[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["token", "n", "toxic"])


def log_odds(toxic, clean, n_toxic: float, n_clean: float, strength: float = STRENGTH):
    """(log-odds, z) of tokens with an informative prior of ``strength`` times the corpus, as numpy arrays."""
    prior, mass = strength * (toxic + clean), strength * (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic + mass - a)) - np.log(b / (n_clean + mass - b))
    return odds, odds / np.sqrt(1 / a + 1 / b)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, most_rows: int = 20_000,
    least_z: float = 3.0, least_odds: float = 2.0, chance: float = 1.0,
) -> ToxicModel:
    """Learn from at most ``most_rows`` labelled rows whose remainder is not ``held``.

    Rows with the same least hash of their 5-word shingles are copies and count once, so that a copied text's
    words don't look telling. A token's share of toxic rows must also be out of reach of chance, at
    ``chance`` over all tokens tested; no other limit keeps a token out, and what passes it is bounded by the sample's size. Without both classes, or
    without a telling token, every score is the share of toxic rows. Null texts count as empty, null ids and labels are left out.
    """
    rows = training_rows(only(docs, doc_id="doc_id", text="text"), labels, "toxic", parts, held, most_rows)
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("shingle", _least_shingle("words"))
    rows = rows.groupBy("shingle", "label").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "label")
    rows = written(rows, "toxic-rows")
    counted = rows.mapInArrow(_counted, "token string, n long, toxic long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counted = written(counted, "toxic-counts")
    total = counted.where(~F.col("token").endswith("*")).agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("tokens")).first()
    n_toxic = float(total.toxic or 0)
    n_clean = float((total.n or 0) - n_toxic)
    model = ToxicModel()
    if n_toxic and n_clean:
        share = n_toxic / (n_toxic + n_clean)
        part = F.least(F.col("toxic") / F.col("n"), F.lit(1 - 1e-12))
        # The logarithm of the chance of so high a share; what fails this test is no candidate, whatever its odds.
        unlikely = -F.col("n") * (part * F.ln(part / share) + (1 - part) * F.ln((1 - part) / (1 - share)))
        found = counted.where((part > share) & (unlikely <= math.log(chance / total.tokens))).orderBy("token").collect()
        toxic, every = (np.array([r[c] for r in found], dtype=float) for c in ("toxic", "n"))
        odds, z = log_odds(toxic, every - toxic, n_toxic, n_clean)
        top = Counter()  # of a prefix, the count of its commonest word: alone, that says nothing of the others
        for r in found:
            for k in keys_of(r.token)[1:] if not r.token.endswith("*") else ():
                top[k] = max(top[k], r.toxic)
        model.lexicon = {r.token: float(o) for r, o, v in zip(found, odds, z, strict=True) if v >= least_z and o >= least_odds and r.toxic >= 1.5 * top[r.token]}
    if model.lexicon:
        _matched(model, rows)
    _calibrate(model, rows, most_rows)
    return model


def _matched(model: ToxicModel, rows: DataFrame) -> None:
    """Score of all other tokens, and the rate, from the words of clean and of toxic rows that match each entry."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, own = re.compile(WORD).findall, {}
        for batch in batches:
            every, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = find(text.as_py().lower())
                for w in set(words).difference(own):
                    own[w] = model.match(w) or ""
                keys = list(map(own.__getitem__, words))
                every.update(keys)
                if label:
                    toxic.update(keys)
            if len(own) > 500_000:
                own = {}
            yield _table(every, toxic)

    # Bounded by the lexicon.
    seen = rows.mapInArrow(match, "token string, n long, toxic long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()
    hits = sorted((r.token, r.n - r.toxic, r.toxic) for r in seen if r.token)
    clean, toxic = (np.array([h[k] for h in hits], dtype=float) for k in (1, 2))
    n_clean, n_toxic = sum(r.n - r.toxic for r in seen), sum(r.toxic for r in seen)
    prior = STRENGTH * (clean + toxic)
    p = (clean + prior) / (n_clean + STRENGTH * (n_clean + n_toxic))
    p_toxic = (toxic + prior).sum() / (n_toxic + STRENGTH * (n_clean + n_toxic))
    model.other = min(math.log1p(-min(p_toxic, 0.9)) - math.log1p(-min(p.sum(), 0.9)), -0.02)
    model.rate = _rate(p, np.array([model.lexicon[h[0]] for h in hits]), model.other)


def _rate(p: np.ndarray, s: np.ndarray, other: float) -> float:
    """The positive root of sum p exp(rate s) + (1 - sum p) exp(rate other) = 1."""
    if not len(p):
        return 1.0
    excess = lambda x: float((p * np.exp(x * s)).sum() + (1 - p.sum()) * math.exp(x * other)) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 0.05)


def _calibrate(model: ToxicModel, rows: DataFrame, most_rows: int) -> None:
    """K from the segments of clean rows, then the logistic curve over the rows' evidence."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            seen = [known.read(x.as_py()) for x in batch.column(0)]
            columns = [pa.array([n for n, _ in seen], pa.int64()), pa.array([[s for *_, s in f] for _, f in seen], pa.list_(pa.float64())), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["n", "scores", "label", "hash"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            x = [model.evidence([(0, 0, s) for s in scores], n) for n, scores in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), *batch.columns[2:]], ["x", "label", "hash"])

    seen = written(rows.withColumn("hash", F.xxhash64("text")).mapInArrow(read, "n long, scores array<double>, label int, hash long"), "toxic-segments")
    clean = seen.where("label = 0").agg(F.sum(F.size("scores")).alias("hits"), F.sum("n").alias("tokens")).first()
    least = min(model.lexicon.values(), default=1.0)
    model.k = ((clean.hits or 0) + 0.5) / (max(clean.tokens or 0, 1) * math.exp(-model.rate * least))
    # A row of two numbers each; repeated ids can make more than ``most_rows`` of them, of which those with the smallest hashes of their texts are taken.
    found = np.array(seen.mapInArrow(weigh, "x double, label int, hash long").orderBy("hash", "x").limit(most_rows).select("x", "label").collect(), dtype=float).reshape(-1, 2)
    x, y = found[:, 0], found[:, 1]
    share = (y.sum() + 1) / (len(y) + 2)
    a, b = math.log(share / (1 - share)), 0.0
    if len(y) and y.min() != y.max() and x.any():
        for _ in range(50):  # Newton steps with a weak pull to 0
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([(p - y).sum() + 0.01 * a, ((p - y) * x).sum() + 0.01 * b])
            h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
            move = np.linalg.solve(h, g)
            a, b = a - float(np.clip(move[0], -2, 2)), max(0.0, b - float(np.clip(move[1], -2, 2)))
    model.intercept, model.slope = a, b


def passages(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, most_p: float = 0.01) -> DataFrame:
    """doc_id, score, predicted and the significant passages of every row.

    A passage is (start, stop, score, p) in tokens; those with p under ``most_p`` are given. Null texts count as empty: no
    passage, the score of a text without evidence. Repeated rows are all kept; other columns play no part.
    """
    narrow = only(docs, doc_id="doc_id", text="text")
    part = "array<struct<start: int, stop: int, score: double, p: double>>"
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType)]).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("n_tokens", T.LongType()).add("passages", T._parse_datatype_string(part))
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            scores, sizes, found = [], [], []
            for text in batch.column(1):
                n, own = known.read(text.as_py() or "")
                scores.append(model.score(model.evidence(own, n)))
                sizes.append(n)
                chance = [(a, b, s, -math.expm1(-math.exp(min(math.log(model.k * n) - model.rate * s, 700)))) for a, b, s in own]
                found.append([dict(zip(("start", "stop", "score", "p"), c, strict=True)) for c in chance if c[3] < most_p])
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(sizes, pa.int64()), pa.array(found, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "n_tokens", "passages"])

    return narrow.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``.

    Null texts count as empty, which score as texts without evidence; repeated rows are judged alike and all stay or go, rows without an id too; an
    empty table stays empty. Where labels have one class only, the score is its share, so without any toxic label nothing goes.
    """
    model = fit_toxicity(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            seen = (known.read(x.as_py() or "") for x in batch.column(at))
            yield batch.filter(pa.array([model.score(model.evidence(own, n)) < threshold for n, own in seen], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
