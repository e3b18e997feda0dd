"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees over the statistics of a bounded labelled sample give paths; each path is a rule, a conjunction of comparisons.
A lasso-penalised logistic regression weighs the rules and drops most of them. Those that stay are
compiled into one Spark column expression, so scoring runs in the JVM at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BLANKS, only, words_of
from larkspur.llm.labelled import remainder, training_rows

FEATURES = ("n_words", "mean_word", "symbols", "pipes", "marks", "digits", "capitals", "distinct", "dup_lines", "points", "line_words")
Rule = tuple[tuple[int, bool, float], ...]  # (feature, is it above, cut), all of which hold


def with_statistics(df: DataFrame, text: str = "_text", words: str = "_words") -> DataFrame:
    """``df`` with a column per statistic of its text column; ``words`` becomes the array of words."""
    t = F.col(text)
    df = df.withColumn(words, words_of(t))
    n, size = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.withColumn("_lines", lines)
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    n_lines = F.greatest(F.size("_lines"), F.lit(1))
    own = {
        "n_words": F.size(words).cast("double"),
        "mean_word": F.length(F.translate(t, BLANKS, "")) / size,
        "symbols": without("#*$%&|<>") / n,
        "pipes": without("|") / size,
        "marks": without("!") / n,
        "digits": without("0123456789") / n,
        "capitals": F.regexp_count(t, F.lit(r"\p{Lu}")) / n,
        "distinct": F.size(F.array_distinct(words)) / size,
        "dup_lines": 1 - F.size(F.array_distinct("_lines")) / n_lines,
        "points": without(".,;:?") / size,
        "line_words": F.size(words) / n_lines,
    }
    return df.withColumns({f"_f_{k}": own[k].cast("double") for k in FEATURES})


@dataclass
class RuleModel:
    """Intercept and weighted rules; ``base`` is the score where nothing could be learned."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, above, cut in rule:
                column = F.col(f"_f_{FEATURES[k]}")
                holds = holds & (column > cut if above else column <= cut)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same scores for a matrix of statistics."""
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds_for(rule, x)
        return 1 / (1 + np.exp(-total))


def holds_for(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def tree_paths(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, least: int):
    """Grow one regression tree; yields (rule, rows, leaf value or None) for every node but the root."""
    stack = [((), rows, depth)]
    while stack:
        rule, own, left = stack.pop()
        g, h = gradient[own].sum(), hessian[own].sum()
        best = (1e-9, None)
        if left:
            for k, grid in enumerate(cuts):
                if not len(grid):
                    continue
                side = np.searchsorted(grid, x[own, k], side="left")  # x <= grid[i] iff side <= i
                count = np.bincount(side, minlength=len(grid) + 1).cumsum()[:-1]
                gl = np.bincount(side, gradient[own], len(grid) + 1).cumsum()[:-1]
                hl = np.bincount(side, hessian[own], len(grid) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(count < least) | (len(own) - count < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (k, float(grid[int(gain.argmax())])))
        if best[1] is None:
            if rule:
                yield rule, own, -g / (h + 1)
            continue
        if rule:
            yield rule, own, None
        k, cut = best[1]
        above = x[own, k] > cut
        stack += [(rule + ((k, True, cut),), own[above], left - 1), (rule + ((k, False, cut),), own[~above], left - 1)]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, seed: int = 1) -> RuleModel:
    """Rules from boosted trees, weighed by lasso logistic regression (accelerated proximal gradient)."""
    share = (y.sum() + 1) / (len(y) + 2)
    plain = RuleModel(float(np.log(share / (1 - share))), [])
    if len(y) < 20 or y.min() == y.max():
        return plain
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    rng, margin, rules = np.random.default_rng(seed), np.full(len(y), plain.intercept), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        for rule, _, value in tree_paths(x, p - y, p * (1 - p), rows, cuts, depth, max(3, len(y) // 500)):
            rules.setdefault(tuple(sorted(rule)), None)
            if value is not None:
                margin = margin + rate * value * holds_for(rule, x)
    names = sorted(rules)
    held = np.array([holds_for(r, x) for r in names], dtype=float).T
    keep = (held.mean(axis=0) > 0.001) & (held.mean(axis=0) < 0.999)
    names, held = [r for r, k in zip(names, keep, strict=True) if k], held[:, keep]
    mean, scale = held.mean(axis=0), held.std(axis=0)
    z = (held - mean) / scale
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w = v = np.zeros(len(names))
    b = c = plain.intercept
    t = 1.0
    for _ in range(600):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    kept = [(r, float(k / s)) for r, k, s in zip(names, w, scale, strict=True) if k]
    return RuleModel(float(b - (w / scale * mean).sum()), kept)


def fit_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, most_rows: int = 20_000) -> RuleModel:
    """Learn from at most ``most_rows`` labelled rows whose remainder is not ``held``."""
    own = training_rows(only(docs, doc_id="doc_id", text="text"), labels, "quality", parts, held, most_rows)
    columns = [f"_f_{k}" for k in FEATURES]
    rows = with_statistics(own.withColumnRenamed("text", "_text")).select("doc_id", "label", *columns)
    # Where ids repeat there may be more rows than labels: a sample by hash, and then in one order whatever the sample.
    some = rows.orderBy(F.xxhash64("doc_id", *columns), "doc_id", *columns).limit(most_rows).collect()
    found = np.array([r[1:] for r in sorted(some, key=lambda r: (r.doc_id, *r[2:]))], dtype=float)
    found = found.reshape(-1, len(columns) + 1)
    return fit_rules(found[:, 1:], found[:, 0])


def scored(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row. Null texts count as empty; other columns play no part."""
    rows = with_statistics(only(docs, doc_id="doc_id", _text="text").withColumn("_text", F.coalesce("_text", F.lit(""))))
    rows = rows.withColumn("score", model.score())
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more.

    Null texts count as empty, whose statistics are 0; repeated rows are judged alike and all stay or go, rows without an id too; an empty table stays empty. Without
    labels of both classes every score is the share of good labels, half without any, so nothing or everything stays.
    """
    model = fit_quality(docs, labels)
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    # A filter would be pushed below the statistics, and each rule would work them out anew; a generator stays above them.
    kept = F.explode(F.filter(F.array(model.score()), lambda x: x >= threshold)).alias("_score")
    return with_statistics(own).select("_row", kept).select("_row.*")


def held_out(parts: int, held: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False))
