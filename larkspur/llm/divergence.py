"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histograms of character classes and of common words are compared with its language's reference by Jensen-Shannon
distance (base 2, so 0 to 1). References are mean histograms over all texts of a language with enough words, however rare the language is; languages
without such a text, and texts without a language, use the mean over all. The common words are those of the text's language, where a list is known. A text with fewer words than a
guard isn't judged by that histogram, which would be too rough. The driver sees the one row of the mean over all; the languages' references are a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BLANKS, let, only, words_of, written

# Character classes as the ASCII characters in them; those of "lower" and beyond ASCII have no code.
CLASSES = {
    "digit": "0123456789",
    "stop": ".,;:?",
    "mark": "!",
    "quote": "'\"()[]{}-_/\\",
    "symbol": "#*$%&|<>",
    "sign": "@=+~^`",
    "blank": BLANKS,
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Common words of four languages, and some of each for texts in any other.
COMMON_WORDS = {
    "en": "the of and to a in is that it for with was on as by at from this are be".split(),
    "de": "der die das und in den von zu mit sich des auf für im nicht ein eine als dem es".split(),
    "fr": "de la le les et des en un une du que est dans qui par pour sur pas au avec".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo es".split(),
    None: "the of and to a der die und den von le les et des un que el y los del".split(),
}
N_WORDS = 20
N_CLASSES = len(CLASSES) + 2


def class_counts(text: Column, n_chars: Column) -> Column:
    """Characters of each class, then lower-case ASCII letters, then all others."""
    codes = "".join(chr(ord("a") + k) * len(c) for k, c in enumerate(CLASSES.values()))
    kinds = "".join(CLASSES.values())
    # One pass gives each character its class's code, lower-case letters none; the rest is short or rare.
    coded = F.translate(text, kinds + LOWER, codes)

    def counts(c: Column) -> Column:
        own = [F.length(c) - F.length(F.replace(c, F.lit(chr(ord("a") + k)), F.lit(""))) for k in range(len(CLASSES))]
        total = own[0]
        for x in own[1:]:
            total = total + x
        return F.array(*(x.cast("long") for x in own), n_chars - F.length(c), (F.length(c) - total).cast("long"))

    return let(coded, counts)


def repeat_words(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of ``width`` words that the text has twice or more, the first included."""
    grams = F.when(
        F.size(words) > width,
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width)))),
    )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda p: F.filter(p, lambda x, k: F.coalesce((F.get(p, k - 1).h == x.h), F.lit(False)) | F.coalesce((F.get(p, k + 1).h == x.h), F.lit(False))),
        )
        places = F.sort_array(F.transform(twice, lambda x: x.i))
        return let(
            places,
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(s, k + 1), x + width) - x)), F.lit(0), lambda a, x: a + x
            ),
        )

    return F.coalesce(
        let(grams, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(covered(h))), F.lit(0)
    ).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms of every row, as counts."""
    t = F.col("text")
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("text", F.coalesce(t, F.lit("")))
    listed = F.array(*map(F.lit, COMMON_WORDS[None]))
    for lang, words in COMMON_WORDS.items():
        if lang:
            listed = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(listed)
    rows = rows.withColumns({
        "words": words_of(t),
        "n_chars": F.length(t).cast("long"),
        "lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
        "listed": listed,
    })
    every = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("words")),
        "by_class": class_counts(t, F.col("n_chars")),
        "common": F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(every)),
    })
    place = {c: k for k, c in enumerate(CLASSES)}
    found = F.array(*((F.size("common") - F.size(F.array_remove("common", F.get("listed", k)))).cast("long") for k in range(N_WORDS)))
    rows = rows.withColumn("found", found)
    rest = F.col("n_words") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", "lang", "n_words",
        (F.col("n_chars") - F.get("by_class", place["blank"])).alias("word_chars"), F.get("by_class", place["symbol"]).alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", "by_class", F.concat("found", F.array(rest)).alias("by_word"),
    )


def shares(counts: Column) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1).cast("long"))
    return let(total, lambda n: F.transform(counts, lambda x: x / n))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: let((a + b) / 2, lambda m: (term(a, m) + term(b, m)) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def references(rows: DataFrame, least_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """Mean shares (classes, commons) over the texts of each language, a row per lang; and over all texts, one row."""
    kept = rows.where(F.col("n_words") >= least_words)
    columns = [F.get(shares(F.col("by_class")), k).alias(f"c{k}") for k in range(N_CLASSES)]
    columns += [F.get(shares(F.col("by_word")), k).alias(f"w{k}") for k in range(N_WORDS + 1)]
    means = [F.avg(c).alias(c) for c in (*(f"c{k}" for k in range(N_CLASSES)), *(f"w{k}" for k in range(N_WORDS + 1)))]
    arrays = [
        F.array(*(F.col(f"c{k}") for k in range(N_CLASSES))).alias("classes"),
        F.array(*(F.col(f"w{k}") for k in range(N_WORDS + 1))).alias("commons"),
    ]
    own = kept.select("lang", *columns)
    per = own.where(F.col("lang").isNotNull()).groupBy("lang").agg(*means)
    return per.select("lang", *arrays), own.agg(*means).select(*arrays)


def judged(
    docs: DataFrame, most_class: float = 0.2, most_common: float = 0.45, both: tuple[float, float] = (0.155, 0.24), class_guard: int = 25, common_guard: int = 50,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Base counts, base_failed, both distances and kept of every row.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: not failed, and each
    distance whose guard (words) is met is at most its limit, nor are the two above ``both`` together. Null texts count as empty and fail. Repeated rows are all kept as rows; other
    columns play no part.
    """
    rows = written(measured(docs, id_col, text_col, lang_col), "divergence")
    per, overall = references(rows)
    every = overall.first()
    # Written, so that Spark knows its size: a small table is sent to all, for a large one both sides are plain exchanges, whose large parts Spark can split.
    rows = rows.join(written(per, "divergence-references"), "lang", "left")

    def near(name: str, mine: str) -> Column:
        whole = F.array(*(F.lit(x).cast("double") for x in every[mine]))
        return distance(shares(F.col(name)), F.coalesce(F.col(mine), whole))

    rows = rows.withColumns({"class_distance": near("by_class", "classes"), "common_distance": near("by_word", "commons")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bad = ((F.col("n_words") >= class_guard) & (F.col("class_distance") > most_class)) | ((F.col("n_words") >= common_guard) & (F.col("common_distance") > most_common))
    bad = bad | ((F.col("n_words") >= common_guard) & (F.col("class_distance") > both[0]) & (F.col("common_distance") > both[1]))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce(bad, F.lit(False))).alias("kept"), "class_distance", "common_distance",
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SQL_CLASSES = ["0-9", ".,;:?", "!", r"""''"()\[\]{}\-_/\\""", "#*$%&|<>", r"@=+~\^`", r"\x20\x09-\x0D", "A-Z", "a-z"]
#: The same rows in DuckDB, with the default limits.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         CASE lang {' '.join(f"WHEN '{k}' THEN {_sql_list(w)}" for k, w in COMMON_WORDS.items() if k)} ELSE {_sql_list(COMMON_WORDS[None])} END AS listed FROM d),
u AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM e),
g AS (
  SELECT rid, i, lead(w, 4) OVER x AS last, concat_ws(' ', w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x) AS g FROM u WINDOW x AS (PARTITION BY rid ORDER BY i)),
r AS (
  SELECT rid, i FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (
  SELECT rid, sum(n) AS n_repeat_words FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) - i) AS n FROM r) GROUP BY rid),
b AS (
  SELECT e.rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         [{', '.join(f"CAST(length(t) - length(regexp_replace(t, '[{x}]', '', 'g')) AS BIGINT)" for x in _SQL_CLASSES)}] AS cs,
         list_transform(listed, lambda x: len(list_filter(list_transform(ws, lambda y: lower(y)), lambda z: z = x))) AS wc
  FROM e LEFT JOIN c ON c.rid = e.rid),
s AS (
  SELECT *, list_transform(list_append(cs, n_chars - list_sum(cs)), lambda x: CAST(x AS DOUBLE) / greatest(n_chars, 1)) AS p,
         list_transform(list_append(wc, n_words - list_sum(wc)), lambda x: CAST(x AS DOUBLE) / greatest(n_words, 1)) AS q FROM b),
m AS (
  SELECT lang, kind, k, avg(v) AS v FROM (
    SELECT lang, 'p' AS kind, unnest(p) AS v, generate_subscripts(p, 1) AS k FROM s WHERE n_words >= 50
    UNION ALL SELECT lang, 'q', unnest(q), generate_subscripts(q, 1) FROM s WHERE n_words >= 50) WHERE lang IS NOT NULL GROUP BY ALL),
al AS (
  SELECT kind, k, avg(v) AS v FROM (
    SELECT 'p' AS kind, unnest(p) AS v, generate_subscripts(p, 1) AS k FROM s WHERE n_words >= 50
    UNION ALL SELECT 'q', unnest(q), generate_subscripts(q, 1) FROM s WHERE n_words >= 50) GROUP BY ALL),
rf AS (
  SELECT lang, list(m.v ORDER BY k) FILTER (WHERE kind = 'p') AS rp, list(m.v ORDER BY k) FILTER (WHERE kind = 'q') AS rq FROM m GROUP BY 1),
ra AS (
  SELECT list(v ORDER BY k) FILTER (WHERE kind = 'p') AS ap, list(v ORDER BY k) FILTER (WHERE kind = 'q') AS aq FROM al),
z AS (
  SELECT s.*, coalesce(rp, ap) AS rp, coalesce(rq, aq) AS rq FROM s LEFT JOIN rf ON rf.lang = s.lang CROSS JOIN ra),
t AS (
  SELECT *, {', '.join(f"sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i: (CASE WHEN {a}[i] > 0 THEN {a}[i] * log2({a}[i] / (({a}[i] + {o}[i]) / 2)) ELSE 0.0 END + CASE WHEN {o}[i] > 0 THEN {o}[i] * log2({o}[i] / (({a}[i] + {o}[i]) / 2)) ELSE 0.0 END) / 2)), 0.0)) AS d{a}" for a, o in (('p', 'rp'), ('q', 'rq')))},
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM z)
SELECT doc_id, n_words, n_chars - cs[7] AS word_chars, cs[5] AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((n_words >= 25 AND dp > 0.2) OR (n_words >= 50 AND dq > 0.45) OR (n_words >= 50 AND dp > 0.155 AND dq > 0.24), false) AS kept
FROM t
"""
