"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what is left.

A run of length L and smallest period q repeats its first L - q words at distance q. With L >= max(``least``, ``times`` * q) those are at least
``overlap(least, times)`` words, so with that number as k every word of a run lies in a k-gram that the text holds twice. Words outside such
k-grams can't be part of a run; the stretches between them are searched by divide and conquer: a run that crosses the middle of a
stretch has its period among the distances to either side of the middle, and its ends by common extensions there, which compare
ranks of words' powers of two and so are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import let, only, words_of

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Pairs of places compared at a time.
PAIRS = 1 << 20


def overlap(least: int, times: int) -> int:
    """Fewest words that a run of ``least`` words and ``times`` periods has in common with itself, one period on."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """A flag for each word: is it in a k-gram that occurs twice or more? Grams are compared by a 64-bit mix, so a flag may be set in excess, never missed."""
    n = len(ids) - k + 1
    flags = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return flags
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    grams, have = np.zeros(n, dtype=np.uint64), 0
    power, width = mixed, 1
    while have < k:  # k as a sum of powers of two
        if k & width:
            grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + power[have : have + n]
            have += width
        if have < k:
            power = power[:-width] * np.uint64(0xD6E8FEB86659FD93) + power[width:]
            power = power ^ (power >> np.uint64(31))
            width *= 2
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return flags
    twice = np.zeros(n + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + k] -= 1
    return np.cumsum(edges)[:-1] > 0


class Extensions:
    """Exact lengths of common extensions within one stretch, by ranks of its substrings of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.ranks) - 1) <= self.n // 2:
            last, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            pairs = last[:-step].astype(np.int64) * (int(last.max()) + 1) + last[step:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words alike from a and from b > a on."""
        done, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
        top = len(self.ranks) - 1
        while len(live):  # the longest power as often as it goes, then each shorter one once
            fits = b[live] + done[live] + (1 << top) <= self.n
            live = live[fits]
            live = live[self.ranks[top][a[live] + done[live]] == self.ranks[top][b[live] + done[live]]]
            done[live] += 1 << top
        for j in range(top - 1, -1, -1):
            live = np.flatnonzero(b + done + (1 << j) <= self.n)
            live = live[self.ranks[j][a[live] + done[live]] == self.ranks[j][b[live] + done[live]]]
            done[live] += 1 << j
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words alike before a and before b > a."""
        done, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
        top = len(self.ranks) - 1
        while len(live):
            fits = a[live] - done[live] >= 1 << top
            live = live[fits]
            back = done[live] + (1 << top)
            live = live[self.ranks[top][a[live] - back] == self.ranks[top][b[live] - back]]
            done[live] += 1 << top
        for j in range(top - 1, -1, -1):
            live = np.flatnonzero(a - done >= 1 << j)
            back = done[live] + (1 << j)
            live = live[self.ranks[j][a[live] - back] == self.ranks[j][b[live] - back]]
            done[live] += 1 << j
        return done


def _crossing(ids: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), b > a, of which one is a middle of the divide and conquer and the other one period away, words next to both alike."""
    n, size = len(ids), 1
    while size < n:
        size *= 2
    while size >= least:
        reach = min(size // times, n)
        middles = np.arange(size // 2, n, size)
        rows = max(1, PAIRS // reach)
        periods = np.arange(1, reach + 1)
        for k in range(0, len(middles), rows):
            c = middles[k : k + rows, None]
            for a, b in ((c + 0 * periods, c + periods), (c - periods, c + 0 * periods)):
                a, b = a.ravel(), b.ravel()
                ok = (a >= 0) & (b < n)
                a, b = a[ok], b[ok]
                # A run over a middle goes on at it or before it.
                alike = (ids[a] == ids[b]) | ((a > 0) & (ids[a - 1] == ids[b - 1]))
                yield a[alike], b[alike]
        size //= 2


def runs_in(ids: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch: maximal, of the smallest period, ``least`` words and ``times`` periods or more.

    A stretch that is also periodic by a multiple of its period has the same ends under both, so the smaller one stays.
    """
    ends, found = Extensions(ids), {}
    for a, b in _crossing(ids, least, times):
        period, after, before = b - a, ends.forward(a, b), ends.backward(a, b)
        length = after + before + period
        for s, m, q in {*zip(*(x[length >= np.maximum(least, times * period)].tolist() for x in (a - before, length, period)), strict=True)}:
            found[s, m] = min(q, found.get((s, m), q))
    return {(s, m, q) for (s, m), q in found.items()}


def runs_of(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a word sequence by start, then period."""
    k = overlap(least, times)
    if len(words) < least:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) > len(words) - k:
        return []  # a run has k words that came before
    flags = repeated(ids, k)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    out = []
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - start >= least:
            out += [(start + s, m, q) for s, m, q in runs_in(ids[start:end], least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for s, m, q in runs:
        edges[s + q] += 1
        edges[s + m] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    return [w for w, out in zip(words, gone.tolist(), strict=True) if not out] if runs else words


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed (the text without the repeats of its runs, words joined by one space) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``least`` is the fewest words and ``times`` the fewest periods of a run. Null and empty texts have no run and collapse to
    an empty text. Ids are passed through, null and repeated ones too; other columns play no part; an empty table stays empty. A text is one task's work: its ranks take
    4 bytes a word of a surviving stretch for each doubling of the stretch's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                own = runs_of(words, least, times)
                found.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                texts.append(b" ".join(collapsed(words, own)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    narrow = only(docs, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    schema = T.StructType([T.StructField("doc_id", narrow.schema[0].dataType), *T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    return narrow.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """``find_runs``' rows as numbers and digests: the run of the greatest exponent, all runs as ``start,length,period`` lines, and the collapsed text."""
    # Quotients are compared by cross products, so exactly; runs come by start, then period, so the first of equals stays.
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    top = F.aggregate("runs", none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.withColumn("_top", top)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * _top.length) div _top.period").cast("long").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def planted(text: Column, doc_id: Column) -> Column:
    """``text``, in a tenth of the rows by id made periodic from some word on: words joined by one space, each from word a on the word a + (i - a) mod p.

    h is the id's crc32 as text, g a tenth of it; rows with h % 10 = 0 have a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")

    own = let(words_of(text), lambda w: F.when(F.size(w) > 0, made(w)).otherwise(F.lit("")))
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)), own).otherwise(text)
