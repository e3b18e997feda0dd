"""Set similarity of word shingles by a count-vector R-tree: all links at a Jaccard likeness of ``share`` percent or more.

A text's set of hashed shingles is dealt into ``GROUPS`` groups by hash; its point is the vector of the groups' counts. Two sets can't have more in common
than the sum of the smaller counts, so pairs under the needed overlap by that sum are no links, and what is left is verified on the sets themselves.

The points of a whole corpus lie too close in every coordinate to cut them into regions that few pairs straddle, so the trees are local. Linked sets share
one of their n - ceil(n * share) + 1 rarest shingles (the order is by a count sketch over all texts, then hash: any order is right, and a rare first
one keeps passages that many texts hold out of it); each such shingle has a block of the sets that it is rare in. Blocks of the same sets count once, and a tree
over each block's points drops the sets that the bound leaves without a partner. In a block the others are first compared with
one leader, which joins most near copies, however many, in time linear in their number; blocks that still hold several components are cut into
chunks of bounded size, and a tree over each pair of chunks yields each set's best partner of another component, or all of them where they are few,
round by round while many of those are links, and in the end all pairs of different components that the bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import cleared, only, written
from larkspur.llm.components import connected_components

GROUPS = 256
SLOT_BITS, SEGMENT = 20, 1 << 16
LEAF = 16
#: Largest block whose sets are all asked for partners at once, and largest share of a component in a mixed chunk.
WHOLE, MIXED = 512, 64
#: After the first round a tree's pairs are all tested if they are no more than so many a set.
FEW = 4
_RANDOM = np.random.default_rng(11)
#: Words are polynomials over random values of their bytes, modulo 2**64; A-Z have the values of a-z.
_BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of the base and of its inverse, as many as the longest text so far has bytes."""

    def __init__(self):
        self.up, self.down = (np.ones(1, dtype=np.uint64) for _ in range(2))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(1 << 16, 1 << (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up, self.down


def shingle_set(text: str | None, width: int, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; of the whole sequence if it is shorter, none without a word.

    A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``. Different shingles have equal hashes by chance alone, about 1 in 2**60 a pair.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    each = (sums[ends] - sums[starts]) * down[starts]
    each ^= each >> np.uint64(32)
    each *= _SPREAD
    span = min(width, len(each))
    out = np.full(len(each) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        out += each[k : k + len(out)] * _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(32)
        out *= _SPREAD
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def prefix_size(n: int, share: int) -> int:
    """How many of a set's shingles, in an order that all sets follow, must meet those of a linked set: n - ceil(n * share / 100) + 1."""
    return n - -(-n * share // 100) + 1


def linked(common: int, a: int, b: int, share: int) -> bool:
    """Is common / (a + b - common) at least ``share`` percent? With a bound in place of ``common``: can it be?"""
    return (100 + share) * common >= share * (a + b)


class Tree:
    """R-tree over count vectors, packed by sort and tile: slabs by size, then the coordinate that varies most.

    Leaves hold ``LEAF`` points; a node has its points' largest counts and the range of their sizes.
    """

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray):
        slab = max(1, int((len(sizes) * LEAF) ** 0.5))
        by_size = np.argsort(sizes, kind="stable")
        wide = int(vectors.var(axis=0).argmax())
        self.order = by_size[np.lexsort((vectors[by_size, wide], np.arange(len(sizes)) // slab))]
        self.levels = [(vectors[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            cuts = np.arange(0, len(self.levels[-1][0]), LEAF)
            self.levels.append(tuple(f.reduceat(x, cuts) for f, x in zip((np.maximum, np.minimum, np.maximum), self.levels[-1], strict=True)))

    def near(self, size: int, vector: np.ndarray, share: int) -> np.ndarray:
        """Points that may be linked with a set of this size and vector: those below nodes that the bound leaves."""
        nodes = np.zeros(1, dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            most, low, high = (x[nodes] for x in self.levels[k])
            bound = np.minimum(most, vector).sum(axis=1)
            # The smallest member that the ratio of sizes allows needs the least overlap.
            least = np.maximum(low, -(-size * share // 100))
            ok = (100 * high >= share * size) & (share * low <= 100 * size) & ((100 + share) * bound >= share * (least + size))
            nodes = nodes[ok]
            if k:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[k - 1][0])]
        return self.order[nodes]


def tree_pairs(
    sizes: np.ndarray, vectors: np.ndarray, roots: np.ndarray, sides: np.ndarray, share: int, best: bool = False, few: int = 0, more: list | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs of places of different roots that the bound leaves, each once; with ``best`` only the pair of the largest bound of each place that asks.

    Where there are two sides (a flag a place), pairs are those across, and the smaller side asks a tree of the larger one. With ``best`` all pairs come too
    if they are no more than ``few`` a place that asks; else the pairs of places that have others beside are added to ``more``, so if that stays empty nothing is left out.
    """
    alone = sides.all() or not sides.any()
    smaller = sides if sides.sum() * 2 <= len(sides) else ~sides
    asking, asked = (np.arange(len(sides)),) * 2 if alone else (np.flatnonzero(smaller), np.flatnonzero(~smaller))
    tree = Tree(sizes[asked], vectors[asked])
    held = []
    for i in asking.tolist():
        found = asked[tree.near(int(sizes[i]), vectors[i], share)]
        found = found[roots[found] != roots[i]]
        if best:
            held.append((i, found))
        else:
            yield from ((min(i, j), max(i, j)) for j in found.tolist() if not alone or j > i)
    whole = sum(len(found) for _, found in held) <= few * len(asking) * (1 + alone)
    for i, found in held:
        if whole:
            yield from ((min(i, j), max(i, j)) for j in found.tolist() if not alone or j > i)
        elif len(found):
            bound = np.minimum(vectors[found], vectors[i]).sum(axis=1)
            j = int(found[(bound / (sizes[found] + sizes[i] - bound)).argmax()])
            if more is not None and len(found) > 1:
                more.append((min(i, j), max(i, j)))
            yield min(i, j), max(i, j)


def _slot_order(docs: DataFrame, width: int) -> np.ndarray:
    """Rank of each slot (the first bits of a hash) by how many shingles of all texts fall into it; the table's size is fixed, and sums of a task come first."""
    slots = 1 << SLOT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(), np.zeros(slots, dtype=np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(counts, (shingle_set(text.as_py(), width, powers) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.uint32(1))
        if counts.any():
            parts = [counts[k : k + SEGMENT].tobytes() for k in range(0, slots, SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["segment", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENT, dtype=np.uint64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_py(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["segment", "counts"])

    parts = docs.select("text").mapInArrow(run, "segment int, counts binary").groupBy("segment").applyInArrow(add, "segment int, counts binary")
    counts = np.zeros(slots, dtype=np.uint64)
    # As many rows as segments, a fixed number: one job brings them, and no empty partition is asked for.
    for r in parts.coalesce(slots // SEGMENT).collect():
        counts[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.counts, "<u8")
    rank = np.empty(slots, dtype=np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(slots, dtype=np.uint32)
    return rank


def _prints(docs: DataFrame, width: int, share: int) -> DataFrame:
    """doc_id, tk (hash of the text), n, sid (hash of the set, null for an empty one), keys (the rarest shingles) and counts; the last two null where the task had the set before."""
    ranks = docs.sparkSession.sparkContext.broadcast(_slot_order(docs, width))
    rest = np.uint64(64 - SLOT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            n, sid, keys, counts = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), width, powers)
                n.append(len(own))
                sid.append(_sid(own))
                if not len(own) or sid[-1] in seen:
                    keys.append(None)
                    counts.append(None)
                    continue
                seen.add(sid[-1])
                # The slot's rank in place of the slot: the same order for all sets, and no two hashes alike in it.
                order = (ranks.value[(own >> rest).astype(np.int64)].astype(np.uint64) << rest) | (own & ((np.uint64(1) << rest) - np.uint64(1)))
                first = prefix_size(len(own), share)
                # 40 bits are enough to meet: sets that meet by chance aren't linked.
                keys.append((np.partition(order, first - 1)[:first] & np.uint64((1 << 40) - 1)).astype(np.int64))
                counts.append(_packed(own))
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tk", "n", "sid", "keys", "counts"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("tk long, n long, sid long, keys array<long>, counts binary").fields])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tk")).mapInArrow(run, schema)


def _sid(own: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else None


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows alike in their first ``keys`` columns, which come one after the other, as columns of values: no more than a group and a batch is held."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, [list(c) for c in zip(*held, strict=True)]
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, [list(c) for c in zip(*held, strict=True)]


def _packed(own: np.ndarray) -> bytes:
    """Counts of a set's hashes by group: a byte each where that holds them, else four."""
    counts = np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def _vector(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "<u1" if len(counts) == GROUPS else "<u4").astype(np.int64)


def _vectors(counts: list[bytes]) -> np.ndarray:
    return np.stack([_vector(x) for x in counts])


def _bounded(pairs: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (a, b) of sids that the sizes and the counts' bound leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, n, c, d = (x.to_pylist() for x in batch.columns)
            ok = [linked(int(np.minimum(_vector(p), _vector(q)).sum()), x, y, share) for x, y, p, q in zip(m, n, c, d, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(v, ok, strict=True) if k], pa.int64()) for v in (a, b)], ["a", "b"])

    one, other = (known.select(*(F.col(c).alias(f"{c}_{k}") for c in ("sid", "n", "counts"))) for k in "ab")
    rows = pairs.join(one, F.col("a") == F.col("sid_a")).join(other, F.col("b") == F.col("sid_b"))
    rows = rows.where((100 * F.col("n_a") >= share * F.col("n_b")) & (100 * F.col("n_b") >= share * F.col("n_a")))
    return rows.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(run, "a long, b long")


def _live(members: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """Those of ``members`` (key, sid, m) that the bound leaves with a partner in their block; blocks of over ``WHOLE`` stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids = [], []
        for (key,), (sid, n, counts) in _groups(batches, 1):
            sizes, vectors = np.array(n), _vectors(counts)
            tree = Tree(sizes, vectors)
            alive = [x for i, x in enumerate(sid) if len(tree.near(n[i], vectors[i], share)) > 1]
            keys += [key] * len(alive)
            sids += alive
            if len(sids) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sids, pa.int64())], ["key", "sid"])
                keys, sids = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sids, pa.int64())], ["key", "sid"])

    small = members.where(F.col("m") <= WHOLE).join(known, "sid").select("key", "sid", "n", "counts")
    dealt = small.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, sid long").unionAll(members.where(F.col("m") > WHOLE).select("key", "sid"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """sid and hashes of the sets of the texts ``wanted`` (tk); of copies of a text a task keeps one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in batches:
            sid, hashes = [], []
            for text in batch.column(0):
                own = shingle_set(text.as_py(), width, powers)
                if len(own) and (one := _sid(own)) not in seen:
                    seen.add(one)
                    sid.append(one)
                    hashes.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(hashes, pa.binary())], ["sid", "hashes"])

    texts = docs.select("text", F.xxhash64("text").alias("tk")).join(wanted.select("tk"), "tk", "left_semi")
    return texts.select("text").mapInArrow(run, "sid long, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, share: int, most: int) -> DataFrame:
    """Those of the pairs (a, b) of sids, ``most`` or fewer, that are links, by the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(*batch.columns, strict=True):
                p, q = np.frombuffer(p.as_py(), "<u8"), np.frombuffer(q.as_py(), "<u8")
                if linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), share):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # Later rounds have few pairs: only their sets are dealt.
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "shingle-needed", 2 * most)
    sets = sets.join(needed, "sid", "left_semi")
    one, other = (sets.select(*(F.col(c).alias(f"{c}_{k}") for c in sets.columns)) for k in "ab")
    rows = pairs.join(one, F.col("a") == F.col("sid_a")).join(other, F.col("b") == F.col("sid_b"))
    return rows.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long").distinct()


def _open(members: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``members`` (key, sid), ``most`` or fewer, with their root, of the blocks that hold several components."""
    rows = written(members.join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", F.coalesce("root", "sid").alias("root")), "shingle-rooted", most)
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    return rows.join(written(several.select("key", "m"), "shingle-several", most), "key")


def _tree_pairs(rows: DataFrame, known: DataFrame, share: int, chunk: int, best: bool, few: int, most: int) -> DataFrame:
    """Pairs (a, b) of different components in the blocks ``rows`` (key, sid, root, m; ``most`` or fewer) that the trees leave; ``more`` where one is a set's best and others beside are left out.

    A block is cut into chunks of some ``chunk`` sets, a component with more than ``MIXED`` into chunks of its own; pairs of chunks of one and the same
    component are left out, so a block of one large component and some others takes time linear in its size.
    """
    own = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("r"))
    rows = rows.join(written(own, "shingle-own", most), ["key", "root"])
    large = F.col("r") > min(chunk, MIXED)
    place = F.when(large, F.struct(F.col("root").alias("c"), F.pmod(F.xxhash64("sid"), F.ceil(F.col("r") / chunk)).alias("s"), F.lit(True).alias("one")))
    place = place.otherwise(F.struct(F.pmod(F.xxhash64("root"), F.ceil(F.col("m") / chunk)).alias("c"), F.lit(0).cast("long").alias("s"), F.lit(False).alias("one")))
    rows = written(rows.select("key", "sid", "root", place.alias("at")), "shingle-chunks", most)
    chunks = written(rows.select("key", "at").distinct(), "shingle-chunks", most)
    left, right = chunks.withColumnRenamed("at", "x"), chunks.withColumnRenamed("at", "y")
    both = left.join(right, "key").where((F.col("x") < F.col("y")) | (F.col("x") == F.col("y")) & ~F.col("x.one"))
    both = both.where(~(F.col("x.one") & F.col("y.one") & (F.col("x.c") == F.col("y.c"))))
    sides = both.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("at"))
    # The counts come last, so that they are dealt once.
    met = rows.join(sides, ["key", "at"]).select(F.struct("key", "x", "y").alias("group"), (F.col("at") == F.col("x")).alias("side"), "sid", "root").join(known.select("sid", "n", "counts"), "sid")
    met = met.select("group", "side", "sid", "root", "n", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, sid, root, n, counts) in _groups(batches, 1):
            sids, roots = np.array(sid), np.array(root)
            left: list[tuple[int, int]] = []
            # A set's best comes a second time, marked.
            pairs = np.array([*tree_pairs(np.array(n), _vectors(counts), roots, np.array(side), share, best, few, left), *left], dtype=np.int64).reshape(-1, 2)
            ends = np.sort(sids[pairs], axis=1)
            more = np.arange(len(pairs)) >= len(pairs) - len(left)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(more)], ["a", "b", "more"])

    found = met.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long, more boolean")
    return found.groupBy("a", "b").agg(F.bool_or("more").alias("more"))


def links(prints: DataFrame, docs: DataFrame, width: int, share: int, chunk: int, rounds: int) -> DataFrame:
    """node and root of the sets of ``prints`` that are linked with a smaller one, by components of all links."""
    keyed = prints.where("keys is not null").select(F.explode("keys").alias("key"), "sid")
    # Dealt by key once: where a key's sets meet, the window tells whether they are several.
    own = Window.partitionBy("key")
    met = keyed.select("key", "sid", F.min("sid").over(own).alias("lo"), F.max("sid").over(own).alias("hi")).where("lo < hi")
    members = written(met.select("key", "sid").distinct(), "shingle-members")
    alike = members.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor("sid").alias("x"), F.bit_xor(F.xxhash64("sid")).alias("y"))
    once = written(alike.groupBy("lo", "hi", "m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "shingle-once", members.count())
    members = written(members.join(once, "key"), "shingle-members")
    most = members.count()
    inside = written(members.select("sid").distinct(), "shingle-inside", most)
    facts = prints.where("counts is not null").join(inside, "sid").groupBy("sid").agg(F.min(F.struct("tk", "n", "counts")).alias("x")).select("sid", "x.*")
    known = written(facts, "shingle-known", most)
    # First a leader a block, for groups of any size; then each set's best partner of another component, or all where they are few, as long as a quarter of the best are links; last all that the bound leaves.
    leaders = written(members.groupBy("key").agg(F.min("sid").alias("leader")), "shingle-leaders", most)
    led = members.join(leaders, "key").where("sid <> leader").select("key", F.col("leader").alias("a"), F.col("sid").alias("b"))
    pairs = written(_bounded(led.select("a", "b").distinct(), known, share), "shingle-pairs", most)
    # A block whose sets may all be linked with its leader is live as it is; the others' sets may have partners beside it.
    near = led.join(pairs.withColumn("near", F.lit(True)), ["a", "b"], "left")
    mixed = written(near.groupBy("key").agg(F.count("near").alias("n"), F.count(F.lit(1)).alias("m")).where("n < m").select("key"), "shingle-mixed", most)
    other = written(members.join(mixed, "key"), "shingle-other", most)
    members = written(members.join(mixed, "key", "left_anti").select("key", "sid").unionAll(_live(other.where("m > 2"), known, share)), "shingle-live")
    inside = written(members.select("sid").distinct(), "shingle-inside", most)
    wanted = written(known.join(inside, "sid").select("tk"), "shingle-wanted", most)
    sets = written(_sets(docs, wanted, width), "shingle-sets")
    # Of a set's leaders one is enough to begin with: what another one would join is open in a block.
    pairs = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "shingle-pairs", most)
    n = pairs.count()
    edges, tested = written(_verified(pairs, sets, share, n), "shingle-links", n), pairs
    best, few, roots = rounds > 0, 1, connected_components(edges, n)
    while True:
        rows = written(_open(members, roots, most), "shingle-open", most)
        if rows.isEmpty():
            return roots
        n = rows.count()
        asked = written(_tree_pairs(rows, known, share, chunk, best, few, n), "shingle-asked", FEW * n if best else None)
        many = asked.where("more").count()
        pairs = written(asked.join(tested, ["a", "b"], "left_anti").select("a", "b"), "shingle-pairs", asked.count())
        n = pairs.count()
        found = written(_verified(pairs, sets, share, n), "shingle-links", n)
        hits, edges, tested = found.count(), edges.unionAll(found), tested.unionAll(pairs)
        if hits:
            roots = connected_components(edges, edges.count())
        if not many:
            return roots
        rounds -= 1
        best, few = rounds > 0 and 4 * hits > many, FEW


def joined(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1024, rounds: int = 6) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included) of every row of ``docs``.

    Two texts are linked when their sets of shingles of ``width`` words have a Jaccard likeness of ``share`` percent or more. A text of fewer words is one shingle; null and
    empty texts have none and are linked with nothing, equal ones included. Null ids take part but name a component only if it has no other. Repeated rows stay, an empty table gives an empty one; other
    columns play no part.
    """
    with cleared(docs.sparkSession) as keep:
        narrow = only(docs, doc_id=id_col, text=text_col)
        prints = keep(_prints(narrow, width, share), "shingle-prints")
        roots = links(prints, narrow, width, share, chunk, rounds)
        # One row a set and one a component, each aggregated map-side and written, so that the join back is of plain exchanges that Spark can split.
        most = prints.count()
        each = prints.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
        table = written(each.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "first", F.coalesce("root", "sid").alias("root")), "shingle-table", most)
        firsts = written(table.groupBy("root").agg(F.min("first").alias("component_id")), "shingle-firsts", most)
        named = keep(table.join(firsts, "root").select("sid", "component_id"), "shingle-names")
    whole = prints.select("doc_id", "n", "sid")
    some = whole.where("sid is not null").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionAll(whole.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same rows in SQL: all pairs of different sets that share a shingle, and components by recursion.
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
d AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, n, unnest(s) AS g FROM d),
p AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.id, b.id HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
r(id, c) AS (SELECT id, id FROM d UNION SELECT r.id, p.b FROM r JOIN p ON r.c = p.a),
k AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.c, s.doc_id) AS component_id FROM s LEFT JOIN d ON d.s = s.s LEFT JOIN k ON k.id = d.id"""
