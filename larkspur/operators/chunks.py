"""Ordered rows of a session cut into chunks of bounded size, each with the rows next to it that a window needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk, and places of a range.
CHUNK = 1 << 16


def matching(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by ``keys`` where null equals null; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(other[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def with_neighbours(rows: DataFrame, before: int, after: int, order: str, chunk: int = CHUNK, session: str = "session_id") -> DataFrame:
    """``rows`` with _chunk and _halo: the rows of (session, _chunk) are a chunk and, marked as halo, at least the ``before`` rows ahead of it and the ``after`` behind.

    ``order`` is a whole number, unique in a session. Ranges of ``chunk`` places are counted map-side; ranges that begin within the same ``chunk`` rows of a session are a chunk, so a chunk has less than
    twice that many rows and a session that fits is one chunk, however its places are spread. Windows over a session see the table of ranges only, never rows. A range's first or last rows are dealt
    again only to chunks that they are next to.
    """
    place = F.floor(F.col(order) / F.lit(chunk))
    rows = rows.withColumn("_range", place)
    counts = rows.groupBy(session, "_range").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(session).orderBy("_range")
    ranges = counts.withColumn("_p", F.sum("_n").over(along) - F.col("_n")).withColumn("_chunk", F.floor(F.col("_p") / F.lit(chunk)))
    start, end = F.struct("_chunk", F.col("_p").alias("at")), F.struct("_chunk", (F.col("_p") + F.col("_n")).alias("at"))
    # A range has a row at least, so only so many ranges on either side can reach a chunk.
    later = F.collect_list(start).over(along.rowsBetween(1, before)) if before else F.array().cast("array<struct<_chunk:bigint,at:bigint>>")
    earlier = F.collect_list(end).over(along.rowsBetween(-after, -1)) if after else F.array().cast("array<struct<_chunk:bigint,at:bigint>>")
    ranges = ranges.withColumns({"_later": later, "_earlier": earlier})
    near = lambda x, ok: F.array_distinct(F.transform(F.filter(x, lambda r: (r["_chunk"] != F.col("_chunk")) & ok(r["at"])), lambda r: r["_chunk"]))
    ranges = ranges.withColumns({
        "_later": near("_later", lambda at: at < F.col("_p") + F.col("_n") + before), "_earlier": near("_earlier", lambda at: at > F.col("_p") - after),
    })
    out = matching(rows, ranges.select(session, "_range", "_chunk"), [session, "_range"]).withColumn("_halo", F.lit(False))
    sides = ((before, "_later", F.col(order).desc()), (after, "_earlier", F.col(order).asc()))
    for most, to, by in sides:
        if most:
            some = matching(rows, ranges.where(F.size(to) > 0).select(session, "_range", to), [session, "_range"])
            nearest = some.withColumn("_k", F.row_number().over(Window.partitionBy(session, "_range").orderBy(by))).where(F.col("_k") <= most)
            out = out.unionByName(nearest.withColumn("_chunk", F.explode(to)).withColumn("_halo", F.lit(True)).drop("_k", to))
    return out.drop("_range")


def chunk_window(order: Column | str, *more: str, session: str = "session_id") -> Window:
    """The window of a chunk and its halo in order."""
    return Window.partitionBy(session, "_chunk", *more).orderBy(order)
