"""Shared helpers: the shared working folder, written intermediates and word expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.expr import BLANKS, let
from larkspur.session import new_folder, remove_folder

__all__ = ["BLANKS", "cleared", "let", "n_words", "only", "words_of", "written"]

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Rows of a file where a table's rows are bounded beforehand.
FILE_ROWS = 1 << 14


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    Any executor can read the files again, so a lost executor costs a reread and no recomputation. ``most``, where known, is a bound of the rows:
    small tables then have a file for each ``FILE_ROWS`` and not one a shuffle partition, and Spark sees that they are small enough to broadcast.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    path = new_folder(spark, name)
    df.write.parquet(path)
    if _made.get() is not None:
        _made.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete on leaving what ``written`` wrote inside; the function given writes a table that stays."""
    outer, own = _made.get(), []
    token = _made.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        _made.set(outer)
        try:
            return written(df, name)
        finally:
            _made.set(own)

    try:
        yield keep
    finally:
        _made.reset(token)
        for path in own:
            remove_folder(spark, path)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for a null text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for a null text."""
    return F.size(words_of(text)).cast("long")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``columns`` (new name = old name); other columns, whatever their names, play no part."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))
