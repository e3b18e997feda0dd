"""The bounded sample of labelled rows that the two classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most_rows: int) -> DataFrame:
    """doc_id, text, label of labelled rows whose remainder is not ``held``: at most ``most_rows`` labels.

    The labels with the smallest hashes of their ids are taken, so the sample is the same on
    every run. Null ids and null labels are left out, repeated labels count once. Being bounded, the sample is broadcast.
    """
    some = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), parts) != held))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    return docs.join(F.broadcast(some), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
