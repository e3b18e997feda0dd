"""Training-text pipeline: the stages in order, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Toxic
documents go, then poor ones, then all but one of each group of near-duplicates; the mix repeats or leaves out
documents by their sources' targets, and the last stage encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import mixing, quality, sentencepieces, simhash, toxicity
from larkspur.llm.common import cleared


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# All stages: null texts count as empty ones, repeated rows and null ids are judged like any other row, other columns pass through whatever
# their names, and an empty table stays empty. Texts are read whole.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for toxicity; copies are alike, so all stay or go. Empty texts score as texts without evidence."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for quality; copies are alike, so all stay or go. Empty texts are scored by their statistics, all 0."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links at 3 bits or fewer: the smallest doc_id, null last; empty texts are one group."""
    return simhash.keep_one(docs, radius=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources weighing 1, 2, 3, repeating, takes them; null is a source, texts without a word go."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text of every document; an empty text has the end id only."""
    return sentencepieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_spans=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Trained models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each written to the shared folder and read again.

    What a stage wrote for itself goes when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with cleared(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
