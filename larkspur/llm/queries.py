"""Thin queries over the operators of this subpackage, one ``op<N>_<name>`` each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import divergence, html_text, importance, mixing, periodic, quality, sentencepieces, sharding, shingle_join, simhash, tokenbin, toxicity, weighted_sampling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the ``bytes`` law."""
    return sharding.pack_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "tokens",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of all documents, and how many bytes the spans cover."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.encode_decode(_table(spark, sf_dir, "documents"), model, keep_spans=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents by weighted rules."""
    docs = _table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels"), parts=5, held=0))
    return found.select("doc_id", quality.held_out(5, 0).alias("held_out"), "score", "predicted")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as directly addressable codes and read back."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokenbin.read_documents(tokenbin.write_segments(_table(spark, sf_dir, "documents"), tokenizer, end_id=2))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents; links at 3 or fewer bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed; sources weigh 1, 2, 3, repeating, and stop at 3 times their size."""
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict by divergence from their language's histograms."""
    found = divergence.judged(_table(spark, sf_dir, "documents"))
    return found.drop("class_distance", "common_distance")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents by their maximal segments."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.passages(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), parts=4, held=2))
    return found.select("doc_id", quality.held_out(4, 2).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return weighted_sampling.fingerprints(_table(spark, sf_dir, "documents"))


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of all documents; links at a Jaccard likeness of 0.8 of 5-word shingles."""
    return shingle_join.joined(_table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and digests of all documents, a tenth of them made periodic by their ids."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.digests(periodic.find_runs(docs))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of all documents; the best tenth by gain toward the benchmark's texts is drawn."""
    found = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_sentencepiece, op3_quality, op4_html_text, op5_token_binary, op6_simhash, op7_mixing, op8_divergence, op9_toxicity, op10_weighted_sampling, op11_shingle_join, op12_periodic, op13_importance)
}

ORACLES: dict[str, str] = {"op7_mixing": mixing.ORACLE, "op8_divergence": divergence.ORACLE, "op11_shingle_join": shingle_join.ORACLE, "op13_importance": importance.ORACLE}
