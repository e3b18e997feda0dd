"""Study history: records with defaults, an append-only store and per-user statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.expr import NEUTRAL, half_even, ratio
from larkspur.operators.quiz import interpretation, sentence
from larkspur.session import names_in, put_text

# What a record holds where the payload has nothing.
DEFAULTS = {
    "module_title": "Modul Pembelajaran", "score": 0, "correct_answers": 0, "total_questions": 10, "concept_correct": 0, "concept_total": 5,
    "problem_solving_correct": 0, "problem_solving_total": 5, "duration_seconds": 0, "dominant_emotion": NEUTRAL,
}


def missing_fields(payloads: DataFrame, fields: tuple[str, ...] = ("nim", "name", "module_id")) -> DataFrame:
    """``payloads`` with missing ARRAY<STRING>: the required fields that are null, empty or blank; none may be saved with any."""
    lacking = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return payloads.withColumn("missing", F.array_compact(F.array(*(F.when(lacking(c), F.lit(c)) for c in fields))))


def records(payloads: DataFrame, completed_at=None) -> DataFrame:
    """Payloads with user fields as history records: defaults filled in, an 8-character id, a time stamp and an interpretation.

    Payloads without a module, or with a null or blank user or name, go. The id is random, as in the source of the format.
    """
    rows = missing_fields(payloads).where(F.size("missing") == 0).drop("missing")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    part = lambda c: F.try_element_at("emotion_distribution", F.lit(c))
    key = interpretation(F.col("score"), F.col("problem_solving_correct"), part("engaged"), part("confused"), part("frustrated"))
    text = F.when(F.coalesce("interpretation", F.lit("")) == "", sentence(key)).otherwise(F.col("interpretation"))
    when = completed_at if completed_at is not None else F.current_timestamp()
    return rows.withColumns({
        "nim": F.trim("nim"), "name": F.trim("name"), "id": F.substring(F.uuid(), 1, 8),
        "completed_at": F.date_format(when, "dd MMM yyyy, HH:mm"), "interpretation": text,
    })


def append(rows: DataFrame, path: str, batch: str) -> bool:
    """Append a batch to the store, partitioned by user; whether it was new.

    The name of a batch is its key: a batch is written to a folder of its own and then entered in the store's ledger, so one that failed half way is replaced by its
    retry and one that is in the ledger is left alone. Earlier files are never rewritten.
    """
    spark = rows.sparkSession
    if batch in names_in(spark, f"{path}/_ledger"):
        return False
    rows.write.mode("overwrite").partitionBy("nim").parquet(f"{path}/batch={batch}")
    put_text(spark, f"{path}/_ledger/{batch}", "")
    return True


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the batches in the ledger, with ``batch`` and ``nim`` from their folders; ``schema`` names the other columns. A missing store is empty."""
    batches = names_in(spark, f"{path}/_ledger")
    kinds = f"{schema}, batch string, nim string"
    if not batches:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches))


def of_user(history: DataFrame, nim: str) -> DataFrame:
    """A user's sessions, newest first by ``seq``; a store partitioned by user reads only that one."""
    return history.where(F.col("nim") == nim).orderBy(F.col("seq").desc())


def stats(history: DataFrame) -> DataFrame:
    """Per user: sessions, mean score (half to even), seconds, and the commonest dominant emotion.

    Missing scores and durations count as 0. Null and empty emotions are left out; of equally common ones the one met first from the newest session wins; neutral if there is none.
    """
    own = history.groupBy("nim").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum(F.coalesce("score", F.lit(0))).alias("_s"), F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("total_duration_sec")
    )
    named = history.where(F.coalesce("dominant_emotion", F.lit("")) != "")
    per = named.groupBy("nim", "dominant_emotion").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest"))
    top = per.groupBy("nim").agg(F.max_by("dominant_emotion", F.struct("n", "newest")).alias("top"))
    return own.join(top, "nim", "left").select(
        "nim", "total_sessions", half_even(ratio(F.col("_s"), F.col("total_sessions"))).alias("avg_score"), "total_duration_sec", F.coalesce("top", F.lit(NEUTRAL)).alias("overall_dominant")
    )


def completed_time(text):
    """Inverse of the record's time format, to the minute; null if it doesn't parse."""
    return F.try_to_timestamp(text, F.lit("dd MMM yyyy, HH:mm"))
