"""Stratified splits and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.expr import ratio

SPLITS = ["train", "val", "test"]


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios must sum to 1: {ratios}")


def stratified_split(rows: DataFrame, by: str, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``rows`` with new_split: of each class floor(n * train) rows, then floor(n * val), then the rest.

    The order is that of md5(seed:key), the same on every run and engine. Ranks are taken in 256 parts of a class by
    the digest's first digits, each offset by the parts before, so that no task holds a whole class.
    """
    check_ratios(ratios)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = rows.withColumn("_d", digest).withColumn("_p", F.substring("_d", 1, 2))
    parts = rows.groupBy(by, "_p").agg(F.count(F.lit(1)).alias("_own"))
    before = Window.partitionBy(by).orderBy("_p")
    parts = parts.select(
        F.col(by).alias("_by"), F.col("_p").alias("_q"), (F.sum("_own").over(before) - F.col("_own")).alias("_base"), F.sum("_own").over(Window.partitionBy(by)).alias("_n")
    )
    rows = rows.join(parts, rows[by].eqNullSafe(parts["_by"]) & (rows["_p"] == parts["_q"]))
    rank = F.col("_base") + F.row_number().over(Window.partitionBy(by, "_p").orderBy("_d", key))
    train, val = (F.floor(F.col("_n") * F.lit(float(r))) for r in ratios[:2])
    split = F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")
    return rows.withColumn("new_split", split).drop("_d", "_p", "_by", "_q", "_base", "_n")


def split_counts(rows: DataFrame, by: str, boxes: str | None = None, digits: int = 2) -> DataFrame:
    """new_split, class, images, boxes and percent of its split, for every pair, zeros included."""
    n = F.count(F.lit(1)).alias("images")
    own = rows.groupBy("new_split", by).agg(n, (F.sum(boxes) if boxes else F.count(F.lit(1))).alias("boxes"))
    every = own.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, SPLITS))).alias("new_split"))
    # A null class is a class like any other.
    mine = own.withColumnsRenamed({"new_split": "_split", by: "_by"})
    full = every.join(mine, (F.col("new_split") == F.col("_split")) & every[by].eqNullSafe(F.col("_by")), "left").drop("_split", "_by").na.fill(0, ["images", "boxes"])
    whole = F.sum("images").over(Window.partitionBy("new_split"))
    return full.withColumn("percent", F.bround(ratio(F.col("images"), whole) * 100, digits))


def imbalance(counts: DataFrame) -> DataFrame:
    """new_split, most, least, ratio (infinite for an empty class, null for an empty split) and its text."""
    own = counts.groupBy("new_split").agg(F.max("images").alias("most"), F.min("images").alias("least"))
    value = F.when(F.col("most") == 0, F.lit(None).cast("double")).when(F.col("least") == 0, F.lit(float("inf"))).otherwise(F.col("most") / F.when(F.col("least") > 0, F.col("least")))
    text = F.when(F.col("most") == 0, "Kosong").when(F.col("least") == 0, "inf").otherwise(F.format_string("%.2f", value))
    return own.withColumn("ratio", value).withColumn("text", text)


def readiness(counts: DataFrame) -> DataFrame:
    """One row with the verdict: NOT_READY if train or val lacks a class, TRAIN_WITH_CAUTION under 50 or 10 images of one."""
    least = counts.agg(
        F.min(F.when(F.col("new_split") == "train", F.col("images"))).alias("train"), F.min(F.when(F.col("new_split") == "val", F.col("images"))).alias("val")
    )
    verdict = F.when((F.col("train") == 0) | (F.col("val") == 0) | F.col("train").isNull() | F.col("val").isNull(), "NOT_READY")
    verdict = verdict.when((F.col("train") < 50) | (F.col("val") < 10), "TRAIN_WITH_CAUTION").otherwise("READY_FOR_TRAINING")
    return least.withColumn("verdict", verdict)


def report_text(counts: list, ratios: list, verdict: str, by: str) -> str:
    """A Markdown report of collected, small aggregates."""
    lines = ["# Split report", "", f"| Split | {by} | Images | Boxes | Percent |", "|---|---|---|---|---|"]
    lines += [f"| {r['new_split']} | {r[by]} | {r['images']} | {r['boxes']} | {r['percent']:.2f}% |" for r in counts]
    lines += ["", *(f"- {r['new_split']}: imbalance {r['text']}" for r in ratios), "", f"Verdict: {verdict}", ""]
    return "\n".join(lines)
