"""Queries that write label files, images, archives and reports and read them again, each with its DuckDB SQL; documents stand in for samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.operators import annotations, split
from larkspur.plans import queries as plans
from larkspur.plans.queries import table
from larkspur.session import names_in, new_folder
from larkspur.sources import annotations as sources
from larkspur.sources.files import write_files


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, stem, line_no, class_id, w: documents as samples of one to four boxes, a third of them in each split."""
    k = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select(F.when(k == 0, "train").when(k == 1, "valid").otherwise("test").alias("split"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"), "doc_id")
    rows = rows.withColumn("line_no", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))))
    return rows.withColumns({"class_id": ((F.col("doc_id") + F.col("line_no")) % 5).cast("int"), "w": (F.col("line_no") + 1) / 8})


def _six_decimals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", annotations.label_line(F.col("class_id"), F.lit(0.5), F.lit(0.25), F.col("w"), F.lit(1.0)))


def zip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files written into archives, a member each, and their lines read member by member; four classes are known."""
    path = new_folder(spark, "zip")
    sources.write_labels(_six_decimals(_samples(spark, sf_dir)), path, zipped=True)
    found = annotations.parsed(sources.zip_label_lines(spark, path, "z")).where(F.col("in_bounds") & (F.col("class_id") < 4))
    return found.groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stem").alias("files"), F.bround(F.sum("w"), 6).alias("w"))


def label_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes as label files with six decimals and as raw tokens, read again line by line."""
    rows = _samples(spark, sf_dir)
    raw = rows.withColumn("value", F.concat_ws(" ", F.col("class_id").cast("string"), F.lit(".5"), F.lit("2.5e-1"), F.concat((F.col("line_no") + 1).cast("string"), F.lit("e-1")), F.lit("1")))
    out = None
    for name, lines in (("decimals", _six_decimals(rows)), ("raw", raw)):
        path = new_folder(spark, "labels")
        sources.write_labels(lines, path)
        read = sources.label_lines(spark, path, name).select("source", "split", "stem", "line_no", "value")
        out = read if out is None else out.unionByName(read)
    return out


def image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images (the documents' texts, empty ones too) copied with their labels to the folders of a new split; files and bytes of every folder."""
    root, out = new_folder(spark, "images"), new_folder(spark, "master")
    docs = table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    name = F.concat(F.lit("train/images/"), stem, F.lit(".png"))
    write_files(docs.select(name.alias("path"), F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.lit(None).cast("string").alias("src")), root)
    listed = sources.files(spark, root, "s", [".png"]).select("split", "stem", "ext")
    places = split.stratified_split(docs.select("doc_id", "lang"), "lang", "doc_id").select(stem.alias("stem"), "new_split")
    moves = annotations.manifest(listed.join(places, "stem"), root, "").where(F.col("dst").endswith(".png"))
    moves = moves.withColumn("dst", F.ltrim("dst", F.lit("/")))
    lines = _six_decimals(_samples(spark, sf_dir)).drop("split").join(places, "stem").withColumnRenamed("new_split", "split")
    sources.write_labels(lines, out, images=moves)
    found = sources.files(spark, out, "s", [".png", ".txt"])
    return found.groupBy("split", "ext").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("length") == 0).alias("empty"))


def class_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, some of no bytes, in folders named after classes, with the box over the whole image, and their number a class."""
    path = new_folder(spark, "folders")
    folder = F.get(F.array(*map(F.lit, X.CLASSES)), (F.col("p_partkey") % 5).cast("int"))
    rows = table(spark, sf_dir, "part").where(folder.isNotNull())
    named = F.concat_ws("/", folder, F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".JPG")))
    write_files(rows.select(named.alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("text"), F.lit(None).cast("string").alias("src")), path)
    found = sources.class_folders(spark, path)
    names = spark.createDataFrame(list(enumerate(X.CLASSES)), "class_id int, class_name string")
    boxes = annotations.full_frame_boxes(found, names).groupBy("folder").agg(F.max("class_id").alias("class_id"), F.sum("w").alias("w"), F.count_if(F.col("length") == 0).alias("empty"))
    return sources.folder_counts(found).join(boxes, "folder", "left")


# --- reports


def _reread(spark: SparkSession, rows: DataFrame) -> DataFrame | None:
    """``rows`` as a CSV report, read again; None where no report was written."""
    path = new_folder(spark, "report")
    kinds = ", ".join(f"`{f.name}` {'string' if f.dataType.typeName() in ('array', 'map', 'struct') else f.dataType.simpleString()}" for f in rows.schema)
    written = sources.write_csv(rows, path)
    assert written == bool(names_in(spark, path))
    return spark.read.schema(kinds).csv(path, header=True) if written else None


def remap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remap log of class names as a CSV report."""
    return _reread(spark, plans.class_names(spark, sf_dir))


def skipped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are skipped, with the reason, as a CSV report; there is no report of those without a reason among them."""
    skipped = plans.pairing_rejects(spark, sf_dir).where(F.col("reason").isNotNull())
    none = _reread(spark, skipped.where(F.col("reason").isNull()))
    return _reread(spark, skipped).withColumn("empty_report", F.lit(none is not None))


def multi_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several classes, their classes as JSON, as a CSV report."""
    files = table(spark, sf_dir, "orders").select(F.lit("s").alias("source"), F.lit("train").alias("split"), F.col("o_orderkey").cast("string").alias("stem"))
    checked = annotations.valid_files(files, plans.label_line_rows(spark, sf_dir))
    return _reread(spark, checked.where("status = 'multi_class'").select("stem", "classes", "num_bboxes"))


def split_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split report to one decimal."""
    rows = split.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return split.split_counts(rows, "lang", digits=1).select("new_split", "lang", "images", "percent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (zip_labels, label_formats, image_copies, class_folders, remap_report, skipped_report, multi_class_report, split_percent)
}

SAMPLE_SQL = """sa AS (
  SELECT ['train', 'val', 'test'][doc_id % 3 + 1] AS split, 'd' || doc_id AS stem, doc_id, CAST(unnest(range(doc_id % 4 + 1)) AS INTEGER) AS line_no FROM documents),
ln AS (
  SELECT *, CAST((doc_id + line_no) % 5 AS INTEGER) AS class_id, (line_no + 1) / 8.0::DOUBLE AS w FROM sa)"""
_DECIMALS = "class_id || ' 0.500000 0.250000 ' || printf('%.6f', w) || ' 1.000000'"
ORACLES: dict[str, str] = {
    "zip_labels": f"WITH {SAMPLE_SQL} SELECT split, class_id, count(*) AS n, count(DISTINCT stem) AS files, round_even(sum(w), 6) AS w FROM ln WHERE class_id < 4 GROUP BY 1, 2",
    "label_formats": f"WITH {SAMPLE_SQL} SELECT 'decimals' AS source, split, stem, line_no, {_DECIMALS} AS value FROM ln UNION ALL SELECT 'raw', split, stem, line_no, class_id || ' .5 2.5e-1 ' || (line_no + 1) || 'e-1 1' FROM ln",
    "image_copies": f"WITH {plans.SPLIT_SQL}, {SAMPLE_SQL}, im AS (SELECT new_split AS split, '.png' AS ext, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE coalesce(strlen(text), 0) END AS b FROM sp JOIN documents USING (doc_id)), "
    f"tx AS (SELECT new_split AS split, '.txt' AS ext, sum(strlen({_DECIMALS}) + 1) AS b FROM sp JOIN ln USING (doc_id) GROUP BY doc_id, 1) "
    "SELECT split, ext, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, count(*) FILTER (WHERE b = 0) AS empty FROM (SELECT * FROM im UNION ALL SELECT * FROM tx) GROUP BY 1, 2",
    "class_folders": "SELECT ['engaged', 'confused', 'bored', 'frustrated'][p_partkey % 5 + 1] AS folder, count(*) AS n, CAST(p_partkey % 5 AS INTEGER) AS class_id, CAST(count(*) AS DOUBLE) AS w, count(*) FILTER (WHERE p_partkey % 3 = 0) AS empty FROM part WHERE p_partkey % 5 < 4 GROUP BY p_partkey % 5",
    "remap_report": plans.ORACLES["class_names"],
    "skipped_report": f"SELECT *, false AS empty_report FROM ({plans.ORACLES['pairing_rejects']}) WHERE reason IS NOT NULL",
    "multi_class_report": f"WITH {plans.LINES_SQL}, fs AS (SELECT stem, bool_and(blank OR (in_bounds AND c < 4)) AS ok, list_sort(list(DISTINCT c) FILTER (WHERE k NOT IN (5, 6, 7))) AS cs, count(*) FILTER (WHERE NOT blank) AS b FROM pl GROUP BY 1) "
    "SELECT stem, '[' || array_to_string(cs, ',') || ']' AS classes, b AS num_bboxes FROM fs WHERE ok AND len(cs) > 1",
    "split_percent": f"WITH {plans.SPLIT_SQL} SELECT new_split, lang, images, round_even(CAST(images AS DOUBLE) / CAST(sum(images) OVER (PARTITION BY new_split) AS DOUBLE) * 100, 1) AS percent FROM sc",
}
