"""Annotation labels: parsing, validation, class remapping, pairing with images, union of sources and summaries.

A label line table has source, split, stem, line_no and value (the text line). A label file listing has source, split, stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.expr import CLASSES, are_numbers, let, strict_int, strip, tokens, truncated
from larkspur.session import small_table

KEYS = ["source", "split", "stem"]
# Names that a class may have elsewhere, in the order in which they are tried, and the class that they stand for.
NAME_TARGETS = {"engaged": 0, "confusion": 1, "boredom": 2, "frustration": 3, "confused": 1, "bored": 2, "frustrated": 3}
# Class ids of the second source and what they become.
SECOND_SOURCE_IDS = {0: 2, 1: 1, 2: 0, 3: 3}
# Suffixes in the order in which an image is looked for.
IMAGE_PRIORITY = [".jpg", ".jpeg", ".png"]


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with toks, class_id, x, y, w, h (null where a line isn't five numbers) and blank, in_bounds.

    The class is the whole part of its number, so NaN and infinities give none. Comparisons order NaN above all numbers, so an upper bound rejects it.
    A line is parsed once: its tokens and numbers come out of a generator, below which no later filter is pushed; the rest is comparisons.
    """
    toks = tokens(F.col("value"))
    row = let(toks, lambda t: F.struct(t.alias("toks"), F.when(are_numbers(F.col("value"), 5), F.transform(t, lambda x: x.try_cast("double"))).alias("_n")))
    rows = lines.select("*", F.inline(F.array(row)))
    x, y, w, h = (F.get("_n", k) for k in range(1, 5))
    all_there = F.get("_n", 0).isNotNull() & x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    inside = x.between(0.0, 1.0) & y.between(0.0, 1.0) & (w > 0.0) & (w <= 1.0) & (h > 0.0) & (h <= 1.0)
    class_id = F.when(all_there, truncated(F.get("_n", 0)))
    rows = rows.withColumns({"blank": F.size("toks") == 0, "class_id": class_id, "x": x, "y": y, "w": w, "h": h})
    return rows.withColumn("in_bounds", F.col("class_id").isNotNull() & F.coalesce(inside, F.lit(False))).drop("_n")


def kept_lines(lines: DataFrame, mapping: DataFrame, check_bounds: bool = True) -> DataFrame:
    """Line mode: lines of five numbers in bounds whose class the mapping (old_id, new_id) knows, with class_id remapped.

    Without ``check_bounds`` only the token count and a strictly whole class id are asked for; the other tokens stay as they are.
    """
    if check_bounds:
        rows = parsed(lines).where("in_bounds")
    else:
        rows = lines.withColumn("toks", tokens(F.col("value"))).where(F.size("toks") == 5).withColumn("class_id", strict_int(F.get("toks", 0)))
    known = mapping.where(F.col("new_id").isNotNull()).select(F.col("old_id").alias("class_id"), "new_id")
    return rows.join(known, "class_id").drop("class_id").withColumnRenamed("new_id", "class_id")


def valid_files(files: DataFrame, lines: DataFrame, classes: int = len(CLASSES)) -> DataFrame:
    """File mode: one row per listed file with status and its distinct classes.

    One bad line (blank ones aside) makes a file ``invalid``. Otherwise ``empty`` (no line at all), ``blank`` (no class), ``multi_class`` or ``sample``.
    """
    ok = F.col("blank") | (F.col("in_bounds") & F.col("class_id").between(0, classes - 1))
    own = parsed(lines).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_lines"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"),
        F.sort_array(F.collect_set("class_id")).alias("classes"), F.count_if(~F.col("blank")).alias("num_bboxes"),
    )
    n = F.size("classes")
    status = F.when(F.col("n_lines").isNull(), "empty").when(~F.col("ok"), "invalid").when(n == 0, "blank").when(n > 1, "multi_class").otherwise("sample")
    return files.join(own, KEYS, "left").select(*KEYS, status.alias("status"), "classes", F.coalesce("num_bboxes", F.lit(0)).alias("num_bboxes"))


def samples(checked: DataFrame, take_smallest: bool = False) -> DataFrame:
    """Files of one class with its id; with ``take_smallest`` those of several too, under their smallest."""
    wanted = ["sample", "multi_class"] if take_smallest else ["sample"]
    return checked.where(F.col("status").isin(wanted)).select(*KEYS, F.get("classes", 0).alias("class_id"), "num_bboxes")


def name_mapping(names: DataFrame) -> DataFrame:
    """Remap log of (old_class_id, old_class_name): new id and name, and KEEP, or DROP with nulls.

    The first target that a trimmed lower-case name contains wins; so ``disengaged`` counts as engaged.
    """
    bare = F.lower(strip(F.col("old_class_name")))
    new = F.lit(None).cast("int")
    for target, k in reversed(NAME_TARGETS.items()):
        new = F.when(bare.contains(target), F.lit(k)).otherwise(new)
    rows = names.withColumn("new_class_id", new)
    name = F.get(F.array(*map(F.lit, CLASSES)), F.col("new_class_id"))
    return rows.withColumn("new_class_name", name).withColumn("action", F.when(F.col("new_class_id").isNull(), "DROP").otherwise("KEEP"))


def id_mapping(spark: SparkSession, pairs: dict[int, int] = SECOND_SOURCE_IDS) -> DataFrame:
    """old_id, new_id of a mapping."""
    return small_table(spark, list(pairs.items()), "old_id int, new_id int")


def with_labels(images: DataFrame, files: DataFrame, kept: DataFrame) -> DataFrame:
    """Images (source, split, stem, ext) with their number of kept lines and a reason if they are rejected."""
    listed = files.select(*KEYS).distinct().withColumn("_file", F.lit(True))
    counts = kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_boxes"))
    rows = images.join(listed, KEYS, "left").join(counts, KEYS, "left")
    reason = F.when(F.col("_file").isNull(), "Missing label file").when(F.col("n_boxes").isNull(), "No target class bbox remaining")
    return rows.withColumn("reason", reason).withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0))).drop("_file")


def with_images(files: DataFrame, images: DataFrame, priority: list[str] = IMAGE_PRIORITY) -> DataFrame:
    """Label files with the extension of their image, the first of ``priority`` that exists; files without one go."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("ext"))
    best = images.where(F.col("ext").isin(priority)).groupBy(*KEYS).agg(F.min_by("ext", rank).alias("ext"))
    return files.join(best, KEYS)


def collisions(images: DataFrame) -> DataFrame:
    """Keys that several images share, and so one label file."""
    return images.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("ext")).alias("exts")).where("n > 1")


def canonical_split(split: Column) -> Column:
    """``valid`` as ``val``."""
    return F.when(split == "valid", F.lit("val")).otherwise(split)


def full_frame_boxes(images: DataFrame, class_names: DataFrame) -> DataFrame:
    """A box over the whole image for each image of a class folder (folder, class_name -> class_id)."""
    rows = images.join(class_names.withColumnRenamed("class_name", "folder"), "folder")
    box = {"x": 0.5, "y": 0.5, "w": 1.0, "h": 1.0}
    return rows.withColumns({n: F.lit(v) for n, v in box.items()})


def united(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of sources; a stem gets its source's prefix, so names stay apart, and ``source`` tells where it is from."""
    out = None
    for prefix, part in parts.items():
        rows = part.withColumn("stem", F.concat(F.lit(prefix + "_"), "stem")).withColumn("source", F.lit(prefix))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def manifest(rows: DataFrame, root: str, out: str) -> DataFrame:
    """src and dst of each image and label file to be copied to its new split."""
    name = lambda base, kind, split, ext: F.concat(F.lit(f"{base}/"), split, F.lit(f"/{kind}/"), F.col("stem"), ext)
    part = lambda kind, ext: F.struct(name(root, kind, F.col("split"), ext).alias("src"), name(out, kind, F.col("new_split"), ext).alias("dst"))
    return rows.select(F.explode(F.array(part("images", F.col("ext")), part("labels", F.lit(".txt")))).alias("x")).select("x.*")


def label_line(class_id: Column, *numbers: Column) -> Column:
    """A label line with numbers to six decimals."""
    return F.concat_ws(" ", class_id.cast("string"), *(F.format_string("%.6f", n) for n in numbers))


def class_counts(kept: DataFrame) -> DataFrame:
    """Boxes and distinct files of every class, zeros included."""
    dim = small_table(kept.sparkSession, list(enumerate(CLASSES)), "class_id int, class_name string")
    files = F.struct(*KEYS)
    own = kept.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_boxes"), F.count_distinct(files).alias("n_images"))
    return dim.join(own, "class_id", "left").select("class_id", "class_name", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


def totals(judged: DataFrame) -> DataFrame:
    """Processed, saved and skipped images."""
    return judged.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("reason").isNull()).alias("saved"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
