"""Sources and sinks of annotation data: label text, image listings, class folders, dataset descriptions, ZIP members and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.expr import CLASSES, stem, suffix
from larkspur.operators.annotations import canonical_split
from larkspur.session import names_in, remove_folder, small_table
from larkspur.sources.files import archives, listing, texts, write_files

# Suffixes of images, and the columns of the table of training epochs.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]
METRIC_COLUMNS = [
    "epoch", "time", "train/box_loss", "train/cls_loss", "train/dfl_loss", "metrics/precision(B)", "metrics/recall(B)", "metrics/mAP50(B)", "metrics/mAP75(B)", "metrics/mAP50-95(B)",
    "val/box_loss", "val/cls_loss", "val/dfl_loss", "lr/pg0", "lr/pg1", "lr/pg2",
]


def split_of(path: Column, folders: dict[str, str] | None = None) -> Column:
    """Split of a path in either layout, ``split/images/..`` or ``images/split/..``, with valid as val; null in neither.

    ``folders`` are the image folders that a dataset description names by split (as from ``described``), for paths in neither layout: leading
    ``../`` and ``./`` are dropped, and the labels' folder is the images' with that word replaced.
    """
    first = F.regexp_extract(path, r"/(train|valid|val|test)/(?:images|labels)/[^/]+$", 1)
    second = F.regexp_extract(path, r"/(?:images|labels)/(train|valid|val|test)/[^/]+$", 1)
    found = F.when(first != "", first).when(second != "", second)
    for name, folder in (folders or {}).items():
        if name in ("train", "valid", "val", "test") and folder:
            place = str(folder).replace("../", "").replace("./", "").strip("/")
            for one in dict.fromkeys((place, place.replace("images", "labels"))):
                found = found.when(path.contains(f"/{one}/"), name)
    return canonical_split(found)


def label_lines(spark: SparkSession, root: str, source: str, folders: dict[str, str] | None = None) -> DataFrame:
    """source, split, stem, line_no, value: the lines of all label files under ``root``, listed and read by tasks; empty files have none."""
    # Spark's own text source would hold every file's status in the driver.
    raw = texts(listing(spark, root).where(F.col("path").endswith(".txt")))
    path = F.col("path")
    return _lines(raw.select(F.lit(source).alias("source"), split_of(path, folders).alias("split"), stem(path).alias("stem"), "text"))


def _lines(texts: DataFrame) -> DataFrame:
    """Lines of whole texts (source, split, stem, text)."""
    cut = F.split("text", r"\r\n|\r|\n")
    rows = texts.select("source", "split", "stem", F.size(cut).alias("n"), F.posexplode(cut).alias("line_no", "value"))
    # A last line end starts no further line.
    last = (F.col("value") == "") & (F.col("line_no") == F.col("n") - 1)
    return rows.where(~last).select("source", "split", "stem", "line_no", "value")


def files(spark: SparkSession, root: str, source: str, suffixes: list[str], recursive: bool = True, any_case: bool = True, folders: dict[str, str] | None = None) -> DataFrame:
    """source, split, stem, ext, path, length of the files with one of ``suffixes``, empty ones included; folders are listed by tasks, and contents aren't read."""
    rows = listing(spark, root, recursive)
    ext = F.lower(suffix(F.col("path"))) if any_case else suffix(F.col("path"))
    rows = rows.withColumn("ext", ext).where(F.col("ext").isin(suffixes))
    return rows.select(F.lit(source).alias("source"), split_of(F.col("path"), folders).alias("split"), stem(F.col("path")).alias("stem"), "ext", "path", "length")


def label_files(spark: SparkSession, root: str, source: str) -> DataFrame:
    return files(spark, root, source, [".txt"], any_case=False)


def class_folders(spark: SparkSession, root: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """folder, stem, ext, path of images in folders named after their class."""
    return files(spark, root, "", suffixes).drop("source", "split").withColumn("folder", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))


def folder_counts(images: DataFrame, names: list[str] = CLASSES) -> DataFrame:
    """folder, n: the files of each class folder, zeros included."""
    dim = small_table(images.sparkSession, [(n,) for n in names], "folder string")
    own = images.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(own, "folder", "left").na.fill(0, ["n"])


def log_line(spark: SparkSession, path: str, text: str, start: bool = False) -> None:
    """Add a time-stamped line to a run log, a folder of text files; ``start`` begins it anew."""
    log_rows(spark.range(1).select(F.lit(text).alias("text")), path, start)


def log_rows(rows: DataFrame, path: str, start: bool = False) -> None:
    """Add a time-stamped line for each text of ``rows`` to a run log."""
    line = F.concat(F.lit("["), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("text"))
    rows.select(line.alias("value")).write.mode("overwrite" if start else "append").text(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """at, text of the lines of a run log."""
    parts = F.regexp_extract("value", r"^\[([^\]]*)\]", 1), F.regexp_replace("value", r"^\[[^\]]*\] ", "")
    return spark.read.text(path).select(F.try_to_timestamp(parts[0], F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"), parts[1].alias("text"))


def described(text: str) -> dict:
    """A flat dataset description: ``key: value`` lines; ``names`` may be a list or a map in block or inline form, and becomes {id: name}."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare[0] not in " -":
            key, _, value = (x.strip() for x in bare.partition(":"))
            out[key] = _value(value) if value else None
        elif key is not None:
            item = bare.strip()
            if item.startswith("-"):
                out[key] = [*(out[key] or []), _value(item[1:].strip())]
            else:
                k, _, v = (x.strip() for x in item.partition(":"))
                out[key] = {**(out[key] or {}), _value(k): _value(v)}
    names = out.get("names")
    if isinstance(names, list):
        out["names"] = dict(enumerate(names))
    elif not isinstance(names, dict):
        raise ValueError("names must be a list or a map")
    return out


def _value(text: str):
    if text[:1] == "[" and text[-1:] == "]":
        return [_value(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] == "{" and text[-1:] == "}":
        return {_value(k.strip()): _value(v.strip()) for k, _, v in (x.partition(":") for x in text[1:-1].split(",") if x.strip())}
    bare = text.strip("'\"")
    return int(bare) if bare.lstrip("-").isdigit() and bare == text else bare


def description(names: dict[int, str], path: str = ".", splits: tuple[str, ...] = ("train", "val", "test")) -> str:
    """The text of a dataset description."""
    lines = [f"path: {path}", *(f"{s}: images/{s}" for s in splits), f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *(f"  {k}: {names[k]}" for k in sorted(names)), ""])


def class_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted((int(k), str(v)) for k, v in names.items()), "old_class_id int, old_class_name string")


def zip_members(spark: SparkSession, path: str, pattern: str = ".txt") -> DataFrame:
    """archive, member, text of text members of ZIP archives; those with a problem, as an absolute name or one with parents, have a null text."""
    return archives(spark, path, pattern).select("archive", "member", F.col("content").cast("string").alias("text"))


def zip_label_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The lines of all label files in the archives at ``path``, as from ``label_lines``."""
    members = zip_members(spark, path).where(F.col("text").isNotNull())
    place = F.concat(F.lit("/"), "member")
    return _lines(members.select(F.lit(source).alias("source"), split_of(place).alias("split"), stem(place).alias("stem"), "text"))


def frame_log_csv(spark: SparkSession, path: str) -> DataFrame:
    kinds = "frame_index int, timestamp_sec double, raw_class_name string, raw_confidence double, stable_label string, vote_ratio double, avg_confidence double"
    kinds += "".join(f", bbox_{c} double" for c in ("x1", "y1", "x2", "y2")) + ", fps double"
    return spark.read.schema(kinds).csv(path, header=True)


def epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The 16-column table of training epochs; most names need back quotes."""
    kinds = ", ".join(f"`{c}` {'int' if c == 'epoch' else 'double'}" for c in METRIC_COLUMNS)
    return spark.read.schema(kinds).csv(path, header=True, ignoreLeadingWhiteSpace=True)


def run_arguments(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a flat argument file."""
    raw = spark.read.text(path).where(F.col("value").contains(":"))
    return raw.select(F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.regexp_replace("value", r"^[^:]*:", "")).alias("value"))


def modules(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested module documents with an explicit schema: one document of all modules, or one a line."""
    kinds = (
        "id int, title string, description string, duration_minutes int, content array<struct<section: string, text: string>>, "
        "questions array<struct<id: string, category: string, question: string, option_a: string, option_b: string, option_c: string, option_d: string, "
        "correct_answer: string, options: array<string>, correct: int>>, "
        "coding_exercises array<struct<id: string, instruction: string, code_template: string, expected_answer: string, hint: string>>"
    )
    return spark.read.schema(kinds).option("multiLine", str(multi_line).lower()).json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write a report as CSV with nested columns as JSON text, unless it is empty; returns whether it was written."""
    if df.isEmpty():
        return False
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.withColumns(nested).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return True


def label_texts(lines: DataFrame) -> DataFrame:
    """path (split/labels/stem.txt) and text of label files from their lines (split, stem, line_no, value) in order."""
    own = lines.groupBy("split", "stem").agg(F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("x"))
    text = F.concat(F.array_join(F.transform("x", lambda v: v["value"]), "\n"), F.lit("\n"))
    return own.select(F.concat_ws("/", "split", F.lit("labels"), F.concat("stem", F.lit(".txt"))).alias("path"), text.alias("text"))


def write_labels(lines: DataFrame, root: str, overwrite: bool = False, images: DataFrame | None = None, zipped: bool = False) -> None:
    """A label file a sample, at split/labels/stem.txt, and beside it the copies of ``images`` (src, and dst below the folder as from ``annotations.manifest``).

    Without ``overwrite`` a folder that holds something is an error. Files appear whole or not at all; a job that fails takes back what it has written. ``zipped`` writes archives of the same files.
    """
    spark = lines.sparkSession
    if not overwrite and names_in(spark, root):
        raise FileExistsError(root)
    if overwrite:
        remove_folder(spark, root)
    none = F.lit(None).cast("string")
    rows = label_texts(lines).withColumn("src", none)
    if images is not None:
        rows = rows.unionByName(images.select(F.col("dst").alias("path"), none.alias("text"), "src"))
    write_files(rows, root, zipped)
