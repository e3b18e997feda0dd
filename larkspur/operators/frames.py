"""Detection streams in batch: the largest face of a frame, the sliding vote and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.expr import CLASSES, NEUTRAL, class_name, exact_decimal
from larkspur.operators.chunks import CHUNK, chunk_window, with_neighbours


def confident(detections: DataFrame, least: float = 0.20) -> DataFrame:
    """Exploded detections at or above the detector's confidence floor; a plain predicate, so it reaches a Parquet scan."""
    return detections.where(F.col("conf") >= least)


def largest_face(frames: DataFrame, least_share: float = 0.02) -> DataFrame:
    """Per frame its largest detection of at least ``least_share`` of the frame, the first one among equals.

    Input: session_id, frame_index, frame_w, frame_h, det ARRAY<STRUCT<class_id, conf, x1, y1, x2, y2>>. Adds class_id, conf, x1..y2 and
    area_share, all null where no detection qualifies (null or empty arrays included).
    """
    whole = (F.col("frame_w") * F.col("frame_h")).cast("double")
    area = lambda d: (d.x2 - d.x1) * (d.y2 - d.y1)
    ranked = F.transform("det", lambda d, i: F.struct(area(d).alias("area"), (-i).alias("first"), d.alias("d")))
    best = F.array_max(F.transform(F.filter(ranked, lambda r: (r.area / whole >= least_share) & (r.area > 0)), lambda r: F.struct(r.area, r["first"])))
    rows = frames.withColumn("_best", best)
    d = F.get("det", (-F.col("_best.first")).cast("int"))
    names = ("class_id", "conf", "x1", "y1", "x2", "y2")
    return rows.withColumns({n: d.getField(n) for n in names}).withColumn("area_share", F.col("_best.area") / whole).drop("_best", "det")


def to_center_box(w: Column, h: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corner box in pixels as a normalised centre box; 0.5 0.5 0.95 0.95 where there is none."""
    some = x1.isNotNull()
    parts = {"x": ((x1 + x2) / 2 / w, 0.5), "y": ((y1 + y2) / 2 / h, 0.5), "w": ((x2 - x1) / w, 0.95), "h": ((y2 - y1) / h, 0.95)}
    return F.struct(*(F.when(some, v).otherwise(d).alias(n) for n, (v, d) in parts.items()))


def vote(
    frames: DataFrame, window: int = 30, least_frames: int = 8, least_ratio: float = 0.40, least_confidence: float = 0.40,
    no_face_label: str = "no_face", classes: int = len(CLASSES), chunk: int = CHUNK,
) -> DataFrame:
    """Majority vote over the last ``window`` frames of a session, emptied by each frame without a face.

    Input: session_id, frame_index, class_id (null: no face), conf. Adds votes (frames in the window), stable_id, stable_label, vote_ratio and
    avg_confidence. Among equals the class seen first in the window wins. Below ``least_frames`` ratio and confidence
    are 0.0; below any gate the label is neutral. Confidences are summed as decimals, so that sums don't depend on order; a double becomes one as
    SQL's cast has it (``exact_decimal``), so a mean that is the limit only in print may lie some 1e-17 off it.

    A session is dealt in chunks of at most twice ``chunk`` frames, each with the window's frames ahead of it: a reset further back can't matter, so
    each chunk counts its own. Frames are read once for the sizes of ranges and once for the vote; only sessions of several chunks are read for neighbours.
    """
    empty = F.col("class_id").isNull()
    rows = with_neighbours(frames, window - 1, 0, "frame_index", chunk).withColumns({"_none": empty, "_conf": exact_decimal(F.col("conf"))})
    rows = rows.withColumn("_epoch", F.sum(empty.cast("long")).over(chunk_window("frame_index").rowsBetween(Window.unboundedPreceding, 0)))
    last = chunk_window("frame_index", "_epoch", "_none").rowsBetween(1 - window, 0)
    per_class = []
    for k in range(classes):
        own = F.col("class_id") == k
        per_class.append(F.struct(
            F.count_if(own).over(last).alias("n"), (-F.min(F.when(own, F.col("frame_index"))).over(last)).alias("seen"),
            F.lit(k).alias("k"), F.sum(F.when(own, F.col("_conf"))).over(last).alias("total"),
        ))
    rows = rows.withColumn("votes", F.when(empty, 0).otherwise(F.count(F.lit(1)).over(last))).withColumn("_top", F.array_max(F.array(*per_class)))
    open_ = ~empty & (F.col("votes") >= least_frames)
    rows = rows.withColumn("vote_ratio", F.when(open_, F.col("_top.n") / F.col("votes")).otherwise(0.0))
    rows = rows.withColumn("avg_confidence", F.when(open_, F.col("_top.total").cast("double") / F.col("_top.n")).otherwise(0.0))
    # The gate compares decimals too: a sum of exactly the limit passes, whatever the quotient rounds to.
    enough = F.col("_top.total") >= F.lit(least_confidence).cast("decimal(9,6)") * F.col("_top.n").cast("decimal(9,0)")
    passed = open_ & (F.col("vote_ratio") >= least_ratio) & enough
    rows = rows.withColumn("stable_id", F.when(passed, F.col("_top.k")))
    label = F.when(empty, F.lit(no_face_label)).when(passed, class_name(F.col("_top.k"))).otherwise(F.lit(NEUTRAL))
    return rows.withColumn("stable_label", label).where(~F.col("_halo")).drop("_none", "_conf", "_epoch", "_top", "_chunk", "_halo")


def frame_log(voted: DataFrame, fps: float = 30.0, no_face_label: str = "no_face") -> DataFrame:
    """The 12-column frame log; missing faces are logged with their label and zeros. A rate of 0 or over 100 counts as 30."""
    rate = fps if 0 < fps <= 100 else 30.0
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    name = F.when(F.col("class_id").isNull(), F.lit(no_face_label)).otherwise(class_name(F.col("class_id")))
    return voted.select(
        "session_id", "frame_index", (F.col("frame_index") / F.lit(rate)).alias("timestamp_sec"), name.alias("raw_class_name"),
        zero("conf").alias("raw_confidence"), "stable_label", "vote_ratio", "avg_confidence",
        *(zero(c).alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")), F.lit(rate).alias("fps"),
    )


def instant_rate(elapsed: Column) -> Column:
    """Frames a second of one frame's time; 0 for none."""
    return F.when(elapsed > 0, 1 / elapsed).otherwise(0.0)


def label_counts(voted: DataFrame, no_face_label: str = "no_face") -> DataFrame:
    """Per session: frames, without a face, neutral, and raw and stable counts of every class, zeros included."""
    raw = [F.count_if(F.col("class_id") == k).alias(f"raw_{n}") for k, n in enumerate(CLASSES)]
    stable = [F.count_if(F.col("stable_label") == n).alias(f"stable_{n}") for n in CLASSES]
    return voted.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("class_id").isNull()).alias("without_face"),
        F.count_if((F.col("stable_label") == NEUTRAL) & F.col("class_id").isNotNull()).alias("neutral"), *raw, *stable,
    )


def captures(voted: DataFrame, keys: DataFrame) -> DataFrame:
    """Frames that an operator marked (session_id, frame_index, key) with the class to file them under.

    Keys 0 to 3 name a class, ``c`` takes the stable label if it is a class; others file nothing.
    """
    rows = voted.join(keys, ["session_id", "frame_index"])
    chosen = F.when(F.col("key").isin(*"0123"), F.col("key").try_cast("int")).when(F.col("key") == "c", F.col("stable_id"))
    return rows.withColumn("file_under", chosen).where(F.col("file_under").isNotNull())


def label_masks(log: DataFrame, label: str = "stable_label") -> DataFrame:
    """``log`` with a flag column is_<class> per class, for plots that draw each class alone."""
    return log.withColumns({f"is_{c}": F.coalesce(F.col(label) == c, F.lit(False)) for c in CLASSES})


def summary_lines(counts: DataFrame, settings: dict[str, object], captured: dict[str, int] | None = None) -> DataFrame:
    """session_id, k, line: the lines of the Markdown summary of every row of ``label_counts``."""
    names = [c for c in counts.columns if c != "session_id"]
    text = summary_text({c: f"{{{c}}}" for c in names}, settings, captured)
    lines = []
    for line in text.split("\n"):
        held = next((c for c in names if line.endswith(f"{{{c}}}")), None)
        lines.append(F.lit(line) if held is None else F.concat(F.lit(line.removesuffix(f"{{{held}}}")), F.col(held).cast("string")))
    return counts.select("session_id", F.posexplode(F.array(*lines)).alias("k", "line"))


def summary_text(counts: dict, settings: dict[str, object], captured: dict[str, int] | None = None) -> str:
    """A Markdown summary of one session: its settings, a row of ``label_counts`` and the files captured per class."""
    lines = ["# Session summary", "", "## Settings", *(f"- {k}: {v}" for k, v in settings.items()), "", "## Frames"]
    lines += [f"- {title}: {counts[key]}" for title, key in (("all", "frames"), ("without a face", "without_face"), ("neutral", "neutral"))]
    for kind in ("raw", "stable"):
        lines += ["", f"## Labels, {kind}", *(f"- {c}: {counts[f'{kind}_{c}']}" for c in CLASSES)]
    if captured is not None:
        lines += ["", "## Captured files", *(f"- {c}: {captured.get(c, 0)}" for c in CLASSES)]
    return "\n".join([*lines, ""])
