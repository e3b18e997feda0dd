"""Detection metrics: detections matched with true boxes per image and class, precision-recall curves, interpolated average precision.

Boxes have image, class_id and corners x1, y1, x2, y2; detections conf as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.expr import let, ratio

# The overlaps at which a detection counts, in percent.
THRESHOLDS = [50, 55, 60, 65, 70, 75, 80, 85, 90, 95]
BOX = ["x1", "y1", "x2", "y2"]
#: Ranges of confidence into which a class's curve is cut.
RANGES = 1024


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0.0 for boxes without area."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return let(side("x1", "x2") * side("y1", "y2"), lambda common: ratio(common, area(a) + area(b) - common))


def matched(truths: DataFrame, detections: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """image, class_id, conf, hits (a flag for each threshold) of every detection.

    In an image and class, detections come by falling confidence, then by their corners; each takes the true box of the largest overlap, the first by corners
    among equals, that reaches the threshold and that none before it took. One exchange by (image, class); an image's boxes are one row,
    and no pair of boxes leaves it. A null confidence counts as 0.
    """
    box = lambda df: F.struct(*(df[c].cast("double").alias(c) for c in BOX))
    conf = F.coalesce(detections["conf"].cast("double"), F.lit(0.0))
    none = F.lit(None)
    rows = truths.select("image", "class_id", none.cast("double").alias("conf"), box(truths).alias("box"), F.lit(True).alias("true")).unionAll(
        detections.select("image", "class_id", conf.alias("conf"), box(detections).alias("box"), F.lit(False).alias("true"))
    )
    found = F.collect_list(F.when(~F.col("true"), F.struct((-F.col("conf")).alias("fall"), "box", "conf")))
    each = rows.groupBy("image", "class_id").agg(F.sort_array(F.collect_list(F.when(F.col("true"), F.col("box")))).alias("truths"), F.sort_array(found).alias("found"))
    each = each.where(F.size("found") > 0)
    # Per detection the true boxes from the best overlap down.
    near = lambda d: F.sort_array(F.filter(F.transform("truths", lambda t, k: F.struct((-overlap(d["box"], t)).alias("fall"), k.alias("k"))), lambda x: x["fall"] <= -min(thresholds) / 100.0))
    each = each.withColumn("found", F.transform("found", lambda d: F.struct(d["conf"].alias("conf"), near(d).alias("near"))))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<boolean>").alias("hits"))

    def step(limit: Column) -> Callable[[Column, Column], Column]:
        def take(state: Column, d: Column) -> Column:
            best = F.get(F.filter(d["near"], lambda x: (x["fall"] <= -limit / 100.0) & ~F.array_contains(state["used"], x["k"])), 0)["k"]
            return let(best, lambda k: F.struct(
                F.when(k.isNull(), state["used"]).otherwise(F.array_append(state["used"], k)).alias("used"), F.array_append(state["hits"], k.isNotNull()).alias("hits")
            ))
        return take

    hits = F.transform(F.array(*map(F.lit, thresholds)), lambda limit: F.aggregate("found", start, step(limit), lambda state: state["hits"]))
    each = each.select("image", "class_id", "found", hits.alias("hits"))
    of = F.transform("found", lambda d, i: F.struct(d["conf"].alias("conf"), F.transform("hits", lambda h: F.get(h, i)).alias("hits")))
    return each.select("image", "class_id", F.inline(of))


def curve(judged: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """class_id, conf, n and hits: how many detections, and right ones by threshold, have that confidence or more.

    A class's confidences are cut into ranges; running sums within a range start from the sums of the ranges above it, a table of at most ``RANGES`` rows a class, so no task holds a
    class. Detections alike in confidence are one point.
    """
    at = F.least(F.floor(F.col("conf") * RANGES), F.lit(RANGES - 1)).cast("int")
    sums = [F.count_if(F.get("hits", k)).alias(f"h{k}") for k in range(len(thresholds))]
    points = judged.groupBy("class_id", at.alias("at"), "conf").agg(F.count(F.lit(1)).alias("n"), *sums)
    names = ["n", *(f"h{k}" for k in range(len(thresholds)))]
    above = Window.partitionBy("class_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = judged.groupBy("class_id", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), *sums)
    ranges = ranges.select(F.col("class_id").alias("c"), F.col("at").alias("a"), *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"b_{x}") for x in names))
    within = Window.partitionBy("class_id", "at").orderBy(F.col("conf").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = points.select("class_id", "at", "conf", *(F.sum(x).over(within).alias(x) for x in names))
    rows = run.join(ranges, run["class_id"].eqNullSafe(ranges["c"]) & (run["at"] == ranges["a"]))
    total = lambda x: F.col(x) + F.col(f"b_{x}")
    return rows.select("class_id", "conf", total("n").alias("n"), F.array(*(total(x) for x in names[1:])).alias("hits"))


def detection_metrics(truths: DataFrame, detections: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """class_id, truths, detections, precision, recall, ap50 and ap of every class that has a true box.

    Average precision is the mean over 101 recalls, 0 to 1, of the best precision at that recall or more; ap50 is that of the first threshold, ap the mean over all. precision and recall are those at
    the confidence of the best harmonic mean at the first threshold, the highest among equals. A class without a detection has zeros; a null class is a class.
    """
    points = curve(matched(truths, detections, thresholds), thresholds)
    whole = truths.groupBy(F.col("class_id").alias("c")).agg(F.count(F.lit(1)).alias("truths"))
    rows = points.join(whole, points["class_id"].eqNullSafe(whole["c"]))
    f1 = 2 * F.get("hits", 0) / (F.col("n") + F.col("truths"))
    best = F.max_by(F.struct((F.get("hits", 0) / F.col("n")).alias("precision"), (F.get("hits", 0) / F.col("truths")).alias("recall")), F.struct(f1, "conf"))
    own = rows.groupBy("class_id").agg(F.max("n").alias("detections"), best.alias("best"))
    # At each of the 101 recalls the best precision among points whose recall reaches that one and no next; then running from the top.
    steps = rows.select("class_id", "truths", "n", F.posexplode("hits").alias("k", "h"))
    level = F.expr("(100 * h) div truths").cast("int")
    tops = steps.groupBy("class_id", "k", level.alias("level")).agg(F.max(F.col("h") / F.col("n")).alias("p"))
    areas = tops.groupBy("class_id", "k").agg(F.sort_array(F.collect_list(F.struct("level", "p")), asc=False).alias("tops"))  # 101 at most
    best_from = lambda r: F.coalesce(F.array_max(F.transform(F.filter("tops", lambda x: x["level"] >= r), lambda x: x["p"])), F.lit(0.0))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), best_from), F.lit(0.0), lambda a, x: a + x)
    areas = areas.select("class_id", "k", (total / 101).alias("area"))
    mean = areas.groupBy("class_id").agg(F.max(F.when(F.col("k") == 0, F.col("area"))).alias("ap50"), (F.sum("area") / len(thresholds)).alias("ap"))
    out = whole
    for part in (own, mean):
        part = part.withColumnRenamed("class_id", "_c")
        out = out.join(part, out["c"].eqNullSafe(part["_c"]), "left").drop("_c")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        F.col("c").alias("class_id"), "truths", F.coalesce("detections", F.lit(0)).alias("detections"), zero(F.col("best.precision")).alias("precision"), zero(F.col("best.recall")).alias("recall"),
        zero(F.col("ap50")).alias("ap50"), zero(F.col("ap")).alias("ap"),
    )


def mean_metrics(by_class: DataFrame) -> DataFrame:
    """One row: means of ``detection_metrics`` over classes, and sums of its counts."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "ap50", "ap")]
    return by_class.agg(F.count(F.lit(1)).alias("classes"), F.sum("truths").alias("truths"), F.sum("detections").alias("detections"), *means)
