"""Detection metrics over the driver's tables, with their DuckDB SQL.

Two orders are an image; their lines of even number are true boxes, those of odd number detections. Boxes lie about a corner that
the image sets, so that lines of an image overlap more or less.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import detection
from larkspur.plans.queries import table


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    image, part, supp = F.expr("l_orderkey div 2"), F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        image.alias("image"), F.when(part % 5 == 0, supp % 4).otherwise(image % 4).cast("int").alias("class_id"), "l_linenumber",
        (image % 97 + part % 9).alias("x1"), (image % 61 + supp % 7).alias("y1"), (image % 97 + part % 9 + 40 + part % 11).alias("x2"), (image % 61 + supp % 7 + 30 + supp % 13).alias("y2"),
        ((part * 7919 + supp * 104729 + F.col("l_orderkey")) % 1000 / F.lit(1000.0)).alias("conf"),
    )
    even = F.col("l_linenumber") % 2 == 0
    return rows.where(even), rows.where(~even)


def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and average precision of every class."""
    found = detection.detection_metrics(*_roles(spark, sf_dir))
    return found.select("class_id", "truths", "detections", *(F.bround(c, 9).alias(c) for c in ("precision", "recall", "ap50", "ap")))


def detection_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all classes."""
    found = detection.mean_metrics(detection.detection_metrics(*_roles(spark, sf_dir)))
    return found.select("classes", "truths", "detections", *(F.bround(c, 9).alias(c) for c in ("precision", "recall", "ap50", "ap")))


def detection_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many detections of each class and confidence are right at each threshold."""
    rows = detection.matched(*_roles(spark, sf_dir)).select("class_id", "conf", F.posexplode("hits").alias("k", "hit"))
    return rows.groupBy("class_id", "conf", F.get(F.array(*map(F.lit, detection.THRESHOLDS)), F.col("k")).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (detection_metrics, detection_means, detection_matches)}

MATCH_SQL = """b AS (
  SELECT l_orderkey // 2 AS image, CAST(CASE WHEN l_partkey % 5 = 0 THEN l_suppkey % 4 ELSE (l_orderkey // 2) % 4 END AS INTEGER) AS class_id, l_linenumber % 2 = 0 AS truth,
         CAST(l_orderkey // 2 % 97 + l_partkey % 9 AS DOUBLE) AS x1, CAST(l_orderkey // 2 % 61 + l_suppkey % 7 AS DOUBLE) AS y1, x1 + 40 + l_partkey % 11 AS x2, y1 + 30 + l_suppkey % 13 AS y2,
         CAST((l_partkey * 7919 + l_suppkey * 104729 + l_orderkey) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS conf FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY x1, y1, x2, y2) AS j FROM b WHERE truth),
d AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY conf DESC, x1, y1, x2, y2) AS i FROM b WHERE NOT truth),
o AS (
  SELECT d.image, d.class_id, d.i, t.j, greatest(0.0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0.0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS c,
         c / ((d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - c) AS iou FROM d JOIN t USING (image, class_id)),
l AS (SELECT image, class_id, i, list({'iou': iou, 'j': j} ORDER BY iou DESC, j) AS l FROM o WHERE iou >= 0.5 GROUP BY ALL),
m(image, class_id, conf, limit_, i, used, hit) AS (
  SELECT image, class_id, CAST(NULL AS DOUBLE), unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM (SELECT DISTINCT image, class_id FROM d)
  UNION ALL
  SELECT d.image, d.class_id, d.conf, m.limit_, d.i,
         CASE WHEN len(list_filter(l.l, lambda x: x.iou >= m.limit_ / 100.0::DOUBLE AND NOT list_contains(m.used, x.j))) > 0
              THEN list_append(m.used, list_filter(l.l, lambda x: x.iou >= m.limit_ / 100.0::DOUBLE AND NOT list_contains(m.used, x.j))[1].j) ELSE m.used END,
         coalesce(len(list_filter(l.l, lambda x: x.iou >= m.limit_ / 100.0::DOUBLE AND NOT list_contains(m.used, x.j))) > 0, false)
  FROM m JOIN d ON d.image = m.image AND d.class_id = m.class_id AND d.i = m.i + 1 LEFT JOIN l ON l.image = d.image AND l.class_id = d.class_id AND l.i = d.i),
h AS (SELECT class_id, conf, limit_ AS threshold, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM m WHERE i > 0 GROUP BY ALL)"""
METRIC_SQL = f"""{MATCH_SQL},
w AS (SELECT class_id, count(*) AS truths FROM t GROUP BY 1),
c AS (
  SELECT class_id, threshold, conf, truths, CAST(sum(n) OVER v AS BIGINT) AS n, CAST(sum(hits) OVER v AS BIGINT) AS hits FROM h JOIN w USING (class_id) WINDOW v AS (PARTITION BY class_id, threshold ORDER BY conf DESC)),
p AS (
  SELECT class_id, max(n) AS detections, arg_max({{'p': CAST(hits AS DOUBLE) / CAST(n AS DOUBLE), 'r': CAST(hits AS DOUBLE) / CAST(truths AS DOUBLE)}}, CAST(2 * hits AS DOUBLE) / CAST(n + truths AS DOUBLE) + conf * 1e-12) AS best FROM c WHERE threshold = 50 GROUP BY 1),
a AS (
  SELECT class_id, threshold, sum(coalesce(best, 0)) / 101 AS area FROM (
    SELECT w.class_id, x.threshold, r.r, (SELECT max(CAST(hits AS DOUBLE) / CAST(n AS DOUBLE)) FROM c WHERE c.class_id = w.class_id AND c.threshold = x.threshold AND 100 * c.hits >= r.r * c.truths) AS best
    FROM w, (SELECT unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) AS threshold) x, (SELECT unnest(range(101)) AS r) r) GROUP BY 1, 2),
f AS (SELECT class_id, max(area) FILTER (WHERE threshold = 50) AS ap50, avg(area) AS ap FROM a GROUP BY 1),
z AS (
  SELECT class_id, truths, coalesce(detections, 0) AS detections, coalesce(best.p, 0.0) AS precision, coalesce(best.r, 0.0) AS recall, ap50, ap FROM w LEFT JOIN p USING (class_id) LEFT JOIN f USING (class_id))"""
_ROUNDED = ", ".join(f"round_even({{0}}({c}), 9) AS {c}" for c in ("precision", "recall", "ap50", "ap"))

ORACLES: dict[str, str] = {
    "detection_metrics": f"WITH RECURSIVE {METRIC_SQL} SELECT class_id, truths, detections, {_ROUNDED.format('')} FROM z",
    "detection_means": f"WITH RECURSIVE {METRIC_SQL} SELECT count(*) AS classes, CAST(sum(truths) AS BIGINT) AS truths, CAST(sum(detections) AS BIGINT) AS detections, {_ROUNDED.format('avg')} FROM z",
    "detection_matches": f"WITH RECURSIVE {MATCH_SQL} SELECT * FROM h",
}
