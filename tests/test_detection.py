"""Detection metrics against a plain loop, and the curve over ranges of confidence."""

import random

from pyspark.sql import functions as F

from larkspur.operators import detection


def iou(a, b):
    side = lambda k: max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
    common = side(0) * side(1)
    whole = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) - common
    return common / whole if whole > 0 else 0.0


def plain(truths, found, limits):
    """{class: (truths, detections, precision, recall, ap50, ap)} of rows (image, class, box) and (image, class, confidence, box)."""
    out = {}
    for c in {t[1] for t in truths}:
        own = [t for t in truths if t[1] == c]
        marks = []
        for image in {d[0] for d in found if d[1] == c}:
            boxes = sorted(t[2] for t in own if t[0] == image)
            ranked = sorted((d for d in found if d[0] == image and d[1] == c), key=lambda d: (-d[2], d[3]))
            hits = [[] for _ in ranked]
            for limit in limits:
                used = set()
                for d, h in zip(ranked, hits, strict=True):
                    best = max(((iou(d[3], b), -k) for k, b in enumerate(boxes) if k not in used and iou(d[3], b) >= limit / 100), default=None)
                    h.append(best is not None)
                    used |= {-best[1]} if best else set()
            marks += [(d[2], h) for d, h in zip(ranked, hits, strict=True)]
        points = []
        for conf in sorted({m[0] for m in marks}, reverse=True):
            above = [m for m in marks if m[0] >= conf]
            points.append((conf, len(above), [sum(m[1][k] for m in above) for k in range(len(limits))]))
        areas = [sum(max((p[2][k] / p[1] for p in points if 100 * p[2][k] >= r * len(own)), default=0.0) for r in range(101)) / 101 for k in range(len(limits))]
        best = max(points, key=lambda p: (2 * p[2][0] / (p[1] + len(own)), p[0]), default=None)
        p, r = (best[2][0] / best[1], best[2][0] / len(own)) if best else (0.0, 0.0)
        out[c] = (len(own), len(marks), p, r, areas[0], sum(areas) / len(areas))
    return out


def test_metrics_equal_plain(spark):
    rng = random.Random(2)
    box = lambda: (x := rng.randrange(20), y := rng.randrange(20), x + rng.randrange(0, 30), y + rng.randrange(0, 30))
    near = lambda b: (b[0] + rng.randrange(-2, 3), b[1] + rng.randrange(-2, 3), b[2] + rng.randrange(-2, 3), b[3] + rng.randrange(-2, 3))
    truths = [(i, rng.choice([0, 1, None]), tuple(map(float, box()))) for i in range(40) for _ in range(rng.randrange(6))]
    found = [(t[0], t[1], rng.randrange(10) / 10, tuple(map(float, near(t[2])))) for t in truths for _ in range(rng.randrange(3))]
    found += [(rng.randrange(50), rng.choice([0, 1, 3]), rng.randrange(10) / 10, tuple(map(float, box()))) for _ in range(60)]
    truths += [(1, 7, (0.0, 0.0, 5.0, 5.0))]  # a class without detections
    corners = "x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame([(i, c, *b) for i, c, b in truths], f"image int, class_id int, {corners}")
    d = spark.createDataFrame([(i, c, s, *b) for i, c, s, b in found], f"image int, class_id int, conf double, {corners}")
    want = plain(truths, found, detection.THRESHOLDS)
    got = {r.class_id: tuple(r)[1:] for r in detection.detection_metrics(t, d).collect()}
    assert set(got) == set(want) and got[7] == (1, 0, 0.0, 0.0, 0.0, 0.0)
    for c, w in want.items():
        assert got[c][:2] == w[:2] and all(abs(a - b) < 1e-12 for a, b in zip(got[c][2:], w[2:], strict=True)), c
    mean = detection.mean_metrics(detection.detection_metrics(t, d)).first()
    assert mean.classes == len(want) and abs(mean.ap - sum(w[5] for w in want.values()) / len(want)) < 1e-12


def test_a_taken_box_is_taken(spark):
    t = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 0, 0, 0, 10, 9)], "image int, class_id int, x1 int, y1 int, x2 int, y2 int")
    d = spark.createDataFrame([(1, 0, c, 0, 0, 10, 10) for c in (0.9, 0.8, 0.7, None)], "image int, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")
    rows = sorted(((r.conf, r.hits) for r in detection.matched(t, d).collect()), reverse=True)
    assert [r[1] for r in rows] == [[True] * 10, [True] * 9 + [False], [False] * 10, [False] * 10] and rows[-1][0] == 0.0
    assert detection.matched(t, d.where("false")).collect() == [] and detection.detection_metrics(t.where("false"), d).collect() == []


def test_a_class_is_cut_into_ranges(spark):
    judged = spark.range(50_000).select(F.lit(0).alias("class_id"), (F.col("id") / 50_000).alias("conf"), F.array((F.col("id") % 3 == 0)).alias("hits"))
    rows = {r.n: r.hits[0] for r in detection.curve(judged, [50]).collect()}
    assert len(rows) == 50_000 and rows[50_000] == 16_667 and rows[1] == 0
    plan = detection.curve(judged, [50])._jdf.queryExecution().optimizedPlan().toString()
    assert all("at#" in x or "a#" in x for x in plan.splitlines() if "Window [" in x)
