"""The sliding vote, in batch and as a stream, against a plain loop."""

import random
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from larkspur.operators import frames
from larkspur.plans import queries as plans
from larkspur.streaming import vote

NAMES = ["engaged", "confused", "bored", "frustrated"]


def plain_vote(rows):
    held, out = [], []
    for class_id, conf in rows:
        if class_id is None:
            held = []
            out.append(("no_face", 0.0, 0.0))
            continue
        held = [*held, (class_id, conf)][-30:]
        if len(held) < 8:
            out.append(("neutral", 0.0, 0.0))
            continue
        top, n = Counter(k for k, _ in held).most_common(1)[0]
        total = sum(Fraction(str(c)) for k, c in held if k == top)
        out.append((NAMES[top] if n / len(held) >= 0.4 and total / n >= Fraction("0.4") else "neutral", n / len(held), float(total / n)))
    return out


def made(seed=3, sessions=3, n=120):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        state = 0
        for i in range(n):
            state = rng.choice([state, state, state, rng.randrange(4)])
            none = rng.random() < 0.04
            rows.append((s, i, None if none else state, None if none else round(rng.uniform(0.2, 0.8), 3)))
    rows += [(9, i, i % 2, 0.4) for i in range(40)]  # ties, and confidences at the gate
    return rows


def expected(rows):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == s)
        for r, v in zip(own, plain_vote([(r[2], r[3]) for r in own]), strict=True):
            out[r[0], r[1]] = v
    return out


def test_vote_equals_loop(spark):
    rows = made()
    df = spark.createDataFrame(rows, "session_id long, frame_index long, class_id int, conf double")
    want = expected(rows)
    for r in frames.vote(df).collect():
        label, ratio, mean = want[r.session_id, r.frame_index]
        assert r.stable_label == label
        assert abs(r.vote_ratio - ratio) < 1e-12 and abs(r.avg_confidence - mean) < 1e-9


def test_largest_face(spark):
    box = lambda w, h, k=0: (k, 0.9, 0.0, 0.0, float(w), float(h))
    rows = [(1, 0, 100, 100, [box(10, 19)]), (1, 1, 100, 100, [box(10, 20)]), (1, 2, 100, 100, [box(20, 20, 1), box(20, 20, 2)]), (1, 3, 100, 100, []), (1, 4, 100, 100, None)]
    kind = "array<struct<class_id int, conf double, x1 double, y1 double, x2 double, y2 double>>"
    df = spark.createDataFrame(rows, f"session_id int, frame_index int, frame_w int, frame_h int, det {kind}")
    found = {r.frame_index: r.class_id for r in frames.largest_face(df).collect()}
    assert found == {0: None, 1: 0, 2: 1, 3: None, 4: None}
    boxes = frames.largest_face(df).select("frame_index", frames.to_center_box(*(F.col(c) for c in ("frame_w", "frame_h", "x1", "y1", "x2", "y2"))).alias("b")).collect()
    assert tuple(next(r.b for r in boxes if r.frame_index == 3)) == (0.5, 0.5, 0.95, 0.95)
    assert tuple(next(r.b for r in boxes if r.frame_index == 1)) == (0.05, 0.1, 0.1, 0.2)


def test_empty_input(spark):
    df = spark.createDataFrame([], "session_id long, frame_index long, class_id int, conf double")
    assert frames.vote(df).count() == 0 and frames.label_counts(frames.vote(df)).count() == 0


def test_sums_at_the_limit_are_those_of_sql(spark, tmp_path):
    # Eight frames a session, whose confidences have the mean 0.4 in print; as SQL's decimals some lie above it and some below.
    rng = random.Random(5)
    rows = []
    for session in range(300):
        cents = [rng.randrange(100, 7000) for _ in range(7)]
        cents.append(32000 - sum(cents))
        if 0 <= cents[-1] <= 10000:
            rows += [(session, 8 * session + k, "click", c / 100) for k, c in enumerate(cents)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2] for r in con.sql(plans.ORACLES["vote_smoothing"]).fetchall()}
    found = {(r.session_id, r.frame_index): r.stable_label for r in plans.vote_smoothing(spark, str(tmp_path)).collect()}
    assert found == want
    ends = [label for (_, i), label in want.items() if i % 8 == 7]
    assert ends.count("neutral") > 5 and ends.count("engaged") > 5


def test_buffer_sums_as_sql_does():
    for low, high in ((0.0316, 0.7684), (0.07, 0.73), (0.3712, 0.4288), (0.2927, 0.5073), (0.0001, 0.7999)):
        buffer = vote.Buffer(30)
        for _ in range(4):
            buffer.add(0, low)
            buffer.add(0, high)
        total = duckdb.sql(f"SELECT 4 * (CAST({low}::DOUBLE AS DECIMAL(28,17)) + CAST({high}::DOUBLE AS DECIMAL(28,17)))").fetchall()[0][0]
        assert sum(vote.units(c) for c in buffer.confidences) == total.scaleb(17)
        assert buffer.label(8, 0.4, 0.4)[0] == ("engaged" if total >= Decimal("3.2") else "neutral")
