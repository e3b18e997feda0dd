"""Long sessions: the vote, the smoothed labels and the ticks by chunks against plain loops, and no task with a whole session."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import frames, report
from larkspur.operators.chunks import with_neighbours
from test_frames import expected, made


@pytest.mark.parametrize("chunk", [1, 7, 40, 1000])
def test_vote_in_chunks(spark, chunk):
    rows = made(seed=chunk, sessions=2, n=90)
    rows += [(5, 1000 * i * i, i % 3, 0.5) for i in range(70)] + [(6, 3, 1, 0.5), (None, 4, 2, 0.5)]  # places far apart, a single row, no session
    df = spark.createDataFrame(rows, "session_id long, frame_index long, class_id int, conf double")
    want = expected([(r[0] if r[0] is not None else -1, *r[1:]) for r in rows])
    found = frames.vote(df, chunk=chunk).collect()
    assert len(found) == len(rows)
    for r in found:
        label, ratio, mean = want[r.session_id if r.session_id is not None else -1, r.frame_index]
        assert r.stable_label == label and abs(r.vote_ratio - ratio) < 1e-12 and abs(r.avg_confidence - mean) < 1e-9


def test_a_million_frames_of_one_session_are_spread(spark):
    rows = spark.range(1_000_000).select(
        F.lit(1).alias("session_id"), F.col("id").alias("frame_index"), F.when(F.col("id") % 997 != 0, F.col("id") / 100 % 4).cast("int").alias("class_id"), F.lit(0.5).alias("conf")
    )
    parts = with_neighbours(rows, 29, 0, "frame_index").groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.count_if("_halo").alias("halo")).collect()
    assert len(parts) == 16 and max(r.n for r in parts) <= 65536 + 29 and sum(r.n - r.halo for r in parts) == 1_000_000
    assert sorted({r.halo for r in parts}) == [0, 29]
    # Windows over a session alone see the table of ranges: its sums, never a confidence.
    plan = frames.vote(rows)._jdf.queryExecution().optimizedPlan().toString()
    alone = [x for x in plan.splitlines() if "Window [" in x and "_chunk" not in x.split("], [")[1]]
    assert alone and all("_range" in x for x in alone)


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_smoothed_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(s, i * (s + 1), float(i), rng.choice(report.LABELS), 0.5) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, i long, timestamp double, emotion string, confidence double")
    found = {(r.session_id, r.i): r.smoothed for r in report.centered_mode(df, chunk=chunk).collect()}
    whole = {(r.session_id, r.i): r.smoothed for r in report.centered_mode(df).collect()}
    assert found == whole and len(found) == len(rows)
    for s in range(3):
        own = [r[3] for r in rows if r[0] == s]
        for k in range(60):
            near = own[max(0, k - 2) : k + 3]
            assert found[s, k * (s + 1)] == max(dict.fromkeys(near), key=near.count)
    assert sorted(report.transitions(df, chunk=chunk).collect()) == sorted(report.transitions(df).collect())


def plain_ticks(rows):
    """(t, emotion) of every tick of rows (i, timestamp, emotion)."""
    duration = rows[-1][1]
    for t in range(0, int(duration) + 1, 10 if duration <= 180 else 20 if duration <= 600 else 30):
        near = [e for _, ts, e in rows if abs(ts - t) <= 4.0]
        live = [e for e in near if e != "neutral"]
        if live:
            yield t, Counter(live).most_common(1)[0][0]
        else:
            yield t, "neutral" if near else min(rows, key=lambda r: abs(r[1] - t))[2]


def test_ticks_over_gaps(spark):
    """Hours without a row: the nearest row comes over empty cells, ties to the earlier one."""
    rng = random.Random(4)
    rows = []
    for s in range(6):
        t = 0.0
        for i in range(40):
            t += rng.choice([0.5, 3.0, 17.0, 60.0, 1000.0]) if s else 10.0 * (i % 3)
            rows.append((s, i, t, rng.choice(report.LABELS), 0.5))
    df = spark.createDataFrame(rows, "session_id long, i long, timestamp double, emotion string, confidence double")
    found = sorted(tuple(r) for r in report.tick_labels(df).collect())
    assert found == sorted((s, t, e) for s in range(6) for t, e in plain_ticks([r[1:4] for r in rows if r[0] == s]))
