"""Streams: frames in any order, late frames, ends of sessions, tables by key, the ledger of the study store, joins with starts and stops."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_frames import expected, made

from larkspur.operators import history
from larkspur.plans import details
from larkspur.session import names_in
from larkspur.streaming import lifecycle, vote
from larkspur.streaming.keyed import KeyedTable

KINDS = "session_id long, frame_index long, ts timestamp, class_id int, conf double, ended boolean"
BEGIN = datetime.datetime(2024, 5, 1)


def timed(spark, rows, ended=()):
    """Frames (session, index, class, confidence), one a second."""
    made = [(s, i, BEGIN + datetime.timedelta(seconds=i), k, c, (s, i) in ended) for s, i, k, c in rows]
    return spark.createDataFrame(made, KINDS).coalesce(1)


def check(found, rows):
    want = expected(rows)
    assert {(r.session_id, r.frame_index) for r in found} == set(want)
    for r in found:
        label, ratio, mean = want[r.session_id, r.frame_index]
        assert r.stable_label == label and abs(r.vote_ratio - ratio) < 1e-12 and abs(r.avg_confidence - mean) < 1e-9


def test_frames_in_any_order_within_the_watermark(spark, tmp_path):
    rows = made(seed=5, sessions=2, n=60)
    dealt = list(rows)
    random.Random(1).shuffle(dealt)
    # The later half of a session first, then the rest at random.
    parts = [timed(spark, [r for r in dealt if r[1] >= 30]), timed(spark, [r for r in dealt if r[1] < 30])]
    found = vote.delivered(spark, parts, str(tmp_path), {"delay": "2 minutes", "cell_seconds": 7}).collect()
    assert not any(r.late for r in found)
    check(found, rows)


def test_late_frames_are_given_and_counted(spark, tmp_path):
    rows = [(1, i, i % 2, 0.5) for i in range(40)] + [(2, i, 0, 0.9) for i in range(3)]
    late = [r for r in rows if r[0] == 1 and r[1] in (3, 4)] + [r for r in rows if r[0] == 2]
    parts = [timed(spark, [r for r in rows if r not in late]), timed(spark, late)]
    found = vote.delivered(spark, parts, str(tmp_path), {"delay": "5 seconds", "cell_seconds": 1}).collect()
    # Session 2 has no state and its times have passed; of session 1 frames 3 and 4 come when 5 is done.
    assert sorted((r.session_id, r.frame_index) for r in found if r.late) == sorted((r[0], r[1]) for r in late)
    assert all(r.stable_label is None and r.votes == 0 for r in found if r.late)
    check([r for r in found if not r.late], [r for r in rows if r not in late])


def test_end_of_a_session_and_no_id(spark, tmp_path):
    rows = [(1, i, 0, 0.9) for i in range(30)] + [(None, i, 1, 0.9) for i in range(12)]
    parts = [timed(spark, rows, ended={(1, 19)})]
    found = vote.delivered(spark, parts, str(tmp_path), {"delay": "5 seconds"}).collect()
    votes = {(r.session_id, r.frame_index): r.votes for r in found}
    assert [votes[1, i] for i in range(30)] == [*range(1, 21), *range(1, 11)]
    assert [votes[None, i] for i in range(12)] == [*range(1, 13)]


def test_idle_sessions_lose_their_state(spark, tmp_path):
    first, second = [(1, i, 0, 0.9) for i in range(10)], [(1, i, 0, 0.9) for i in range(500, 505)]
    for idle, want in ((60.0, 1), (None, 11)):
        path = str(tmp_path / str(idle))
        other = [(2, i, 1, 0.9) for i in range(0, 400, 20)]  # moves the watermark on
        parts = [timed(spark, first), timed(spark, other), timed(spark, second)]
        found = vote.delivered(spark, parts, path, {"delay": "5 seconds", "idle_seconds": idle}).collect()
        assert {r.frame_index: r.votes for r in found if r.session_id == 1}[500] == want


def test_cells_left_waiting_get_their_turn(spark, tmp_path):
    # The watermark stops at the end of a cell, then within later ones, and only the other session moves it on.
    first = [(1, i, 0, 0.9) for i in (0, 1, 6, 9, 12)] + [(2, 7, 1, 0.9)]
    parts = [timed(spark, first), timed(spark, [(2, 11, 1, 0.9)]), timed(spark, [(1, 3, 0, 0.9), (1, 10, 0, 0.9), (2, 15, 1, 0.9)])]
    found = vote.delivered(spark, parts, str(tmp_path), {"delay": "5 seconds", "cell_seconds": 1}).collect()
    assert sorted((r.session_id, r.frame_index, r.votes, r.late) for r in found) == [
        (1, 0, 1, False), (1, 1, 2, False), (1, 3, 0, True), (1, 6, 3, False), (1, 9, 4, False), (1, 10, 5, False), (1, 12, 6, False), (2, 7, 1, False), (2, 11, 2, False), (2, 15, 3, False),
    ]


def test_lifecycle_of_a_table_whose_times_start_again(spark, tmp_path):
    # Two copies with ids of their own and the same times: the second one lies behind the first one's watermark.
    rows = [(c * 90 + i, c * 3 + i % 3, BEGIN + datetime.timedelta(days=i // 3), "click" if i % 7 else "view", 50.0 + i) for c in (0, 1) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = details.session_lifecycle(spark, str(tmp_path)).select("session_id", "frame_index", "stable_label", "votes").collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(details.ORACLES["session_lifecycle"]).fetchall())


def test_pace_is_the_trigger():
    class Writer:
        def trigger(self, **kinds):
            return kinds

    assert vote.paced(Writer()) == {"processingTime": "33 milliseconds"}
    assert vote.paced(Writer(), 10) == {"processingTime": "100 milliseconds"}


def test_paced_stream_runs(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = vote.paced(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")), 5).start(str(tmp_path / "out"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


# --- tables by key


def table_rows(spark, rows):
    return spark.createDataFrame(rows, "k string, v long")


def test_batches_write_their_parts_only(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path), ["k"], parts=8)
    first = [(f"k{i}", i) for i in range(40)] + [(None, -1)]
    assert kept.merge(table_rows(spark, first), 0)
    assert kept.merge(table_rows(spark, [("k3", 300), ("new", 1)]), 1)
    schema = table_rows(spark, first).schema
    want = {**dict(first), "k3": 300, "new": 1}
    assert dict(tuple(r) for r in kept.read(schema).collect()) == want
    assert len(names_in(spark, f"{tmp_path}/data/batch=0")) > 4 and 1 <= len([n for n in names_in(spark, f"{tmp_path}/data/batch=1") if n.startswith("part=")]) <= 2
    # A replay changes nothing, whatever it holds.
    before = kept.version()
    assert not kept.merge(table_rows(spark, [("k4", 9)]), 1) and not kept.merge(table_rows(spark, first), 0)
    assert kept.version() == before and dict(tuple(r) for r in kept.read(schema).collect()) == want
    assert kept.merge(table_rows(spark, [(None, 5)]), 2)
    assert dict(tuple(r) for r in kept.read(schema).collect()) == {**want, None: 5}


def test_a_batch_that_failed_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    from larkspur.streaming import keyed

    kept = KeyedTable(spark, str(tmp_path), ["k"], parts=4)
    kept.merge(table_rows(spark, [("a", 1), ("b", 2)]), 0)
    schema = table_rows(spark, [("a", 1)]).schema

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(keyed, "put_text", fail)
        kept.merge(table_rows(spark, [("a", 7)]), 1)
    assert dict(tuple(r) for r in kept.read(schema).collect()) == {"a": 1, "b": 2}
    kept.merge(table_rows(spark, [("a", 7)]), 1)
    assert dict(tuple(r) for r in kept.read(schema).collect()) == {"a": 7, "b": 2}


def test_store_takes_a_batch_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("007", 1), ("8", 2)], "nim string, seq long")
    assert history.stored(spark, str(tmp_path), "seq long").collect() == []

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(history, "put_text", fail)
        history.append(rows, str(tmp_path), "a")
    assert history.stored(spark, str(tmp_path), "seq long").collect() == []  # written, but not in the ledger
    assert history.append(rows, str(tmp_path), "a") and not history.append(rows, str(tmp_path), "a")
    assert history.append(rows.withColumn("seq", F.col("seq") + 10), str(tmp_path), "b")
    own = history.of_user(history.stored(spark, str(tmp_path), "seq long"), "007")
    assert [(r.nim, r.seq) for r in own.collect()] == [("007", 11), ("007", 1)]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(nim" in plan and "(nim#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


# --- starts and stops


def test_state_of_ended_sessions_goes(spark, tmp_path):
    at = lambda s: BEGIN + datetime.timedelta(seconds=s)
    rows = [(1, 10, "start"), (1, 15, "frame"), (1, 20, "stop"), (1, 25, "frame"), (2, 5, "stop"), (2, 6, "frame"), (3, 1, "start"), (3, 2, "frame"), (3, 2, "stop"), (None, 3, "start"), (None, 4, "frame"), (None, 5, "stop")]
    rows += [(9, 10_000_000, k) for k in ("start", "stop", "frame")]
    df = spark.createDataFrame([(s, t, at(t), k) for s, t, k in rows], "session_id long, frame_index long, ts timestamp, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    every = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    of = lambda k, name: every.where(F.col("kind") == k).withColumnRenamed("ts", name)
    found = lifecycle.active_frames(of("frame", "ts"), of("start", "started"), of("stop", "stopped"), "1 hour", "10 seconds")
    sink = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    sink.awaitTermination()
    assert sorted((r.session_id, r.frame_index) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 15), (3, 2)]
    # Only the heartbeat's own rows are left.
    assert sum(o["numRowsTotal"] for o in sink.lastProgress["stateOperators"]) <= 3
