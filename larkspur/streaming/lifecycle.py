"""Sessions that start and stop, by event time: which frames fall into a running session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans(starts: DataFrame, stops: DataFrame, most: str, delay: str) -> DataFrame:
    """session_id, started, stopped for each stop (session_id, stopped) after a start (session_id, started), ``most`` later at most; a stream-stream join.

    Both sides have a watermark ``delay`` behind their times, and a stop lies within ``most`` of its start, so Spark lets go of a start when no stop for it can come any more, and of a stop likewise.
    """
    one = starts.select("session_id", "started").withWatermark("started", delay)
    other = stops.select(F.col("session_id").alias("_session"), "stopped").withWatermark("stopped", delay)
    within = F.expr(f"stopped > started AND stopped <= started + INTERVAL {most}")
    # One event time goes on; the other becomes a plain column.
    return one.join(other, (F.col("session_id") == F.col("_session")) & within).select("session_id", "started", F.expr("stopped + INTERVAL 0 seconds").alias("stopped"))


def active_frames(frames: DataFrame, starts: DataFrame, stops: DataFrame, most: str, delay: str) -> DataFrame:
    """session_id, frame_index, ts, started, stopped: the frames (session_id, frame_index, ts) within each span of their session, ends included.

    State of a frame goes when the watermark of starts has passed it, and that of a span when no frame in it can come; rows later than the watermark have no part.
    Null sessions never match.
    """
    own = frames.select(F.col("session_id").alias("_session"), "frame_index", "ts").withWatermark("ts", delay)
    found = spans(starts, stops, most, delay)
    within = F.expr(f"ts >= started AND ts <= started + INTERVAL {most} AND ts <= stopped")
    return own.join(found, (F.col("_session") == F.col("session_id")) & within).select("session_id", "frame_index", F.expr("ts + INTERVAL 0 seconds").alias("ts"), "started", "stopped")
