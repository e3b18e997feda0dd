"""Session reports: distribution, dominant class and a resampled timeline with transitions.

Input is the history table: session_id, i (order within the session), timestamp (seconds), emotion, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.expr import CLASSES, NEUTRAL, half_even, percent
from larkspur.operators.chunks import CHUNK, chunk_window, matching, with_neighbours

LABELS = [*CLASSES, NEUTRAL]


def distribution(history: DataFrame) -> DataFrame:
    """Per session total_frames, duration (timestamp of the last row) and pct_<class>, to one decimal.

    Neutral rows are part of the whole but have no share of their own.
    """
    counts = [F.count_if(F.col("emotion") == c).alias(f"n_{c}") for c in CLASSES]
    own = history.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_frames"), F.max_by("timestamp", "i").alias("duration"), *counts)
    shares = [percent(F.col(f"n_{c}"), F.col("total_frames"), 1).alias(f"pct_{c}") for c in CLASSES]
    return own.select("session_id", "total_frames", "duration", *shares)


def dominant(shares: list[Column], neutral_if_zero: bool = False) -> Column:
    """Class of the largest rounded share, the first in class order among equals.

    A session of neutral rows only yields the first class, unless ``neutral_if_zero``.
    """
    top = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(F.array(*shares), F.greatest(*shares)).cast("int"))
    return F.when(F.greatest(*shares) == 0, F.lit(NEUTRAL)).otherwise(top) if neutral_if_zero else top


def step_seconds(duration: Column) -> Column:
    return F.when(duration <= 180, 10).when(duration <= 600, 20).otherwise(30)


def first_seen_top(label: Column, order: Column, over=None, labels: list[str] = LABELS) -> Column:
    """The commonest label of a group or window, the first seen among equals."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    parts = [F.struct(at(F.count_if(label == x)).alias("n"), (-at(F.min(F.when(label == x, order)))).alias("seen"), F.lit(x).alias("label")) for x in labels]
    return F.array_max(F.array(*parts)).getField("label")


def _smoothed(history: DataFrame, reach: int, chunk: int) -> DataFrame:
    """``history`` with smoothed and _before, the smoothed label of the row before; a session is dealt in chunks with ``reach`` rows on either side and one more ahead."""
    rows = with_neighbours(history, reach + 1, reach, "i", chunk)
    rows = rows.withColumn("smoothed", first_seen_top(F.col("emotion"), F.col("i"), chunk_window("i").rowsBetween(-reach, reach)))
    return rows.withColumn("_before", F.lag("smoothed").over(chunk_window("i"))).where(~F.col("_halo")).drop("_chunk", "_halo")


def centered_mode(history: DataFrame, reach: int = 2, chunk: int = CHUNK) -> DataFrame:
    """``history`` with smoothed: the commonest of up to ``reach`` rows on either side and the row itself."""
    return _smoothed(history, reach, chunk).drop("_before")


def transitions(history: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """session_id, i, t, emotion of rows whose smoothed label differs from the one before."""
    return _smoothed(history, 2, chunk).where(F.col("_before") != F.col("smoothed")).select(
        "session_id", "i", half_even(F.col("timestamp")).cast("int").alias("t"), F.col("smoothed").alias("emotion")
    )


def ticks(history: DataFrame) -> DataFrame:
    """session_id, t, step: every tick from 0 to the session's last second."""
    ends = history.groupBy("session_id").agg(F.max_by("timestamp", "i").alias("duration"))
    ends = ends.withColumn("step", step_seconds(F.col("duration")))
    return ends.select("session_id", "step", F.explode(_tick_times(F.col("duration"), F.col("step"))).alias("t"))


def _tick_times(duration: Column, step: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.floor(duration).cast("int"), F.lit(0)), step)


#: Steps between ticks, by the session's length, and what divides them all.
STEPS, CELL = [10, 20, 30], 10


def _in_reach(history: DataFrame, reach: float) -> DataFrame:
    """session_id, step, t, classes, rows and top: counts and the commonest class of the rows within ``reach`` of a tick, for ticks of any step.

    A row has one tick of each step that it can belong to, so the band is an equality of keys, and counts of a task come first.
    """
    near = lambda s: F.struct(F.lit(s).alias("step"), (half_even(F.col("timestamp") / s) * s).cast("int").alias("t"))
    ours = history.select("session_id", "i", "emotion", "timestamp", F.explode(F.array(*map(near, STEPS))).alias("at")).where(F.abs(F.col("timestamp") - F.col("at.t")) <= reach)
    return ours.groupBy("session_id", F.col("at.step").alias("step"), F.col("at.t").alias("t")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("emotion").isin(CLASSES)).alias("classes"), first_seen_top(F.col("emotion"), F.col("i"), labels=CLASSES).alias("top")
    )


def _nearest(history: DataFrame, tick_rows: DataFrame) -> DataFrame:
    """session_id, step, t of ``tick_rows`` and nearest: the label of the row closest in time, the earlier row among equals.

    Ticks lie on the bounds of cells of ``CELL`` seconds, so a cell's first and last rows, found map-side, stand for all its rows; running extremes carry them over empty
    cells. The window over a session sees two rows a cell, never the history.
    """
    own, number = history.where(F.col("timestamp").isNotNull()), F.col("i").cast("long")
    cells = own.groupBy("session_id", F.floor(F.col("timestamp") / CELL).alias("cell")).agg(
        F.max(F.struct(F.col("timestamp").cast("double").alias("time"), (-number).alias("i"), "emotion")).alias("last"),
        F.min(F.struct(F.col("timestamp").cast("double").alias("time"), number.alias("i"), "emotion")).alias("first"),
    )
    none = F.lit(None).cast("struct<time:double,i:bigint,emotion:string>")
    edges = cells.select("session_id", F.explode(F.array(
        F.struct(F.col("last.time").alias("time"), "last", none.alias("first")), F.struct(F.col("first.time").alias("time"), none.alias("last"), "first"),
    )).alias("x")).select("session_id", F.lit(None).cast("int").alias("step"), F.lit(None).cast("int").alias("t"), "x.*")
    marks = tick_rows.select("session_id", "step", "t", F.col("t").cast("double").alias("time"), none.alias("last"), none.alias("first"))
    session = Window.partitionBy("session_id")
    found = edges.unionAll(marks).withColumns({
        "earlier": F.max("last").over(session.orderBy("time")), "later": F.min("first").over(session.orderBy(F.col("time").desc())),
    }).where(F.col("t").isNotNull())
    left, right = F.struct(F.col("t") - F.col("earlier.time"), -F.col("earlier.i")), F.struct(F.col("later.time") - F.col("t"), F.col("later.i"))
    nearest = F.when(F.col("earlier").isNull() | F.col("later").isNotNull() & (right < left), F.col("later.emotion")).otherwise(F.col("earlier.emotion"))
    return found.select("session_id", "step", "t", nearest.alias("nearest"))


def tick_labels(history: DataFrame, reach: float = 4.0) -> DataFrame:
    """session_id, t, emotion of every tick.

    The commonest class among rows within ``reach`` seconds, neutral if they are all neutral; without any, the nearest row's label, the earlier
    row among equals. ``reach`` is under half a step. No row meets another of its session but in counts and extremes made map-side.
    """
    found = _nearest(history, ticks(history))
    rows = matching(found, _in_reach(history, reach), ["session_id", "step", "t"], "left")
    label = F.when(F.col("classes") > 0, F.col("top")).when(F.col("rows") > 0, F.lit(NEUTRAL)).otherwise(F.col("nearest"))
    return rows.select("session_id", "t", label.alias("emotion"))


def _points(history: DataFrame, reach: float, least_share: float, chunk: int) -> DataFrame:
    """session_id, t, emotion and wanted: at each second the label of the last transition, or else of its tick.

    One more row a session, with a null t, has as ``wanted`` the best row (t, o, emotion) of each class of ``least_share`` percent or more.
    """
    labels = tick_labels(history, reach).select("session_id", "t", F.col("emotion").alias("tick"), F.lit(None).cast("struct<i:bigint,emotion:string>").alias("change"))
    changes = transitions(history, chunk).select("session_id", "t", F.lit(None).cast("string").alias("tick"), F.struct(F.col("i").cast("long").alias("i"), "emotion").alias("change"))
    points = labels.unionAll(changes).groupBy("session_id", "t").agg(F.max("tick").alias("tick"), F.max("change").alias("change"))
    points = points.select("session_id", "t", F.coalesce("change.emotion", "tick").alias("emotion"), F.lit(None).cast("array<struct<t:int,o:int,emotion:string>>").alias("wanted"))
    best = lambda c: F.max(F.when(F.col("emotion") == c, F.struct(F.coalesce("confidence", F.lit(0.0)).alias("conf"), (-F.col("i")).alias("k"), "timestamp")))
    own = history.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("emotion") == c).alias(f"n_{c}") for c in CLASSES), *(best(c).alias(f"best_{c}") for c in CLASSES)
    )
    row = lambda k, c: F.struct(half_even(F.col(f"best_{c}.timestamp")).cast("int").alias("t"), F.lit(k).alias("o"), F.lit(c).alias("emotion"))
    wanted = F.array_compact(F.array(*(F.when(percent(F.col(f"n_{c}"), F.col("n"), 1) >= least_share, row(k, c)) for k, c in enumerate(CLASSES))))
    return points.unionAll(own.select("session_id", F.lit(None).cast("int").alias("t"), F.lit(None).cast("string").alias("emotion"), wanted.alias("wanted")))


def timeline(history: DataFrame, least_share: float = 2.0, most_points: int = 12, reach: float = 4.0, chunk: int = CHUNK) -> DataFrame:
    """session_id, t, o (order at equal times), emotion of the report's points.

    Ticks and transitions by second, a later transition replacing what stood there; neutral points go; a class with ``least_share`` percent or
    more that is left without a point gets its most confident row; more than ``most_points`` points are thinned to evenly spaced
    ones and each class's first. Windows over a session see its points, never its rows.
    """
    session = Window.partitionBy("session_id")
    rows = _points(history, reach, least_share, chunk).where(F.col("wanted").isNotNull() | (F.col("emotion") != NEUTRAL))
    rows = rows.withColumn("present", F.collect_set("emotion").over(session))
    own = F.array(F.struct("t", F.lit(-1).alias("o"), "emotion"))
    missing = F.filter("wanted", lambda x: ~F.array_contains("present", x.emotion))
    points = rows.select("session_id", F.inline(F.when(F.col("wanted").isNotNull(), missing).otherwise(own)))
    ordered = session.orderBy("t", "o")
    rows = points.withColumns({
        "rn": F.row_number().over(ordered), "n": F.count(F.lit(1)).over(session),
        "nth": F.row_number().over(Window.partitionBy("session_id", "emotion").orderBy("t", "o")),
    })
    many = F.col("n") > most_points
    spots = F.transform(F.sequence(F.lit(0), F.lit(most_points - 1)), lambda k: half_even(k * ((F.col("n") - 1) / F.lit(float(most_points - 1)))).cast("int"))
    kept = rows.where(~many | F.array_contains(spots, F.col("rn") - 1) | (F.col("nth") == 1))
    # Of many points the last of a second stays, first ones before others; few points all stay.
    return kept.groupBy("session_id", "t", F.when(many, 0).otherwise(F.col("rn")).alias("place")).agg(
        F.max_by("emotion", F.struct(F.col("nth") == 1, "rn")).alias("emotion"), F.max(F.when(many, 0).otherwise(F.col("o"))).alias("o")
    ).select("session_id", "t", "o", "emotion")


def synthetic_timeline(shares: DataFrame) -> DataFrame:
    """An invented timeline for sessions without one: session_id, time, emotion. It makes data up; call it only to fill a chart.

    Classes with a share, the largest first, take turns at max(4, min(8, 2k)) evenly spaced times; engaged if none has one.
    """
    listed = F.array(*(F.struct(F.col(f"pct_{c}").alias("p"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(CLASSES)))
    some = F.transform(F.sort_array(F.filter(listed, lambda x: x.p > 0), asc=False), lambda x: x.c)
    names = F.when(F.size(some) == 0, F.array(F.lit(CLASSES[0]))).otherwise(some)
    rows = shares.withColumn("_names", names).withColumn("_n", F.greatest(F.lit(4), F.least(F.lit(8), 2 * F.size("_names"))))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    time = F.floor(F.col("_k") / (F.col("_n") - 1) * F.greatest(F.lit(10), F.floor("duration")) + 0.5)
    return rows.select("session_id", time.cast("int").alias("time"), F.element_at("_names", F.col("_k") % F.size("_names") + 1).alias("emotion"))


def session_report(history: DataFrame, sessions: DataFrame | None = None, neutral_if_zero: bool = False) -> DataFrame:
    """One row per session: distribution MAP, dominant, total_frames, duration (whole seconds), timeline.

    ``sessions`` (session_id) adds those without rows: zero shares, dominant neutral, an empty timeline.
    """
    own = distribution(history)
    names = [F.col(f"pct_{c}") for c in CLASSES]
    points = timeline(history).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", "o", "emotion"))).alias("p"))
    points = points.select("session_id", F.transform("p", lambda x: F.struct(x.t.alias("time"), x.emotion.alias("emotion"))).alias("timeline"))
    out = own.join(points, "session_id", "left")
    if sessions is not None:
        out = sessions.select("session_id").distinct().join(out, "session_id", "left")
    pairs = [x for c in CLASSES for x in (F.lit(c), F.coalesce(F.col(f"pct_{c}"), F.lit(0.0)))]
    none = F.col("total_frames").isNull()
    return out.select(
        "session_id", F.create_map(*pairs).alias("distribution"),
        F.when(none, F.lit(NEUTRAL)).otherwise(dominant(names, neutral_if_zero)).alias("dominant"),
        F.coalesce("total_frames", F.lit(0)).cast("long").alias("total_frames"),
        F.coalesce(half_even(F.col("duration")), F.lit(0.0)).alias("duration"),
        F.coalesce("timeline", F.array().cast("array<struct<time:int,emotion:string>>")).alias("timeline"),
    )


def latest_per_session(history: DataFrame) -> DataFrame:
    """The newest row of each session, with the payload's rounding: confidence to 2 decimals, time to whole seconds."""
    last = history.groupBy("session_id").agg(F.max_by(F.struct("emotion", "confidence", "timestamp"), "i").alias("x"))
    return last.select("session_id", "x.emotion", half_even(F.col("x.confidence"), 2).alias("confidence"), half_even(F.col("x.timestamp")).alias("duration"))


def top_shares(shares: DataFrame) -> DataFrame:
    """session_id, shares ARRAY<STRUCT<emotion, pct>> of classes with a share, largest first, class order among equals."""
    listed = F.array(*(F.struct(F.col(f"pct_{c}").alias("p"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(CLASSES)))
    kept = F.sort_array(F.filter(listed, lambda x: x.p > 0), asc=False)
    return shares.select("session_id", F.transform(kept, lambda x: F.struct(x.c.alias("emotion"), x.p.alias("pct"))).alias("shares"))


def active(sessions: DataFrame) -> DataFrame:
    """Sessions (session_id, started, ended) that were started and have not ended since."""
    return sessions.where(F.col("started").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("started"))))
