"""Queries that apply the operators to the driver's tables, and the same in DuckDB SQL.

The driver's events stand in for detection frames: session = user, frame = event, class = event type, ``error`` = no face or neutral.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.operators import annotations, frames, history, quiz, report, split
from larkspur.operators.chunks import matching
from larkspur.session import new_folder
from larkspur.streaming import vote

EVENT_CLASSES = {"click": 0, "view": 1, "signup": 2, "purchase": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_class() -> Column:
    out = F.lit(None).cast("int")
    for name, k in EVENT_CLASSES.items():
        out = F.when(F.col("event_type") == name, F.lit(k)).otherwise(out)
    return out


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame_index, class_id, conf."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_index"), _event_class().alias("class_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf")
    )


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, i, timestamp, emotion, confidence; an hour counts as a quarter to a whole second."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events")
    rows = matching(events, events.groupBy("user_id").agg(F.min(us).alias("first")), ["user_id"])
    label = F.coalesce(F.get(F.array(*map(F.lit, X.CLASSES)), _event_class()), F.lit(X.NEUTRAL))
    time = (us - F.col("first")).cast("double") / F.lit(3.6e9) * ((F.col("user_id") % 4 + 1) / F.lit(4.0))
    return rows.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("i"), time.alias("timestamp"), label.alias("emotion"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence")
    )


CLASS_SQL = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END"
NAME_SQL = "CASE {} WHEN 0 THEN 'engaged' WHEN 1 THEN 'confused' WHEN 2 THEN 'bored' WHEN 3 THEN 'frustrated' ELSE 'neutral' END"
HISTORY_SQL = f"""h AS (
  SELECT user_id AS session_id, event_id AS i,
         CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / CAST(3.6e9 AS DOUBLE) * (CAST(user_id % 4 + 1 AS DOUBLE) / CAST(4.0 AS DOUBLE)) AS timestamp,
         {NAME_SQL.format(CLASS_SQL)} AS emotion, least(value / 100, 1.0) AS confidence
  FROM events)"""
VOTE_SQL = f"""f AS (
  SELECT user_id AS session_id, event_id AS frame_index, {CLASS_SQL} AS class_id, least(value / 100, 1.0) AS conf FROM events),
e AS (
  SELECT *, sum(CASE WHEN class_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame_index) AS epoch FROM f),
w AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, epoch, class_id IS NULL ORDER BY frame_index) AS rn FROM e),
p AS (
  SELECT a.session_id, a.frame_index, b.class_id AS k, count(*) AS n, min(b.frame_index) AS seen, sum(CAST(b.conf AS DECIMAL(28,17))) AS total
  FROM w a JOIN w b ON a.session_id = b.session_id AND a.epoch = b.epoch AND b.class_id IS NOT NULL AND b.rn BETWEEN a.rn - 29 AND a.rn
  WHERE a.class_id IS NOT NULL GROUP BY 1, 2, 3),
t AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, frame_index ORDER BY n DESC, seen) AS r, sum(n) OVER (PARTITION BY session_id, frame_index) AS votes FROM p),
v AS (
  SELECT f.session_id, f.frame_index, f.class_id, CAST(coalesce(t.votes, 0) AS INTEGER) AS votes, t.k,
         CASE WHEN t.votes >= 8 THEN CAST(t.n AS DOUBLE) / CAST(t.votes AS DOUBLE) ELSE 0.0 END AS vote_ratio,
         CASE WHEN t.votes >= 8 THEN CAST(t.total AS DOUBLE) / CAST(t.n AS DOUBLE) ELSE 0.0 END AS avg_confidence, t.total >= CAST(0.4 AS DECIMAL(9,6)) * CAST(t.n AS DECIMAL(9,0)) AS enough
  FROM f LEFT JOIN t ON f.session_id = t.session_id AND f.frame_index = t.frame_index AND t.r = 1),
s AS (
  SELECT *, CASE WHEN class_id IS NULL THEN 'no_face' WHEN votes >= 8 AND vote_ratio >= 0.4 AND enough THEN {NAME_SQL.format('k')} ELSE 'neutral' END AS stable_label FROM v)"""
SHARE_SQL = ", ".join(f"round_even(CAST(count(*) FILTER (WHERE emotion = '{c}') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100, 1) AS pct_{c}" for c in X.CLASSES)
SMOOTH_SQL = """a AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS rn FROM h),
c AS (
  SELECT a.session_id, a.i, a.rn, a.timestamp, b.emotion, count(*) AS n, min(b.i) AS seen
  FROM a JOIN a b ON a.session_id = b.session_id AND b.rn BETWEEN a.rn - 2 AND a.rn + 2 GROUP BY ALL),
m AS (
  SELECT session_id, i, timestamp, emotion AS smoothed FROM c QUALIFY row_number() OVER (PARTITION BY session_id, i ORDER BY n DESC, seen) = 1),
x AS (
  SELECT *, lag(smoothed) OVER (PARTITION BY session_id ORDER BY i) AS before FROM m),
tr AS (
  SELECT session_id, i, CAST(round_even(timestamp, 0) AS INTEGER) AS t, smoothed AS emotion FROM x WHERE before <> smoothed)"""
TICK_SQL = """ends AS (
  SELECT session_id, arg_max(timestamp, i) AS duration FROM h GROUP BY 1),
st AS (
  SELECT session_id, duration, CASE WHEN duration <= 180 THEN 10 WHEN duration <= 600 THEN 20 ELSE 30 END AS step FROM ends),
tk AS (
  SELECT session_id, CAST(unnest(generate_series(0, CAST(floor(duration) AS INTEGER), step)) AS INTEGER) AS t FROM st),
nb AS (
  SELECT tk.session_id, tk.t, h.emotion, h.i FROM tk JOIN h ON h.session_id = tk.session_id AND abs(h.timestamp - tk.t) <= 4.0),
nv AS (
  SELECT session_id, t, emotion FROM (SELECT session_id, t, emotion, count(*) AS n, min(i) AS seen FROM nb GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY session_id, t ORDER BY emotion = 'neutral', n DESC, seen) = 1),
nn AS (
  SELECT tk.session_id, tk.t, h.emotion FROM tk JOIN h ON h.session_id = tk.session_id
  WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.session_id = tk.session_id AND nb.t = tk.t)
  QUALIFY row_number() OVER (PARTITION BY tk.session_id, tk.t ORDER BY abs(h.timestamp - tk.t), h.i) = 1),
tl AS (
  SELECT * FROM nv UNION ALL SELECT * FROM nn)"""
POINT_SQL = """pts AS (
  SELECT session_id, t, -1 AS o, emotion FROM (
    SELECT session_id, t, emotion, 0 AS late, 0 AS i FROM tl UNION ALL SELECT session_id, t, emotion, 1, i FROM tr)
  QUALIFY row_number() OVER (PARTITION BY session_id, t ORDER BY late DESC, i DESC) = 1),
np AS (
  SELECT * FROM pts WHERE emotion <> 'neutral'),
sh AS (
  SELECT session_id, emotion, round_even(CAST(count(*) AS DOUBLE) / CAST(any_value(n) AS DOUBLE) * 100, 1) AS pct
  FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM h) GROUP BY 1, 2),
ms AS (
  SELECT h.session_id, CAST(round_even(h.timestamp, 0) AS INTEGER) AS t, list_position(['engaged', 'confused', 'bored', 'frustrated'], h.emotion) - 1 AS o, h.emotion
  FROM sh JOIN h USING (session_id, emotion)
  WHERE pct >= 2.0 AND emotion <> 'neutral' AND NOT EXISTS (SELECT 1 FROM np WHERE np.session_id = sh.session_id AND np.emotion = sh.emotion)
  QUALIFY row_number() OVER (PARTITION BY h.session_id, h.emotion ORDER BY h.confidence DESC, h.i) = 1),
al AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, o) AS rn, count(*) OVER (PARTITION BY session_id) AS n,
         row_number() OVER (PARTITION BY session_id, emotion ORDER BY t, o) AS nth
  FROM (SELECT * FROM np UNION ALL SELECT * FROM ms)),
kept AS (
  SELECT session_id, t, emotion FROM al
  WHERE n > 12 AND (nth = 1 OR list_contains(list_transform(range(12), lambda k: CAST(round_even(k * (CAST(n - 1 AS DOUBLE) / 11), 0) AS BIGINT)), rn - 1))
  QUALIFY row_number() OVER (PARTITION BY session_id, t ORDER BY nth = 1 DESC, rn DESC) = 1)"""


def vote_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = frames.vote(event_frames(spark, sf_dir))
    return voted.select("session_id", "frame_index", "stable_label", F.bround("vote_ratio", 9).alias("vote_ratio"), F.bround("avg_confidence", 9).alias("avg_confidence"), "votes")


def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.label_counts(frames.vote(event_frames(spark, sf_dir)))


def frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = frames.vote(event_frames(spark, sf_dir), no_face_label="neutral").withColumns({c: F.lit(None).cast("double") for c in ("x1", "y1", "x2", "y2")})
    return frames.frame_log(voted, no_face_label="neutral").select("session_id", "frame_index", F.bround("timestamp_sec", 9).alias("timestamp_sec"), "raw_class_name", "raw_confidence", "stable_label", "bbox_x1", "fps")


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distribution(event_history(spark, sf_dir)).drop("duration")


def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = report.distribution(event_history(spark, sf_dir))
    return own.select("session_id", report.dominant([F.col(f"pct_{c}") for c in X.CLASSES]).alias("dominant"))


def top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = report.top_shares(report.distribution(event_history(spark, sf_dir)))
    return own.select("session_id", F.array_join(F.transform("shares", lambda x: x.emotion), ",").alias("classes"))


def centered_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.centered_mode(event_history(spark, sf_dir)).select("session_id", "i", "smoothed")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.transitions(event_history(spark, sf_dir))


def timeline_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tick_labels(event_history(spark, sf_dir))


def session_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.timeline(event_history(spark, sf_dir)).select("session_id", "t", "emotion")


def session_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest_per_session(event_history(spark, sf_dir)).select("session_id", "emotion", "confidence")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "lang", "new_split")


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_counts(_split(spark, sf_dir), "lang", "n_chars")


def split_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.imbalance(split.split_counts(_split(spark, sf_dir), "lang")).select("new_split", "most", "least", F.bround("ratio", 9).alias("ratio"))


def split_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.readiness(split.split_counts(_split(spark, sf_dir), "lang"))


def pairing_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images, labels as label files, toxic ones as the kept boxes."""
    key = lambda df: df.select(F.lit("s").alias("source"), F.lit("train").alias("split"), F.col("doc_id").alias("stem"), *(c for c in df.columns if c != "source"))
    docs, labels = key(table(spark, sf_dir, "documents")), key(table(spark, sf_dir, "labels"))
    judged = annotations.with_labels(docs.select("source", "split", "stem"), labels, labels.where("toxic = 1"))
    return judged.select(F.col("stem").alias("doc_id"), "n_boxes", "reason")


def pairing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.totals(pairing_rejects(spark, sf_dir))


def remap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices of the line items with return flags as classes, the second remapped and both prefixed."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("stem"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("class_id"), "l_shipdate",
    )
    cut = F.col("l_shipdate") < F.to_timestamp(F.lit("1996-01-01"))
    old = rows.where(cut).join(annotations.id_mapping(spark), F.col("class_id") == F.col("old_id")).select("stem", F.col("new_id").alias("class_id"))
    both = annotations.united({"finetuned": rows.where(~cut).select("stem", "class_id"), "bigdata": old})
    return both.groupBy("source", "class_id").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("first_stem"))


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as foreign class names, with four that the targets know."""
    named = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("old_class_id"),
        F.get(F.array(*map(F.lit, ["Engaged", " Boredom ", "confusion", "disengaged", "sleepy"])), F.col("n_nationkey") % 5).alias("old_class_name"),
    )
    return annotations.name_mapping(named)


def largest_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order its line of the highest price, the first among equals."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max_by(F.struct("l_linenumber", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("x")
    )
    return rows.select("l_orderkey", "x.l_linenumber", "x.l_extendedprice")


def image_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as label files and their lines as images with an extension by line number; the best extension of each."""
    exts = F.array(*map(F.lit, [".bmp", ".png", ".jpeg", ".jpg"]))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("source"), F.lit("train").alias("split"), F.col("l_orderkey").alias("stem"), F.get(exts, F.col("l_linenumber") % 4).alias("ext"))
    orders = table(spark, sf_dir, "orders").select(F.lit("s").alias("source"), F.lit("train").alias("split"), F.col("o_orderkey").alias("stem"))
    return annotations.with_images(orders, lines).select("stem", "ext")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return quiz.upserted(rows, ["user_id", "event_type"], "event_id")


def _quiz(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 50).cast("int").alias("module_id"), F.concat(F.lit("q"), F.floor(F.col("p_partkey") / 50).cast("string")).alias("question_id"),
        F.when(F.col("p_size") % 3 == 0, "Concept").when(F.col("p_size") % 3 == 1, "Problem Solving").alias("category"),
        F.when(F.col("p_size") % 2 == 0, X.letter(F.col("p_size") % 4)).alias("correct_answer"), (F.col("p_size") % 4).cast("int").alias("correct"),
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("attempt_id"), (F.col("c_custkey") % 60).cast("int").alias("module_id"), "c_nationkey", "c_acctbal")
    ids = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.struct(k.alias("k"), F.concat(F.lit("q"), k.cast("string")).alias("q"), F.pmod(k + F.col("c_nationkey"), F.lit(5)).alias("a")))
    text = F.map_from_entries(F.transform(F.filter(ids, lambda x: (x.k % 2 == 0) & (x.a < 4)), lambda x: F.struct(x.q, F.lower(X.letter(x.a)))))
    index = F.map_from_entries(F.transform(F.filter(ids, lambda x: (x.k % 2 == 1) & (x.a < 4)), lambda x: F.struct(x.q, x.a.cast("int"))))
    shares = F.create_map(F.lit("engaged"), F.abs("c_acctbal") / 100, F.lit("confused"), F.col("c_nationkey") * F.lit(2.0), F.lit("frustrated"), F.col("c_nationkey") * F.lit(1.0))
    return parts, rows.select("attempt_id", "module_id", text.alias("answers_text"), index.alias("answers_index"), shares.alias("distribution"))


def quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions, customers as attempts; modules 50 to 59 have no question."""
    return quiz.scored(*_quiz(spark, sf_dir))


def rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.scored(*_quiz(spark, sf_dir)).groupBy("interpretation").agg(F.count(F.lit(1)).alias("n"))


def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as study sessions of their customers."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("nim"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"),
        F.floor(F.col("o_totalprice") % 900).cast("long").alias("duration_seconds"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("dominant_emotion"),
    )
    return history.stats(rows)


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy((F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def label_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as label lines, some of them broken on purpose."""
    d = lambda x, n: F.concat(F.lit("0."), F.lpad(F.pmod(x, F.lit(10**n)).cast("string"), n, "0"))
    k = F.col("l_linenumber")
    box = F.concat_ws(" ", (F.col("l_suppkey") % 5).cast("string"), d(F.col("l_partkey"), 3), d(F.col("l_orderkey"), 3), d(F.col("l_partkey") + 1, 2), F.when(k % 3 == 0, "1.5").otherwise(d(F.col("l_orderkey"), 2)))
    value = F.when(k == 7, F.concat(box, F.lit(" 9"))).when(k == 6, F.replace(box, F.lit("0."), F.lit("x"))).when(k == 5, F.lit("  ")).otherwise(box)
    return table(spark, sf_dir, "lineitem").select(F.lit("s").alias("source"), F.lit("train").alias("split"), F.col("l_orderkey").cast("string").alias("stem"), k.alias("line_no"), value.alias("value"))


def token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line mode on label lines: kept lines by class."""
    kept = annotations.kept_lines(label_line_rows(spark, sf_dir), annotations.id_mapping(spark))
    return annotations.class_counts(kept)


def file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File mode on the same lines; orders without lines are empty files."""
    files = table(spark, sf_dir, "orders").select(F.lit("s").alias("source"), F.lit("train").alias("split"), F.col("o_orderkey").cast("string").alias("stem"))
    return annotations.valid_files(files, label_line_rows(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("num_bboxes").alias("num_bboxes"))


def timed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their time, as a stream has them."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_index"), F.col("ts").cast("timestamp").alias("ts"), _event_class().alias("class_id"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"), F.lit(False).alias("ended"),
    )


def stream_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote as a stream over two deliveries, each with frames of all times out of order; the same rows as ``vote_smoothing``."""
    rows = timed_frames(spark, sf_dir)
    parts = [rows.where("frame_index % 3 = 1"), rows.where("frame_index % 3 <> 1")]
    found = vote.delivered(spark, parts, new_folder(spark, "stream"), {"delay": "40 days", "cell_seconds": 864_000})
    return found.where("not late").select("session_id", "frame_index", "stable_label", F.bround("vote_ratio", 9).alias("vote_ratio"), F.bround("avg_confidence", 9).alias("avg_confidence"), "votes")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh frame of the first ten days comes after the watermark has passed them: given with a flag, and no part of the vote."""
    rows = timed_frames(spark, sf_dir)
    late = (F.col("frame_index") % 7 == 0) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    found = vote.delivered(spark, [rows.where(~late), rows.where(late)], new_folder(spark, "stream"), {"delay": "1 day", "cell_seconds": 864_000})
    return found.select("session_id", "frame_index", "stable_label", "votes", "late")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vote_smoothing, vote_counts, frame_log, class_distribution, dominant_class, top_shares, centered_mode, transitions, timeline_ticks, session_timeline,
        session_latest, stratified_split, split_report, split_imbalance, split_readiness, pairing_rejects, pairing_totals, remap_union, class_names, largest_item,
        image_priority, latest_per_key, quiz_score, rule_class, history_stats, json_props, token_parse, file_validation, stream_vote, stream_late,
    )
}

SPLIT_SQL = """r AS (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
sp AS (
  SELECT doc_id, lang, n_chars, CASE WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS new_split FROM r),
sc AS (
  SELECT x.new_split, l.lang, count(sp.doc_id) AS images, CAST(coalesce(sum(sp.n_chars), 0) AS BIGINT) AS chars
  FROM (VALUES ('train'), ('val'), ('test')) x(new_split) CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN sp ON sp.new_split = x.new_split AND sp.lang = l.lang GROUP BY 1, 2)"""
LINES_SQL = """raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS stem, l_linenumber AS k, l_suppkey % 5 AS c, l_partkey % 1000 AS x, l_orderkey % 1000 AS y, (l_partkey + 1) % 100 AS w,
         CASE WHEN l_linenumber % 3 = 0 THEN 150 ELSE l_orderkey % 100 END AS h FROM lineitem),
pl AS (
  SELECT *, k = 5 AS blank, k NOT IN (5, 6, 7) AND w > 0 AND h > 0 AND h <= 100 AS in_bounds FROM raw)"""
SENTENCE_SQL = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quiz.SENTENCES.items()) + " END"
QUIZ_SQL = f"""q AS (
  SELECT CAST(p_partkey % 50 AS INTEGER) AS module_id, p_partkey // 50 AS k, p_size, CASE p_size % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'P' ELSE 'C' END AS cat FROM part),
an AS (
  SELECT c_custkey AS attempt_id, CAST(c_custkey % 60 AS INTEGER) AS module_id, c_nationkey, c_acctbal FROM customer),
mk AS (
  SELECT an.attempt_id, an.module_id, cat, k < 30 AND (k + c_nationkey) % 5 = p_size % 4 AND (k + c_nationkey) % 5 < 4 AS hit FROM an JOIN q USING (module_id)),
ag AS (
  SELECT attempt_id, module_id, count(*) AS total, count(*) FILTER (WHERE hit) AS correct, count(*) FILTER (WHERE cat = 'C') AS concept_total, count(*) FILTER (WHERE cat = 'C' AND hit) AS concept_correct,
         count(*) FILTER (WHERE cat = 'P') AS problem_solving_total, count(*) FILTER (WHERE cat = 'P' AND hit) AS problem_solving_correct FROM mk GROUP BY 1, 2),
fu AS (
  SELECT an.attempt_id, an.module_id, c_nationkey, c_acctbal, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total', 'correct', 'concept_total', 'concept_correct', 'problem_solving_total', 'problem_solving_correct'))}
  FROM an LEFT JOIN ag USING (attempt_id, module_id)),
pc AS (
  SELECT *, {', '.join(f'CASE WHEN {b} > 0 THEN round_even(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100, 0) ELSE 0.0 END AS {n}' for n, a, b in (('score', 'correct', 'total'), ('concept_score_pct', 'concept_correct', 'concept_total'), ('problem_solving_score_pct', 'problem_solving_correct', 'problem_solving_total')))} FROM fu),
ru AS (
  SELECT *, CASE WHEN score >= 75 AND abs(c_acctbal) / 100 >= 40 THEN 'good' WHEN problem_solving_correct < 3 AND c_nationkey * 2 >= 25 THEN 'confused' WHEN c_nationkey >= 20 THEN 'frustrated' WHEN score >= 70 THEN 'stable_good' ELSE 'stable' END AS rule FROM pc),
qs AS (
  SELECT attempt_id, module_id, total, correct, concept_total, concept_correct, problem_solving_total, problem_solving_correct, score, concept_score_pct, problem_solving_score_pct, {SENTENCE_SQL} AS interpretation FROM ru)"""

LATE_ROWS = "event_id % 7 = 0 AND ts < TIMESTAMP '2024-01-10'"
LATE_SQL = VOTE_SQL.replace("AS conf FROM events)", f"AS conf FROM events WHERE NOT ({LATE_ROWS}))")

ORACLES: dict[str, str] = {
    "stream_vote": f"WITH {VOTE_SQL} SELECT session_id, frame_index, stable_label, round_even(vote_ratio, 9) AS vote_ratio, round_even(avg_confidence, 9) AS avg_confidence, votes FROM s",
    "stream_late": f"WITH {LATE_SQL} SELECT session_id, frame_index, stable_label, votes, false AS late FROM s UNION ALL SELECT user_id, event_id, NULL, CAST(0 AS INTEGER), true FROM events WHERE {LATE_ROWS}",
    "vote_smoothing": f"WITH {VOTE_SQL} SELECT session_id, frame_index, stable_label, round_even(vote_ratio, 9) AS vote_ratio, round_even(avg_confidence, 9) AS avg_confidence, votes FROM s",
    "vote_counts": f"WITH {VOTE_SQL} SELECT session_id, count(*) AS frames, count(*) FILTER (WHERE class_id IS NULL) AS without_face, count(*) FILTER (WHERE stable_label = 'neutral') AS neutral, "
    + ", ".join(f"count(*) FILTER (WHERE class_id = {k}) AS raw_{c}, count(*) FILTER (WHERE stable_label = '{c}') AS stable_{c}" for k, c in enumerate(X.CLASSES)) + " FROM s GROUP BY 1",
    "frame_log": f"WITH {VOTE_SQL} SELECT s.session_id, s.frame_index, round_even(CAST(s.frame_index AS DOUBLE) / 30.0, 9) AS timestamp_sec, CASE WHEN s.class_id IS NULL THEN 'neutral' ELSE {NAME_SQL.format('s.class_id')} END AS raw_class_name, "
    "coalesce(f.conf, 0.0) AS raw_confidence, CASE stable_label WHEN 'no_face' THEN 'neutral' ELSE stable_label END AS stable_label, CAST(0.0 AS DOUBLE) AS bbox_x1, CAST(30.0 AS DOUBLE) AS fps FROM s JOIN f USING (session_id, frame_index)",
    "class_distribution": f"WITH {HISTORY_SQL} SELECT session_id, count(*) AS total_frames, {SHARE_SQL} FROM h GROUP BY 1",
    "dominant_class": f"WITH {HISTORY_SQL}, d AS (SELECT session_id, {SHARE_SQL} FROM h GROUP BY 1) SELECT session_id, CASE greatest(pct_engaged, pct_confused, pct_bored, pct_frustrated) WHEN pct_engaged THEN 'engaged' WHEN pct_confused THEN 'confused' WHEN pct_bored THEN 'bored' ELSE 'frustrated' END AS dominant FROM d",
    "top_shares": f"WITH {HISTORY_SQL}, d AS (SELECT session_id, emotion, list_position(['engaged', 'confused', 'bored', 'frustrated'], emotion) AS k, round_even(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY session_id) AS DOUBLE) * 100, 1) AS pct FROM h GROUP BY 1, 2) "
    "SELECT session_id, coalesce(string_agg(emotion, ',' ORDER BY pct DESC, k) FILTER (WHERE pct > 0 AND emotion <> 'neutral'), '') AS classes FROM d GROUP BY 1",
    "centered_mode": f"WITH {HISTORY_SQL}, {SMOOTH_SQL} SELECT session_id, i, smoothed FROM m",
    "transitions": f"WITH {HISTORY_SQL}, {SMOOTH_SQL} SELECT * FROM tr",
    "timeline_ticks": f"WITH {HISTORY_SQL}, {TICK_SQL} SELECT * FROM tl",
    "session_timeline": f"WITH {HISTORY_SQL}, {SMOOTH_SQL}, {TICK_SQL}, {POINT_SQL} SELECT session_id, t, emotion FROM al WHERE n <= 12 UNION ALL SELECT * FROM kept",
    "session_latest": f"WITH {HISTORY_SQL} SELECT session_id, arg_max(emotion, i) AS emotion, round_even(arg_max(confidence, i), 2) AS confidence FROM h GROUP BY 1",
    "stratified_split": f"WITH {SPLIT_SQL} SELECT doc_id, lang, new_split FROM sp",
    "split_report": f"WITH {SPLIT_SQL} SELECT new_split, lang, images, chars AS boxes, round_even(CAST(images AS DOUBLE) / CAST(sum(images) OVER (PARTITION BY new_split) AS DOUBLE) * 100, 2) AS percent FROM sc",
    "split_imbalance": f"WITH {SPLIT_SQL} SELECT new_split, max(images) AS most, min(images) AS least, CASE WHEN max(images) = 0 THEN NULL WHEN min(images) = 0 THEN CAST('inf' AS DOUBLE) ELSE round_even(CAST(max(images) AS DOUBLE) / CAST(min(images) AS DOUBLE), 9) END AS ratio FROM sc GROUP BY 1",
    "split_readiness": f"WITH {SPLIT_SQL}, m AS (SELECT min(images) FILTER (WHERE new_split = 'train') AS train, min(images) FILTER (WHERE new_split = 'val') AS val FROM sc) SELECT train, val, CASE WHEN train = 0 OR val = 0 THEN 'NOT_READY' WHEN train < 50 OR val < 10 THEN 'TRAIN_WITH_CAUTION' ELSE 'READY_FOR_TRAINING' END AS verdict FROM m",
    "pairing_rejects": "SELECT d.doc_id, CAST(coalesce(l.toxic, 0) AS BIGINT) AS n_boxes, CASE WHEN l.doc_id IS NULL THEN 'Missing label file' WHEN l.toxic = 0 THEN 'No target class bbox remaining' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)",
    "pairing_totals": "SELECT count(*) AS processed, count(*) FILTER (WHERE l.toxic = 1) AS saved, count(*) FILTER (WHERE coalesce(l.toxic, 0) = 0) AS skipped FROM documents d LEFT JOIN labels l USING (doc_id)",
    "remap_union": "WITH r AS (SELECT l_orderkey || '_' || l_linenumber AS stem, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, l_shipdate < TIMESTAMP '1996-01-01' AS old FROM lineitem), "
    "u AS (SELECT 'finetuned' AS source, 'finetuned_' || stem AS stem, c AS class_id FROM r WHERE NOT old UNION ALL SELECT 'bigdata', 'bigdata_' || stem, CASE c WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END FROM r WHERE old) SELECT source, class_id, count(*) AS n, min(stem) AS first_stem FROM u GROUP BY 1, 2",
    "class_names": "WITH n AS (SELECT n_nationkey AS old_class_id, ['Engaged', ' Boredom ', 'confusion', 'disengaged', 'sleepy'][n_nationkey % 5 + 1] AS old_class_name FROM nation) "
    "SELECT *, CASE old_class_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS new_class_id, CASE old_class_id % 5 WHEN 0 THEN 'engaged' WHEN 1 THEN 'bored' WHEN 2 THEN 'confused' WHEN 3 THEN 'engaged' END AS new_class_name, CASE WHEN old_class_id % 5 = 4 THEN 'DROP' ELSE 'KEEP' END AS action FROM n",
    "largest_item": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1",
    "image_priority": "WITH i AS (SELECT l_orderkey AS stem, l_linenumber % 4 AS e FROM lineitem) SELECT o_orderkey AS stem, CASE max(CASE e WHEN 3 THEN 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) WHEN 3 THEN '.jpg' WHEN 2 THEN '.jpeg' ELSE '.png' END AS ext FROM orders JOIN i ON o_orderkey = stem WHERE e > 0 GROUP BY 1",
    "latest_per_key": "SELECT user_id, event_type, min(event_id) AS place, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "quiz_score": f"WITH {QUIZ_SQL} SELECT * FROM qs",
    "rule_class": f"WITH {QUIZ_SQL} SELECT interpretation, count(*) AS n FROM qs GROUP BY 1",
    "history_stats": "WITH r AS (SELECT o_custkey AS nim, o_orderkey AS seq, CAST(floor(o_totalprice / 5000) AS INTEGER) AS score, CAST(floor(o_totalprice % 900) AS BIGINT) AS sec, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS em FROM orders), "
    "t AS (SELECT nim, em FROM (SELECT nim, em, count(*) AS n, max(seq) AS newest FROM r WHERE em IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY nim ORDER BY n DESC, newest DESC) = 1) "
    "SELECT r.nim, count(*) AS total_sessions, round_even(CAST(sum(score) AS DOUBLE) / CAST(count(*) AS DOUBLE), 0) AS avg_score, CAST(sum(sec) AS BIGINT) AS total_duration_sec, coalesce(any_value(t.em), 'neutral') AS overall_dominant FROM r LEFT JOIN t USING (nim) GROUP BY 1",
    "json_props": "SELECT CAST(props ->> '$.k' AS INTEGER) % 10 AS k, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "token_parse": f"WITH {LINES_SQL}, kl AS (SELECT stem, CASE c WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 3 END AS class_id FROM pl WHERE in_bounds AND c < 4) "
    "SELECT CAST(d.class_id AS INTEGER) AS class_id, d.class_name, count(kl.stem) AS n_boxes, count(DISTINCT kl.stem) AS n_images FROM (VALUES (0, 'engaged'), (1, 'confused'), (2, 'bored'), (3, 'frustrated')) d(class_id, class_name) LEFT JOIN kl ON kl.class_id = d.class_id GROUP BY 1, 2",
    "file_validation": f"WITH {LINES_SQL}, fs AS (SELECT stem, bool_and(blank OR (in_bounds AND c < 4)) AS ok, count(DISTINCT c) FILTER (WHERE k NOT IN (5, 6, 7)) AS n, count(*) FILTER (WHERE NOT blank) AS b FROM pl GROUP BY 1), "
    "js AS (SELECT CASE WHEN fs.stem IS NULL THEN 'empty' WHEN NOT ok THEN 'invalid' WHEN n = 0 THEN 'blank' WHEN n > 1 THEN 'multi_class' ELSE 'sample' END AS status, coalesce(b, 0) AS b FROM orders LEFT JOIN fs ON fs.stem = CAST(o_orderkey AS VARCHAR)) SELECT status, count(*) AS n, CAST(sum(b) AS BIGINT) AS num_bboxes FROM js GROUP BY 1",
}
