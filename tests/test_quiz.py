"""Quiz scoring, interpretation, history and small expressions."""

import time

from pyspark.sql import functions as F

from larkspur.functions import expr as X
from larkspur.operators import history, quiz

ANSWERS = "attempt_id int, module_id int, answers_text map<string,string>, answers_index map<string,int>, distribution map<string,double>"


def test_scores(spark):
    questions = spark.createDataFrame(
        [(1, "q1", "Concept", "B", None), (1, "q2", None, "C", None), (1, "q3", "Problem Solving", None, 0), (1, "q4", "Other", "D", None), (2, "q1", "Concept", "A", None)],
        "module_id int, question_id string, category string, correct_answer string, correct int",
    )
    answers = spark.createDataFrame(
        [(1, 1, {"q1": "b", "q3": "a", "q4": "x"}, {"q2": 2}, {"engaged": 50.0}), (2, 1, {}, {}, {"confused": 30.0}), (3, 2, {"q1": "B"}, {}, None), (4, 7, {}, {}, {"frustrated": 20.0})], ANSWERS
    )
    found = {r.attempt_id: r for r in quiz.scored(questions, answers).collect()}
    a = found[1]
    assert (a.total, a.correct, a.score, a.concept_correct, a.concept_total, a.problem_solving_correct, a.concept_score_pct) == (4, 3, 75.0, 2, 2, 1, 100.0)
    assert a.interpretation == quiz.SENTENCES["good"] and found[2].interpretation == quiz.SENTENCES["confused"]
    assert found[3].correct == 0 and found[4].total == 0 and found[4].score == 0.0 and found[4].interpretation == quiz.SENTENCES["frustrated"]


def test_coding(spark):
    exercises = spark.createDataFrame([(1, "e1", "print"), (1, "e2", " For ")], "module_id int, exercise_id string, expected_answer string")
    answers = spark.createDataFrame([(1, 1, {"e1": "PRINT ", "e2": "while"}, {}, {})], ANSWERS)
    r = quiz.scored_coding(exercises, answers).first()
    assert (r.total, r.correct, r.score, r.concept_total, r.problem_solving_correct) == (2, 1, 50.0, None, 1)


def test_history(spark):
    rows = spark.createDataFrame(
        [("u", 1, 70, 10, "bored"), ("u", 2, 71, None, "engaged"), ("u", 3, None, 5, None), ("u", 4, 61, 1, "engaged"), ("u", 5, 0, 1, "bored"), ("v", 1, 1, 1, "")],
        "nim string, seq int, score int, duration_seconds int, dominant_emotion string",
    )
    found = {r.nim: r for r in history.stats(rows).collect()}
    assert (found["u"].total_sessions, found["u"].avg_score, found["u"].total_duration_sec, found["u"].overall_dominant) == (5, 40.0, 17, "bored")
    assert found["v"].overall_dominant == "neutral"


def test_records(spark):
    kinds = "module_id int, nim string, name string, emotion_distribution map<string,double>, interpretation string, " + ", ".join(f"{c} {'int' if isinstance(v, int) else 'string'}" for c, v in history.DEFAULTS.items())
    rows = spark.createDataFrame([(1, " n ", "x", {}, None, *[None] * len(history.DEFAULTS)), (None, "n", "x", {}, None, *[None] * len(history.DEFAULTS))], kinds)
    found = history.records(rows, F.to_timestamp(F.lit("2024-02-03 04:05:06"))).collect()
    assert len(found) == 1
    r = found[0]
    assert (r.nim, r.total_questions, r.dominant_emotion, r.completed_at, len(r.id)) == ("n", 10, "neutral", "03 Feb 2024, 04:05", 8)


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(X.clock(F.lit(125.9))) == "02:05" and value(X.minutes_and_seconds(F.lit(125))) == "2m 5s"
    assert value(X.seconds_spent(F.lit(1500))) == 2 and value(X.seconds_spent(F.lit(10))) == 1
    assert value(X.percent(F.lit(1), F.lit(8), 1)) == 12.5 and value(X.percent(F.lit(1), F.lit(200))) == 0.0 and value(X.percent(F.lit(3), F.lit(0))) == 0.0
    assert value(X.tokens(F.lit(" \t 1  2\r"))) == ["1", "2"] and value(X.tokens(F.lit(" \t"))) == []
    assert value(X.number(F.lit("1_0"))) is None and value(X.number(F.lit("5d"))) is None and value(X.number(F.lit("1e2"))) == 100.0
    assert value(X.strict_int(F.lit("1.0"))) is None and value(X.letter(F.lit(3))) == "D" and value(X.letter_index(F.lit("c"))) == 2
    assert value(X.slug(F.lit("Problem  Solving"))) == "problem-solving" and value(X.stem(F.lit("/a/b.c.txt"))) == "b.c" and value(X.suffix(F.lit("/a/b.c.txt"))) == ".txt"
    assert value(X.marked_up(F.lit("a **b** <c>"))) == "a <strong>b</strong> &lt;c&gt;" and value(X.with_blanks(F.lit("x = ___"), "?")) == "x = ?"
    assert value(X.plot_level(F.lit("frustrated"))) == 1 and value(X.class_order(F.lit("no_face"), 4)) == 4


def test_work_grows_with_answers_not_with_questions_times_attempts(spark):
    # 40,000 questions and 4,000 attempts of one module: 160 million pairs, of which 8,000 have an answer.
    n, attempts = 40_000, 4_000
    questions = spark.range(n).select(F.lit(1).alias("module_id"), F.concat(F.lit("q"), "id").alias("question_id"), F.lit("Concept").alias("category"), F.lit("A").alias("correct_answer"), F.lit(None).cast("int").alias("correct"))
    q = lambda k: F.concat(F.lit("q"), ((F.col("id") + k) % n).cast("string"))
    answers = spark.range(attempts).select(
        F.col("id").alias("attempt_id"), F.lit(1).alias("module_id"), F.create_map(q(0), F.lit("a"), q(1), F.lit("b")).alias("answers_text"), F.create_map(q(0), F.lit(0)).alias("answers_index"),
        F.lit(None).cast("map<string,double>").alias("distribution"),
    )
    exercises = questions.select("module_id", F.col("question_id").alias("exercise_id"), F.when(F.col("question_id") == "q7", " ").otherwise("A").alias("expected_answer"))
    for rows, right in ((quiz.scored(questions, answers), 1), (quiz.scored_coding(exercises, answers), 2)):
        began = time.perf_counter()
        found = rows.groupBy("total", "correct").count().collect()
        assert time.perf_counter() - began < 40
        assert sum(r["count"] for r in found) == attempts and {r.total for r in found} == {n}
        assert max(found, key=lambda r: r["count"]).correct == right


def test_blank_and_repeated_answers(spark):
    exercises = spark.createDataFrame([(1, "e1", " "), (1, "e2", None), (1, "e3", "x"), (1, None, "")], "module_id int, exercise_id string, expected_answer string")
    answers = spark.createDataFrame([(1, 1, {"e1": "y", "e3": " X"}, {}, None), (2, 1, None, None, None), (3, 1, {"e2": None, "e9": "x"}, {}, None), (4, None, {}, {}, None)], ANSWERS)
    assert {r.attempt_id: (r.total, r.correct) for r in quiz.scored_coding(exercises, answers).collect()} == {1: (4, 3), 2: (4, 3), 3: (4, 3), 4: (0, 0)}
    questions = spark.createDataFrame([(1, "q1", "Concept", "A", None), (1, "q1", None, "B", None), (1, None, "Concept", None, None)], "module_id int, question_id string, category string, correct_answer string, correct int")
    twice = spark.createDataFrame([(1, 1, {"q1": "a"}, {"q1": 1}, None), (1, 1, {"q1": "c"}, None, None)], ANSWERS)
    assert [(r.total, r.correct, r.concept_total) for r in quiz.scored(questions, twice).collect()] == [(6, 2, 6)] * 2
