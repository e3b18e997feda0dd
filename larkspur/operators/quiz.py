"""Quiz scoring and the rule-based interpretation.

``questions``: module_id, question_id, category (null counts as Concept), correct_answer (a letter) or correct (0 to 3). ``answers``: attempt_id,
module_id, answers_text MAP<STRING, STRING>, answers_index MAP<STRING, INT>, distribution MAP<STRING, DOUBLE>. Question ids repeat across modules, so
the key is always module and question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.expr import letter, letter_index, percent, strip

CONCEPT, PROBLEM = "Concept", "Problem Solving"
# The sentences of the interpretation, in the order of their rules.
SENTENCES = {
    "good": "Mahasiswa menunjukkan keterlibatan belajar yang baik.",
    "confused": "Mahasiswa menunjukkan indikasi kesulitan memahami materi.",
    "frustrated": "Terdapat peningkatan indikasi kesulitan selama proses pembelajaran.",
    "stable_good": "Mahasiswa menunjukkan indikasi emosi belajar yang relatif stabil dengan hasil pemahaman yang baik.",
    "stable": "Mahasiswa menunjukkan indikasi emosi belajar yang relatif stabil selama sesi pembelajaran.",
}


def interpretation(score: Column, solved: Column, engaged: Column, confused: Column, frustrated: Column) -> Column:
    """Key of the first rule that holds; missing shares count as 0."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return (
        F.when((score >= 75) & (zero(engaged) >= 40.0), "good")
        .when((solved < 3) & (zero(confused) >= 25.0), "confused")
        .when(zero(frustrated) >= 20.0, "frustrated")
        .when(score >= 70, "stable_good")
        .otherwise("stable")
    )


def sentence(key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair)), key)


def is_correct(text: Column, index: Column, target: Column, target_index: Column) -> Column:
    """Letters match in either case, an index stands for its letter; the target's index counts only without a letter."""
    no = F.lit(False)
    by_letter = F.coalesce(F.upper(text) == F.upper(target), no) | F.coalesce(letter(index) == F.upper(target), no)
    by_index = F.coalesce(index == target_index, no) | F.coalesce(letter_index(text) == target_index, no)
    return F.when(target.isNotNull(), by_letter).otherwise(by_index)


def marked(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per attempt and question of its module: the answer and whether it is right; unanswered questions are wrong."""
    rows = questions.join(answers.drop("distribution"), "module_id")
    text, index = F.try_element_at("answers_text", F.col("question_id")), F.try_element_at("answers_index", F.col("question_id"))
    rows = rows.withColumn("user_text", text).withColumn("user_index", index)
    hit = is_correct(F.col("user_text"), F.col("user_index"), F.col("correct_answer"), F.col("correct"))
    return rows.select(
        "attempt_id", "module_id", "question_id", F.coalesce("category", F.lit(CONCEPT)).alias("category"),
        F.coalesce("correct_answer", letter(F.coalesce("correct", F.lit(0)))).alias("correct_answer"), "user_text", "user_index", hit.alias("is_correct"),
    )


def scored(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Totals by category, percents half to even, and the interpretation of every attempt; categories other than the two count only in the whole.

    Questions are counted a module, and only answers that were given meet theirs (an unanswered question is wrong), so the work grows with questions and answers, not with their product.
    The hint keeps Spark from broadcasting the answers, whose number a map hides from it.
    """
    asked = questions.select("module_id", "question_id", F.coalesce("category", F.lit(CONCEPT)).alias("category"), "correct_answer", "correct")
    kinds = {"": F.lit(True), "concept_": F.col("category") == CONCEPT, "problem_solving_": F.col("category") == PROBLEM}
    totals = asked.groupBy("module_id").agg(*(F.count_if(of).alias(f"{k}total") for k, of in kinds.items()))
    given = _given(answers, "question_id", "answers_text", "answers_index")
    hit = is_correct(F.col("answers_text"), F.col("answers_index"), F.col("correct_answer"), F.col("correct"))
    right = given.join(asked.hint("shuffle_hash"), ["module_id", "question_id"]).where(hit).groupBy("attempt_id", "module_id").agg(*(F.count_if(of).alias(f"{k}correct") for k, of in kinds.items()))
    own = _attempts(answers, totals, right)
    own = own.select("attempt_id", "module_id", "distribution", *(F.coalesce(c, F.lit(0)).alias(c) for k in kinds for c in (f"{k}total", f"{k}correct")))
    return _finished(own, {"concept_score_pct": ("concept_correct", "concept_total"), "problem_solving_score_pct": ("problem_solving_correct", "problem_solving_total")})


def scored_coding(exercises: DataFrame, answers: DataFrame) -> DataFrame:
    """Coding attempts: answers equal the expected text, trimmed and in either case; all count as problem solving, concept figures are null. No answer is a blank one, which is right where nothing is expected."""
    plain = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    asked = exercises.select("module_id", "exercise_id", plain("expected_answer").alias("expected")).withColumn("blank", F.col("expected") == "")
    totals = asked.groupBy("module_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("blank").alias("blank"))
    given = _given(answers, "exercise_id", "answers_text")
    hit = plain("answers_text") == F.col("expected")
    # What a blank answer would have got is counted a module already.
    more = given.join(asked.hint("shuffle_hash"), ["module_id", "exercise_id"]).where(hit != F.col("blank")).groupBy("attempt_id", "module_id").agg((F.count_if(hit) - F.count_if("blank")).alias("more"))
    own = _attempts(answers, totals, more)
    total, correct = F.coalesce("total", F.lit(0)), F.coalesce("blank", F.lit(0)) + F.coalesce("more", F.lit(0))
    own = own.select("attempt_id", "module_id", "distribution", total.alias("total"), correct.alias("correct"))
    none = F.lit(None).cast("long")
    own = own.withColumns({"concept_total": none, "concept_correct": none, "problem_solving_total": F.col("total"), "problem_solving_correct": F.col("correct")})
    return _finished(own, {"problem_solving_score_pct": ("correct", "total")}).withColumn("concept_score_pct", F.lit(None).cast("double"))


def _given(answers: DataFrame, name: str, *maps: str) -> DataFrame:
    """A row per attempt and key of any of its maps: attempt_id, module_id, the key as ``name``, and each map's value as its column."""
    keys = F.flatten(F.array(*(F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in maps)))
    rows = answers.select("attempt_id", "module_id", *maps, F.explode(F.array_distinct(keys)).alias(name))
    return rows.select("attempt_id", "module_id", name, *(F.try_element_at(m, F.col(name)).alias(m) for m in maps))


def _attempts(answers: DataFrame, totals: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``answers`` with its module's ``totals``, once for each row of its attempt, and its attempt's ``right``."""
    own = answers.groupBy("attempt_id", "module_id").agg(F.count(F.lit(1)).alias("_n")).join(totals, "module_id", "left")
    own = own.select("attempt_id", "module_id", *((F.col(c) * F.col("_n")).alias(c) for c in totals.columns if c != "module_id"))
    own = own.join(right, ["attempt_id", "module_id"], "left")
    return answers.select("attempt_id", "module_id", "distribution").join(own, ["attempt_id", "module_id"], "left")


def _finished(own: DataFrame, shares: dict[str, tuple[str, str]]) -> DataFrame:
    own = own.withColumn("score", percent(F.col("correct"), F.col("total"))).withColumns({n: percent(F.col(a), F.col(b)) for n, (a, b) in shares.items()})
    part = lambda c: F.try_element_at("distribution", F.lit(c))
    key = interpretation(F.col("score"), F.col("problem_solving_correct"), part("engaged"), part("confused"), part("frustrated"))
    return own.withColumn("interpretation", sentence(key)).drop("distribution")


def options(questions: DataFrame) -> DataFrame:
    """question with options ARRAY<STRUCT<letter, text>>: option_a to option_d if the first is there, else the list."""
    named = F.array(*(F.struct(F.lit(c.upper()).alias("letter"), F.col(f"option_{c}").alias("text")) for c in "abcd"))
    listed = F.transform("options", lambda x, i: F.struct(letter(i).alias("letter"), x.alias("text")))
    return questions.withColumn("choices", F.when(F.col("option_a").isNotNull(), named).otherwise(listed))


def answered(answers: DataFrame) -> DataFrame:
    """Per attempt: keys answered and answers that aren't blank."""
    some = F.filter(F.map_values("answers_text"), lambda x: strip(F.coalesce(x, F.lit(""))) != "")
    return answers.select("attempt_id", F.size(F.map_keys("answers_text")).alias("n_keys"), F.size(some).alias("n_filled"))


def upserted(tracking: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key by ``seq``, at the place of its first."""
    rest = [c for c in tracking.columns if c not in (*keys, seq)]
    return tracking.groupBy(*keys).agg(F.min(seq).alias("place"), F.max_by(F.struct(*rest), seq).alias("x")).select(*keys, "place", "x.*")


def time_gates(seconds_read: Column, seconds_answering: Column, least_read: int = 60, most_answering: int = 300) -> Column:
    """STRUCT<may_start, must_submit>: a quiz opens after so much reading, and is handed in when its time is up."""
    return F.struct((seconds_read >= least_read).alias("may_start"), (seconds_answering >= most_answering).alias("must_submit"))


def module_by_id(modules: DataFrame, module_id: int, order: str | None = None) -> DataFrame:
    """The first module of an id, or no row."""
    rows = modules.where(F.col("id") == module_id)
    return (rows.orderBy(order) if order else rows).limit(1)


def module_sizes(modules: DataFrame) -> DataFrame:
    return modules.select("id", F.size("content").alias("n_sections"), F.size("questions").alias("n_questions"), F.size("coding_exercises").alias("n_exercises"))

