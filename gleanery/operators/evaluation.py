"""Measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import LINE_END, stripped

# Fixed values of the answer checks.
REFUSAL = (
    r"(?i)\b(don't|do not|doesn't|does not|can't|cannot|couldn't|could not)\s+(have|find|see|contain|mention|say|know)"
    r"|\bno (information|results|mention|record)|\bnot (mentioned|in the (search )?results)|\bnothing (on|about)"
)
GAVE_UP = "I could not settle on an answer"
CLAIM_AFTER = r"(?i)\b(but|however|although|though|instead)\b"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"
QUESTION_WORDS = ["why", "what", "how", "when", "where", "who", "which", "did", "do", "does", "is", "are", "can", "should"]
MAX_SENTENCES = 15
GATE = 0.85


def first_hits(questions: DataFrame, expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question_id, rank): the least position of an expected item in each question's list; null if there is none."""
    hits = ranked.join(expected, ["question_id", "item"], "left_semi").groupBy("question_id").agg(F.min("position").alias("rank"))
    return questions.select("question_id").join(hits, "question_id", "left")


def recall_mrr(ranks: DataFrame, k: int) -> DataFrame:
    """One row (recall, mrr) of ranks (rank): the share found among the first k, and the mean of 1 / rank; both 0 without questions."""
    found = F.col("rank") <= k
    part = lambda v: F.coalesce(F.avg(F.when(found, v).otherwise(0.0)), F.lit(0.0))
    return ranks.agg(F.round(part(F.lit(1.0)), 6).alias("recall"), F.round(part(1.0 / F.col("rank")), 6).alias("mrr"))


def bad_labels(expected: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, item): expected items that the index lacks. Such questions are not scored."""
    return expected.join(items, "item", "left_anti").select("question_id", "item")


def by_tag(ranks: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """(tag, found, total) of ranks (question_id, rank) over tags (question_id, tag)."""
    return tags.join(ranks, "question_id").groupBy("tag").agg(F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))).alias("found"), F.count(F.lit(1)).alias("total"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question_id, was, now, change, fatal) of questions in both runs whose rank differs; only found to missed is fatal."""
    both = before.withColumnRenamed("rank", "was").join(after.withColumnRenamed("rank", "now"), "question_id")
    far = F.lit(float("inf"))
    was, now = F.coalesce(F.col("was").cast("double"), far), F.coalesce(F.col("now").cast("double"), far)
    change = F.when(now < was, "better").when(now > was, "worse")
    return both.withColumn("change", change).withColumn("fatal", F.col("was").isNotNull() & F.col("now").isNull()).filter(F.col("change").isNotNull())


def kappa(graded: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agree, kappa) of two yes-or-no columns; nulls without rows, 1 where chance alone would agree."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = graded.agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("px"), F.avg(y).alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    k = F.when(F.abs(pe - 1) < 1e-12, 1.0).otherwise((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return sums.select("n", F.round("po", 6).alias("agree"), F.when(F.col("n") > 0, F.round(k, 6)).alias("kappa"))


def confusion(graded: DataFrame, a: str, b: str) -> DataFrame:
    """(key, grade, n) of the pairs that differ."""
    return graded.filter(F.col(a) != F.col(b)).groupBy(F.col(a).alias("key"), F.col(b).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def is_correct(answerable: Column, grade: Column) -> Column:
    """Of a trap, a refusal is correct too."""
    return F.when(answerable, grade == "correct").otherwise(grade.isin("correct", "refused"))


def grader_split(answers: DataFrame) -> DataFrame:
    """(grader, n, exact, agree) of answers (grade_note, answerable, grade, ai_grade): the note's prefix in brackets names the grader."""
    grader = F.when(F.col("grade_note").rlike(r"^\["), F.regexp_extract("grade_note", r"^\[([^\]]*)\]", 1)).otherwise("user")
    same = is_correct(F.col("answerable"), F.col("grade")) == is_correct(F.col("answerable"), F.col("ai_grade"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return answers.groupBy(grader.alias("grader")).agg(F.count(F.lit(1)).alias("n"), share(F.col("grade") == F.col("ai_grade")).alias("exact"), share(same).alias("agree"))


def gated(runs: DataFrame) -> DataFrame:
    """(grader, passed): whether each grader's latest run (grader, seq, agree, caught, total) is good enough."""
    last = runs.groupBy("grader").agg(F.max(F.struct("seq", "agree", "caught", "total")).alias("r"))
    return last.select("grader", ((F.col("r.agree") >= GATE) & (F.col("r.caught") >= F.col("r.total") - 1)).alias("passed"))


def answer_checks(answers: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with malformed (why, or null) and refused."""
    t = stripped(F.col(text))
    malformed = F.when(t == "", "empty").when(t.startswith(GAVE_UP), "gave up").when(t.startswith("{") & t.contains('"name"'), "tool call written as text")
    return answers.withColumn("malformed", malformed).withColumn("refused", F.col("malformed").isNull() & t.rlike(REFUSAL))


def sentences(answers: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """(ids, nth, sentence, states_no_fact) of each answer's sentences of three words or more, or its only one; 15 at most, which is the checks' own limit."""
    rows = F.filter(F.transform(F.split(F.col(text), LINE_END, -1), lambda x: stripped(F.regexp_replace(x, BULLET, ""))), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(rows, lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda x: x != "")
    words = lambda x: F.size(F.split(stripped(x), r"\s+"))
    kept = F.slice(F.filter("parts", lambda x: (words(x) >= 3) | (F.size("parts") == 1)), 1, MAX_SENTENCES)
    found = answers.select(*id_cols, parts.alias("parts")).select(*id_cols, F.posexplode(kept).alias("nth", "sentence"))
    return found.withColumn("states_no_fact", F.col("sentence").endswith(":") | (F.col("sentence").rlike(REFUSAL) & ~F.col("sentence").rlike(CLAIM_AFTER)))


def mode_of(text: Column) -> Column:
    """Whether what was typed is a question to answer or words to search for."""
    t = F.lower(stripped(text))
    words = F.split(t, r"\s+")
    asks = t.endswith("?") | (F.element_at(words, 1).isin(QUESTION_WORDS) & (F.size(words) > 2))
    return F.when((t != "") & asks, "ask").otherwise("search")


def combined_grades(checks: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, grade, min_confidence) from checks (answer_id, kind, answer, confidence) of answers (answer_id, answerable), in the order of the rules."""
    said = lambda kind, *values: F.max(F.when((F.col("kind") == kind) & F.col("answer").isin(*values), 1).otherwise(0))
    points = F.count_if(F.col("kind") == "point")
    found = checks.groupBy("answer_id").agg(
        said("malformed", "yes").alias("malformed"), said("supported", "no").alias("invented"), said("refusal", "yes").alias("refused"), said("different", "yes").alias("different"),
        points.alias("points"), F.count_if((F.col("kind") == "point") & (F.col("answer") == "yes")).alias("yes"), F.count_if((F.col("kind") == "point") & (F.col("answer") == "partly")).alias("partly"),
        said("conclusion", "yes").alias("concluded"), F.min("confidence").alias("min_confidence"),
    )
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    grade = (
        F.when(on("malformed"), "malformed").when(on("invented"), "hallucinated").when(~F.col("answerable"), F.when(on("refused"), "correct").otherwise("wrong")).when(on("refused"), "refused").when(on("different"), "wrong")
        .when(F.coalesce("yes", F.lit(0)) == F.coalesce("points", F.lit(0)), "correct").when(on("yes") | on("partly"), "partial").when(on("concluded"), "partial").otherwise("wrong")
    )
    return answers.select("answer_id", "answerable").join(found, "answer_id", "left").select("answer_id", grade.alias("grade"), "min_confidence")


def answer_summary(answers: DataFrame) -> DataFrame:
    """One row of counts and medians of answers (answerable, malformed, refused, retrieval_found, seconds, prompt_tokens, load_seconds, grade)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    trap, graded = ~F.col("answerable"), F.col("grade").isNotNull()
    wrong = yes(F.col("answerable") & graded & (F.col("grade") != "correct"))
    return answers.agg(
        F.count(F.lit(1)).alias("answered"),
        F.count_if(F.col("malformed").isNotNull()).alias("malformed"),
        F.count_if(trap).alias("traps"),
        F.count_if(yes(trap & F.col("refused"))).alias("traps_refused"),
        F.count_if(yes(F.col("answerable") & F.col("refused") & F.col("retrieval_found"))).alias("refused_despite_retrieval"),
        F.median("seconds").alias("median_seconds"),
        F.median(F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens"))).alias("median_prompt_tokens"),
        F.round(F.sum("load_seconds"), 1).alias("total_load_seconds"),
        F.count_if(graded).alias("graded"),
        F.count_if(yes(F.col("answerable") & (F.col("grade") == "correct"))).alias("correct"),
        F.count_if(yes(trap & F.col("grade").isin("refused", "correct"))).alias("traps_correct"),
        F.count_if(wrong & yes(F.col("retrieval_found"))).alias("generation_failures"),
        F.count_if(wrong & ~yes(F.col("retrieval_found"))).alias("retrieval_failures"),
    )


#: Fixed values of what a grader reads: how much of the reference and of what was shown.
REFERENCE_CHARS, CONTEXT_CHARS = 2500, 3500


def graded_source(points: Column, answerable: Column, reference: Column, context: Column) -> Column:
    """What an answer's sentences are checked against: key points if there are any, the reference if the question has an answer, and what was shown. Each part has its own limit."""
    shown = F.when(F.size(points) > 0, F.concat(F.lit("KEY POINTS:\n"), F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n")))
    held = F.when(answerable, F.concat(F.lit("REFERENCE:\n"), F.substring(F.coalesce(reference, F.lit("")), 1, REFERENCE_CHARS)))
    return F.concat_ws("\n\n", shown, held, F.concat(F.lit("WHAT THE ASSISTANT WAS SHOWN:\n"), F.substring(F.coalesce(context, F.lit("")), 1, CONTEXT_CHARS)))
