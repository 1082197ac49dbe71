"""Measures of retrieval and answers, over labels, documents and conversations, and over small runs given row by row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import checks
from gleanery.operators import evaluation as E
from gleanery.operators.evaluation import REFUSAL
from gleanery.plans.registry import Registry
from gleanery.sources.shared import shared_folder
from gleanery.sources.tables import Literal, table

R = Registry()
#: Tasks that the documents of one question are dealt to.
SALTS = 64
QUESTIONS = Literal("questions", "question_id string, tag string", [("q1", "a"), ("q1", "b"), ("q2", "a"), ("q3", "b"), ("q4", "c"), ("q5", "c")])
EXPECTED = Literal("expected", "question_id string, item string", [("q1", "n1"), ("q1", "n9"), ("q2", "n2"), ("q3", "n3"), ("q4", "gone"), ("q5", "n5")])
RANKED = Literal("ranked", "question_id string, position int, item string", [("q1", 1, "n7"), ("q1", 2, "n1"), ("q1", 3, "n9"), ("q2", 1, "n2"), ("q3", 1, "n1"), ("q3", 6, "n3"), ("q5", 1, "n4")])
ITEMS = Literal("items", "item string", [("n1",), ("n2",), ("n3",), ("n4",), ("n5",), ("n7",), ("n9",)])
RANKS_SQL = f"""{QUESTIONS.sql()}, {EXPECTED.sql()}, {RANKED.sql()}, {ITEMS.sql()},
ranks AS (SELECT q.question_id, min(r.position) AS rank FROM (SELECT DISTINCT question_id FROM questions) q LEFT JOIN (SELECT r.* FROM ranked r JOIN expected e ON e.question_id = r.question_id AND e.item = r.item) r ON r.question_id = q.question_id GROUP BY 1)"""


def ranks(spark: SparkSession) -> DataFrame:
    return E.first_hits(QUESTIONS.df(spark).select("question_id").distinct(), EXPECTED.df(spark), RANKED.df(spark))


@R.query(f"WITH {RANKS_SQL} SELECT * FROM ranks")
def eval_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(spark)


@R.query(f"WITH {RANKS_SQL} SELECT round(coalesce(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 0), 6)::DOUBLE AS recall, round(coalesce(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 0), 6)::DOUBLE AS mrr FROM ranks")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall_mrr(ranks(spark), 5)


@R.query(
    """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS position, doc_id FROM documents),
h AS (SELECT lang, min(position) AS rank FROM r JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang)
SELECT round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6)::DOUBLE AS mrr FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN h USING (lang)"""
)
def eval_recall_mrr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as questions: documents ranked by length, toxic ones expected. The rank is one more than the number of longer documents, so no language's list is sorted in one task."""
    docs = table(spark, sf_dir, "documents")
    expected = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    key = F.struct((-F.col("n_chars")).alias("less"), "doc_id")
    first = docs.join(expected, "doc_id", "left_semi").groupBy("lang").agg(F.min(key).alias("first"))
    ahead = docs.withColumn("key", key).join(F.broadcast(first), "lang").groupBy("lang").agg((F.count_if(F.col("key") < F.col("first")) + 1).alias("rank"))
    found = docs.select(F.col("lang").alias("question_id")).distinct().join(ahead.withColumnRenamed("lang", "question_id"), "question_id", "left")
    return E.recall_mrr(found, 50)


@R.query(f"WITH {RANKS_SQL} SELECT question_id, item FROM expected WHERE item NOT IN (SELECT item FROM items)")
def eval_bad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bad_labels(EXPECTED.df(spark), ITEMS.df(spark))


@R.query(f"WITH {RANKS_SQL} SELECT tag, count(*) FILTER (rank <= 5)::BIGINT AS found, count(*)::BIGINT AS total FROM questions JOIN ranks USING (question_id) GROUP BY tag")
def eval_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_tag(ranks(spark), QUESTIONS.df(spark), 5)


@R.query(
    """WITH d AS (SELECT lang || '/' || source AS question_id, lang, source, doc_id, n_chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
r AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY n_chars DESC, doc_id) AS position, doc_id FROM d),
h AS (SELECT question_id, min(position) AS rank FROM r WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY question_id),
t AS (SELECT question_id, lang AS tag FROM d UNION SELECT question_id, source FROM d)
SELECT tag, count(*) FILTER (rank <= 5)::BIGINT AS found, count(*)::BIGINT AS total FROM t LEFT JOIN h USING (question_id) GROUP BY tag"""
)
def eval_by_tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of language and source as questions, tagged with both: documents ranked by length, toxic ones expected. Ranks are counted as in ``eval_recall_mrr_documents``."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").withColumn("question_id", F.concat_ws("/", "lang", "source"))
    expected = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    key = F.struct((-F.col("n_chars")).alias("less"), "doc_id")
    first = docs.join(expected, "doc_id", "left_semi").groupBy("question_id").agg(F.min(key).alias("first"))
    # one pair may hold a third of all documents: they are dealt to several tasks, each of which gets the pair's first hit
    dealt = docs.select("question_id", key.alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    each = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ahead = dealt.join(each, ["question_id", "salt"]).groupBy("question_id").agg((F.count_if(F.col("key") < F.col("first")) + 1).alias("rank"))
    tags = docs.select("question_id", F.explode(F.array("lang", "source")).alias("tag")).distinct()
    return E.by_tag(tags.select("question_id").distinct().join(ahead, "question_id", "left"), tags, 5)


BEFORE = Literal("before", "question_id string, rank int", [("q1", 1), ("q2", None), ("q3", 2), ("q4", 3), ("q6", 1)])
AFTER = Literal("after", "question_id string, rank int", [("q1", 1), ("q2", 4), ("q3", 5), ("q4", None), ("q7", 1)])


@R.query(
    f"""WITH {BEFORE.sql()}, {AFTER.sql()}
SELECT question_id, b.rank AS was, a.rank AS now, CASE WHEN coalesce(a.rank, 1e9) < coalesce(b.rank, 1e9) THEN 'better' ELSE 'worse' END AS change, b.rank IS NOT NULL AND a.rank IS NULL AS fatal
FROM before b JOIN after a USING (question_id) WHERE coalesce(a.rank, 1e9) <> coalesce(b.rank, 1e9)"""
)
def eval_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_diff(BEFORE.df(spark), AFTER.df(spark))


@R.query(
    """WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INTEGER) AS po, avg(quality) AS px, avg(toxic) AS py FROM labels), e AS (SELECT *, px * py + (1 - px) * (1 - py) AS pe FROM s)
SELECT n::BIGINT AS n, round(po, 6) AS agree, round((po - pe) / (1 - pe), 6) AS kappa FROM e"""
)
def kappa_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels as two graders."""
    return E.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@R.query("SELECT quality AS key, toxic AS grade, count(*)::BIGINT AS n FROM labels WHERE quality <> toxic GROUP BY ALL")
def confusion_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@R.query("SELECT lang, round(avg((quality = toxic)::INTEGER), 6) AS exact, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def exact_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return own.groupBy("lang").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("double")), 6).alias("exact"), F.count(F.lit(1)).alias("n"))


ANSWERS = Literal(
    "answers",
    "answer_id string, answerable boolean, malformed string, refused boolean, retrieval_found boolean, seconds double, prompt_tokens int, load_seconds double, grade string, ai_grade string, grade_note string",
    [
        ("a1", True, None, False, True, 10.5, 1200, 0.5, "correct", "correct", "[ai] fine"),
        ("a2", True, None, True, True, 9.0, 1300, None, "refused", "partial", None),
        ("a3", True, "empty", False, False, 30.0, None, 1.0, "malformed", "malformed", "by hand"),
        ("a4", False, None, True, None, 8.0, 1100, 0.25, "refused", "correct", "[ai] ok"),
        ("a5", False, None, False, None, 7.5, 900, None, "hallucinated", "hallucinated", "[ai] invented"),
        ("a6", True, None, False, False, 12.0, 1500, None, "wrong", "correct", "[ai] other"),
        ("a7", True, None, False, True, 11.0, 1250, None, None, None, None),
    ],
)


@R.query(
    f"""WITH {ANSWERS.sql()}
SELECT count(*)::BIGINT AS answered, count(malformed)::BIGINT AS malformed, count(*) FILTER (NOT answerable)::BIGINT AS traps, count(*) FILTER (NOT answerable AND refused)::BIGINT AS traps_refused,
  count(*) FILTER (answerable AND refused AND retrieval_found)::BIGINT AS refused_despite_retrieval, median(seconds) AS median_seconds, median(prompt_tokens)::DOUBLE AS median_prompt_tokens, round(sum(load_seconds), 1) AS total_load_seconds,
  count(grade)::BIGINT AS graded, count(*) FILTER (answerable AND grade = 'correct')::BIGINT AS correct, count(*) FILTER (NOT answerable AND grade IN ('refused', 'correct'))::BIGINT AS traps_correct,
  count(*) FILTER (answerable AND grade <> 'correct' AND retrieval_found)::BIGINT AS generation_failures, count(*) FILTER (answerable AND grade <> 'correct' AND NOT retrieval_found)::BIGINT AS retrieval_failures FROM answers"""
)
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.answer_summary(ANSWERS.df(spark))


@R.query(
    f"""WITH {ANSWERS.sql()}, g AS (SELECT *, CASE WHEN regexp_matches(grade_note, '^\\[') THEN regexp_extract(grade_note, '^\\[([^\\]]*)\\]', 1) ELSE 'user' END AS grader,
  CASE WHEN answerable THEN grade = 'correct' ELSE grade IN ('correct', 'refused') END AS x, CASE WHEN answerable THEN ai_grade = 'correct' ELSE ai_grade IN ('correct', 'refused') END AS y FROM answers)
SELECT grader, count(*)::BIGINT AS n, round(avg((grade = ai_grade)::INTEGER), 6) AS exact, round(avg((x = y)::INTEGER), 6) AS agree FROM g GROUP BY grader"""
)
def grader_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.grader_split(ANSWERS.df(spark))


@R.query(f"WITH {ANSWERS.sql()}, t AS (SELECT answer_id, CASE WHEN answerable THEN grade = 'correct' ELSE grade IN ('correct', 'refused') END AS is_correct FROM answers) SELECT * FROM t")
def correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ANSWERS.df(spark).select("answer_id", E.is_correct(F.col("answerable"), F.col("grade")).alias("is_correct"))


RUNS = Literal("runs", "grader string, seq int, agree double, caught int, total int", [("g1", 1, 0.9, 10, 10), ("g1", 2, 0.8, 10, 10), ("g2", 1, 0.86, 9, 10), ("g3", 1, 0.95, 7, 10)])


@R.query(f"WITH {RUNS.sql()}, l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY grader ORDER BY seq DESC) = 1) SELECT grader, agree >= 0.85 AND caught >= total - 1 AS passed FROM l")
def grader_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gated(RUNS.df(spark))


CHECKS = Literal(
    "checks",
    "answer_id string, kind string, answer string, confidence double",
    [
        ("a1", "supported", "yes", 0.9), ("a1", "refusal", "no", 0.8), ("a1", "different", "no", 0.95), ("a1", "point", "yes", 0.7), ("a1", "point", "yes", None),
        ("a2", "refusal", "yes", 0.6), ("a3", "malformed", "yes", None), ("a4", "refusal", "yes", 0.9), ("a5", "supported", "no", 0.99),
        ("a6", "refusal", "no", 0.9), ("a6", "different", "no", 0.9), ("a6", "point", "no", 0.5), ("a6", "conclusion", "yes", 0.4),
        ("a7", "refusal", "no", 0.9), ("a7", "different", "no", 0.9), ("a7", "point", "partly", 0.55), ("a7", "point", "no", 0.65),
    ],
)


@R.query(
    f"""WITH {ANSWERS.sql()}, {CHECKS.sql()},
f AS (SELECT answer_id, bool_or(kind = 'malformed' AND answer = 'yes') AS malformed, bool_or(kind = 'supported' AND answer = 'no') AS invented, bool_or(kind = 'refusal' AND answer = 'yes') AS refused,
  bool_or(kind = 'different' AND answer = 'yes') AS different, count(*) FILTER (kind = 'point') AS points, count(*) FILTER (kind = 'point' AND answer = 'yes') AS yes, count(*) FILTER (kind = 'point' AND answer = 'partly') AS partly,
  bool_or(kind = 'conclusion' AND answer = 'yes') AS concluded, min(confidence) AS min_confidence FROM checks GROUP BY answer_id)
SELECT answer_id, CASE WHEN f.malformed THEN 'malformed' WHEN invented THEN 'hallucinated' WHEN NOT answerable THEN CASE WHEN f.refused THEN 'correct' ELSE 'wrong' END WHEN f.refused THEN 'refused' WHEN different THEN 'wrong'
  WHEN yes = points THEN 'correct' WHEN yes + partly > 0 THEN 'partial' WHEN concluded THEN 'partial' ELSE 'wrong' END AS grade, min_confidence FROM answers JOIN f USING (answer_id)"""
)
def grade_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.combined_grades(CHECKS.df(spark), ANSWERS.df(spark))


SAID = Literal("said", "answer_id int, text string", [(1, "  "), (2, "I could not settle on an answer today"), (3, '{"name": "get_note"}'), (4, "I don't have anything on that."), (5, "There is no mention of it, but RabbitMQ was chosen."), (6, "It was Redis."), (7, "Nothing about that here.")])
REFUSAL_SQL = "(?i)\\b(don''t|do not|doesn''t|does not|can''t|cannot|couldn''t|could not)\\s+(have|find|see|contain|mention|say|know)|\\bno (information|results|mention|record)|\\bnot (mentioned|in the (search )?results)|\\bnothing (on|about)"
CHECK_SQL = f"""CASE WHEN trim(text) = '' THEN 'empty' WHEN starts_with(trim(text), 'I could not settle on an answer') THEN 'gave up' WHEN starts_with(trim(text), '{{') AND contains(text, '"name"') THEN 'tool call written as text' END"""


@R.query(f"WITH {SAID.sql()}, m AS (SELECT answer_id, text, {CHECK_SQL} AS malformed FROM said) SELECT answer_id, malformed, malformed IS NULL AND regexp_matches(trim(text), '{REFUSAL_SQL}') AS refused FROM m")
def answer_checks_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.answer_checks(SAID.df(spark)).drop("text")


@R.query(f"WITH m AS (SELECT conv_id, turn, text, {CHECK_SQL} AS malformed FROM conversations) SELECT conv_id, turn, malformed, malformed IS NULL AND regexp_matches(trim(text), '{REFUSAL_SQL}') AS refused FROM m")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.answer_checks(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))).select("conv_id", "turn", "malformed", "refused")


@R.query(
    """WITH t AS (SELECT conv_id, turn, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t <> '' AND (ends_with(t, '?') OR (regexp_split_to_array(t, '\\s+')[1] IN ('why', 'what', 'how', 'when', 'where', 'who', 'which', 'did', 'do', 'does', 'is', 'are', 'can', 'should') AND len(regexp_split_to_array(t, '\\s+')) > 2)) THEN 'ask' ELSE 'search' END AS mode FROM t"""
)
def infer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.mode_of(F.coalesce("text", F.lit(""))).alias("mode"))


NOT_A_FACT = REFUSAL.removeprefix("(?i)").replace("'", "''")


@R.query(
    f"""WITH rows AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM conversations),
bare AS (SELECT conv_id, turn, n, trim(regexp_replace(line, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''), ' ' || chr(9) || chr(13)) AS line FROM rows),
cut AS (SELECT conv_id, turn, n, unnest(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, unnest(range(0, len(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))) AS k FROM bare WHERE line <> ''),
counted AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS parts FROM cut WHERE sentence <> ''),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n, k) - 1 AS nth FROM counted WHERE parts = 1 OR len(regexp_split_to_array(trim(sentence), '\\s+')) >= 3)
SELECT conv_id, turn, nth::INTEGER AS nth, sentence, ends_with(sentence, ':') OR (regexp_matches(sentence, '{NOT_A_FACT}', 'i') AND NOT regexp_matches(sentence, '\\b(but|however|although|though|instead)\\b', 'i')) AS states_no_fact FROM kept WHERE nth < 15"""
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sentences(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


REPLIES = Literal("replies", "id int, reply string", [(1, "<think>long\nthought</think>\n\nYes."), (2, "No."), (3, "<think>open")])


@R.query(f"WITH {REPLIES.sql()} SELECT id, regexp_replace(reply, '(?s)<think>.*?</think>\\s*', '', 'g') AS answer FROM replies")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.functions.text import without_thoughts

    return REPLIES.df(spark).select("id", without_thoughts(F.col("reply")).alias("answer"))


@R.query("SELECT conv_id, 'POINTS:' || chr(10) || string_agg(substr(text, 1, 2500), chr(10) || chr(10) ORDER BY turn) AS source FROM conversations WHERE role = 'user' GROUP BY conv_id")
def graded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a grader reads: the parts of each conversation, each cut to 2500 characters as the format says."""
    parts = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.substring("text", 1, 2500).alias("text")))).alias("p"))
    return parts.select("conv_id", F.concat(F.lit("POINTS:\n"), F.array_join("p.text", "\n\n")).alias("source"))


#: Turns of a part that can matter: each has two characters of line ends at least, and no part shows more than 3500.
MOST_TURNS = 1800
GRADED_SQL = """
WITH own AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, 'KEY POINTS:' || chr(10) || string_agg('- ' || substr(text, 1, 80), chr(10) ORDER BY turn) AS points FROM own WHERE role = 'user' AND turn < 2 GROUP BY conv_id),
r AS (SELECT conv_id, 'REFERENCE:' || chr(10) || substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 2500) AS reference FROM own WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id, 'WHAT THE ASSISTANT WAS SHOWN:' || chr(10) || substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 3500) AS shown FROM own GROUP BY conv_id)
SELECT c.conv_id, concat_ws(chr(10) || chr(10), points, CASE WHEN c.conv_id % 5 <> 0 THEN coalesce(reference, 'REFERENCE:' || chr(10)) END, shown) AS source FROM c LEFT JOIN p USING (conv_id) LEFT JOIN r USING (conv_id)
"""


@R.query(GRADED_SQL)
def graded_source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a grader reads of each conversation: the user's first turns as key points, the assistant's as the reference, all of them as what was shown. Each fifth has no reference."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    first = Window.partitionBy("conv_id").orderBy("turn")

    def joined(rows: DataFrame, name: str) -> DataFrame:
        kept = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= MOST_TURNS)
        return kept.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "\n\n").alias(name))

    points = turns.filter("role = 'user' AND turn < 2").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.substring("text", 1, 80).alias("text"))))["text"].alias("points"))
    records = joined(turns, "context").join(joined(turns.filter("role = 'assistant'"), "reference"), "conv_id", "left").join(points, "conv_id", "left").withColumn("answerable", F.col("conv_id") % 5 != 0)
    return records.select("conv_id", E.graded_source(F.col("points"), F.col("answerable"), F.col("reference"), F.col("context")).alias("source"))


BUDGET = 5000
CHECKS_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS p, length(coalesce(text, '')) // 4 + 1 AS cost FROM conversations),
warm AS (SELECT DISTINCT p FROM c WHERE role = 'user'),
missing AS (SELECT conv_id, turn, p, cost FROM c ANTI JOIN warm USING (p) QUALIFY row_number() OVER (PARTITION BY p ORDER BY conv_id, turn) = 1),
spent AS (SELECT conv_id AS at_conv, turn AS at_turn, p, coalesce(sum(cost) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM missing),
told AS (SELECT conv_id, turn, p, CASE WHEN before IS NULL THEN 'cached' WHEN before >= {BUDGET} THEN 'over budget' WHEN conv_id = at_conv AND turn = at_turn THEN 'called' ELSE 'shared' END AS outcome FROM c LEFT JOIN spent USING (p))
SELECT conv_id, turn, outcome, CASE WHEN outcome <> 'over budget' THEN CASE WHEN length(p) % 2 = 0 THEN 'yes' ELSE 'no' END END AS answer FROM told
"""


@R.query(CHECKS_SQL)
def checks_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a question. The users' turns were asked before; now all are, by a backend that goes by a text's length, until a budget of tokens is spent."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("prompt"))
    asked = turns.withColumns({"options": F.array(F.lit("yes"), F.lit("no")), "cost": F.expr("length(prompt) div 4 + 1")})
    store = checks.Store(spark, f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}")
    backend = lambda q: q.select("key", F.element_at("options", (F.length("prompt") % 2 + 1).cast("int")).alias("answer"), F.lit(None).cast("double").alias("confidence"))
    order = ["conv_id", "turn"]
    checks.asked(store, asked.filter("role = 'user'"), backend, "by length", "1", order)
    return checks.asked(store, asked, backend, "by length", "1", order, BUDGET).select("conv_id", "turn", "outcome", "answer")
