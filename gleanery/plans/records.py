"""Retrieval's modes and contexts, data sets in lines, note writes up to the file, calendars and tasks as one listing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import stems
from gleanery.functions import text as T
from gleanery.functions.vectors import cosine, hashed_words
from gleanery.operators import chunking, fusion, ingest, lexical, state, tags, vector
from gleanery.plans import notes as vault_plans
from gleanery.plans import retrieval
from gleanery.plans.registry import Registry
from gleanery.sources import jsonl, vault
from gleanery.sources.commits import Folder
from gleanery.sources.shared import shared_folder
from gleanery.sources.tables import Literal, table

R = Registry()


# retrieval


@R.query(
    f"""WITH {retrieval.LISTS_SQL},
kw_best AS (SELECT entity_id, rank FROM any_hits ORDER BY rank DESC, entity_id LIMIT 20),
near AS (SELECT position AS entity_id, score FROM scored ORDER BY score DESC, position LIMIT 20)
SELECT 'keyword' AS asked, * FROM (SELECT entity_id, rank AS score, 'keyword' AS mode FROM kw_best ORDER BY rank DESC, entity_id LIMIT 5)
UNION ALL SELECT 'hybrid, model down', * FROM (SELECT entity_id, rank, 'keyword' FROM kw_best ORDER BY rank DESC, entity_id LIMIT 5)
UNION ALL SELECT 'vector', * FROM (SELECT entity_id, score, 'vector' FROM near ORDER BY score DESC, entity_id LIMIT 5)
UNION ALL SELECT 'hybrid', * FROM (SELECT entity_id, score, 'hybrid' FROM fused ORDER BY score DESC, first LIMIT 5)"""
)
def retrieve_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each mode, and of a hybrid search whose vectors can't be had."""
    words = lexical.top(lexical.search(retrieval.index(spark, sf_dir), " ".join(retrieval.WORDS), retrieval.STOP, "any"), 20)
    near = vector.scored(retrieval.chunks(spark, sf_dir), retrieval.first_vector(spark, sf_dir)).select(F.col("position").alias("entity_id"), "score").orderBy(F.desc("score"), "entity_id").limit(20)
    asked = [("keyword", words, near, "keyword"), ("hybrid, model down", words, None, "hybrid"), ("vector", words, near, "vector"), ("hybrid", words, near, "hybrid")]
    every = [fusion.retrieved(w, n, mode).select(F.lit(name).alias("asked"), "entity_id", "score", "mode") for name, w, n, mode in asked]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@R.query(
    f"""WITH {retrieval.LISTS_SQL}, best AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, first) AS position FROM fused QUALIFY position <= 5),
hits AS (SELECT b.position, d.doc_id, d.source, d.text, d.lang = 'en' AND d.text <> '' AS whole FROM best b JOIN documents d ON d.doc_id = b.entity_id),
counted AS (SELECT *, count(*) FILTER (whole) OVER (ORDER BY position) AS nth FROM hits),
blocks AS (SELECT position, '[' || position || '] ITEM — document ' || doc_id || '  (source: ' || source || ')'
  || coalesce(chr(10) || '    ' || nullif(CASE WHEN whole AND nth <= 2 THEN text ELSE substr(text, 1, 500) END, ''), '') AS block FROM counted)
SELECT coalesce(string_agg(block, chr(10) || chr(10) ORDER BY position), 'No results found in the user''s personal system.') AS context FROM blocks"""
)
def context_whole_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best hits: English documents stand for notes, of which the first two are whole; the others are what the index keeps, 500 characters."""
    best = fusion.fused(retrieval.ranked_lists(spark, sf_dir)).orderBy(F.desc("score"), "first").limit(5)
    best = fusion.positioned(best, F.desc("score"), F.col("first"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entity_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "source", (F.col("lang") == "en").alias("is_note"), F.substring("text", 1, T.INDEX_EXCERPT_CHARS).alias("excerpt"), F.col("text").alias("body"), F.lit(None).cast("timestamp").alias("modified_at")
    )
    return fusion.rendered(fusion.with_contents(docs.join(F.broadcast(best), "entity_id")))


@R.query()
def context_best_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, context): the chunk of each of the five best hits that is closest to the question, and three of the first hit in the order of the document.

    Hashed words stand for a model's vectors. No SQL: chunks have none.
    """
    best = fusion.positioned(fusion.fused(retrieval.ranked_lists(spark, sf_dir)).orderBy(F.desc("score"), "first").limit(5), F.desc("score"), F.col("first"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("body"))
    hits = docs.join(F.broadcast(best.withColumnRenamed("entity_id", "note_id")), "note_id")
    question = hashed_words(F.array(*(F.lit(w) for w in retrieval.WORDS)))
    parts = chunking.chunks(hits.select("note_id", "body")).join(F.broadcast(best.withColumnsRenamed({"entity_id": "note_id", "position": "hit"})), "note_id")
    scored = parts.withColumn("score", F.round(cosine(hashed_words(lexical.lexemes(F.col("text"))), question), 6))
    first = Window.partitionBy("note_id").orderBy(F.desc_nulls_last("score"), "position")
    kept = scored.withColumn("nth", F.row_number().over(first)).filter((F.col("nth") == 1) | (F.col("hit") == 1) & (F.col("nth") <= 3))
    shown = kept.select("note_id", F.struct("position", fusion.chunk_rendered(F.col("path"), F.col("text")).alias("text")).alias("c"))
    return shown.groupBy(F.col("note_id").alias("entity_id")).agg(F.sort_array(F.collect_list("c")).alias("c")).select("entity_id", F.array_join("c.text", "\n\n").alias("context"))


@R.query(
    f"""WITH {retrieval.ANY_SQL}, lengths AS (SELECT entity_id, count(*) AS n FROM postings GROUP BY entity_id), flags(flag) AS (VALUES (0), (1), (2), (32)),
ranked AS (SELECT flag, h.entity_id, round(CASE flag WHEN 1 THEN rank / (1 + ln(n)) WHEN 2 THEN rank / n WHEN 32 THEN rank / (rank + 1) ELSE rank END, 6) AS rank FROM any_hits h JOIN lengths USING (entity_id), flags)
SELECT flag::INTEGER AS flag, entity_id, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY flag ORDER BY rank DESC, entity_id) <= 20"""
)
def kw_length_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best by each way to allow for the length, in words that the index keeps."""
    index = retrieval.index(spark, sf_dir)
    hits = lexical.search(index, " ".join(retrieval.WORDS), retrieval.STOP, "any").withColumn("rank", F.round("rank", 6))
    sized = hits.join(index.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id")
    rank = {f: F.round(lexical.length_normalised(F.col("rank"), F.col("n"), f), 6) for f in (0, 1, 2, 32)}
    each = sized.select("entity_id", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), c.alias("rank")) for f, c in rank.items()))).alias("r")).select("entity_id", "r.*")
    best = Window.partitionBy("flag").orderBy(F.desc("rank"), "entity_id")
    return each.withColumn("nth", F.row_number().over(best)).filter("nth <= 20").select("flag", "entity_id", "rank")


def english(items: DataFrame) -> DataFrame:
    """Postings of stems, found text by text; each distinct word of a batch is stemmed once."""
    return lexical.postings(items, stems.STOP_WORDS, stems.stemmed_all)


@R.query()
def kw_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best for words in other forms than the texts have, over an index of English stems. No SQL: it has no stemmer."""
    index = retrieval.index(spark, sf_dir, "lists-english", lambda own: lexical.lists(own, stems.STOP_WORDS, stems.known))
    return lexical.top(lexical.search(index, "licensing the tokens", stems.STOP_WORDS, "any", stem=stems.stem), 50)


@R.query(f"WITH {vault_plans.SECTIONS_SQL} SELECT note_id, section::BIGINT AS section, coalesce('[' || path || ']' || chr(10), '') || text AS shown FROM parts LEFT JOIN paths USING (note_id, section) WHERE text <> ''")
def chunk_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunking.sections(vault_plans.MARKDOWN.df(spark))
    return own.select("note_id", "section", fusion.chunk_rendered(F.col("path"), F.col("text")).alias("shown"))


@R.query(
    """WITH spelled AS (SELECT vec_id, 'tag-' || label AS tag FROM embeddings), known AS (SELECT 'tag-' || label AS "similar", label AS nth, min_by(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY label),
wanted AS (SELECT 'new' || vec_id AS tag, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 = 0),
meant AS (SELECT tag, "similar", round(list_cosine_similarity(w.v, k.v), 6) AS score FROM wanted w, known k QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, "similar" DESC) = 1),
near AS (SELECT * FROM meant WHERE score >= 0.68)
SELECT w.tag, n."similar", round(n.score, 2) AS score, CASE WHEN n.tag IS NOT NULL THEN 'meaning' END AS "by", true AS checked_meaning FROM wanted w LEFT JOIN near n USING (tag)"""
)
def tag_similar_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector is a wanted tag's, each label's first a known one's. These spellings are never alike; a test has those that are."""
    vectors = table(spark, sf_dir, "embeddings")
    known = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("known_vector")).select(F.concat(F.lit("tag-"), F.col("label").cast("string")).alias("similar"), F.col("label").alias("nth"), "known_vector")
    return tags.similar_existing(vectors.filter("vec_id % 3 = 0").select(F.concat(F.lit("new"), F.col("vec_id").cast("string")).alias("tag"), F.col("embedding").alias("vector")), known)


# tables


@R.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def pk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key; the scan's statistics prune the rest."""
    return table(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@R.query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 AND event_type = 'click'")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id = 7 AND event_type = 'click'").select("event_id", "user_id", "event_type")


#: The tables of the SQL; the query lists what is there.
CATALOG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n_rows FROM {t}" for t in CATALOG))
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the folder has, with their numbers of rows; counting reads no column."""
    out = spark.createDataFrame([], "name string, n_rows long")
    for name in sorted(n.removesuffix(".parquet") for n in Folder(spark, sf_dir).names() if n.endswith(".parquet")):
        out = out.unionByName(table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows"))
    return out


@R.query(
    """WITH left_items AS (SELECT doc_id FROM documents WHERE source <> 'src3')
SELECT 'item' AS kind, doc_id AS entity_id FROM left_items UNION ALL SELECT 'chunk', vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM left_items)"""
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of one source are gone: their items go, and the items' chunks."""
    docs = table(spark, sf_dir, "documents")
    items, chunks = ingest.cascaded(docs.filter("source <> 'src3'").select(F.col("doc_id").alias("id")), docs.select(F.col("doc_id").alias("entity_id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id")))
    return items.select(F.lit("item").alias("kind"), "entity_id").unionByName(chunks.select(F.lit("chunk").alias("kind"), "entity_id"))


@R.query(
    """SELECT label AS entity_id, vec_id AS position, round(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 5) AS first, CASE WHEN label = 3 THEN 'new' ELSE 'old' END AS embedder FROM embeddings"""
)
def embedding_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item's chunks get the vectors of another embedder; a vector for a chunk that isn't there changes nothing."""
    chunks = table(spark, sf_dir, "embeddings").select(F.col("label").alias("entity_id"), F.col("vec_id").alias("position"), "embedding", F.lit("old").alias("embedder"))
    fresh = chunks.filter("entity_id = 3").select("entity_id", "position", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit("new").alias("embedder"))
    nowhere = fresh.limit(1).withColumn("position", F.lit(-1).cast("long"))
    out = vector.updated(chunks, fresh.unionByName(nowhere))
    return out.select("entity_id", "position", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), "embedder")


LINES = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@R.query("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE lang <> 'es' OR source <> 'src7'")
def jsonl_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines: written, appended to, written anew without some rows, and scanned."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    jsonl.append(docs.filter("lang = 'en'"), f"{folder}/first")
    jsonl.append(docs.filter("lang <> 'en'"), f"{folder}/first")
    jsonl.rewritten(jsonl.scan(spark, f"{folder}/first", LINES).filter("lang <> 'es' OR source <> 'src7'"), f"{folder}/data")
    return jsonl.current(spark, f"{folder}/data", LINES)


# notes and their writes

HEADED = Literal(
    "headed",
    "path string, modified_at timestamp, text string",
    [
        ("a.md", None, "---\ntags: [x, 'y z']\n---\nText #in/line"),
        ("b.md", None, "---\ntags:\n- One\n- two\n---\nbody"),
        ("c.md", None, "no head #tag\n---\ntags: [z]\n---\n"),
        ("d.md", None, "---\nnever ends #t"),
        ("e.md", None, ""),
        ("f.md", None, "---\nproject: p\ntag: solo\n---\n\nrest"),
    ],
)


@R.query(
    f"""WITH {HEADED.sql()}, cut AS (SELECT path, text, starts_with(text, '---' || chr(10)) AND contains(substr(text, 4), chr(10) || '---') AS headed FROM headed),
parts AS (SELECT path, CASE WHEN headed THEN regexp_extract(text, '(?s)^---\\n(.*?)\\n---', 1) ELSE '' END AS head, CASE WHEN headed THEN regexp_replace(text, '(?s)^---\\n.*?\\n---\\n*', '') ELSE text END AS body FROM cut),
found AS (SELECT path, body, list_concat(string_split(regexp_extract(head, '(?m)^tags?: \\[(.*)\\]$', 1), ','), regexp_extract_all(head, '(?m)^- (.*)$', 1), [regexp_extract(head, '(?m)^tags?: ([^\\[].*)$', 1)], regexp_extract_all(body, '(?:^|\\s)#([A-Za-z][A-Za-z0-9_/-]*)', 1)) AS raw FROM parts)
SELECT path, array_to_string(list_sort(list_distinct(list_filter(list_transform(raw, lambda x: trim(x, ' ''"')), lambda x: x <> ''))), ',') AS tags, body FROM found"""
)
def note_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields at the head of a note, and what is body."""
    return vault.parsed(HEADED.df(spark)).select("path", F.array_join("tags", ",").alias("tags"), "body")


#: Heads of seven kinds, by the remainder of an id: what each is, and its tags. The fourth is bad YAML, the fifth no mapping; the seventh is no head.
HEADS = [
    ("title: 'It''s: one'\ntags: [SRC, 'a, b', \"c\\u0021\"]", ["SRC", "a, b", "c!"]),
    ("tags:\n  - SRC\n  - two words # a remark\nmore:\n  tags: [deep]", ["SRC", "two words"]),
    ("tags: 'x, #y'\nlist:\n- {a: 1}", ["x", "y"]),
    ("tags: [one", None),
    ("- tags\n- two", []),
    ("note: |\n  tags: [no]\n\n  more\ntags:\ntag: solo", ["solo"]),
    (None, []),
]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


HEADED_SQL = f"""
WITH own AS (SELECT doc_id, coalesce(source, '') AS src, coalesce(text, '') AS said, doc_id % 7 AS k FROM documents WHERE doc_id IS NOT NULL),
cut AS (SELECT doc_id, CASE WHEN k = 6 THEN said WHEN k = 3 THEN {_sql_text("---" + chr(10) + "tags: [one" + chr(10) + "---" + chr(10) + chr(10))} || said ELSE ltrim(said, chr(10)) END AS text,
  CASE k {" ".join(f"WHEN {k} THEN [{', '.join('src' if t == 'SRC' else _sql_text(t) for t in tags)}]::VARCHAR[]" for k, (_, tags) in enumerate(HEADS) if tags is not None)} ELSE []::VARCHAR[] END AS head FROM own)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(head, regexp_extract_all({vault_plans.NO_CODE.replace("body", "text")}, '(?:^|\\s)#([A-Za-z][A-Za-z0-9_/-]*)', 1)))), ',') AS tags, sha256(text) AS body_sha256 FROM cut
"""


@R.query(HEADED_SQL)
def note_heads_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes under heads of seven kinds: tags of head and text, and what is body."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.coalesce("text", F.lit("")).alias("said"))
    text = F.col("said")
    for k, (head, _) in enumerate(HEADS):
        if head is not None:
            text = F.when(F.col("doc_id") % len(HEADS) == k, F.concat(F.lit("---\n"), F.replace(F.lit(head), F.lit("SRC"), F.col("src")), F.lit("\n---\n\n"), F.col("said"))).otherwise(text)
    notes = docs.select(F.col("doc_id").alias("path"), F.lit(None).cast("timestamp").alias("modified_at"), text.alias("text"))
    return vault.parsed(notes).select(F.col("path").alias("doc_id"), F.array_join("tags", ",").alias("tags"), F.sha2("body", 256).alias("body_sha256"))


DRAFTS = Literal(
    "drafts",
    "nth int, path string, body string",
    [(101, "Life/New Reader.md", "Two homes: [[Harbor Map]] and [[Lantern Project]]"), (102, "Life/Fine.md", "Just [[Some Note]]"), (103, "Life/Records.md", "See [[ADR-001 storage]]"), (6, "Life/Fixed Page.md", "Only [[Harbor Map]] now")],
)
#: The rules' SQL over the vault with the drafts in it; its first three findings are about links of one note.
WRITE_SQL = (
    vault_plans.RULES_SQL.split("\nSELECT rule, source, target FROM judged")[0].replace(vault_plans.NOTES.sql(), f"{DRAFTS.sql()}, {vault_plans.NOTES.sql().replace('notes(', 'saved(', 1)}, notes AS (SELECT * FROM saved WHERE path NOT IN (SELECT path FROM drafts) UNION ALL SELECT * FROM drafts)")
    + ", broken AS (SELECT rule, source, target FROM judged WHERE rule <> 'to-project' UNION ALL SELECT 'many-projects', source, NULL FROM judged WHERE rule = 'to-project' GROUP BY source HAVING count(*) > 1)"
)


@R.query(f"WITH {WRITE_SQL} SELECT source AS path, rule, target FROM broken WHERE source IN (SELECT path FROM drafts)")
def write_links_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on links that drafts would break, judged as if they were saved."""
    return state.illegal_links(vault_plans.notes(spark), DRAFTS.df(spark), vault_plans.RULES)


@R.query(
    """SELECT event_id::VARCHAR AS path, CASE WHEN event_id % 5 = 0 THEN 'no longer there' WHEN event_id % 4 IN (0, 1, 2) THEN NULL ELSE 'changed since it was read' END AS refusal FROM events"""
)
def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes, read half a millisecond to one and a half ago; each fifth has gone since."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), "event_id", F.col("ts").cast("timestamp").alias("modified_at"))
    read = e.select("path", (F.col("modified_at") - F.expr("make_interval(0, 0, 0, 0, 0, 0, (event_id % 4) * 0.0005)")).alias("base_modified_at"))
    return state.unchanged_since(e.filter("event_id % 5 <> 0"), read)


TO_WRITE = Literal(
    "to_write",
    "path string, type string, project string, status string, repos array<string>, topics array<string>, body string",
    [
        ("a.md", "note", "Harbor Map", None, None, ["x", "note"], "  Body\n"),
        ("b.md", "project", "ignored", 'say "hi"', ["o/r", "o/s"], None, "B"),
        ("c.md", "plan", None, None, None, ["b", "a", "b"], "é\n\n"),
        ("d.md", "project", None, "", [], [], ""),
        ("e.md", "adr", "A \\ B", None, None, [], "x"),
    ],
)


@R.query(
    f"""WITH {TO_WRITE.sql()}, topped AS (SELECT *, list_concat([type], coalesce(topics, [])) AS raw FROM to_write),
deduped AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS all_tags FROM topped)
SELECT path, '---' || chr(10) || concat_ws(chr(10), CASE WHEN type = 'project' THEN 'type: project' END, CASE WHEN type = 'project' AND status <> '' THEN 'status: ' || to_json(status)::VARCHAR END,
  CASE WHEN type = 'project' AND len(repos) > 0 THEN 'repos:' || chr(10) || array_to_string(list_transform(repos, lambda r: '  - ' || to_json(r)::VARCHAR), chr(10)) END,
  CASE WHEN type <> 'project' AND project <> '' THEN 'project: ' || to_json('[[' || project || ']]')::VARCHAR END,
  'tags: [' || array_to_string(all_tags, ', ') || ']') || chr(10) || '---' || chr(10) || chr(10) || trim(body, ' ' || chr(10)) || chr(10) AS content FROM deduped"""
)
def note_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.composed(TO_WRITE.df(spark))


# calendars and tasks

CALENDARS = Literal("calendars", "calendar_id string, summary string, selected boolean", [("c1", "Home", True), ("c2", "Work", True), ("c3", "Sports", False), ("c4", "Feed", None)])
CALENDAR_EVENTS = Literal(
    "calendar_events",
    "calendar_id string, id string, title string, date_time string, date string, status string",
    [
        ("c1", "1", "Dinner", "2024-01-02T19:00:00+01:00", None, "confirmed"),
        ("c1", "2", "Holiday", None, "2024-01-02", None),
        ("c2", "3", None, "2024-01-02T17:30:00Z", None, None),
        ("c2", "4", "Off", "2024-01-01T09:00:00Z", None, "cancelled"),
        ("c2", "5", "Naive", "2024-01-02T18:00:00", None, None),
        ("c3", "6", "Game", "2024-01-02T20:00:00Z", None, None),
        ("c4", "7", "News", None, "2024-01-03", None),
    ],
)


@R.query(
    f"""WITH {CALENDARS.sql()}, {CALENDAR_EVENTS.sql()}, timed AS (SELECT c.calendar_id, summary AS calendar_name, id AS provider_id, coalesce(title, '(untitled)') AS title,
  CASE WHEN date_time IS NULL THEN date::TIMESTAMP WHEN regexp_matches(date_time, '(Z|[+-]\\d\\d:\\d\\d)$') THEN (date_time::TIMESTAMPTZ AT TIME ZONE 'UTC')::TIMESTAMP ELSE date_time::TIMESTAMP END AS start, date_time IS NULL AS all_day
  FROM calendar_events e JOIN calendars c USING (calendar_id) WHERE selected AND status IS DISTINCT FROM 'cancelled')
SELECT row_number() OVER (ORDER BY start, calendar_name, provider_id)::INTEGER AS nth, calendar_name, provider_id, title, start, all_day FROM timed"""
)
def calendar_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all calendars that are switched on, the earliest first."""
    merged = ingest.calendars_merged(CALENDARS.df(spark), CALENDAR_EVENTS.df(spark))
    return merged.withColumn("nth", F.row_number().over(Window.orderBy("start", "calendar_name", "provider_id")))


@R.query(
    """SELECT o_custkey || '/' || o_orderkey AS provider_id, o_custkey::VARCHAR AS list_id, o_orderkey::VARCHAR AS task_id, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS due FROM orders"""
)
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks on their customers' lists: one id of both, taken apart again, and the day that is due."""
    own = table(spark, sf_dir, "orders").select(state.task_id(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("provider_id"), "o_orderdate")
    list_id, task = state.task_id_parts(F.col("provider_id"))
    return own.select("provider_id", list_id.alias("list_id"), task.alias("task_id"), state.due_text(F.col("o_orderdate")).alias("due"))


# text operators over whole documents

DOC_NO_CODE = vault_plans.NO_CODE.replace("body", "text")


@R.query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({DOC_NO_CODE}, '(?:^|\\s)#([A-Za-z][A-Za-z0-9_/-]*)', 1))), ',') AS tags FROM documents")
def inline_tags_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.inline_tags(F.coalesce("text", F.lit(""))), ",").alias("tags"))


@R.query(f"WITH raw AS (SELECT doc_id, unnest(regexp_extract_all({DOC_NO_CODE}, '(?:^|\\s)#([A-Za-z][A-Za-z0-9_/-]*)', 1)) AS tag FROM documents), own AS (SELECT {vault_plans.TAG_SQL} AS tag FROM (SELECT DISTINCT doc_id, tag FROM raw)) SELECT tag, count(*)::BIGINT AS notes FROM own WHERE tag <> '' GROUP BY tag")
def tag_histogram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.histogram(table(spark, sf_dir, "documents").select(T.inline_tags(F.coalesce("text", F.lit(""))).alias("tags")))


@R.query("SELECT page_id, md5(url) AS url_key, length(html)::INTEGER AS n FROM pages WHERE url IS NOT NULL")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", F.md5("url").alias("url_key"), F.length("html").alias("n"))
