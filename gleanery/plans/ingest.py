"""Ingest, connectors and state views. Driver tables stand in where they have the shape; small sources are given row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import ingest, state, vector
from gleanery.plans.registry import Registry
from gleanery.sources.tables import Literal, table

R = Registry()
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click'")
def captures_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all types but one, as captures that aren't archived."""
    return table(spark, sf_dir, "events").filter("event_type <> 'click'").select("event_id", "user_id", "ts")


@R.query(f"SELECT event_id, event_type FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY AND ts <= {NOW} + INTERVAL 30 DAY AND event_type <> 'error'")
def events_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).filter((F.col("ts") >= now() - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= now() + F.expr("INTERVAL 30 DAYS")))
    return own.filter("event_type <> 'error'").select("event_id", "event_type")


@R.query(f"SELECT event_id, user_id FROM events WHERE date_diff('day', ts::DATE, {NOW}::DATE) <= 7")
def recent_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.datediff(F.to_date(now()), F.to_date("ts")) <= 7).select("event_id", "user_id")


@R.query(f"SELECT event_type, round((epoch_us({NOW}) - epoch_us(max(ts))) / 3.6e9, 6) AS hours, (epoch_us({NOW}) - epoch_us(max(ts))) / 3.6e9 >= 24 AS stale FROM events GROUP BY event_type")
def sync_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since each source's newest event."""
    newest = events(spark, sf_dir).groupBy("event_type").agg(F.max("ts").alias("completed_at"))
    hours = (F.unix_micros(now()) - F.unix_micros("completed_at")) / 3.6e9
    return newest.select("event_type", F.round(hours, 6).alias("hours"), (hours >= 24).alias("stale"))


@R.query(f"SELECT round((epoch_us({NOW}) - epoch_us(max(ts))) / 3.6e9, 6) AS hours, coalesce((epoch_us({NOW}) - epoch_us(max(ts))) / 3.6e9 >= 24, true) AS stale FROM events")
def sync_age_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sync_age(events(spark, sf_dir).select(F.col("ts").alias("completed_at")), now())


@R.query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("provider_id"), F.col("ts").alias("taken_at"), F.col("event_id").alias("id"), "event_type", F.lit(None).cast("timestamp").alias("undone_at"))
    return state.latest_snapshots(log).select(F.col("provider_id").alias("user_id"), F.col("taken_at").alias("ts"), F.col("id").alias("event_id"), "event_type")


CAPTURE_ROWS = [("a", 1, "2024-01-01 10:00:00", "route"), ("a", 2, "2024-01-02 10:00:00", "undo"), ("a", 3, "2024-01-03 10:00:00", "archive"), ("b", 1, "2024-01-01 11:00:00", "archive"), ("b", 2, "2024-01-01 12:00:00", "route"), ("c", 1, "2024-01-05 09:00:00", "undo"), ("d", 1, "2024-01-06 09:00:00", "route")]


@R.query(
    f"""WITH RECURSIVE log(id, seq, at_text, action) AS (VALUES {", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in CAPTURE_ROWS)}),
walk(id, seq, status, moved, steps) AS (
  SELECT DISTINCT id, 0, 'inbox', NULL::VARCHAR, 0::BIGINT FROM log
  UNION ALL
  SELECT w.id, l.seq,
    CASE WHEN status = 'inbox' AND action = 'route' THEN 'routed' WHEN status = 'inbox' AND action = 'archive' THEN 'archived' WHEN status = 'routed' AND action = 'undo' THEN 'inbox' ELSE status END,
    CASE WHEN (status = 'inbox' AND action IN ('route', 'archive')) OR (status = 'routed' AND action = 'undo') THEN at_text ELSE moved END,
    steps + CASE WHEN (status = 'inbox' AND action IN ('route', 'archive')) OR (status = 'routed' AND action = 'undo') THEN 1 ELSE 0 END
  FROM walk w JOIN log l ON l.id = w.id AND l.seq = w.seq + 1)
SELECT id, status, moved::TIMESTAMP AS moved_at, steps FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""
)
def capture_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.createDataFrame(CAPTURE_ROWS, "id string, seq int, at string, action string").withColumn("at", F.to_timestamp("at"))
    return state.capture_states(log).withColumnRenamed("at", "moved_at")


@R.query(
    """WITH RECURSIVE log AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS at_time,
  CASE event_type WHEN 'click' THEN 'route' WHEN 'view' THEN 'undo' WHEN 'error' THEN 'archive' ELSE event_type END AS action FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
walk(id, seq, status, moved, steps) AS (
  SELECT DISTINCT id, 0::BIGINT, 'inbox', NULL::TIMESTAMP, 0::BIGINT FROM log
  UNION ALL
  SELECT w.id, l.seq,
    CASE WHEN status = 'inbox' AND action = 'route' THEN 'routed' WHEN status = 'inbox' AND action = 'archive' THEN 'archived' WHEN status = 'routed' AND action = 'undo' THEN 'inbox' ELSE status END,
    CASE WHEN (status = 'inbox' AND action IN ('route', 'archive')) OR (status = 'routed' AND action = 'undo') THEN at_time ELSE moved END,
    steps + CASE WHEN (status = 'inbox' AND action IN ('route', 'archive')) OR (status = 'routed' AND action = 'undo') THEN 1 ELSE 0 END
  FROM walk w JOIN log l ON l.id = w.id AND l.seq = w.seq + 1)
SELECT id, status, moved AS moved_at, steps FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""
)
def capture_state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as captures: clicks route, views undo, errors archive, other events change nothing. Events without a user or a time are in no log."""
    action = F.when(F.col("event_type") == "click", "route").when(F.col("event_type") == "view", "undo").when(F.col("event_type") == "error", "archive").otherwise(F.col("event_type"))
    log = events(spark, sf_dir).filter("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), action.alias("action"))
    return state.capture_states(log).withColumnRenamed("at", "moved_at")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents as listed now and as indexed before: without those of source src3, those of src5 since edited, and some of lang es since deleted."""
    docs = table(spark, sf_dir, "documents")
    item = lambda df, text: df.select(F.col("lang").alias("provider"), F.col("doc_id").cast("string").alias("provider_id"), T.fingerprint(text).alias("fingerprint"))
    old = item(docs.filter("source <> 'src3'"), F.when(F.col("source") == "src5", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = item(docs.filter("NOT (lang = 'es' AND source = 'src7') AND NOT (lang = 'de' AND source = 'src8')"), F.col("text"))
    return new, old


SNAPSHOT_SQL = """old AS (SELECT lang AS provider, doc_id::VARCHAR AS provider_id, sha256('v6' || chr(10) || CASE WHEN source = 'src5' THEN text || '!' ELSE text END) AS fingerprint FROM documents WHERE source <> 'src3'),
new AS (SELECT lang AS provider, doc_id::VARCHAR AS provider_id, sha256('v6' || chr(10) || text) AS fingerprint FROM documents WHERE NOT (lang = 'es' AND source = 'src7') AND NOT (lang = 'de' AND source = 'src8')),
changes AS (SELECT coalesce(n.provider, o.provider) AS provider, coalesce(n.provider_id, o.provider_id) AS provider_id,
  CASE WHEN o.fingerprint IS NULL THEN 'new' WHEN n.fingerprint IS NULL THEN 'missing' WHEN n.fingerprint <> o.fingerprint THEN 'changed' ELSE 'unchanged' END AS change
  FROM new n FULL JOIN old o ON n.provider = o.provider AND n.provider_id = o.provider_id)"""


@R.query(f"WITH {SNAPSHOT_SQL} SELECT * FROM changes")
def ingest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classified(*snapshots(spark, sf_dir))


@R.query(
    f"""WITH {SNAPSHOT_SQL}
SELECT provider, count(*) FILTER (change <> 'missing')::BIGINT AS seen, count(*) FILTER (change IN ('new', 'changed'))::BIGINT AS indexed, count(*) FILTER (change = 'unchanged')::BIGINT AS skipped,
  CASE WHEN provider IN ('en', 'es') AND count(*) FILTER (change <> 'missing') > 0 THEN count(*) FILTER (change = 'missing') ELSE 0 END::BIGINT AS removed FROM changes GROUP BY provider"""
)
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stats(ingest.classified(*snapshots(spark, sf_dir)), ["en", "es"])


@R.query(
    f"""WITH {SNAPSHOT_SQL}, n AS (SELECT provider, count(*) AS n FROM changes WHERE change <> 'missing' GROUP BY provider),
waiting AS (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))
SELECT concat_ws(' · ', coalesce((SELECT n FROM n WHERE provider = 'en'), 0) || ' English', coalesce((SELECT n FROM n WHERE provider = 'fr'), 0) || ' French', coalesce((SELECT n FROM n WHERE provider = 'xx'), 0) || ' others',
  CASE WHEN n > 0 THEN n || ' not yet embedded' END) || ' — failed: es, de' AS status FROM waiting"""
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line on the last ingest: totals of some sources, documents without a vector, sources that failed."""
    counts = ingest.stats(ingest.classified(*snapshots(spark, sf_dir)), ["en", "es"])
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).distinct()
    waiting = table(spark, sf_dir, "documents").join(chunks, "doc_id", "left_anti").count()
    return ingest.status_line(counts, {"en": "English", "fr": "French", "xx": "others"}, F.lit(waiting), ["es", "de"])


@R.query(f"WITH {SNAPSHOT_SQL} SELECT o.* FROM old o WHERE provider NOT IN ('en', 'es') OR EXISTS (SELECT 1 FROM new n WHERE n.provider = o.provider AND n.provider_id = o.provider_id)")
def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = snapshots(spark, sf_dir)
    return ingest.pruned(old, new, ["en", "es"])


@R.query(
    f"""WITH {SNAPSHOT_SQL}
SELECT n.* FROM new n UNION ALL SELECT o.* FROM old o WHERE provider NOT IN ('en', 'es') AND NOT EXISTS (SELECT 1 FROM new n WHERE n.provider = o.provider AND n.provider_id = o.provider_id)"""
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = snapshots(spark, sf_dir)
    return ingest.merged(old, new, ["en", "es"])


@R.query("SELECT doc_id, sha256('v6' || chr(10) || text) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@R.query("SELECT doc_id, substr(text, 1, 200) AS title, substr(text, 1, 500) AS excerpt FROM documents")
def index_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, T.TITLE_CHARS).alias("title"), F.substring("text", 1, T.INDEX_EXCERPT_CHARS).alias("excerpt"))


@R.query("SELECT doc_id, CASE WHEN substr(string_split(text, chr(10))[1], 1, 80) = '' THEN '(empty)' ELSE substr(string_split(text, chr(10))[1], 1, 80) END AS title FROM documents")
def capture_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_line_title(F.col("text")).alias("title"))


@R.query("SELECT doc_id, concat_ws(' · ', nullif(lang, 'en'), nullif(source, ''), n_chars::VARCHAR) AS excerpt FROM documents")
def parts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.joined_parts(F.nullif("lang", F.lit("en")), F.col("source"), F.col("n_chars").cast("string")).alias("excerpt"))


@R.query("SELECT label AS entity_id, vec_id AS position FROM embeddings WHERE label IN (2, 4) OR CASE WHEN label = 6 THEN NULL WHEN label = 8 THEN 'old' ELSE 'm|d|none' END IS DISTINCT FROM 'm|d|none'")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels' chunks lack a vector, some have no embedder, some another one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("entity_id"), F.col("vec_id").alias("position"), F.when(~F.col("label").isin(2, 4), F.col("embedding")).alias("embedding"))
    e = e.withColumn("embedder", F.when(F.col("entity_id") == 8, "old").when(F.col("entity_id") != 6, vector.embedder_signature("m", "d", "none")))
    return vector.pending(e, "m|d|none").select("entity_id", "position")


@R.query("SELECT doc_id AS entity_id, 0 AS position, trim(source || chr(10) || substr(text, 1, 500)) AS text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def backfill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the excerpts that the index keeps, 500 characters; ``backfill_whole`` has the whole texts."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("source").alias("title"), F.substring("text", 1, T.INDEX_EXCERPT_CHARS).alias("excerpt"))
    return ingest.backfilled(items, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id")))


@R.query("SELECT doc_id AS entity_id, 0 AS position, trim(coalesce(source, '') || chr(10) || coalesce(text, '')) AS text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def backfill_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk of source and whole text for every document without a chunk. The reference stores 500 characters of it, as its index keeps no more; here the text is at hand."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("source").alias("title"), F.col("text").alias("excerpt"))
    return ingest.backfilled(items, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id")))


@R.query("SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id) WHERE (l.quality, l.toxic) IN ((0, 1), (1, 1))")
def row_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, 1), (1, 1)], "quality int, toxic int")
    own = table(spark, sf_dir, "labels").join(F.broadcast(wanted), ["quality", "toxic"], "left_semi")
    return own.join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source")


@R.query("SELECT doc_id, lang FROM documents WHERE ('fr' IS NULL OR lang = 'fr') AND n_chars > 100")
def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted: str | None = "fr"
    docs = table(spark, sf_dir, "documents")
    return (docs if wanted is None else docs.filter(F.col("lang") == wanted)).filter("n_chars > 100").select("doc_id", "lang")


@R.query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one state, newest first, 200 of them."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)


@R.query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def late_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with what the dimension says of them; unknown ids drop out."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").select("c_custkey", "n_name")


LISTS = Literal("lists", "list_id string, list_name string", [("l1", "Home"), ("l2", "Work"), ("l3", "Empty")])
TASKS = Literal(
    "tasks",
    "list_id string, task_id string, parent_id string, title string, position int, completed boolean, deleted boolean, hidden boolean",
    [
        ("l1", "t1", None, "Paint", 1, False, False, False),
        ("l1", "t2", "t1", "Buy brush", 2, False, False, False),
        ("l1", "t3", "t1", "Buy paint", 1, True, False, False),
        ("l2", "t4", None, "Report", 1, True, False, False),
        ("l2", "t5", None, "Mail", 2, False, True, False),
        ("l2", "t6", None, "Call", 3, False, False, True),
        ("l2", "t7", None, "Plan", 4, False, False, False),
    ],
)


@R.query(f"WITH {LISTS.sql()}, {TASKS.sql()} SELECT list_id, list_name, task_id, title FROM tasks JOIN lists USING (list_id) WHERE NOT completed AND NOT deleted AND NOT hidden")
def tasks_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.open_tasks(LISTS.df(spark), TASKS.df(spark))


@R.query(f"WITH {LISTS.sql()}, {TASKS.sql()} SELECT list_id, list_name, count(task_id) FILTER (NOT completed)::BIGINT AS open FROM lists LEFT JOIN tasks USING (list_id) GROUP BY ALL")
def task_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.list_counts(LISTS.df(spark), TASKS.df(spark))


@R.query(
    f"""WITH {TASKS.sql()}, c AS (SELECT parent_id, string_agg(title, '; ' ORDER BY position) AS children FROM tasks WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT t.task_id, t.title, coalesce(children, '') AS children FROM tasks t LEFT JOIN c ON c.parent_id = t.task_id WHERE t.parent_id IS NULL AND NOT t.completed"""
)
def task_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = TASKS.df(spark)
    return state.task_tree(every.filter(~F.col("completed")), every).withColumn("children", F.array_join("children", "; "))


@R.query(
    """WITH c AS (SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS children FROM nation GROUP BY n_regionkey)
SELECT r_regionkey AS region, r_name AS title, children FROM region LEFT JOIN c ON n_regionkey = r_regionkey"""
)
def region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("task_id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("title"))
    every = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("title"))
    return state.task_tree(shown, every).select(F.col("task_id").alias("region"), "title", F.array_join("children", "; ").alias("children"))


ACTIVITY = Literal(
    "raw",
    "id string, type string, repo string, created_at string, payload string",
    [
        ("1", "PushEvent", "a/b", "2024-01-02T03:04:05Z", '{"size": 2, "commits": [{"message": "first line\\nsecond"}, {"message": "x"}]}'),
        ("2", "PushEvent", "a/b", "2024-01-02T04:04:05Z", '{"size": 1, "commits": []}'),
        ("3", "PullRequestEvent", "a/c", "2024-01-03T00:00:00+02:00", '{"action": "opened", "pull_request": {"title": "Add things", "html_url": "https://x/1"}}'),
        ("4", "IssuesEvent", "a/c", "2024-01-04T00:00:00Z", '{"issue": {"title": "Broken", "html_url": "https://x/2"}}'),
        ("5", "CreateEvent", "a/d", "2024-01-05T00:00:00Z", '{"ref_type": "repository"}'),
        ("6", "WatchEvent", "a/d", "2024-01-06T00:00:00Z", "{}"),
    ],
)


@R.query(
    f"""WITH {ACTIVITY.sql()}, p AS (SELECT *, payload::JSON AS j FROM raw WHERE type IN ('PushEvent', 'PullRequestEvent', 'IssuesEvent', 'CreateEvent'))
SELECT id AS provider_id, CASE type WHEN 'PushEvent' THEN 'push' WHEN 'PullRequestEvent' THEN 'pull_request' WHEN 'IssuesEvent' THEN 'issue' ELSE 'create' END AS kind,
  CASE type WHEN 'PushEvent' THEN coalesce(j->>'size', '0') || CASE WHEN j->>'size' = '1' THEN ' commit' ELSE ' commits' END || coalesce(': ' || substr(string_split(j->>'$.commits[0].message', chr(10))[1], 1, 70), '')
    WHEN 'PullRequestEvent' THEN coalesce(j->>'action', 'updated') || ' PR: ' || (j->>'$.pull_request.title')
    WHEN 'IssuesEvent' THEN coalesce(j->>'action', 'updated') || ' issue: ' || (j->>'$.issue.title')
    ELSE trim('created ' || coalesce(j->>'ref_type', '') || ' ' || coalesce(j->>'ref', '')) END AS summary,
  repo AS repository, (created_at::TIMESTAMPTZ AT TIME ZONE 'UTC')::TIMESTAMP AS occurred_at,
  CASE type WHEN 'PullRequestEvent' THEN j->>'$.pull_request.html_url' WHEN 'IssuesEvent' THEN j->>'$.issue.html_url' ELSE 'https://github.com/' || repo END AS url FROM p"""
)
def activity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.activities(ACTIVITY.df(spark))


@R.query("SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


INTENTS = Literal("intents", "path string, type string, topics array<string>, body string", [("a.md", "note", ["x"], "fine"), ("b.md", "diary", ["x"], "text"), ("c.md", "plan", ["a", "b", "c", "d"], "text"), ("d.md", "adr", ["plan"], "text"), ("e.md", "note", ["x"], "---\ntags: x\n---\n"), ("old.md", "note", ["x"], "text")])


@R.query(
    f"""WITH {INTENTS.sql()}
SELECT path, CASE WHEN type NOT IN ('project', 'adr', 'plan', 'learning', 'note') THEN 'unknown type' WHEN starts_with(body, '---' || chr(10)) THEN 'frontmatter in the body' WHEN path = 'old.md' THEN 'already there'
  WHEN len(topics) > 3 THEN 'too many topics' WHEN list_has_any(topics, ['project', 'adr', 'plan', 'learning', 'note']) THEN 'a type is no topic' END AS refusal FROM intents"""
)
def write_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.validated(INTENTS.df(spark), spark.createDataFrame([("old.md",)], "path string"))


@R.query(f"WITH {INTENTS.sql()}, t AS (SELECT path, unnest(topics) AS tag FROM intents) SELECT path, tag FROM t WHERE tag NOT IN ('x', 'plan')")
def new_tag_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("x",), ("plan",)], "tag string")
    return INTENTS.df(spark).select("path", F.explode("topics").alias("tag")).join(F.broadcast(known), "tag", "left_anti").select("path", "tag")


ASKED = Literal("asked", "call_id int, argument string", [(1, "2"), (2, "9"), (3, "two"), (4, "1"), (5, None)])
RESULTS = Literal("results", "number int, title string, source string", [(1, "An event", "google_calendar"), (2, "A note", "obsidian")])


@R.query(
    f"""WITH {ASKED.sql()}, {RESULTS.sql()}
SELECT call_id, CASE WHEN try_cast(argument AS INTEGER) IS NULL THEN 'not a number' WHEN title IS NULL THEN 'out of range' WHEN source <> 'obsidian' THEN 'not a note' ELSE title END AS answer
FROM asked LEFT JOIN results ON number = try_cast(argument AS INTEGER)"""
)
def tool_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.looked_up(ASKED.df(spark), RESULTS.df(spark))
