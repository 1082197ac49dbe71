"""Streams driven to their end and tables written by commits, with the same results in SQL."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import embedding, ingest, state
from gleanery.plans.ingest import R as INGEST
from gleanery.plans.ingest import SNAPSHOT_SQL, snapshots
from gleanery.plans.registry import Registry
from gleanery.sources.buckets import Buckets
from gleanery.sources.shared import shared_folder
from gleanery.sources.tables import table
from gleanery.streaming import states
from gleanery.streaming.ingest import current, index_stream, windowed_counts

R = Registry()


@R.query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, counted by day; the shared folder of the cluster keeps progress and state."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    # a pattern, since a stream's path must be a folder or a pattern
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    counted = windowed_counts(stream, "1 day", "1 day")
    query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start()
    query.awaitTermination()
    out = spark.read.schema(counted.schema.add("batch", "long")).parquet(f"{folder}/out")
    last = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("start", "event_type", "v.n", F.round("v.total", 4).alias("total"))


#: Rounds of requests: what kind of event asks, what it expects, what it asks for.
ROUNDS = (("click", "inbox", "routed"), ("error", "inbox", "archived"), ("view", "routed", "inbox"), ("purchase", "inbox", "archived"))


@R.query(
    """WITH e AS (SELECT user_id AS id, event_type, min(event_id) AS first, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
u AS (SELECT id, max(first) FILTER (event_type = 'click') AS c, max(first) FILTER (event_type = 'error') AS x, max(first) FILTER (event_type = 'view') AS v, max(first) FILTER (event_type = 'purchase') AS p,
  coalesce(sum(n) FILTER (event_type IN ('click', 'error', 'view', 'purchase')), 0) AS asked FROM e GROUP BY id),
one AS (SELECT *, CASE WHEN c IS NOT NULL THEN 'routed' ELSE 'inbox' END AS s1, c AS b1, CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END AS n1 FROM u),
two AS (SELECT *, s1 = 'inbox' AND x IS NOT NULL AS hit2 FROM one),
three AS (SELECT *, CASE WHEN hit2 THEN 'archived' ELSE s1 END AS s2, CASE WHEN hit2 THEN x ELSE b1 END AS b2, n1 + hit2::INT AS n2 FROM two),
four AS (SELECT *, s2 = 'routed' AND v IS NOT NULL AS hit3 FROM three),
five AS (SELECT *, CASE WHEN hit3 THEN 'inbox' ELSE s2 END AS s3, CASE WHEN hit3 THEN v ELSE b2 END AS b3, n2 + hit3::INT AS n3 FROM four),
six AS (SELECT *, s3 = 'inbox' AND p IS NOT NULL AS hit4 FROM five)
SELECT id, CASE WHEN hit4 THEN 'archived' ELSE s3 END AS status, CASE WHEN hit4 THEN p ELSE b3 END AS by_event, (n3 + hit4::INT)::BIGINT AS applied, (asked - n3 - hit4::INT)::BIGINT AS refused FROM six"""
)
def capture_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as captures in a table that is written by commits: in four rounds each event of a kind asks for a change of status, if the status is the expected one."""
    events = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    every = events.select("id").distinct().select("id", F.lit("inbox").alias("status"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("seq"))
    captures = Buckets(spark, f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}", every.schema, ["id"], 16)
    captures.create(every)
    told = None
    for kind, expected, status in ROUNDS:
        asked = events.filter(F.col("event_type") == kind).withColumns({"expected": F.lit(expected), "status": F.lit(status)})
        outcome = state.compare_and_set(captures, asked)
        told = outcome if told is None else told.unionByName(outcome)
    counts = told.groupBy("id").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("refused"))
    zero = F.lit(0).cast("long")
    return captures.read().join(counts, "id", "left").select("id", "status", F.col("seq").alias("by_event"), F.coalesce("applied", zero).alias("applied"), F.coalesce("refused", zero).alias("refused"))


@R.query(
    f"""WITH {SNAPSHOT_SQL}
SELECT n.* FROM new n UNION ALL SELECT o.* FROM old o WHERE provider NOT IN ('en', 'es') AND NOT EXISTS (SELECT 1 FROM new n WHERE n.provider = o.provider AND n.provider_id = o.provider_id)"""
)
def index_upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of now merged into the index of before, of which only touched buckets are written anew."""
    new, old = snapshots(spark, sf_dir)
    index = Buckets(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", old.schema, ingest.KEYS, 256)
    index.create(old)
    ingest.upsert(index, new, ["en", "es"])
    return index.read()


@R.query("SELECT lang AS provider, doc_id::VARCHAR AS provider_id, sha256('v6' || chr(10) || text) AS fingerprint FROM documents")
def index_stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of listings, merged batch by batch into an index in buckets."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]")
    listing = stream.select(F.col("lang").alias("provider"), F.col("doc_id").cast("string").alias("provider_id"), F.lit(None).cast("timestamp").alias("modified_at"), T.fingerprint(F.col("text")).alias("fingerprint"))
    index_stream(listing, folder, buckets=64).awaitTermination()
    return current(spark, folder, listing.schema)[0].select("provider", "provider_id", "fingerprint")


PREFIX = embedding.DOCUMENT_PREFIX


def by_word_lengths(texts: list[str]) -> list[list[float]]:
    """How many words have a length that leaves 0 to 3 when divided by 4: stands for a model."""
    counts = [Counter(len(w) % 4 for w in t.split(" ")) for t in texts]
    return [[float(c[k]) for k in range(4)] for c in counts]


@R.query(
    f"""WITH w AS (SELECT doc_id, lang, string_split('{PREFIX}' || coalesce(text, ''), ' ') AS words FROM documents)
SELECT doc_id AS entity_id, 'new' AS embedder, CASE WHEN lang IN ('es', 'de') THEN array_to_string(list_transform(range(4), lambda k: len(list_filter(words, lambda x: length(x) % 4 = k))), ',') ELSE '9' END AS vector FROM w"""
)
def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: Spanish ones have no vector, German ones another model's. They are embedded by requests of 32 texts, and each batch is committed as it lands."""
    docs = table(spark, sf_dir, "documents")
    lang = F.coalesce("lang", F.lit(""))
    chunks = docs.select(F.col("doc_id").alias("entity_id"), F.lit(0).alias("position"), "text", F.when(lang != "es", F.array(F.lit(9.0).cast("float"))).alias("embedding"), F.when(lang == "de", "old").when(lang != "es", "new").alias("embedder"))
    held = Buckets(spark, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}", chunks.schema, embedding.KEYS, 32)
    held.create(chunks)
    embedding.embed_pending(held, by_word_lengths, "new", files=8)
    return held.read().select("entity_id", "embedder", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@R.query(INGEST.sql["capture_state_events"])
def capture_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of ``capture_state_events``, kept by a stream of the events."""
    folder = f"{shared_folder(spark)}/capture-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    kind = F.col("event_type")
    action = F.when(kind == "click", "route").when(kind == "view", "undo").when(kind == "error", "archive").otherwise(kind)
    log = stream.filter("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").alias("id"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    changes = states.capture_changes(log)
    states.run_to_end(changes, folder)
    return states.newest(changes, folder, "id").withColumnRenamed("at", "moved_at")


@R.query(
    """WITH e AS (SELECT user_id::VARCHAR AS provider_id, event_id AS id, row_number() OVER w AS nth, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, lag(event_id) OVER w AS before
  FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
last AS (SELECT * FROM e WHERE back = 1), told AS (SELECT *, provider_id::BIGINT % 3 = 0 AS edited FROM last)
SELECT provider_id, id, CASE WHEN edited THEN 'changed since' WHEN nth = 1 THEN 'moved to the trash' ELSE 'restored' END AS outcome,
  CASE WHEN edited THEN 'edited by hand' WHEN nth = 1 THEN 'text ' || id ELSE 'text ' || before END AS content, NOT edited AND nth = 1 AS trashed, NOT edited AS undone FROM told"""
)
def note_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as writes to a note each; each third note was edited by hand since. The newest write to every note is taken back, log and notes in one commit."""
    events = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("provider_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("taken_at"))
    before = F.lag("id").over(Window.partitionBy("provider_id").orderBy("taken_at", "id"))
    text = lambda c: F.concat(F.lit("text "), c.cast("string"))
    wrote = events.withColumn("before", before).select("id", "provider_id", F.when(F.col("before").isNull(), "create").otherwise("update").alias("operation"), text(F.col("before")).alias("content"), F.sha2(text(F.col("id")), 256).alias("wrote_sha256"), "taken_at", F.lit(None).cast("timestamp").alias("undone_at"))
    last = events.groupBy("provider_id").agg(F.max_by("id", F.struct("taken_at", "id")).alias("id"))
    as_is = last.select("provider_id", F.when(F.col("provider_id").cast("long") % 3 == 0, "edited by hand").otherwise(text(F.col("id"))).alias("content"), F.lit(False).alias("trashed"))
    folder = f"{shared_folder(spark)}/undo-{uuid.uuid4().hex}"
    log = Buckets(spark, folder, wrote.schema, ["provider_id"], 16, "log")
    notes = Buckets(spark, folder, as_is.schema, ["provider_id"], 16, "notes")
    log.create(wrote)
    notes.create(as_is)
    told = state.undone(log, notes, as_is, F.lit("2024-03-01").cast("timestamp"))
    marked = log.read().groupBy("provider_id").agg(F.bool_or(F.col("undone_at").isNotNull()).alias("undone"))
    return told.join(notes.read(), "provider_id").join(marked, "provider_id")
