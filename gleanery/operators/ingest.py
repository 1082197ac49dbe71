"""Incremental ingest: sources in one row shape, differences by fingerprint, identities, removals.

Items are (provider, provider_id, title, excerpt, tags, modified_at, fingerprint, body).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources.buckets import Buckets
from gleanery.sources.commits import Conflict
from gleanery.sources.shared import written

#: Rows of keys that are sent to all executors, some 100 bytes each; more are joined by a shuffle.
SMALL = 1 << 18
KEYS = ["provider", "provider_id"]
COLUMNS = [*KEYS, "title", "excerpt", "tags", "modified_at", "fingerprint", "body"]


def _items(df: DataFrame, provider: str, provider_id: Column, title: Column, excerpt: Column, tags: Column, modified_at: Column, own_text: Column, body: Column) -> DataFrame:
    return df.select(
        F.lit(provider).alias("provider"), provider_id.cast("string").alias("provider_id"), F.substring(title, 1, T.TITLE_CHARS).alias("title"), F.substring(excerpt, 1, T.INDEX_EXCERPT_CHARS).alias("excerpt"),
        tags.cast("array<string>").alias("tags"), modified_at.cast("timestamp").alias("modified_at"), T.fingerprint(own_text).alias("fingerprint"), body.alias("body"),
    )


def NO_TAGS() -> Column:  # noqa: N802
    return F.array().cast("array<string>")


def captures(df: DataFrame) -> DataFrame:
    """Captured thoughts (id, body, kind, status, updated_at) that aren't archived: titled by their first line."""
    body = F.col("body")
    return _items(df.filter("status <> 'archived'"), "captures", F.col("id"), T.first_line_title(body), body, F.array("kind"), F.col("updated_at"), F.concat_ws("\n", "kind", "status", "body"), body)


def notes(df: DataFrame) -> DataFrame:
    """Notes (path, body, tags, modified_at)."""
    body = F.coalesce("body", F.lit(""))
    return _items(df, "obsidian", F.col("path"), T.file_stem(F.col("path")), T.excerpt(body), F.col("tags"), F.col("modified_at"), F.concat_ws("\n", F.col("path"), F.array_join("tags", ","), body), body)


def events(df: DataFrame, now: Column, back: int = 7, ahead: int = 30) -> DataFrame:
    """Calendar events (provider_id, title, start, location, description, calendar_name, status) from ``back`` days before now to ``ahead`` days after, cancelled ones left out."""
    window = (F.col("start") >= now - F.make_dt_interval(F.lit(back))) & (F.col("start") <= now + F.make_dt_interval(F.lit(ahead)))
    kept = df.filter(window & ~F.coalesce(F.col("status") == "cancelled", F.lit(False)))
    return _items(kept, "google_calendar", F.col("provider_id"), F.col("title"), T.joined_parts(F.col("calendar_name"), F.col("location"), F.col("description")), NO_TAGS(), F.col("start"), F.concat_ws("\n", "title", F.col("start").cast("string"), "location"), F.lit(""))


def tasks(df: DataFrame, now: Column) -> DataFrame:
    """Open tasks (provider_id, title, completed, due, notes, list_name): dated by what is due, else now."""
    return _items(df.filter(~F.col("completed")), "google_tasks", F.col("provider_id"), F.col("title"), T.joined_parts(F.col("list_name"), F.col("notes")), NO_TAGS(), F.coalesce("due", now), F.concat_ws("\n", "title", "notes", "list_name"), F.lit(""))


def repositories(df: DataFrame) -> DataFrame:
    """Repositories (provider_id, name, description, pushed_at, language)."""
    return _items(df, "github", F.col("provider_id"), F.col("name"), T.joined_parts(F.col("description"), F.col("language")), NO_TAGS(), F.col("pushed_at"), F.concat_ws("\n", "name", "description", F.col("pushed_at").cast("string")), F.lit(""))


def together(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sources)


def classified(new: DataFrame, old: DataFrame) -> DataFrame:
    """(provider, provider_id, change): new, changed, unchanged or missing, by fingerprint. One full join on the keys gives stats and work alike."""
    a = new.select(*KEYS, F.col("fingerprint").alias("f_new"))
    b = old.select(*KEYS, F.col("fingerprint").alias("f_old"))
    change = F.when(F.col("f_old").isNull(), "new").when(F.col("f_new").isNull(), "missing").when(F.col("f_new") != F.col("f_old"), "changed").otherwise("unchanged")
    return a.join(b, KEYS, "full_outer").select(*KEYS, change.alias("change"))


def stats(changes: DataFrame, prunes: list[str]) -> DataFrame:
    """(provider, seen, indexed, skipped, removed). Only providers in ``prunes`` remove, and only if their listing isn't empty: an empty one changes nothing."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    seen = n("new", "changed", "unchanged")
    removed = F.when(F.col("provider").isin(prunes) & (F.col("seen") > 0), F.col("gone")).otherwise(0)
    own = changes.groupBy("provider").agg(seen.alias("seen"), n("new", "changed").alias("indexed"), n("unchanged").alias("skipped"), n("missing").alias("gone"))
    return own.select("provider", "seen", "indexed", "skipped", removed.cast("long").alias("removed"))


def status_line(counts: DataFrame, names: dict[str, str], pending: Column, failed: list[str] = ()) -> DataFrame:
    """One row (status): how many items each source of ``names`` (provider to name, in this order) has, how many wait for a vector, and which sources failed.

    ``counts`` (provider, indexed, skipped) has a row for each source; one without a row has 0.
    """
    own = counts.filter(F.col("provider").isin(list(names))).groupBy().pivot("provider", list(names)).agg(F.sum(F.col("indexed") + F.col("skipped")))
    parts = [F.format_string(f"%d {name}", F.coalesce(F.col(p), F.lit(0))) for p, name in names.items()]
    waiting = F.when(pending > 0, F.format_string("%d not yet embedded", pending))
    return own.select(F.concat(F.concat_ws(" · ", *parts, waiting), F.lit(f" — failed: {', '.join(failed)}" if failed else "")).alias("status"))


def pruned(index: DataFrame, new: DataFrame, prunes: list[str]) -> DataFrame:
    """The index without rows of pruning providers that their listing, if it has any row, no longer has."""
    listed = new.select("provider").distinct().filter(F.col("provider").isin(prunes)).withColumn("listed", F.lit(True))
    kept = new.select(*KEYS).distinct().withColumn("kept", F.lit(True))
    marked = index.join(listed, "provider", "left").join(kept, KEYS, "left")
    return marked.filter(F.col("listed").isNull() | F.col("kept").isNotNull()).select(*index.columns)


def merged(index: DataFrame, new: DataFrame, prunes: list[str]) -> DataFrame:
    """The next version of the index: changed and new rows replaced, missing ones pruned. To be written beside the old version, not over it."""
    kept = pruned(index, new, prunes)
    changed = new.join(index.select(*KEYS, F.col("fingerprint").alias("had")), KEYS, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("had"))).drop("had")
    return kept.join(changed.select(*KEYS), KEYS, "left_anti").unionByName(changed.select(*index.columns))


def upsert(index: Buckets, new: DataFrame, prunes: list[str] = (), marks: dict | None = None, gone: DataFrame | None = None, tries: int = 5) -> dict[str, int]:
    """Merges a batch into an index in buckets: the same rows as ``merged``, but only buckets with a changed, new or missing row are written.

    ``gone`` (provider, provider_id) are keys to remove, those that the batch has excepted. Of an unpruned batch, only the buckets that its keys fall into are read. Gives how many rows were new, changed and removed, and the commit; a batch
    that changes nothing writes no data. Where another writer was faster with one of the buckets, the batch is merged again into what that one left.
    """
    new = written(new.select(*index.schema.names), f"{index.folder.path}/batches")
    if not new.groupBy(*KEYS).count().filter("count > 1").isEmpty():
        raise ValueError("a batch has one row for each key")
    for left in reversed(range(tries)):
        at = index.state()
        listed = [r["provider"] for r in new.filter(F.col("provider").isin(list(prunes))).select("provider").distinct().collect()]
        asked = list(range(index.n)) if listed else sorted({*index.buckets_of(new), *(index.buckets_of(gone) if gone is not None else [])})
        had = index.read(at, asked).select(*KEYS, "fingerprint")
        told = classified(new, had)
        missing = F.col("provider").isin(listed)
        if gone is not None:
            told = told.join(gone.select(*KEYS).distinct().withColumn("gone", F.lit(True)), KEYS, "left")
            missing = missing | F.coalesce("gone", F.lit(False))
        changes = written(told.filter(F.col("change").isin("new", "changed") | (F.col("change") == "missing") & missing).select(*KEYS, "change"), f"{index.folder.path}/changes")
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        touched = index.buckets_of(changes)
        keys = changes.select(*KEYS)
        keys = F.broadcast(keys) if sum(counts.values()) <= SMALL else keys
        kept = index.read(at, touched).join(keys, KEYS, "left_anti")
        fresh = new.join(keys, KEYS, "left_semi").select(*index.schema.names)
        try:
            number = index.write(at, kept.unionByName(fresh), touched, asked, marks)
            return {"new": counts.get("new", 0), "changed": counts.get("changed", 0), "removed": counts.get("missing", 0), "commit": number}
        except Conflict:
            if not left:
                raise
    raise AssertionError


def identified(known: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """(id, provider, provider_id, first_seen_at, last_seen_at): known keys keep their ids, seen ones a new time, new ones a new id.

    Ids are random: write the result before reading it twice.
    """
    keys = seen.select(*KEYS).distinct()
    touched = known.join(keys.withColumn("again", F.lit(True)), KEYS, "left").select("id", *KEYS, "first_seen_at", F.when(F.col("again"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))
    fresh = keys.join(known, KEYS, "left_anti").select(F.uuid().alias("id"), *KEYS, now.alias("first_seen_at"), now.alias("last_seen_at"))
    return touched.unionByName(fresh)


def backfilled(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity_id, position, text): one chunk of title and excerpt for items without any; only spaces are trimmed."""
    bare = items.join(chunks.select("entity_id").distinct(), "entity_id", "left_anti")
    return bare.select("entity_id", F.lit(0).alias("position"), F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("excerpt", F.lit("")))).alias("text"))


def chunks_replaced(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of each entity in ``fresh`` replaced."""
    return chunks.join(fresh.select("entity_id").distinct(), "entity_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def cascaded(identities: DataFrame, items: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and chunks (entity_id, ...) that are left once their identities (id) are: an item goes with its identity, a chunk with its item."""
    left = items.join(identities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return left, chunks.join(left.select("entity_id").distinct(), "entity_id", "left_semi")


def sync_age(states: DataFrame, now: Column) -> DataFrame:
    """(hours, stale): since the newest completed sync of (completed_at); 24 hours or none at all is stale."""
    hours = (F.unix_micros(now) - F.unix_micros(F.max("completed_at"))) / 3.6e9
    return states.agg(F.round(hours, 6).alias("hours")).withColumn("stale", F.col("hours").isNull() | (F.col("hours") >= 24))


def synced(states: DataFrame, provider: str, now: Column) -> DataFrame:
    """Sync states (provider, completed_at, last_error) with one provider's success."""
    own = states.sparkSession.range(1).select(F.lit(provider).alias("provider"), now.alias("completed_at"), F.lit(None).cast("string").alias("last_error"))
    return states.filter(F.col("provider") != provider).unionByName(own)


PUSH, PULL, ISSUE, CREATE = "PushEvent", "PullRequestEvent", "IssuesEvent", "CreateEvent"
PAYLOAD = "size int, commits array<struct<message: string>>, action string, pull_request struct<title: string, html_url: string>, issue struct<title: string, html_url: string>, ref_type string, ref string"


def activities(raw: DataFrame) -> DataFrame:
    """(provider_id, kind, summary, repository, occurred_at, url) of raw events (id, type, repo, created_at, payload as JSON); types that aren't work drop out."""
    p = F.from_json("payload", PAYLOAD)
    own = raw.filter(F.col("type").isin(PUSH, PULL, ISSUE, CREATE)).withColumn("p", p)
    count = F.coalesce("p.size", F.lit(0))
    first = F.substring(F.element_at(F.split(F.coalesce(F.try_element_at("p.commits", F.lit(1))["message"], F.lit("")), T.LINE_END, 2), 1), 1, 70)
    pushed = F.concat(count.cast("string"), F.when(count == 1, " commit").otherwise(" commits"), F.when(first != "", F.concat(F.lit(": "), first)).otherwise(""))
    titled = lambda name, c: F.concat(F.coalesce("p.action", F.lit("updated")), F.lit(f" {name}: "), F.substring(F.coalesce(c, F.lit("")), 1, 70))
    created = F.trim(F.concat(F.lit("created "), F.coalesce("p.ref_type", F.lit("")), F.lit(" "), F.coalesce("p.ref", F.lit(""))))
    kind = F.col("type")
    home = F.concat(F.lit("https://github.com/"), F.col("repo"))
    return own.select(
        F.col("id").alias("provider_id"),
        F.when(kind == PUSH, "push").when(kind == PULL, "pull_request").when(kind == ISSUE, "issue").otherwise("create").alias("kind"),
        F.when(kind == PUSH, pushed).when(kind == PULL, titled("PR", F.col("p.pull_request.title"))).when(kind == ISSUE, titled("issue", F.col("p.issue.title"))).otherwise(created).alias("summary"),
        F.col("repo").alias("repository"),
        F.to_timestamp("created_at").alias("occurred_at"),
        F.when(kind == PULL, F.col("p.pull_request.html_url")).when(kind == ISSUE, F.col("p.issue.html_url")).otherwise(home).alias("url"),
    )


def calendars_merged(calendars: DataFrame, events: DataFrame) -> DataFrame:
    """(calendar_name, provider_id, title, start, all_day) of all calendars (calendar_id, summary, selected) that are switched on; events (calendar_id, id, title, date_time, date, status) that aren't cancelled.

    To be shown by ``start``, then calendar and id; a date counts as its midnight, a time without a zone as UTC.
    """
    shown = calendars.filter(F.coalesce("selected", F.lit(False))).select("calendar_id", F.col("summary").alias("calendar_name"))
    own = events.filter(~F.coalesce(F.col("status") == "cancelled", F.lit(False))).join(shown, "calendar_id")
    start = F.coalesce(F.try_to_timestamp("date_time"), F.try_to_timestamp("date"))
    return own.select("calendar_name", F.col("id").alias("provider_id"), F.coalesce("title", F.lit("(untitled)")).alias("title"), start.alias("start"), F.col("date_time").isNull().alias("all_day"))


def event_times(raw: DataFrame) -> DataFrame:
    """(provider_id, start, all_day) of events with a time (RFC 3339) or a date; no zone means UTC."""
    start = F.coalesce(F.try_to_timestamp("date_time"), F.try_to_timestamp("date"))
    return raw.select("provider_id", start.alias("start"), F.col("date").isNotNull().alias("all_day"))
