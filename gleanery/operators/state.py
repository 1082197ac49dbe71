"""Views of logs: captures' states, notes' snapshots, tasks and their lists, intents to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import stripped
from gleanery.operators.graph import Rules, problems
from gleanery.operators.tags import MAX_TOPICS, TYPE_TAGS
from gleanery.sources.buckets import Buckets, State, commit
from gleanery.sources.commits import Conflict
from gleanery.sources.shared import written


def capture_states(log: DataFrame) -> DataFrame:
    """(id, status, at, steps) of a log (id, action, at, seq): inbox to routed and back, inbox to archived; actions that a state doesn't allow change nothing.

    The last route or undo before an action tells the state that it meets: what repeats one changes nothing, so it may count too. Nothing
    leaves the archive. So no log is gathered, however long one is.
    """
    order = Window.partitionBy("id").orderBy("at", "seq", "action")
    action, before = F.col("action"), order.rowsBetween(Window.unboundedPreceding, -1)
    met = F.last(F.when(action.isin("route", "undo"), action), ignorenulls=True).over(before)
    routed = F.coalesce(F.col("met") == "route", F.lit(False))
    move = F.when(~routed & (action == "route"), "routed").when(~routed & (action == "archive"), "archived").when(routed & (action == "undo"), "inbox")
    moves = log.withColumn("met", met).withColumn("move", move).withColumn("late", F.max(F.col("move") == "archived").over(before))
    counts = F.col("move").isNotNull() & ~F.coalesce("late", F.lit(False))
    last = F.max(F.when(counts, F.struct("at", "seq", "action", "move"))).alias("s")
    return moves.groupBy("id").agg(last, F.count_if(counts).alias("steps")).select("id", F.coalesce("s.move", F.lit("inbox")).alias("status"), F.col("s.at").alias("at"), "steps")


def compare_and_set(table: Buckets, requests: DataFrame, at: State | None = None, tries: int = 5) -> DataFrame:
    """Changes states (id, status, at, seq) as requests (id, seq, at, expected, status) ask, each only where the status is the expected one.

    Gives (id, seq, applied). Of several requests for one id the first by ``seq`` is judged, the others are refused, and so are those for ids that
    aren't there. All that are applied are committed at once. ``at`` is the state that the requests were made for, the newest if not given. Where another writer
    has changed a bucket since, the requests are judged again by what it left, so of two that expect one status one is refused; with the last
    of the ``tries`` it is ``Conflict``. What is refused leaves nothing behind.
    """
    requests = written(requests.select("id", "seq", "at", "expected", "status"), f"{table.folder.path}/requests")
    first = requests.groupBy("id").agg(F.min(F.struct("seq", "at", "expected", "status")).alias("r")).select("id", "r.*")
    asked = table.buckets_of(requests)
    for left in reversed(range(tries)):
        at = at or table.state()
        now = table.read(at, asked).select("id", F.col("status").alias("now"))
        fits = first.join(now, "id").filter(F.col("now") == F.col("expected")).select("id", "status", "at", "seq")
        fits = written(fits, f"{table.folder.path}/applied")
        touched = table.buckets_of(fits)
        kept = table.read(at, touched).join(fits.select("id"), "id", "left_anti")
        try:
            if touched:
                table.write(at, kept.unionByName(fits), touched, asked)
            return requests.join(fits.select("id", "seq", F.lit(True).alias("hit")), ["id", "seq"], "left").select("id", "seq", F.coalesce("hit", F.lit(False)).alias("applied"))
        except Conflict:
            at = None
            if not left:
                raise
    raise AssertionError


def latest_snapshots(log: DataFrame) -> DataFrame:
    """The newest snapshot of each note (provider_id, taken_at, undone_at, ...) that isn't undone."""
    newest = Window.partitionBy("provider_id").orderBy(F.desc("taken_at"), F.desc("id"))
    return log.filter(F.col("undone_at").isNull()).withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")


#: What ``undone`` works on: a log of what was there before each write and what the write left, and the notes as they are.
SNAPSHOTS = "id long, provider_id string, operation string, content string, wrote_sha256 string, taken_at timestamp, undone_at timestamp"
NOTES = "provider_id string, content string, trashed boolean"


def undone(log: Buckets, notes: Buckets, asked: DataFrame, now: Column, tries: int = 5) -> DataFrame:
    """Takes back the newest write to each note (provider_id) that is asked for, and gives (provider_id, id, outcome).

    A note that was changed gets the content of before, one that was created goes to the trash and keeps what it holds; the log's entry is marked as undone. Both
    tables, of one folder and keyed by ``provider_id``, are committed at once, so neither is changed without the other. A note whose text isn't
    what the write left is refused: the write is no longer the last one. Where another writer was faster, all is judged again by what it left.
    """
    asked = written(asked.select("provider_id").distinct(), f"{log.folder.path}/asked")
    in_log, in_notes = log.buckets_of(asked), notes.buckets_of(asked)
    for left in reversed(range(tries)):
        at = log.state()
        last = latest_snapshots(log.read(at, in_log).join(asked, "provider_id", "left_semi"))
        there = notes.read(at, in_notes).select("provider_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha256"), "trashed")
        found = asked.join(last, "provider_id", "left").join(there, "provider_id", "left")
        outcome = (
            F.when(F.col("id").isNull(), "nothing to undo")
            .when(F.col("sha256").isNull() | F.col("trashed"), "already gone")
            .when(F.col("sha256") != F.col("wrote_sha256"), "changed since")
            .when(F.col("operation") == "create", "moved to the trash")
            .otherwise("restored")
        )
        told = written(found.select("provider_id", "id", "content", outcome.alias("outcome")), f"{log.folder.path}/outcomes")
        done = told.filter(F.col("outcome").isin("moved to the trash", "restored"))
        if done.isEmpty():
            return told.select("provider_id", "id", "outcome")
        log_buckets, note_buckets = log.buckets_of(done), notes.buckets_of(done)
        marked = log.read(at, log_buckets).join(done.select("provider_id", "id", F.lit(True).alias("hit")), ["provider_id", "id"], "left")
        log_rows = marked.withColumn("undone_at", F.when(F.col("hit"), now).otherwise(F.col("undone_at"))).select(*log.schema.names)
        before = notes.read(at, note_buckets).join(done.select("provider_id", F.col("content").alias("was"), "outcome"), "provider_id", "left")
        restored = F.col("outcome") == "restored"
        note_rows = before.withColumns({"content": F.when(restored, F.coalesce("was", F.lit(""))).otherwise(F.col("content")), "trashed": F.col("trashed") | F.coalesce(F.col("outcome") == "moved to the trash", F.lit(False))}).select(*notes.schema.names)
        try:
            commit(at, [log.prepared(at, log_rows, log_buckets, in_log), notes.prepared(at, note_rows, note_buckets, in_notes)])
            return told.select("provider_id", "id", "outcome")
        except Conflict:
            if not left:
                raise
    raise AssertionError


def open_tasks(lists: DataFrame, tasks: DataFrame, most: int = 500) -> DataFrame:
    """(list_id, list_name, task_id, title) of open tasks that are neither deleted nor hidden, ``most`` of each list by position."""
    nth = Window.partitionBy("list_id").orderBy("position", "task_id")
    kept = tasks.filter(~F.col("completed") & ~F.col("deleted") & ~F.col("hidden")).withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= most)
    return kept.join(lists, "list_id").select("list_id", "list_name", "task_id", "title")


def list_counts(lists: DataFrame, tasks: DataFrame) -> DataFrame:
    """(list_id, list_name, open): empty lists count 0."""
    counts = tasks.filter(~F.col("completed")).groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return lists.join(counts, "list_id", "left").select("list_id", "list_name", F.coalesce("n", F.lit(0)).alias("open"))


def task_tree(shown: DataFrame, every: DataFrame) -> DataFrame:
    """(task_id, title, children): shown top tasks, with all their children's titles in order whether shown or not."""
    under = every.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("task_id")).agg(F.sort_array(F.collect_list(F.struct("position", "title"))).alias("c"))
    top = shown.filter(F.col("parent_id").isNull())
    return top.join(under, "task_id", "left").select("task_id", "title", F.coalesce(F.col("c.title"), F.array().cast("array<string>")).alias("children"))


def validated(intents: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, refusal) of intents (path, type, topics, body): the first rule that each breaks, null if none."""
    known = existing.select("path", F.lit(True).alias("exists"))
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    refusal = (
        F.when(~F.col("type").isin(*TYPE_TAGS), "unknown type")
        .when(F.col("body").startswith("---\n"), "frontmatter in the body")
        .when(F.coalesce("exists", F.lit(False)), "already there")
        .when(F.size(topics) > MAX_TOPICS, "too many topics")
        .when(F.arrays_overlap(topics, F.array(*(F.lit(t) for t in TYPE_TAGS))), "a type is no topic")
    )
    return intents.join(known, "path", "left").select("path", refusal.alias("refusal"))


def unchanged_since(notes: DataFrame, intents: DataFrame) -> DataFrame:
    """(path, refusal) of intents (path, base_modified_at) to change notes (path, modified_at): refused where the note is gone or changed by more than a millisecond since it was read."""
    known = notes.select("path", F.col("modified_at").alias("now_at"))
    apart = F.abs(F.unix_micros(F.col("now_at").cast("timestamp")) - F.unix_micros(F.col("base_modified_at").cast("timestamp")))
    refusal = F.when(F.col("now_at").isNull(), "no longer there").when(apart > 1000, "changed since it was read")
    return intents.join(known, "path", "left").select("path", refusal.alias("refusal"))


def illegal_links(notes: DataFrame, drafts: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(path, rule, target): link rules that drafts (nth, path, body) would break if they were saved in the vault of notes (nth, path, body); other notes aren't judged."""
    saved = notes.join(drafts.select("path"), "path", "left_anti").select("nth", "path", "body").unionByName(drafts.select("nth", "path", "body"))
    found = problems(saved, rules=rules).filter(F.col("rule") != "unlisted")
    return found.join(drafts.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("source").alias("path"), "rule", "target")


def composed(drafts: DataFrame) -> DataFrame:
    """(path, content) of drafts (path, type, project, status, repos, topics, body): the note as it is written, fields first.

    A project's page has its status and repositories, another note the project that it belongs to.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    filled = lambda c: F.nullif(c, F.lit(""))
    page = F.col("type") == "project"
    repos = F.when(F.size("repos") > 0, F.concat(F.lit("repos:\n"), F.array_join(F.transform("repos", lambda r: F.concat(F.lit("  - "), quoted(r))), "\n")))
    head = [
        F.when(page, F.lit("type: project")),
        F.when(page & filled(F.col("status")).isNotNull(), F.concat(F.lit("status: "), quoted(F.col("status")))),
        F.when(page, repos),
        F.when(~page & filled(F.col("project")).isNotNull(), F.concat(F.lit("project: "), quoted(F.concat(F.lit("[["), F.col("project"), F.lit("]]"))))),
        F.concat(F.lit("tags: ["), F.array_join(F.array_distinct(F.concat(F.array("type"), F.coalesce("topics", F.array().cast("array<string>")))), ", "), F.lit("]")),
    ]
    return drafts.select("path", F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n"), stripped(F.col("body")), F.lit("\n")).alias("content"))


def task_id(list_id: Column, own: Column) -> Column:
    """One id for a task and its list."""
    return F.concat(list_id, F.lit("/"), own)


def task_id_parts(provider_id: Column) -> tuple[Column, Column]:
    """The list and the task of an id; null for an id without both."""
    at = F.instr(provider_id, "/")
    whole = (at > 1) & (at < F.length(provider_id))
    return F.when(whole, F.substring_index(provider_id, "/", 1)), F.when(whole, F.substr(provider_id, at + 1))


def due_text(due: Column) -> Column:
    """What a task is due on, as midnight UTC of its day: the service keeps the day alone."""
    return F.date_format(due.cast("timestamp"), "yyyy-MM-dd'T00:00:00.000Z'")


def looked_up(asked: DataFrame, results: DataFrame) -> DataFrame:
    """(call_id, answer): calls (call_id, argument) by the number of a result (number, title, source): only notes can be opened."""
    number = F.expr("try_cast(argument AS int)")
    found = asked.withColumn("number", number).join(results, "number", "left")
    answer = F.when(F.col("number").isNull(), "not a number").when(F.col("title").isNull(), "out of range").when(F.col("source") != "obsidian", "not a note").otherwise(F.col("title"))
    return found.select("call_id", answer.alias("answer"))
