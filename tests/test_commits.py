"""Commits by several writers, tables in buckets, conditional changes of state."""

import datetime
import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from gleanery.operators import ingest, state
from gleanery.sources import jsonl
from gleanery.sources.buckets import Buckets
from gleanery.sources.commits import Commits, Conflict, Folder
from gleanery.streaming import ingest as streaming

CAPTURE = "id long, status string, at timestamp, seq long"
REQUEST = "id long, seq long, at timestamp, expected string, status string"
ITEM = "provider string, provider_id string, title string, excerpt string, tags array<string>, modified_at timestamp, fingerprint string, body string"


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    folder, got = Folder(spark, f"file://{tmp_path}/f"), []
    start = threading.Barrier(8)

    def write(k):
        start.wait()
        if folder.put_if_absent("sub/name", f"text of {k}"):
            got.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 1 and folder.text("sub/name") == f"text of {got[0]}"
    assert folder.names("sub") == ["name"] and folder.names("nowhere") == []


def test_commits_go_on_top_of_others(spark, tmp_path):
    a, b = Commits(spark, f"file://{tmp_path}"), Commits(spark, f"file://{tmp_path}")
    assert a.latest() == (-1, {})
    at = b.latest()
    assert a.commit(a.latest(), lambda e: e | {"a": 1}) == 0
    assert b.commit(at, lambda e: e | {"b": 1}) == 1  # on top of a's
    assert a.latest() == (1, {"a": 1, "b": 1})
    assert not a.put(1, {"lost": 1}) and a.latest()[1] == {"a": 1, "b": 1}


def captures(spark, path, n=40, buckets=8):
    made = spark.createDataFrame([(i, "inbox", None, None) for i in range(n)], CAPTURE)
    t = Buckets(spark, f"file://{path}", made.schema, ["id"], buckets)
    t.create(made)
    return t


def request(spark, *rows):
    return spark.createDataFrame([(i, seq, None, expected, status) for i, seq, expected, status in rows], REQUEST)


def outcome(df):
    return {(r["id"], r["seq"]): r["applied"] for r in df.collect()}


def statuses(table):
    return {r["id"]: r["status"] for r in table.read().collect()}


def test_changes_apply_where_the_status_is_the_expected_one(spark, tmp_path):
    t = captures(spark, tmp_path)
    assert outcome(state.compare_and_set(t, request(spark, (1, 1, "inbox", "routed"), (1, 2, "inbox", "archived"), (2, 3, "routed", "inbox"), (99, 4, "inbox", "routed")))) == {(1, 1): True, (1, 2): False, (2, 3): False, (99, 4): False}
    assert outcome(state.compare_and_set(t, request(spark, (1, 5, "routed", "inbox"), (3, 6, "inbox", "archived")))) == {(1, 5): True, (3, 6): True}
    assert {i: s for i, s in statuses(t).items() if s != "inbox"} == {3: "archived"} and len(statuses(t)) == 40
    with pytest.raises(Conflict):
        t.create(t.read())


def test_the_slower_of_two_writers_is_refused_and_writes_nothing(spark, tmp_path):
    a = captures(spark, tmp_path)
    b = Buckets(spark, f"file://{tmp_path}", a.schema, ["id"])
    assert b.n == 8  # as the table was made
    seen = b.state()
    assert outcome(state.compare_and_set(a, request(spark, (5, 1, "inbox", "routed")))) == {(5, 1): True}
    before = a.state()
    with pytest.raises(Conflict):  # b still takes 5 for what it was
        state.compare_and_set(b, request(spark, (5, 2, "inbox", "archived")), seen, tries=1)
    assert a.state() == before and statuses(b)[5] == "routed"
    # judged again by what a left, it is refused
    assert outcome(state.compare_and_set(b, request(spark, (5, 2, "inbox", "archived")), seen)) == {(5, 2): False}
    assert a.state() == before


def test_writers_of_different_buckets_dont_disturb_each_other(spark, tmp_path):
    a = captures(spark, tmp_path)
    b = Buckets(spark, f"file://{tmp_path}", a.schema, ["id"])
    rows = a.read().withColumn("bucket", a.bucket())
    by_bucket = {r["bucket"]: r["id"] for r in rows.collect()}
    (_, one), (_, other) = list(by_bucket.items())[:2]
    seen = b.state()
    state.compare_and_set(a, request(spark, (one, 1, "inbox", "routed")))
    assert outcome(state.compare_and_set(b, request(spark, (other, 2, "inbox", "routed")), seen, tries=1)) == {(other, 2): True}
    assert {statuses(a)[one], statuses(a)[other]} == {"routed"}


def test_concurrent_writers_lose_no_change(spark, tmp_path):
    """Every capture is asked for by all writers at once; exactly one of them gets it, and a reader keeps to its commit."""
    t = captures(spark, tmp_path, 12, 3)
    first = t.state()
    told, errors = {}, []

    def ask(k):
        try:
            mine = Buckets(spark, f"file://{tmp_path}", t.schema, ["id"])
            told[k] = outcome(state.compare_and_set(mine, request(spark, *((i, 100 * k + i, "inbox", f"by {k}") for i in range(12))), tries=20))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=ask, args=(k,)) for k in range(1, 4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors
    won = {i: [k for k in told if told[k][i, 100 * k + i]] for i in range(12)}
    assert all(len(k) == 1 for k in won.values())
    assert statuses(t) == {i: f"by {k[0]}" for i, k in won.items()}
    assert {r["status"] for r in t.read(first).collect()} == {"inbox"}


def test_lines_of_two_writers(spark, tmp_path):
    at, rows = f"file://{tmp_path}", spark.createDataFrame([(1,)], "id long")
    assert jsonl.rewritten(rows, at) == 0
    assert jsonl.rewritten(rows.withColumn("id", F.lit(2)), at, onto=0) == 1
    with pytest.raises(Conflict):
        jsonl.rewritten(rows.withColumn("id", F.lit(3)), at, onto=0)
    assert [r["id"] for r in jsonl.current(spark, at, "id long").collect()] == [2] and jsonl.versions(spark, at) == 1


def item(p, i, f):
    return (p, str(i), "t", "e", [], None, f, "some body text " * 20)


def keyed(df):
    return {(r["provider"], r["provider_id"], r["fingerprint"]) for r in df.collect()}


def test_upserts_equal_merging_whole_indexes(spark, tmp_path):
    rng = random.Random(6)
    schema = spark.createDataFrame([], ITEM).schema
    index = Buckets(spark, f"file://{tmp_path}", schema, ingest.KEYS, 16)
    whole = spark.createDataFrame([], schema)
    for step in range(4):
        new = spark.createDataFrame([item(p, i, rng.choice("xyz")) for p in "abc" for i in rng.sample(range(30), rng.randint(0, 12))], schema)
        prunes = ["a", "b"] if step % 2 else []
        whole = spark.createDataFrame(ingest.merged(whole, new, prunes).collect(), schema)
        had = keyed(index.read())
        told = ingest.upsert(index, new, prunes)
        assert keyed(index.read()) == keyed(whole)
        now = keyed(index.read())
        ids = lambda rows: {r[:2] for r in rows}
        assert told["new"] == len(ids(now) - ids(had)) and told["removed"] == len(ids(had) - ids(now)) and told["changed"] == len({r for r in now - had if r[:2] in ids(had)})
    with pytest.raises(ValueError, match="one row"):
        ingest.upsert(index, new.unionByName(new), [])


def test_bytes_written_follow_the_batch(spark, tmp_path):
    schema = spark.createDataFrame([], ITEM).schema
    index = Buckets(spark, f"file://{tmp_path}", schema, ingest.KEYS, 64)
    index.create(spark.createDataFrame([item("a", i, "x") for i in range(6400)], schema))
    whole = sum(index.folder.size(n) for n in index.folder.names() if n.startswith("data-"))
    held = set(index.folder.names())
    ingest.upsert(index, spark.createDataFrame([item("a", 7, "new"), item("a", 8, "x")], schema))
    wrote = sum(index.folder.size(n) for n in set(index.folder.names()) - held)
    assert 0 < wrote < whole / 20
    held = set(index.folder.names())
    told = ingest.upsert(index, spark.createDataFrame([item("a", 7, "new")], schema), marks={"batch": 3})
    assert told["new"] == told["changed"] == 0 and not any(n.startswith("data-") for n in set(index.folder.names()) - held)
    assert index.state()[1]["marks"] == {"batch": 3} and index.read().count() == 6400


def test_a_batch_that_ran_is_not_merged_again(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/index"
    spark.createDataFrame([item("a", 1, "x")], ITEM).write.parquet(source)
    read = lambda: spark.readStream.schema(ITEM).parquet(source)
    streaming.index_stream(read(), folder).awaitTermination()
    # as if the query had been stopped between its commit and its own note of it
    (tmp_path / "index" / "progress" / "commits" / "0").unlink()
    (tmp_path / "index" / "progress" / "commits" / ".0.crc").unlink(missing_ok=True)
    streaming.index_stream(read(), folder).awaitTermination()
    index, commit = streaming.current(spark, folder, read().schema)
    assert commit == 0 and keyed(index) == {("a", "1", "x")}
    assert json.loads(Folder(spark, folder).text(Commits._name(0)))["marks"] == {"batch": 0}


def undo_tables(spark, path, notes, log):
    folder = f"file://{path}"
    held = spark.createDataFrame([(*n, False) for n in notes], state.NOTES)
    rows = spark.createDataFrame([(i, p, op, was, hashlib.sha256(wrote.encode()).hexdigest(), datetime.datetime(2024, 1, i), None) for i, p, op, was, wrote in log], state.SNAPSHOTS)
    tables = Buckets(spark, folder, rows.schema, ["provider_id"], 4, "log"), Buckets(spark, folder, held.schema, ["provider_id"], 4, "notes")
    tables[0].create(rows)
    tables[1].create(held)
    return tables


def undo(log, notes, *names):
    asked = log.spark.createDataFrame([(n,) for n in names], "provider_id string")
    return {r["provider_id"]: r["outcome"] for r in state.undone(log, notes, asked, F.lit("2024-03-01").cast("timestamp")).collect()}


def contents(notes):
    return {r["provider_id"]: (r["content"], r["trashed"]) for r in notes.read().collect()}


def test_writes_are_taken_back_one_after_the_other(spark, tmp_path):
    log, notes = undo_tables(spark, tmp_path, [("a", "three"), ("b", "by hand"), ("c", "c")], [(1, "a", "create", None, "one"), (2, "a", "update", "one", "two"), (3, "a", "update", "two", "three"), (4, "b", "update", "", "wrote")])
    assert undo(log, notes, "a", "b", "c", "none") == {"a": "restored", "b": "changed since", "c": "nothing to undo", "none": "nothing to undo"}
    assert contents(notes) == {"a": ("two", False), "b": ("by hand", False), "c": ("c", False)}
    assert undo(log, notes, "a", "a") == {"a": "restored"} and contents(notes)["a"] == ("one", False)
    assert undo(log, notes, "a") == {"a": "moved to the trash"} and contents(notes)["a"] == ("one", True)
    assert undo(log, notes, "a") == {"a": "nothing to undo"}
    assert {r["id"]: r["undone_at"] is not None for r in log.read().collect()} == {1: True, 2: True, 3: True, 4: False}


def test_undo_is_judged_again_after_another_writer(spark, tmp_path):
    log, notes = undo_tables(spark, tmp_path, [("a", "two")], [(1, "a", "update", "one", "two")])
    prepared, raced = notes.prepared, []

    def slow(*how):
        if not raced:  # meanwhile the note is edited
            raced.append(1)
            other = Buckets(spark, f"file://{tmp_path}", notes.schema, ["provider_id"], name="notes")
            now = other.state()
            other.write(now, other.read(now).withColumn("content", F.lit("edited")), list(range(other.n)))
        return prepared(*how)

    notes.prepared = slow
    before = {r["undone_at"] for r in log.read().collect()}
    assert undo(log, notes, "a") == {"a": "changed since"}
    assert contents(notes) == {"a": ("edited", False)} and {r["undone_at"] for r in log.read().collect()} == before == {None}
