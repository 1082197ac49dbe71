"""Operators of retrieval, notes and ingest on small cases, and every query that has SQL against DuckDB."""

import datetime
import glob
import json
import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.functions import heads, stems
from gleanery.functions import text as T
from gleanery.operators import chunking, evaluation, fusion, graph, ingest, lexical, state, tags, vector
from gleanery.sources import jsonl, paged, vault
from gleanery.streaming import ingest as streaming

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)


OWN = [n for n in entry.oracle_sql() if not re.match(r"op\d", n) and n != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rel = con.sql(entry.oracle_sql()[name])
    names = list(rel.columns)
    want = sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in (r[names.index(c)] for c in sorted(names))) for r in rel.fetchall()), key=repr)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows(df) == want


def test_entry(spark):
    """The ten best of the fusion, less the ids that have no document: as the SQL of the same query has them."""
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = {r[0] for r in con.sql(f"SELECT entity_id FROM ({entry.oracle_sql()['hybrid_retrieve']})").fetchall()}
    got = [r["entity_id"] for r in entry.entry(spark).collect()]
    assert 0 < len(got) <= 10 and len(got) == len(set(got)) and set(got) == want


def index(spark, *items):
    return lexical.postings(spark.createDataFrame(items, "entity_id string, title string, body string"), ["the", "a"])


def test_rank_contract(spark):
    idx = index(spark, ("t", "docker", "x"), ("b", "x", "docker"), ("two", "", "postgres and docker"), ("often", "", "docker docker docker"))
    rank = {r["entity_id"]: r["rank"] for r in lexical.search(idx, "docker", ["the"], "any").collect()}
    assert rank["t"] > rank["b"] and rank["often"] > rank["b"]
    rank = {r["entity_id"]: r["rank"] for r in lexical.search(idx, "postgres docker", ["the"], "any").collect()}
    assert rank["two"] > rank["b"]
    prefix = {r["entity_id"]: r["rank"] for r in lexical.search(idx, "dock", ["the"]).collect()}
    assert all(v > 0 for v in prefix.values()) and len(prefix) == 4
    assert lexical.search(idx, "the", ["the"]).count() == 0 and lexical.search(idx, "  ", ["the"]).count() == 0


def test_queries_as_written(spark):
    idx = index(spark, ("1", "", "red green blue"), ("2", "", "green red"), ("3", "", "red blue"), ("4", "", "yellow"))
    ids = lambda q, **k: {r["entity_id"] for r in lexical.search(idx, q, [], **k).collect()}
    assert ids('"red green"', strict=True) == {"1"}
    assert ids("red -blue", strict=True) == {"2"}
    assert ids("red -blue") == {"1", "2", "3"}  # the last word's prefix admits what was excluded
    assert ids("yellow OR green", strict=True) == {"1", "2", "4"}
    items = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "entity_id string")
    found = {r["entity_id"] for r in lexical.search(idx, "-red", [], strict=True, items=items).collect()}
    assert found == {"4"}


def test_stems_are_joined(spark):
    items = spark.createDataFrame([("1", "", "optimizing")], "entity_id string, title string, body string")
    stem = spark.createDataFrame([("optimizing", "optim")], "word string, lexeme string")
    assert lexical.postings(items, [], stem).first()["lexeme"] == "optim"


def test_stored_postings_follow_the_table(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, "s", "red green"), (2, "s", None)], "doc_id long, source string, text string").write.parquet(f"{at}/documents.parquet")
    find = lambda q: {r["entity_id"] for r in lexical.search(entry.retrieval.index(spark, at), q, []).collect()}
    assert find("green") == {1} and find("blue") == set()
    assert find("s") == {1, 2}  # from what was written, by the same name
    spark.createDataFrame([(3, "s", "blue")], "doc_id long, source string, text string").write.mode("append").parquet(f"{at}/documents.parquet")
    assert find("blue") == {3} and find("green") == {1}


def test_retrieval_without_vectors(spark):
    words = spark.createDataFrame([(1, 0.5), (2, 0.9)], "entity_id long, rank double")
    near = spark.createDataFrame([(3, 0.5), (1, 0.4)], "entity_id long, score double")
    ids = lambda df: [(r["entity_id"], r["mode"]) for r in df.collect()]
    assert ids(fusion.retrieved(words, None)) == [(2, "keyword"), (1, "keyword")]
    assert ids(fusion.retrieved(words, near, "vector", 1)) == [(3, "vector")]
    assert ids(fusion.retrieved(words, near))[0] == (1, "hybrid") and len(ids(fusion.retrieved(words, near))) == 3
    with pytest.raises(fusion.VectorsUnavailable):
        fusion.retrieved(words, None, "vector")


def test_two_notes_are_whole(spark):
    hits = spark.createDataFrame([(1, False, "e1", "b1"), (2, True, "e2", ""), (3, True, "e3", "b3"), (4, True, "e4", None), (5, True, "e5", "b5"), (6, True, "e6", "b6")], "position int, is_note boolean, excerpt string, body string")
    assert [r["content"] for r in fusion.with_contents(hits).orderBy("position").collect()] == ["e1", "e2", "b3", "e4", "b5", "e6"]


def test_best_chunks_of_hits(spark):
    """Against the chunks themselves: the closest by hashed words, three of the first hit in the order of the document."""
    from hashlib import md5

    def embedded(words):
        out = [0.0] * 64
        for w in words:
            out[int(md5(w.encode()).hexdigest()[:4], 16) % 64] += 1
        return out

    def near(a, b):
        size = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) if size else -2

    got = {r["entity_id"]: r["context"] for r in entry.queries()["context_best_chunks"](spark, SF).collect()}
    best = [r["entity_id"] for r in fusion.top_fused(entry.retrieval.ranked_lists(spark, SF), 5).collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = embedded(entry.retrieval.WORDS)
    want = {}
    for k, doc in enumerate(best):
        own = chunking.note_chunks(texts[doc]) if doc in texts else []
        order = sorted(range(len(own)), key=lambda i: (-near(embedded(re.findall("[a-z0-9]+", own[i][1].lower())), asked), i))
        if own:
            want[doc] = "\n\n".join(("[" + " › ".join(own[i][0]) + "]\n" if own[i][0] else "") + own[i][1] for i in sorted(order[: 3 if k == 0 else 1]))
    assert want and got == want


def test_lines_and_runs(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "id long, text string"
    assert jsonl.current(spark, f"{at}/d", schema).count() == 0
    first = spark.createDataFrame([(1, 'a "b"\n'), (2, None)], schema)
    assert jsonl.rewritten(first, f"{at}/d") == 0 and jsonl.rewritten(first.filter("id = 1"), f"{at}/d") == 1
    assert [tuple(r) for r in jsonl.current(spark, f"{at}/d", schema).collect()] == [(1, 'a "b"\n')]
    jsonl.append(first, f"{at}/l")
    jsonl.append(first, f"{at}/l")
    assert jsonl.scan(spark, f"{at}/l", schema).count() == 4
    run = spark.createDataFrame([("one", 0.5)], "name string, recall double")
    jsonl.record_run(run, f"{at}/runs")
    with pytest.raises(ValueError, match="recorded"):
        jsonl.record_run(run, f"{at}/runs")
    jsonl.record_run(run.withColumn("name", F.lit("two")), f"{at}/runs")
    assert spark.read.json(f"{at}/runs").count() == 2
    (tmp_path / "bad").write_text("{not json}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.scan(spark, f"{at}/bad", schema).collect()


def test_english_stems(spark):
    """The samples that are published with the rules."""
    words = "consign consigned consigning consignment consist consisted consistency consistent consistently consisting consists consolation consolations consolatory console consoled consoles consolidate consolidated consolidating knackeries knaves knavish kneaded kneading knew knick knickknacks knights knitting knives knobs knocked knocker knocking knots"
    want = "consign consign consign consign consist consist consist consist consist consist consist consol consol consolatori consol consol consol consolid consolid consolid knackeri knave knavish knead knead knew knick knickknack knight knit knive knob knock knocker knock knot"
    assert [stems.stem(w) for w in words.split()] == want.split()
    more = {"skies": "sky", "dying": "die", "news": "news", "generously": "generous", "communication": "communic", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "happy": "happi", "by": "by", "say": "say", "hopping": "hop", "hoping": "hope", "proceed": "proceed", "rational": "ration", "relational": "relat", "analogies": "analog", "adoption": "adopt", "controlled": "control", "optimizing": "optim", "optimized": "optim"}
    assert {w: stems.stem(w) for w in more} == more
    items = spark.createDataFrame([("1", "Note", "The query was optimized last week."), ("2", "Other", "nothing")], "entity_id string, title string, body string")
    table = stems.stem_table(items.select(F.explode(lexical.lexemes(F.col("body"))).alias("word")))
    idx = lexical.postings(items, stems.STOP_WORDS, table)
    found = lexical.search(idx, "optimizing", stems.STOP_WORDS, stem=stems.stem)
    assert [r["entity_id"] for r in found.collect()] == ["1"] and lexical.search(idx, "the was", stems.STOP_WORDS, stem=stems.stem).count() == 0


def test_fusion_order(spark):
    lists = [spark.createDataFrame([(e, i + 1) for i, e in enumerate(order)], "entity_id string, position int") for order in ("axyzc", "bpqac")]
    got = [r["entity_id"] for r in fusion.top_fused(lists, 9).collect()]
    assert got.index("a") < got.index("c") < got.index("b") and all(r["score"] <= 2 / 61 for r in fusion.fused(lists).collect())


def test_context_of_nothing(spark):
    empty = spark.createDataFrame([], "position int, title string, source string, modified_at timestamp, content string")
    assert fusion.rendered(empty).first()["context"].startswith("No results")


def test_pending_and_embedding(spark):
    c = spark.createDataFrame([("n", 0, "a", None, None), ("n", 1, "b", [1.0], "s"), ("n", 2, "c", [1.0], "old")], "entity_id string, position int, text string, embedding array<float>, embedder string")
    todo = vector.pending(c, "s")
    assert {r["position"] for r in todo.collect()} == {0, 2}
    assert vector.embedded(todo, lambda ts: [[len(t), 0.5] for t in ts], "s").count() == 2
    with pytest.raises(Exception, match="vectors for"):
        vector.embedded(todo, lambda ts: [], "s").collect()


FILL = " ".join(["walking"] * 60)


def test_sections_and_chunks(spark):
    notes = spark.createDataFrame(
        [
            (1, f"# A\n{FILL}\n## B\n{FILL}\n### C\n{FILL}\n## D\n{FILL}"),
            (2, "x\n```\n# install it\n```\n  ~~~\n# no\n  ~~~"),
            (3, "\n\n".join(" ".join([f"p{k}"] * 80) for k in range(12))),
            (4, f"- one\n- two\n# Real\n{FILL}"),
            (5, "w" * 5000),
            (6, ""),
        ],
        "note_id int, body string",
    )
    got = {}
    for r in chunking.chunks(notes).collect():
        got.setdefault(r["note_id"], []).append((r["position"], list(r["path"]), r["text"]))
    for own in got.values():
        own.sort()
    assert [p for _, p, _ in got[1]] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert len(got[2]) == 1 and "install" in got[2][0][2]
    assert len(got[3]) > 1 and all(len(t) // 4 < 500 for *_, t in got[3])
    assert all(got[3][k + 1][2].split("\n\n")[0] in got[3][k][2] for k in range(len(got[3]) - 1))
    assert len(got[4]) == 1 and got[4][0][1] == ["Real"] and got[4][0][2].startswith("- one")
    assert "".join(t for *_, t in got[5]) == "w" * 5000 and 6 not in got
    items = spark.createDataFrame([(1, "T", "E", ""), (2, "", "", None), (3, "T", None, "body")], "note_id int, title string, excerpt string, body string")
    assert sorted((r["note_id"], r["text"]) for r in chunking.item_chunks(items).collect()) == [(1, "T\nE"), (3, "body")]


def test_text_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(T.stripped(F.lit("  \t a b \n"))) == "a b"
    assert value(T.lines(F.lit("a\r\nb\x1cc\n"))) == ["a", "b", "c"]
    assert value(T.tokens(F.lit("x" * 403))) == 100
    assert len(value(T.excerpt(F.lit("word " * 100)))) == 240
    assert value(T.file_stem(F.lit("a/b.c.md"))) == "b.c"


def test_links_of_one_note(spark):
    body = "[[A|x]] [[b/C#h]] [[D.md]] [[p.png]] [[A]] `[[no]]` ![[E^b]]"
    assert graph.links(spark.createDataFrame([("n.md", body)], "path string, body string")).orderBy("nth").toPandas()["target"].tolist() == ["A", "b/C", "D", "A", "E"]


def test_ingest_steps(spark):
    schema = "provider string, provider_id string, title string, excerpt string, tags array<string>, modified_at timestamp, fingerprint string, body string"
    item = lambda p, i, f: (p, i, "t", "e", [], None, f, "")
    old = spark.createDataFrame([item("a", "1", "x"), item("a", "2", "x"), item("b", "1", "x"), item("c", "1", "x")], schema)
    new = spark.createDataFrame([item("a", "1", "y"), item("a", "3", "z"), item("b", "9", "q")], schema)
    nxt = ingest.merged(old, new, ["a", "c"])
    assert {(r["provider"], r["provider_id"], r["fingerprint"]) for r in nxt.collect()} == {("a", "1", "y"), ("a", "3", "z"), ("b", "1", "x"), ("b", "9", "q"), ("c", "1", "x")}
    again = ingest.stats(ingest.classified(new, new), ["a"])
    assert all(r["indexed"] == 0 and r["removed"] == 0 for r in again.collect())
    known = spark.createDataFrame([("id1", "a", "1", None, None)], "id string, provider string, provider_id string, first_seen_at timestamp, last_seen_at timestamp")
    ids = ingest.identified(known, new, F.current_timestamp()).collect()
    assert len(ids) == 3 and {r["id"] for r in ids if r["provider_id"] == "1"} == {"id1"}
    chunks = spark.createDataFrame([("e", 0, "x"), ("f", 0, "y")], "entity_id string, position int, text string")
    fresh = spark.createDataFrame([("e", 0, "new"), ("e", 1, "new")], "entity_id string, position int, text string")
    assert ingest.chunks_replaced(chunks, fresh).count() == 3
    states = spark.createDataFrame([], "provider string, completed_at timestamp, last_error string")
    assert ingest.sync_age(states, F.current_timestamp()).first()["stale"]
    assert ingest.synced(states, "a", F.current_timestamp()).count() == 1


def test_sources_share_one_shape(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    caps = spark.createDataFrame([("1", "first\nsecond", "idea", "inbox", None), ("2", "x", "idea", "archived", None)], "id string, body string, kind string, status string, updated_at timestamp")
    evs = spark.createDataFrame([("e", "T", "2024-02-01 10:00:00", "here", None, "Cal", None), ("f", "T", "2025-02-01 10:00:00", None, None, None, None)], "provider_id string, title string, start string, location string, description string, calendar_name string, status string").withColumn("start", F.to_timestamp("start"))
    tsk = spark.createDataFrame([("l/t", "Do", False, None, "n", "L")], "provider_id string, title string, completed boolean, due timestamp, notes string, list_name string")
    rep = spark.createDataFrame([("o/r", "r", "d", None, None)], "provider_id string, name string, description string, pushed_at timestamp, language string")
    nts = spark.createDataFrame([("a/N.md", "body", ["t"], None)], "path string, body string, tags array<string>, modified_at timestamp")
    every = ingest.together(ingest.captures(caps), ingest.events(evs, now), ingest.tasks(tsk, now), ingest.repositories(rep), ingest.notes(nts))
    assert every.columns == ingest.COLUMNS
    assert {r["provider"]: (r["title"], r["excerpt"]) for r in every.collect()} == {"captures": ("first", "first\nsecond"), "google_calendar": ("T", "Cal · here"), "google_tasks": ("Do", "L · n"), "github": ("r", "d"), "obsidian": ("N", "body")}
    times = spark.createDataFrame([("a", "2024-01-01T10:00:00+02:00", None), ("b", None, "2024-01-02")], "provider_id string, date_time string, date string")
    assert [(str(r["start"]), r["all_day"]) for r in ingest.event_times(times).withColumn("start", F.col("start").cast("string")).orderBy("provider_id").collect()] == [("2024-01-01 08:00:00", False), ("2024-01-02 00:00:00", True)]


def test_vault(spark, tmp_path):
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".other").mkdir()
    (tmp_path / "Sub").mkdir()
    for name, body in {"A.md": b"---\ntags: [x, 'y z']\n---\nText #in/line", "_Index.md": b"", ".other/d.md": b"d", ".obsidian/c.md": b"c", "Sub/Bad.md": b"ok \xff", "b.txt": b"no"}.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "out.md").symlink_to("/etc/hostname")
    own = {r["path"]: r for r in vault.read_vault(spark, str(tmp_path)).collect()}
    assert set(own) == {"A.md", "_Index.md", ".other/d.md", "Sub/Bad.md"}
    assert own["Sub/Bad.md"]["text"] == "ok �" and bytes(own["Sub/Bad.md"]["content"]) == b"ok \xff"
    assert vault.read_vault(spark, str(tmp_path), limit=2).count() == 2
    assert vault.note(spark, str(tmp_path), "../A.md").count() == 0
    assert [list(r["tags"]) for r in vault.parsed(vault.read_vault(spark, str(tmp_path))).filter("path = 'A.md'").collect()] == [["in/line", "x", "y z"]]
    assert heads.head_and_body("a\n---\nb: c\n---\n") == ({}, "a\n---\nb: c\n---\n")
    assert heads.head_and_body("---\ntags:\n- a\n- b\n---\nbody") == ({"tags": ["a", "b"]}, "body")


def test_pages(spark):
    waits = []
    answers = iter([paged.Page(429, headers={"Retry-After": "99"}), paged.Page(401), paged.Page(200, [{"n": 1}], "t"), paged.Page(503), paged.Page(200, [{"n": 2}, {"n": 3}])])
    refreshed = []
    got = list(paged.by_token(lambda token: next(answers), limit=2, refresh=lambda: refreshed.append(1), sleep=waits.append))
    assert got == [{"n": 1}, {"n": 2}] and waits[0] == 30 and refreshed == [1]
    with pytest.raises(paged.Unavailable):
        list(paged.by_token(lambda token: paged.Page(403)))
    assert paged.next_link('<https://x/1>; rel="prev", <https://x/2>; rel="next"') == "https://x/2"
    out = paged.listed(spark, ["a", "b"], lambda c: iter([{"name": c, "n": k} for k in range(2)]), "name string, n long")
    assert out.count() == 4


def test_index_stream(spark, tmp_path):
    schema = "provider string, provider_id string, title string, excerpt string, tags array<string>, modified_at timestamp, fingerprint string, body string"
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/index"
    for n, f in enumerate(("x", "y")):
        spark.createDataFrame([("a", "1", "t", "e", [], None, f, ""), ("a", str(2 + n), "t", "e", [], None, f, "")], schema).write.mode("append").parquet(source)
        listing = spark.readStream.schema(schema).parquet(source)
        streaming.index_stream(listing, folder).awaitTermination()
    index, version = streaming.current(spark, folder, listing.schema)
    assert version == 1 and {(r["provider_id"], r["fingerprint"]) for r in index.collect()} == {("1", "y"), ("2", "x"), ("3", "y")}


def test_index_stream_prunes_complete_listings_only(spark, tmp_path):
    schema = "provider string, provider_id string, title string, excerpt string, tags array<string>, modified_at timestamp, fingerprint string, body string, complete boolean"
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/index"
    early, late = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    row = lambda p, i, f, at, whole: (p, i, "t", "e", [], at, f, "", whole)
    runs = [
        [row("a", "1", "x", early, True), row("a", "2", "x", early, True), row("b", "1", "x", early, True)],
        [row("a", "1", "new", late, False), row("a", "1", "old", early, False)],  # a part of a listing: the second row stays in the index
        [row("a", "1", "new", late, True), row("b", "9", "x", None, None)],  # the whole of a's listing, which lacks "2"; b's isn't said to be whole
    ]
    seen = []
    for data in runs:
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.index_stream(spark.readStream.schema(schema).parquet(source), folder, ["a", "b"]).awaitTermination()
        index, _ = streaming.current(spark, folder, spark.createDataFrame([], schema).drop("complete").schema)
        seen.append({(r["provider"], r["provider_id"], r["fingerprint"]) for r in index.collect()})
    assert seen[0] == {("a", "1", "x"), ("a", "2", "x"), ("b", "1", "x")}
    assert seen[1] == {("a", "1", "new"), ("a", "2", "x"), ("b", "1", "x")}
    assert seen[2] == {("a", "1", "new"), ("b", "1", "x"), ("b", "9", "x")}


def test_note_chunks_follow_the_sections(spark):
    """The sections that windows find, and those that one pass over a note finds, on random notes; and what cuts and merges must keep."""
    rng = random.Random(1)
    bits = ["# A\n", "## B  \n", "### C ##\n", "#no\n", "text here\n", " \n", "\n", "```\n", "  ~~~ x\n", "---\n", "***  \n", "- - -\n", "\r\n", "a\x1cb\n", "# \n", "\t---\n", "#\ttab\n", " ".join(["word"] * 500) + "\n\n"]
    notes = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(notes, "note_id int, body string")
    found = {}
    for r in chunking.sections(df).orderBy("note_id", "section").collect():
        found.setdefault(r["note_id"], []).append((list(r["path"]), r["text"]))
    for i, body in notes:
        assert chunking.marked_sections(body) == found.get(i, []), body
        own = chunking.note_chunks(body)
        if len(own) > 1:
            assert all(len(t) // 4 >= chunking.MIN_TOKENS for _, t in own)
        assert [w for _, t in own for w in t.split() if w not in ("word",)] == [w for _, t in found.get(i, []) for w in t.split() if w not in ("word",)] or any(len(t) // 4 > chunking.MAX_TOKENS for _, t in found[i])


def test_measures_of_nothing(spark):
    assert tuple(evaluation.recall_mrr(spark.createDataFrame([], "rank int"), 5).first()) == (0.0, 0.0)
    got = evaluation.recall_mrr(spark.createDataFrame([(1,), (2,), (5,), (None,)], "rank int"), 5).first()
    assert tuple(got) == (0.75, 0.425)
    k = lambda pairs: tuple(evaluation.kappa(spark.createDataFrame(pairs, "a boolean, b boolean"), "a", "b").first())
    assert k([(True, True)] * 5 + [(False, False)] * 3 + [(True, False), (False, True)]) == (10, 0.8, 0.583333)
    assert k([(True, True)]) == (1, 1.0, 1.0) and k([])[1:] == (None, None)


def test_tag_rules(spark):
    wanted = spark.createDataFrame([("postgresql", [1.0, 0.0])], "tag string, vector array<double>")
    known = spark.createDataFrame([("db", [0.9, 0.1]), ("zoo", [0.0, 1.0])], "similar string, known_vector array<double>")
    assert tags.alike_by_meaning(wanted, known).first()["similar"] == "db"
    assert state.capture_states(spark.createDataFrame([], "id string, action string, at timestamp, seq int")).count() == 0


def test_similar_existing_takes_spelling_before_meaning(spark):
    wanted = spark.createDataFrame([("postgresqls", [1.0, 0.0]), ("storage", [1.0, 0.0]), ("alone", [0.0, -1.0])], "tag string, vector array<double>")
    known = spark.createDataFrame([(1, "postgresql", [0.0, 1.0]), (2, "database", [0.9, 0.1]), (3, "plan", [1.0, 0.0])], "nth int, similar string, known_vector array<double>")
    got = {r["tag"]: tuple(r)[1:] for r in tags.similar_existing(wanted, known).collect()}
    assert got == {"postgresqls": ("postgresql", 0.95, "spelling", True), "storage": ("database", 0.99, "meaning", True), "alone": (None, None, None, True)}
    down = {r["tag"]: tuple(r)[1:] for r in tags.similar_existing(wanted, known, model=False).collect()}
    assert down == {"postgresqls": ("postgresql", 0.95, "spelling", True), "storage": (None, None, None, False), "alone": (None, None, None, False)}
    assert {r["checked_meaning"] for r in tags.similar_existing(wanted, known.limit(0), model=False).collect()} == {True}


def test_spelling_bound_loses_nothing(spark):
    import difflib

    rng = random.Random(4)
    words = ["".join(rng.choice("abcde-") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    words += [w[:-1] + rng.choice("abc") for w in words] + [w + "s" for w in words[:20]]
    wanted = spark.createDataFrame([(w,) for w in sorted(set(words))], "tag string")
    known = spark.createDataFrame(list(enumerate(sorted(set(words)))), "nth int, similar string")
    want = {}
    for w in set(words):
        scored = [(-difflib.SequenceMatcher(None, w, k).ratio(), n, k) for n, k in enumerate(sorted(set(words))) if k != w]
        if scored and -min(scored)[0] >= tags.SAME_SPELLING:
            want[w] = min(scored)[2]
    assert want and {r["tag"]: r["similar"] for r in tags.alike_by_spelling(wanted, known).collect()} == want


def test_crowding_over_many_queries(spark):
    """Against brute force: the best chunk counts, not the number of chunks; ties by id; vectors without length aren't ranked."""
    c = spark.createDataFrame([("far", 0, [-1.0, 0.1]), ("far", 1, [-1.0, 0.0]), ("far", 2, [-1.0, -0.1]), ("x", 0, [1.0, 0.0]), ("y", 0, [0.0, 1.0]), ("y", 1, [0.0, -1.0]), ("z", 0, [1.0, 1.0]), ("zero", 0, [0.0, 0.0]), ("null", 0, None)], "entity_id string, position int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.2]), (2, [0.5, 1.0]), (3, [2.0, -0.1]), (4, [-1.0, 0.05]), (5, [0.0, 0.0])], "query_id int, embedding array<float>")
    want = {}
    for ask in (r["embedding"] for r in q.collect()):
        best = {}
        for r in c.collect():
            sizes = [sum(x * x for x in v) ** 0.5 for v in (ask, r["embedding"] or [0.0])]
            if min(sizes) > 0:
                score = round(sum(x * y for x, y in zip(ask, r["embedding"], strict=True)) / sizes[0] / sizes[1], 6)
                best[r["entity_id"]] = max(best.get(r["entity_id"], -2.0), score)
        for entity in sorted(best, key=lambda e: (-best[e], e))[:3]:
            want[entity] = want.get(entity, 0) + 1
    assert len(set(want.values())) > 1
    assert {r["entity_id"]: r["in_top"] for r in vector.crowding(c.repartition(3), q.repartition(2)).collect()} == want


def test_backfill_keeps_whole_texts(spark, tmp_path):
    long = "word " * 300 + "last"
    spark.createDataFrame([(1, "s", "has a chunk"), (2, "s", long), (3, None, " x "), (4, "t", None)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (None,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["entity_id"]: r["text"] for r in entry.queries()["backfill_whole"](spark, str(tmp_path)).collect()}
    assert got == {2: f"s\n{long}", 3: "\n x", 4: "t\n"}


def test_context_has_whole_texts(spark):
    context = entry.queries()["context_bodies"](spark, SF).first()["context"]
    best = [r["entity_id"] for r in fusion.top_fused(entry.retrieval.ranked_lists(spark, SF), 5).collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = [i for i in best if i in texts]
    assert any(len(texts[i]) > 500 for i in known) and all(f"\n    {texts[i]}" in context for i in known)


def test_chunk_sizes(spark, tmp_path):
    spark.createDataFrame([(1, "w" * 5000), (2, "a\n\nb"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["over_all"]): tuple(r)[2:] for r in entry.queries()["chunk_sizes"](spark, str(tmp_path)).collect()}
    assert got == {(1, False): (50, 400.0, 400, 4), (2, False): (1, 1.0, 1, 1), (None, True): (1, 400.0, 400, 5)}


def test_states_and_tags_read_the_tables(spark, tmp_path):
    log = [(1, 7, "2024-01-01", "click"), (2, 7, "2024-01-02", "view"), (3, 7, "2024-01-03", "error"), (4, 7, "2024-01-04", "click"), (5, 8, "2024-01-01", "signup"), (6, None, "2024-01-01", "click"), (7, 8, None, "click")]
    spark.createDataFrame(log, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["id"]: (r["status"], r["moved_at"] and r["moved_at"].day, r["steps"]) for r in entry.queries()["capture_state_events"](spark, str(tmp_path)).collect()}
    assert got == {7: ("archived", 3, 3), 8: ("inbox", None, 0)}
    docs = [(k, "en", "a", 100 - k) for k in range(7)] + [(10, "en", "b", 5), (11, "de", "b", 5), (12, None, "b", 5)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1), (10, 1), (11, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["tag"]: (r["found"], r["total"]) for r in entry.queries()["eval_by_tag_documents"](spark, str(tmp_path)).collect()}
    assert got == {"en": (1, 2), "a": (0, 1), "b": (1, 2), "de": (0, 1)}


def test_searches_without_the_question_s_vector(spark, tmp_path):
    spark.createDataFrame([(1, 1, [1.0, 0.0])], "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "s", "a license", "en", 9)], "doc_id long, source string, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("vector_best_chunk", "vector_best_chunk_ids", "top_chunks_in_order", "vectors_like_first"):
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0
    assert [r["entity_id"] for r in entry.queries()["hybrid_retrieve"](spark, str(tmp_path)).collect()] == [1]


def test_chunks_are_made_over_small_batches(spark, monkeypatch):
    from gleanery.functions import batches

    made = []
    monkeypatch.setattr(chunking, "map_slices", lambda df, step, schema: made.append(df) or batches.map_slices(df, step, schema))
    notes = spark.createDataFrame([(i, f"# Head {i}\n" + "words " * 99) for i in range(1200)], "note_id long, body string").coalesce(1)
    assert chunking.chunks(notes).count() == 1200 and len(made) == 1
    sizes = [r["n"] for r in batches.map_slices(notes, lambda b: pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}), "n long").collect()]
    assert sum(sizes) == 1200 and max(sizes) <= batches.BATCH_ROWS


def test_heads_are_read_over_small_batches(spark, monkeypatch):
    from gleanery.functions import batches

    made = []
    monkeypatch.setattr(vault, "map_slices", lambda df, step, schema: made.append(df) or batches.map_slices(df, step, schema))
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    files = spark.createDataFrame([(str(i), None if i % 2 else at, f"---\ntags: [t{i}]\n---\n\nwords #in " if i % 3 else None) for i in range(1200)], "path string, modified_at timestamp, text string").coalesce(1)
    own = {r["path"]: tuple(r)[1:] for r in vault.parsed(files).collect()}
    assert len(made) == 1 and own == {str(i): (None if i % 2 else at, ["in", f"t{i}"] if i % 3 else [], json.dumps({"tags": [f"t{i}"]}) if i % 3 else "{}", "words #in " if i % 3 else "") for i in range(1200)}
