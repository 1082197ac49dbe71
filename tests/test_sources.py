"""Heads of notes, the vault as a source and as a stream of changes, paged listings."""

import datetime
import os
import resource

import pytest
from pyspark.sql import functions as F

from gleanery.functions import heads
from gleanery.operators import ingest
from gleanery.sources import paged, vault
from gleanery.streaming import ingest as streaming

TREES = [
    ("a: 1\nb: two words # c\nc:\n", {"a": 1, "b": "two words", "c": None}),
    ("tags: [x, 'y, z', \"q\\n\", 3, true]", {"tags": ["x", "y, z", "q\n", 3, True]}),
    ("tags:\n- One\n- two\nmore: 1", {"tags": ["One", "two"], "more": 1}),
    ("tags:\n  - One\n  - - a\n    - b\n  - k: v\n    l: w\n  -\n    deep: 1\n", {"tags": ["One", ["a", "b"], {"k": "v", "l": "w"}, {"deep": 1}]}),
    ("a: {b: c, d: [1, 2], e}\n", {"a": {"b": "c", "d": [1, 2], "e": None}}),
    ("a: [1,\n  2, # c\n  3]\nb: x", {"a": [1, 2, 3], "b": "x"}),
    ("t: |\n  one\n   two\n\n  three\n\nb: 1", {"t": "one\n two\n\nthree\n", "b": 1}),
    ("t: >-\n  one\n  two\n\n  three\n    in\n  out\n", {"t": "one two\nthree\n  in\nout"}),
    ("t: |+\n  a\n\n", {"t": "a\n\n"}),
    ("t: |2\n    in\n  out", {"t": "  in\nout\n"}),
    ("d: 2024-01-02\ne: 1.5\nf: 0x1F\ng: 017\nh: ~\ni: No\nj: 1e3\nk: -.inf\nl: 12:30", {"d": datetime.date(2024, 1, 2), "e": 1.5, "f": 31, "g": 15, "h": None, "i": False, "j": "1e3", "k": float("-inf"), "l": 750}),
    ("'quoted key': it''s\n\"k2\": 'it''s'", {"quoted key": "it''s", "k2": "it's"}),
    ("a: plain\n  goes on\n\n  here\nb: 'two\n  lines'\n", {"a": "plain goes on\nhere", "b": "two lines"}),
    ("a: &x [1]\nb: *x\nc: &y\n  d: 1\ne: [*y]", {"a": [1], "b": [1], "c": {"d": 1}, "e": [{"d": 1}]}),
    ("a: http://x.y/z\nb: c:d\nurl: [http://a/b, 'c']", {"a": "http://x.y/z", "b": "c:d", "url": ["http://a/b", "c"]}),
    ("a: \"\\u00e9\\x41\\\n   b\"", {"a": "éAb"}),
    ("a: [b: c, d]\nproject: \"[[Harbor Map]]\"", {"a": [{"b": "c"}, "d"], "project": "[[Harbor Map]]"}),
    ("1: a\ntrue: b", {1: "a", True: "b"}),
    ("a:\n  b:\n    c: 1\n  d: 2\ne: 3", {"a": {"b": {"c": 1}, "d": 2}, "e": 3}),
    ("- a\n- b", ["a", "b"]),
    ("just text", "just text"),
    ("", None),
    ("# only a comment\n", None),
]
BAD = ["a: b: c", "a: [1, 2", "a: 'x", "a: [1]]", "a: {b", "a: @x", "a: `x`", "\ta: 1", "a: 1\n  b: 2", "a: %x", "a: 'x' y", "a: [,]", "a: *none", "a:\n   b: 1\n  c: 2", "a: - b", "key: value\nnot a key\n", 'a: "\\q"', "a: !x y", "[a, b", "a: " + "[" * 5000, "d: 2024-13-01"]


@pytest.mark.parametrize(("text", "tree"), TREES)
def test_trees_of_heads(text, tree):
    assert heads.parsed(text) == tree
    body = heads.head_and_body(f"---\n{text}\n---\n\n\nBody\n")
    assert body == (tree if isinstance(tree, dict) else {}, "Body\n")


@pytest.mark.parametrize("text", BAD)
def test_bad_heads_are_body(text):
    with pytest.raises(heads.BadHead):
        heads.parsed(text)
    whole = f"---\n{text}\n---\nBody"
    assert heads.head_and_body(whole) == ({}, whole)


def test_any_text_is_read_or_refused():
    import random

    rng = random.Random(7)
    bits = ["a: ", "- ", "b", "\n", "  ", "[", "]", "{", "}", ",", "'", '"', "#", "|", ">", "&x ", "*x", ":", "\\", "é", "1", "~", "\t", "? ", "---", "..."]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        try:
            heads.parsed(text)
        except heads.BadHead:
            pass


def test_tags_of_heads():
    tags = lambda text: heads.head_tags(heads.parsed(text))
    assert tags("tags: a, '#b'") == ["a", "'#b'"] and tags("tags: '#a,b , ,c'") == ["a", "b", "c"] and tags("tags: [1, #x\n '#y', no]") == ["1", "y", "False"]
    assert tags("tags: []\ntag: solo") == ["solo"] and tags("tags: 5") == [] and tags("other: x") == []


def write(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


def test_only_what_is_asked_for_is_opened(spark, tmp_path):
    opened, tmp_path = tmp_path / "opened", tmp_path / "vault"
    opened.mkdir()
    for k in range(5):
        write(tmp_path, f"n{k}.md", f"text {k}")
    own = vault.opened

    def telling(path):
        (opened / path.name).touch()
        return own(path)

    reader = vault.VaultReader(str(tmp_path), None, 200, True, ["n1.md"])
    vault.opened = telling
    try:
        assert [r[2] for p in reader.partitions() for r in reader.read(p)] == [b"text 1"]
        assert os.listdir(opened) == ["n1.md"]
        listing = vault.VaultReader(str(tmp_path), None, 200, False, None)
        assert len([r for p in listing.partitions() for r in listing.read(p)]) == 5 and os.listdir(opened) == ["n1.md"]
    finally:
        vault.opened = own
    assert [r["text"] for r in vault.note(spark, str(tmp_path), "n1.md").collect()] == ["text 1"]
    assert vault.note(spark, str(tmp_path), "../n1.md").count() == vault.note(spark, str(tmp_path), "none.md").count() == 0
    assert sorted(r["path"] for r in vault.listed(spark, str(tmp_path)).collect()) == [f"n{k}.md" for k in range(5)]


def test_filters_on_the_path_reach_the_source(spark, tmp_path):
    for k in range(4):
        write(tmp_path, f"n{k}.md", f"text {k}")
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = vault.FilteredVaultReader(str(tmp_path), None, 200, True, None)
    left = list(reader.pushFilters([EqualTo(("path",), "n1.md"), GreaterThan(("modified_at",), 1)]))
    assert len(left) == 1 and [p.names for p in reader.partitions()] == [["n1.md"]]
    assert list(reader.pushFilters([In(("path",), ("n2.md", "n1.md"))])) == [] and [p.names for p in reader.partitions()] == [["n1.md"]]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = vault.read_vault(spark, str(tmp_path)).filter(F.col("path").isin("n1.md", "n3.md"))
        assert sorted(r["text"] for r in found.collect()) == ["text 1", "text 3"]
        assert vault.read_vault(spark, str(tmp_path)).filter("path = 'n0.md' AND text LIKE 'text%'").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_changes_of_the_vault_reach_the_index_once(spark, tmp_path):
    root, folder = tmp_path / "vault", f"file://{tmp_path}/index"
    write(root, "a.md", "---\ntags: [x]\n---\nfirst")
    write(root, "sub/b.md", "second")
    seen = []

    def ingested():
        stream = vault.changes(spark, str(root))
        items = stream.select(F.lit("notes").alias("provider"), F.col("path").alias("provider_id"), "modified_at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.coalesce("text", F.lit("")).alias("body"), "deleted")
        before = streaming.current(spark, folder, items.drop("deleted").schema)[1]
        streaming.index_stream(items, folder, buckets=4).awaitTermination()
        index, now = streaming.current(spark, folder, items.drop("deleted").schema)
        seen.append(now - before)
        return {r["provider_id"]: r["body"] for r in index.collect()}

    assert ingested() == {"a.md": "---\ntags: [x]\n---\nfirst", "sub/b.md": "second"}
    write(root, "c.md", "third")
    (root / "a.md").unlink()
    write(root, "sub/b.md", "changed")
    os.utime(root / "sub/b.md", ns=(1, 1))
    assert ingested() == {"c.md": "third", "sub/b.md": "changed"}
    assert ingested() == {"c.md": "third", "sub/b.md": "changed"}
    assert seen[:2] == [1, 1] and seen[2] <= 1


def test_removed_keys_leave_the_index(spark, tmp_path):
    from gleanery.sources.buckets import Buckets

    schema = spark.createDataFrame([], "provider string, provider_id string, fingerprint string").schema
    index = Buckets(spark, f"file://{tmp_path}", schema, ingest.KEYS, 8)
    row = lambda *r: spark.createDataFrame([("p", i, f) for i, f in r], schema)
    ingest.upsert(index, row(("1", "x"), ("2", "x"), ("3", "x")))
    told = ingest.upsert(index, row(("2", "y")), gone=row(("1", ""), ("2", ""), ("9", "")))
    assert {(r["provider_id"], r["fingerprint"]) for r in index.read().collect()} == {("2", "y"), ("3", "x")} and told["removed"] == 1


def test_pages_stream_out(spark):
    size, pages = 10_000, 100

    def rows(name):
        def fetch(token):
            k = int(token or 0)
            return paged.Page(200, [{"name": name, "n": k * size + j, "more": "x" * 100} for j in range(size)], str(k + 1) if k + 1 < pages else None)

        yield from paged.pages_by_token(fetch)

    # in this process: 10^6 rows a collection, of which one page is held
    kind = spark.createDataFrame([], "name string, n long").schema
    reader = paged.Collections(["a"], rows, kind)
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for batch in reader.read(reader.partitions()[0]):
        n += batch.num_rows
    assert n == size * pages and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 120
    pages = 3
    out = paged.streamed(spark, ["a", "b"], rows, "name string, n long")
    assert out.rdd.getNumPartitions() == 2 and {tuple(r) for r in out.groupBy("name").agg(F.count(F.lit(1)), F.max("n")).collect()} == {("a", 30_000, 29_999), ("b", 30_000, 29_999)}
    assert paged.streamed(spark, [], rows, "name string, n long").count() == 0


def test_pages_end_with_the_limit_or_the_first_failure(spark):
    fetch = lambda token: paged.Page(200, [{"n": 1}, {"n": 2}], "more")
    assert [len(p) for p in paged.pages_by_token(fetch, limit=5)] == [2, 2, 1]
    assert list(paged.pages_by_token(fetch, limit=0)) == []

    def failing(name):
        def fetch(token):
            return paged.Page(403) if name == "b" and token else paged.Page(200, [{"n": 1}], "x" if name == "b" else None)

        yield from paged.pages_by_token(fetch)

    with pytest.raises(Exception, match="status 403"):
        paged.streamed(spark, ["a", "b"], failing, "n long").collect()
