"""The keyword index in segments: what is read again, what dies, merges, and searches equal to an index made anew."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.functions import stems
from gleanery.operators import lexical, segments
from gleanery.plans import records

ITEMS = "entity_id long, title string, body string"
WORDS = "red green blue yellow black white grey brown".split()


def postings(items):
    return lexical.postings(items, ["the"])


def rows(df):
    return sorted(tuple(r) for r in df.select("entity_id", "lexeme", "pos", "weight").collect())


def some(spark, rng, ids):
    return [(i, rng.choice(WORDS), " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))) for i in ids]


def test_additions_replacements_and_removals_equal_an_index_made_anew(spark, tmp_path):
    rng = random.Random(9)
    index = segments.Segments(spark, f"file://{tmp_path}", postings, most=3)
    assert index.live().count() == 0
    held = {}
    for step in range(9):
        own = some(spark, rng, rng.sample(range(20), rng.randint(1, 8)))
        gone = rng.sample(range(20), 3) if step % 2 else []
        gone = [i for i in gone if i not in {r[0] for r in own}]
        index.add(spark.createDataFrame(own, ITEMS), spark.createDataFrame([(i,) for i in gone], "entity_id long") if gone else None)
        held = {i: r for i, r in held.items() if i not in gone} | {r[0]: r for r in own}
        assert rows(index.live()) == rows(postings(spark.createDataFrame(list(held.values()), ITEMS))), step
        _, now = index.commits.latest()
        assert len(now["segments"]) <= 4 and all(d["number"] > min(s["number"] for s in now["segments"]) for d in now["dead"])
    query = '"red green" OR blue -white'
    anew = postings(spark.createDataFrame(list(held.values()), ITEMS))
    for kind in ({}, {"mode": "any"}, {"strict": True}):
        hits = [sorted((r["entity_id"], round(r["rank"], 9)) for r in lexical.search(i, query, ["the"], **kind).collect()) for i in (index.live(), anew)]
        assert hits[0] == hits[1]


def test_only_new_files_are_read(spark, tmp_path):
    at = f"file://{tmp_path}/docs"
    seen = []

    def counting(items):
        seen.append(sorted(r["entity_id"] for r in items.collect()))
        return postings(items)

    def find(word):
        index = segments.Segments(spark, f"file://{tmp_path}/index", counting)
        live = segments.followed(index, spark.read.parquet(at), lambda d: d)
        return {r["entity_id"] for r in lexical.search(live, word, ["the"]).collect()}

    spark.createDataFrame([(1, "t", "red"), (2, "t", "green")], ITEMS).coalesce(1).write.parquet(at)
    assert find("red") == {1} and find("green") == {2} and seen == [[1, 2]]
    spark.createDataFrame([(3, "t", "red")], ITEMS).coalesce(1).write.mode("append").parquet(at)
    assert find("red") == {1, 3} and seen == [[1, 2], [3]]
    first = next(f for f in (tmp_path / "docs").glob("part*") if spark.read.parquet(f"file://{f}").count() == 2)
    first.unlink()
    assert find("red") == {3} and find("green") == set() and seen[2:] == [[]]
    spark.createDataFrame([(3, "t", "blue"), (1, "t", "red")], ITEMS).coalesce(1).write.mode("overwrite").parquet(at)
    assert find("red") == {1} and find("blue") == {3} and seen[3:] == [[1, 3]]


def test_postings_are_written_in_order_and_filtered_in_the_scan(spark, tmp_path):
    index = segments.Segments(spark, f"file://{tmp_path}", postings)
    index.add(spark.createDataFrame([(i, "t", f"word{i} " + " ".join(WORDS)) for i in range(50)], ITEMS).repartition(3))
    plan = lexical.search(index.live(), "red word7", ["the"], "any")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(lexeme, [red,word7])]" in plan
    for f in (tmp_path / index.commits.latest()[1]["segments"][0]["name"] / "postings").glob("part*"):
        own = [r["lexeme"] for r in spark.read.parquet(f"file://{f}").collect()]
        assert own == sorted(own)


def test_positions_are_gathered_for_phrases_alone(spark):
    idx = postings(spark.createDataFrame([(1, "", "red green red"), (2, "", "green red")], ITEMS))
    plan = lambda q: lexical.search(idx, q, [], "all", strict=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan("red -blue OR green") and "collect_list" in plan('"red green" blue')


def test_jobs_that_add_at_once(spark, tmp_path):
    a, b = (segments.Segments(spark, f"file://{tmp_path}", postings) for _ in range(2))
    latest = b.commits.latest
    b.commits.latest = lambda: (b.commits.__dict__.pop("latest"), a.add(spark.createDataFrame([(1, "", "red")], ITEMS)), (-1, {}))[2]
    b.add(spark.createDataFrame([(1, "", "green")], ITEMS))  # takes the folder for empty, as it was
    assert latest()[0] == 1 and rows(b.live()) == [(1, "green", 0, "B")]


@pytest.mark.parametrize("name", ["kw_any", "kw_all", "kw_english"])
def test_queries_follow_their_table(spark, tmp_path, name):
    at = f"file://{tmp_path}"
    docs = lambda *r: spark.createDataFrame(r, "doc_id long, source string, text string")
    docs((1, "s", "an apache license token"), (2, "s", None)).write.parquet(f"{at}/documents.parquet")
    find = lambda: {r["entity_id"] for r in entry.queries()[name](spark, at).collect()}
    first = find()
    docs((3, "s", "licensed under apache license, tokens"), (4, None, "the license")).write.mode("append").parquet(f"{at}/documents.parquet")
    assert find() == first | ({3, 4} if name != "kw_all" else {3})


def test_a_large_file_is_dealt_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/docs"
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, rng.choice(WORDS), " ".join(f"w{rng.randrange(9999)}" for _ in range(300))) for i in range(200)], ITEMS)
    docs.coalesce(1).write.parquet(at)
    size = sum(f.stat().st_size for f in (tmp_path / "docs").glob("part*"))
    monkeypatch.setattr(segments, "TASK_BYTES", size // 8)
    index = segments.Segments(spark, f"file://{tmp_path}/index", postings)
    live = segments.followed(index, spark.read.parquet(at), lambda d: d)
    assert rows(live) == rows(postings(docs))
    written = [spark.read.parquet(f"file://{f}").count() for f in tmp_path.glob("index/segment-*/postings/part*")]
    assert len(written) >= 8 and max(written) < sum(written) / 3


def test_a_merge_is_dealt_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "TASK_POSTINGS", 100)
    index = segments.Segments(spark, f"file://{tmp_path}", postings, most=2)
    held = [(i, "t", " ".join(WORDS)) for i in range(120)]
    for k in range(3):
        index.add(spark.createDataFrame(held[k * 40 : (k + 1) * 40], ITEMS).coalesce(1))
    segment = max(index.commits.latest()[1]["segments"], key=lambda s: s["documents"])
    assert segment["documents"] == 80 and rows(index.live()) == rows(postings(spark.createDataFrame(held, ITEMS)))
    written = [spark.read.parquet(f"file://{f}").count() for f in (tmp_path / segment["name"] / "postings").glob("part*")]
    assert len(written) > 4 and max(written) < 300


def test_stems_are_found_without_sending_postings(spark):
    texts = ["Licensing the licensed tokens", None, "", "the of", "Running runs ran, tokens Ünïcode running " * 9]
    items = spark.createDataFrame([(i, title, body) for i, (title, body) in enumerate((t, b) for t in ("The Tokens", None) for b in texts)], ITEMS)
    words = items.select(F.explode(F.concat(*(lexical.lexemes(F.coalesce(c, F.lit(""))) for c in ("title", "body")))).alias("word"))
    own = records.english(items)
    assert rows(own) == rows(lexical.postings(items, stems.STOP_WORDS, stems.stem_table(words)))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    held = spark.createDataFrame([(["running", None, ""],), (None,), ([],)], "words array<string>")
    assert [r[0] for r in held.coalesce(1).select(stems.stemmed_all("words")).collect()] == [["run", None, ""], None, []]
