"""Postings as lists: the words of Arrow texts are those of the expression, and lists hold the postings that rows do."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.functions import batches, stems
from gleanery.functions import words as W
from gleanery.operators import lexical, segments
from gleanery.plans import records

ITEMS = "entity_id long, title string, body string"
ODD = ["", None, "a", " a", "a ", "The THE the", "x-1_y", "Ünïcode İstanbul ſtraße K2", "日本 n1 語", "end9", "9start", "\x00a\x7fb", "über" * 9, "   ", "z" * 5000, "the of"]


def rows(df):
    return sorted(tuple(r) for r in df.select("entity_id", "lexeme", "pos", "weight").collect())


def odd(spark):
    rng = random.Random(5)
    drawn = ["".join(rng.choices("ab19 -.ÄİKß\n", k=rng.randrange(40))) for _ in range(300)]
    return spark.createDataFrame([(i, rng.choice(ODD + drawn), rng.choice(ODD + drawn)) for i in range(700)], ITEMS).repartition(3)


@pytest.mark.parametrize("run", [1, 3000, 16 << 20])
def test_lists_hold_the_postings_of_rows(spark, monkeypatch, run):
    monkeypatch.setattr(lexical, "RUN_BYTES", run)
    monkeypatch.setattr(W, "BATCH_LISTS", 50)
    items = odd(spark)
    for stop in (["the", "a"], []):
        want = rows(lexical.postings(items, stop))
        assert want and rows(lexical.spread(lexical.lists(items, stop))) == want
        assert rows(lexical.spread(lexical.gathered(lexical.postings(items, stop)))) == want
    assert rows(lexical.spread(lexical.lists(items, stems.STOP_WORDS, stems.known))) == rows(records.english(items))


def test_words_of_a_slice_and_of_nothing():
    texts = pa.array(["zz", "ab cd", "", "ef", " g", "yy"])[1:5]
    found, counts = W.words(texts)
    assert found.to_pylist() == ["ab", "cd", "ef", "g"] and counts.tolist() == [2, 0, 1, 1]
    for empty in (texts[:0], pa.array(["", ""])):
        found, counts = W.words(empty)
        assert len(found) == 0 and counts.tolist() == [0] * len(empty)
    owner, pos = W.places(np.array([2, 0, 1]), np.array([5, 0, 7]))
    assert owner.tolist() == [0, 0, 2] and pos.tolist() == [5, 6, 7]


def test_runs_are_bounded_and_whole():
    made = [pa.RecordBatch.from_pydict({"n": pa.array(range(n), pa.int64())}) for n in (3, 3, 100, 1, 1)]
    assert [b.num_rows for b in batches.runs(iter(made), 48)] == [6, 100, 2] and list(batches.runs(iter([]), 48)) == []


def test_an_index_cuts_each_text_once_and_keeps_lists(spark, tmp_path):
    items = spark.createDataFrame([(i, "t", "red green blue " * 50) for i in range(60)], ITEMS)
    items.write.parquet(f"file://{tmp_path}/docs")
    held = spark.read.parquet(f"file://{tmp_path}/docs")
    for make in (lambda d: lexical.postings(d, ["the"]), lambda d: lexical.lists(d, ["the"])):
        plan = make(held.repartition(3, "entity_id"))._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression") :]
        assert "regexp_extract_all" not in below and "lower" not in below
    index = segments.Segments(spark, f"file://{tmp_path}/index", lambda d: lexical.lists(d, ["the"]))
    live = segments.followed(index, held, lambda d: d)
    assert live.count() == 60 * 151
    stored = spark.read.parquet(*(f"file://{f}" for f in tmp_path.glob("index/segment-*/postings/part*")))
    assert stored.count() <= 4 * stored.select(F.input_file_name()).distinct().count()


def test_a_search_reads_no_positions_without_phrases(spark, tmp_path):
    index = segments.Segments(spark, f"file://{tmp_path}", lambda d: lexical.lists(d, []))
    index.add(spark.createDataFrame([(1, "t", "red green"), (2, "t", "green red")], ITEMS))
    plan = lambda q: lexical.search(index.live(), q, [], strict=True)._jdf.queryExecution().executedPlan().toString()
    scan = lambda q: plan(q).split("ReadSchema: ")[1].split("\n")[0]
    assert "positions" not in scan("red OR green") and "positions" in scan('"red green"')
    assert [r["entity_id"] for r in lexical.search(index.live(), '"red green"', [], strict=True).collect()] == [1]
