"""The store of answers with its budget, running totals, Bloom filters; embedding by requests and with progress kept."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions.bloom import bloom, fits, perhaps_in
from gleanery.functions.totals import totals_before
from gleanery.operators import checks, embedding
from gleanery.sources.buckets import Buckets

QUESTION = "id long, prompt string, options array<string>, cost long"


def test_totals_equal_adding_up(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.randint(0, 9)])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, n long").repartition(7)
    got = {r["id"]: r["before"] for r in totals_before(df, ["id"], "n", f"file://{tmp_path}").collect()}
    total = 0
    for i, n in sorted(rows):
        assert got[i] == total
        total += n or 0
    assert totals_before(df.limit(0), ["id"], "n", f"file://{tmp_path}").count() == 0


def test_bloom_filters_keep_what_was_put_in(spark):
    keys = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    made = bloom(keys, "key", 20_000)
    assert made.count() > 1 and fits(10_000_000) and not fits(10**9)
    assert perhaps_in(keys, "key", made, 20_000).count() == 20_000
    others = spark.range(20_000, 60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    assert perhaps_in(others, "key", made, 20_000).count() < 40_000 * 0.03


def questions(spark, *rows):
    return spark.createDataFrame([(i, p, ["yes", "no"], c) for i, p, c in rows], QUESTION)


def answering(calls):
    """A backend that tells how many questions it was asked."""

    def backend(asked):
        calls.append(sorted(r["prompt"] for r in asked.select("prompt").collect()))
        return asked.select("key", F.element_at("options", 1).alias("answer"), F.lit(0.5).alias("confidence"))

    return backend


def outcomes(df):
    return {r["id"]: (r["outcome"], r["answer"]) for r in df.collect()}


def test_nothing_is_asked_twice(spark, tmp_path):
    calls, folder = [], f"file://{tmp_path}"
    ask = lambda q, **k: outcomes(checks.asked(checks.Store(spark, folder), q, answering(calls), k.pop("name", "m"), k.pop("version", "1"), ["id"], **k))
    q = questions(spark, (1, "a", 5), (2, "b", 5), (3, "a", 5), (4, "c", 5))
    assert ask(q) == {1: ("called", "yes"), 2: ("called", "yes"), 3: ("shared", "yes"), 4: ("called", "yes")}
    assert ask(q) == {i: ("cached", "yes") for i in (1, 2, 3, 4)}
    assert calls == [["a", "b", "c"], []]
    assert ask(questions(spark, (1, "a", 5), (2, "new", 1)))[2] == ("called", "yes") and calls[-1] == ["new"]
    for other in ({"name": "n"}, {"version": "2"}):
        assert ask(q, **other)[1][0] == "called"
    changed = q.withColumn("options", F.array(F.lit("no"), F.lit("yes")))
    assert ask(changed)[1] == ("called", "no")
    assert outcomes(checks.asked(checks.Store(spark, f"{folder}/none"), q.limit(0), answering(calls), "m", "1", ["id"])) == {}


def test_calls_end_with_the_budget(spark, tmp_path):
    calls, store = [], checks.Store(spark, f"file://{tmp_path}")
    q = questions(spark, *((i, f"p{i // 2}", 10) for i in range(20)))  # each prompt twice, ten calls in all
    got = outcomes(checks.asked(store, q, answering(calls), "m", "1", ["id"], budget=35))
    # the fourth call is made, as 30 were spent before it; the fifth isn't
    assert [got[i][0] for i in range(10)] == ["called", "shared"] * 4 + ["over budget"] * 2 and got[8][1] is None
    again = outcomes(checks.asked(store, q, answering(calls), "m", "1", ["id"], budget=35))
    assert [again[i][0] for i in range(18)] == ["cached"] * 8 + ["called", "shared"] * 4 + ["over budget"] * 2
    assert [len(c) for c in calls] == [4, 4]
    none = outcomes(checks.asked(store, q, answering(calls), "m", "1", ["id"], budget=0))
    assert none[19] == ("over budget", None) and calls[-1] == []


def test_answers_outside_the_options_are_an_error(spark, tmp_path):
    store, q = checks.Store(spark, f"file://{tmp_path}"), questions(spark, (1, "a", 5))
    with pytest.raises(Exception, match="none of"):
        checks.asked(store, q, checks.by_request(lambda p, o: ("maybe", None)), "m", "1", ["id"])
    assert store.read().count() == 0
    assert outcomes(checks.asked(store, q, checks.by_request(lambda p, o: (o[1], None)), "m", "1", ["id"])) == {1: ("called", "no")}


def test_stores_of_two_writers_keep_both(spark, tmp_path):
    a, b = (checks.Store(spark, f"file://{tmp_path}") for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, "yes", None)], checks.STORED)
    threads = [threading.Thread(target=s.add, args=(row(k),)) for s, k in ((a, "x"), (b, "y"), (a, "z"), (b, "x"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["key"] for r in a.read().collect()) == ["x", "x", "y", "z"]
    assert [tuple(r) for r in a.known(spark.createDataFrame([("x",), ("w",)], "key string")).collect()] == [("x", "yes", None)]


# embedding


def test_requests_keep_their_order_and_number():
    lock, state = threading.Lock(), {"now": 0, "most": 0}
    rng = random.Random(1)

    def embed(texts):
        with lock:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(rng.random() / 50)
        with lock:
            state["now"] -= 1
        return [[float(t)] for t in texts]

    lists = [[str(10 * k + j) for j in range(rng.randint(1, 5))] for k in range(60)]
    assert [[str(int(v[0])) for v in own] for own in embedding.in_order(iter(lists), embed, 3)] == lists
    assert 1 < state["most"] <= 3
    with pytest.raises(embedding.EmbeddingsUnavailable, match="0 vectors for 1"):
        list(embedding.in_order(iter([["1"]]), lambda t: []))

    def down(texts):
        raise embedding.EmbeddingsUnavailable("not reachable")

    with pytest.raises(embedding.EmbeddingsUnavailable, match="not reachable"):
        embedding.query_vector(down, "q")
    assert embedding.query_vector(lambda t: [[len(x)] for x in t], "q") == [len("search_query: q")]


def test_requests_are_bounded_and_prefixed(spark):
    def embed(texts):
        assert len(texts) <= 32 and all(t.startswith("search_document: ") for t in texts)
        return [[float(len(t)), float(len(texts))] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i if i % 7 else None) for i in range(100)], "id long, text string").coalesce(1)
    got = {r["id"]: r["vector"] for r in embedding.embedded(rows, embed).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: 17 + (i if i % 7 else 0) for i in range(100)} and {v[1] for v in got.values()} == {32, 4}


def chunk_table(spark, path, n=60):
    rows = spark.createDataFrame([(i, 0, f"text {i}", None, None) for i in range(n)] + [(n, 0, "has one", [1.0], "s"), (n + 1, 0, "has another's", [1.0], "old")], embedding.CHUNK)
    t = Buckets(spark, f"file://{path}", rows.schema, embedding.KEYS, 6)
    t.create(rows)
    return t


def test_embedding_goes_on_where_it_was_stopped(spark, tmp_path):
    table, log = chunk_table(spark, tmp_path / "t"), str(tmp_path / "log")

    def embed(texts, fails):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if fails and any("text 33" in t for t in texts):
            raise embedding.EmbeddingsUnavailable("the model went away")
        return [[float(len(t))] for t in texts]

    with pytest.raises(Exception, match="went away"):
        embedding.embed_pending(table, lambda t: embed(t, True), "s", files=1)
    state = {r["entity_id"]: r["embedder"] for r in table.read().collect()}
    left = {i for i, e in state.items() if e != "s"}
    assert len(state) == 62 and 33 in left and 0 < len(left) < 61
    open(log, "w").close()
    assert embedding.embed_pending(table, lambda t: embed(t, False), "s", files=1) == len(left)
    with open(log) as f:
        again = sorted(f.read().splitlines())
    assert again == sorted("search_document: " + ("has another's" if i == 61 else f"text {i}") for i in left)
    done = {r["entity_id"]: (r["embedder"], list(r["embedding"])) for r in table.read().collect()}
    assert done[60] == ("s", [1.0]) and done[33] == ("s", [float(len("search_document: text 33"))]) and {e for e, _ in done.values()} == {"s"}
    assert embedding.embed_pending(table, lambda t: embed(t, True), "s") == 0


def test_a_vector_of_a_text_that_has_changed_is_left_out(spark, tmp_path):
    table = chunk_table(spark, tmp_path, 3)
    other = Buckets(spark, f"file://{tmp_path}", table.schema, embedding.KEYS)
    changed = []

    def between(at, rows, touched, read=None, marks=None, write=table.write):
        if not changed:  # another writer replaces a chunk while vectors are made
            changed.append(1)
            now = other.state()
            every = list(range(other.n))
            other.write(now, other.read(now).withColumn("text", F.when(F.col("entity_id") == 1, "new text").otherwise(F.col("text"))), every)
        return write(at, rows, touched, read, marks)

    table.write = between
    embedding.embed_pending(table, lambda t: [[1.0] for _ in t], "s", files=100)
    assert {r["entity_id"] for r in table.read().collect() if r["embedder"] != "s"} == {1}
    assert {r["text"] for r in table.read().collect() if r["entity_id"] == 1} == {"new text"}
