"""The registered queries and the pipeline over small tables in files, with the parameters that they have."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import best_fit, near, pii, spm, suffix, token_counts
from gleanery.llm.queries import ORACLES, QUERIES, vocabulary
from test_operators import INTERNAL, brute_exact, brute_lines, brute_near, brute_repeats, corpus, slow_base

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    return [(i, t, "en", "s", len(t or "")) for i, t, *_ in corpus()]


def folder(spark, at, data, extra=()):
    docs = spark.createDataFrame(data, DOCUMENTS)
    docs = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in extra))
    docs.repartition(3).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("sf"), rows())


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("nothing"), [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_of_an_empty_table(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_toxicity_query(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    assert set(found) == {i for i, *_ in rows()}
    for i, r in found.items():
        assert r["held_out"] == (crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_packing_query(spark, sf):
    enc = best_fit.encoder(vocabulary("byte_bpe_50k.json"))
    places, total = defaultdict(list), Counter()
    for r in QUERIES["op1_best_fit_packing"](spark, sf).collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(enc.encode(t or "")) // 4 + 1 for i, t, *_ in rows()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_suffix_query(spark, sf):
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op3_suffix_dedup"](spark, sf).collect())
    assert got == Counter(brute_repeats([t or "" for _, t, *_ in rows()], suffix.LENGTH))


def test_exact_query(spark, sf):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in QUERIES["op4_exact_dedup"](spark, sf).collect())
    assert got == brute_exact([(i, t) for i, t, *_ in rows()])


def test_near_query(spark, sf):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op5_minhash_near_dedup"](spark, sf).collect())
    assert got == brute_near([(i, t) for i, t, *_ in rows()], 3, 85)


def test_personal_data_query(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op6_pii"](spark, sf).collect()}
    for i, text, *_ in rows():
        base = slow_base(text or "")
        assert [found[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[2] == k for s in base) for k in pii.BASE_KINDS]


def test_sentencepiece_query(spark, sf):
    peer = spm.coder(vocabulary("piece_bpe_32k.model")).peer
    found = {r["doc_id"]: r for r in QUERIES["op7_sentencepiece"](spark, sf).collect()}
    for i, text, *_ in rows():
        assert found[i]["n_tokens"] == len(peer.encode(text or "")) and found[i]["parity"] and found[i]["round_trip"]


def test_token_count_query(spark, sf):
    c = token_counts.counter(vocabulary("word_bpe_49k.json"))
    for r in QUERIES["op8_token_counts"](spark, sf).collect():
        text = dict((i, t or "") for i, t, *_ in rows())[r["doc_id"]]
        n = len(c.tok.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
        table = c.counts(text)
        assert r["n_within"] == max(i for i, k in enumerate(table.tolist()) if k <= 2048)


def test_line_query(spark, sf):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op10_line_dedup"](spark, sf).collect())
    assert got == brute_lines([(i, t) for i, t, *_ in rows()])


def test_media_query(spark, sf):
    found = {r["doc_id"]: r for r in QUERIES["op9_progressive_jpeg"](spark, sf).collect()}
    for i, text, *_ in rows():
        own = (text or "").encode()
        assert found[i]["n_bytes"] == len(own) and found[i]["payload_bytes"] == max(576, -(-len(own) // 576) * 576)


def test_sql_is_of_registered_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_the_pipeline_takes_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_the_pipeline_with_clashing_columns(spark, tmp_path):
    """Each stage keeps all columns; near copies, equal texts and personal data go, everything else arrives whole."""
    data = [*rows(), (900, None, None, None, None), (901, "write to jane.doe@mail.example.org today", "en", None, 40)]
    sf = folder(spark, tmp_path, data, INTERNAL)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {name: None for name, _ in corpus_pipeline.STAGES}
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
            at.write.parquet(f"file://{tmp_path}/{name}")
            at = spark.read.parquet(f"file://{tmp_path}/{name}")
            held[name] = {r["doc_id"]: r for r in at.collect()}
            assert all(r[c] == c + str(i) for i, r in held[name].items() for c in INTERNAL)
    clean = [(i, r["text"]) for i, r in held["toxicity"].items()]
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in clean]
    assert len(held["exact_dedup"]) == len(set(bodies))
    want = {c for _, _, c in brute_near([(i, r["text"]) for i, r in held["exact_dedup"].items()], 5, 80)}
    assert set(held["minhash_near_dedup"]) == want == set(held["pii"])
    assert 901 not in held["pii"] or "jane.doe" not in held["pii"][901]["text"]
    assert {r["doc_id"] for r in at.collect()} == want
    assert near.keep_one(docs).columns == docs.columns
