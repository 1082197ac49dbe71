"""Alignment, manifest and fingerprints against brute force, on nulls, empty and long texts, repeated rows and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import align, fingerprints, merkle
from gleanery.llm.queries import QUERIES, UPPER
from test_operators import SCHEMA, corpus, path
from test_queries import folder

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["<|endoftext|> in a text", "▁marker", " starts with a space", "two  spaces ", "\x7f\x00\x01", "日本語のテキスト 🙂🙂", "<0x41> <s> </s>", "tab\tand\nline\r\n", "é" * 700 + " ", "a" * 5000, "﻿ bom"]


def data():
    return [(i, t, "en", "d", i % 3, 1, 5) for i, t in enumerate([t for _, t, *_ in corpus()] + ODD)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(data(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 11: alignment


def byte_table():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}


def brute_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) by comparing all tokens' ranges."""
    tok, peer, table = Tokenizer.from_file(path(A)), sentencepiece.SentencePieceProcessor(model_file=path(B)), byte_table()
    tok.encode_special_tokens = True
    held, documents = [], Counter()
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = peer.encode(text) if text else []
        a_bytes = [bytes(table[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if peer.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [peer.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            held.append(None)
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        cuts = sorted(set(a_end) & set(b_end))
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(i) for i, e in zip(a, a_end, strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, b_end, strict=True) if lo < e <= hi))
        links, j = [], 0
        for i, (lo, hi) in enumerate(zip([0, *a_end], a_end, strict=False)):
            while b_end[j] <= lo:
                j += 1
            k = j
            while k < len(b) and (b_end[k - 1] if k else 0) < hi:
                links.append((a[i], b[k]))
                k += 1
        documents.update(set(links))
        held.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    out = []
    for h in held:
        if h is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = h
            out.append((n_a, n_b, len(groups), len(links), sum(documents[p] == best[p[0]] for p in links), sum(documents[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def alignment_rows(df):
    return Counter(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


@pytest.mark.parametrize("head", [align.HEAD, 300, 1])
def test_alignment_equals_comparing_all_ranges(docs, head):
    """Also where some or all pairs are too many to be sent."""
    want = Counter(brute_alignment([r[1] or "" for r in data()]))
    assert alignment_rows(align.aligned(docs, path(A), path(B), head=head)) == want


def test_alignment_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "one two three", None, None, None, None, None)] * 3 + [(7, "one two four", "x", "y", 1, 1, 1)] * 2
    want = Counter(brute_alignment([r[1] for r in rows]))
    assert alignment_rows(align.aligned(spark.createDataFrame(rows, SCHEMA), path(A), path(B))) == want


def test_alignment_shows_its_groups(docs):
    rows = align.linked(docs, path(A), path(B), groups=True).collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows)
    assert all(r["n_groups"] == (r["groups"].count(";") + 1 if r["groups"] else 0) for r in rows)


def test_alignment_of_random_strings():
    rng = random.Random(5)
    t = align.tokens(path(A), path(B))
    tok = Tokenizer.from_file(path(A))
    tok.encode_special_tokens = True
    peer = sentencepiece.SentencePieceProcessor(model_file=path(B))
    chars = [chr(c) for c in [*range(1, 0x180), 0x2003, 0x2028, 0x3042, 0x1F600, 0x301]] + [" "] * 60
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, found in zip(texts, t.both(texts), strict=True):
        a, b = (np.frombuffer(ids, "<u4").tolist() for ids in found)
        assert a == tok.encode(" " + text, add_special_tokens=False).ids and b == peer.encode(text), repr(text)


def test_terminals_are_the_last_tokens_of_components():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randint(1, 40)
        a, b = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})) for _ in range(2))
        label = align.terminals(a, b)
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        ends = [next(c for c in shared if c >= e) for e in [*a.tolist(), *b.tolist()]]
        assert [b[x - len(a)] for x in label.tolist()] == ends


# 12: manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes, fanout=16):
    """(root, the siblings' list of every leaf as (before, behind) from below)."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(places):
            run = level[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[k].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
            places[k] = p // fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    import zlib

    def leaf(values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    sources = defaultdict(list)
    for r in rows:
        lower = r[4] and r[4].translate(str.maketrans(UPPER, UPPER.lower()))
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r[0], leaf((*r[:4], lower if changed else r[4]))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(sources[s])]) for s in names}
    root, upper = brute_tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (_, _, own, i, claim), below in zip(sorted(sources[s]), trees[s][1], strict=True):
            fold = claim
            for before, behind in below + above:
                fold = h(before, fold, behind)
            out.append((i, own, trees[s][0], root, h(*(b + a for b, a in below + above)), fold, fold == root))
    return Counter(out)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(spark, tmp_path, rows, extra=()):
    sf = folder(spark, tmp_path, [(i, t, lang, s, n) for i, s, lang, n, t in rows], extra)
    return Counter(tuple(r[c] for c in MANIFEST) for r in QUERIES["op12_merkle_manifest"](spark, sf).collect())


def manifest_data(sizes):
    rng = random.Random(3)
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    return [(ids.pop(), s, rng.choice(["en", None, "é"]), rng.choice([None, 5]), rng.choice(["Some Text", "", None, "no capitals", "ÄÖ A"])) for s, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 16},
        {"a": 17, "b": 1},
        {None: 3, "": 1, "é": 300, "z": 33, "Z": 257},
        {f"s{k}": 1 for k in range(40)} | {"hot": 700},
    ],
)
def test_manifest_equals_brute_force(spark, tmp_path, sizes):
    rows = manifest_data(sizes)
    assert manifest_rows(spark, tmp_path, rows, ("tree", "pos", "node", "n", "path", "slot", "parent")) == brute_manifest(rows)


def test_manifest_of_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(5, "a", "en", 1, "T")] * 20 + [(None, "a", None, None, None)] * 2 + [(None, None, None, None, "X"), (5, "a", "en", 1, "U")]
    assert manifest_rows(spark, tmp_path, rows) == brute_manifest(rows)


def test_manifest_finds_what_was_changed(spark):
    rows = spark.createDataFrame([(i, f"Text {i}", "en", "s", 1) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    claimed = F.when(F.col("doc_id") == 7, F.lit("another")).otherwise(F.col("text"))
    out = {r["doc_id"]: r for r in merkle.manifest(rows, claimed={"text": claimed}).collect()}
    assert [i for i, r in out.items() if not r["verified"]] == [7]
    assert out[8]["claimed_leaf"] == out[8]["leaf"] and out[7]["claimed_leaf"] != out[7]["leaf"]


# 13: fingerprints


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        other = text[: len(text) - n] + following[:n]
        sketch, changed, after = (slow_sketch(t) for t in (text, other, following))
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), shared(text, sketch, other, changed), shared(text, sketch, following, after)))
    return Counter(out)


def slow_sketch(text):
    data, mask = text.encode(), (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def half(b):
        x = int.from_bytes(b, "little") * 0x9E3779B97F4A7C15 & mask
        return x ^ x >> 29

    runs = [data[k : k + 16] for k in range(max(1, len(data) - 15))] if data else []
    hashes = {mix((half(r.ljust(16, b"\0")[:8]) * 0xD6E8FEB86659FD93 + half(r.ljust(16, b"\0")[8:]) + min(len(data), 16)) & mask) for r in runs}
    return {x for x in hashes if x < (1 << 64) // fingerprints.SCALE}


def shared(text, a, other, b):
    return 1.0 if text == other else len(a & b) / min(len(a), len(b)) if a and b else 0.0


def fingerprint_rows(df):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect())


def test_fingerprints_equal_brute_force(docs):
    found = fingerprints.neighbours(docs)
    assert fingerprint_rows(found) == brute_fingerprints([(r[0], r[1]) for r in data()])
    rows = found.collect()
    text = {r[0]: r[1] or "" for r in data()}
    by_text = defaultdict(set)
    for r in rows:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(f) == 1 for f in by_text.values())


@pytest.mark.parametrize("rows", [[(3, "alone in the table, with its own text as the next")], [(None, "b"), (None, "a"), (1, None)], [(1, "same")] * 3 + [(2, "x" * 100), (None, "nothing")]])
def test_fingerprints_of_few_rows(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)
    assert fingerprint_rows(fingerprints.neighbours(df)) == brute_fingerprints(rows)


def test_ids_of_any_type(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 5, "0")))
    want = {f"d{r[0]:05d}": r for r in brute_fingerprints([(r[0], r[1]) for r in data()])}
    for r in fingerprints.neighbours(named).collect():
        assert tuple(r)[1:3] == want[r["doc_id"]][1:3]


def test_a_long_text():
    text = "0123456789abcdef " * 60_000 + "an end of its own"
    assert set(fingerprints.least(text.encode()).tolist()) == slow_sketch(text)


def test_sketches_merge_and_contain(spark):
    rng = random.Random(1)
    parts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) for n in (3000, 40_000)]
    df = spark.createDataFrame([(0, parts[0], 0), (1, parts[1], 0), (2, parts[0] + parts[1], 1)], "doc_id int, text string, g int")
    own = fingerprints.sketches(df).join(df.select("doc_id", "g"), "doc_id")
    union = {r["g"]: r["sketch"] for r in fingerprints.merged(own, "g").collect()}
    assert len(set(union[1]) ^ set(union[0])) <= 4  # but for the shingles over the seam
    both = own.filter("doc_id = 0").select(F.col("sketch").alias("a")).join(own.filter("doc_id = 2").select(F.col("sketch").alias("b")))
    got = both.select(fingerprints.containment(F.col("a"), F.col("b")).alias("in"), fingerprints.containment(F.col("b"), F.col("a")).alias("out"), fingerprints.likeness(F.col("a"), F.col("b")).alias("like")).first()
    assert got["in"] == 1 and abs(got["out"] - 3 / 43) < 0.02 and got["like"] == 1


@pytest.mark.parametrize("run", [lambda d: align.aligned(d, path(A), path(B)), lambda d: merkle.manifest(d.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))), fingerprints.neighbours])
def test_of_empty_tables(none, run):
    assert run(none).count() == 0
