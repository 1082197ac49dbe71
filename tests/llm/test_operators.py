"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanery.llm import best_fit, exact, lines, media, near, pii, spm, suffix, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, digest string, row long, n long, sequence_id long"


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "é", "in", "ß"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def corpus():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    passage = prose(rng, 90)
    rows = list(base)
    rows += [base[0], base[0] + " ", base[1].replace(" ", "\n"), None, "", "   ", None]
    for k in range(6):  # near copies
        w = base[2 + k % 2].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows += [prose(rng, 5) + " " + passage + " " + prose(rng, 5) for _ in range(5)]
    rows += ["\n".join(["A line of text that stands in more than five documents, all of them"] + [prose(rng, 8)] * 2) for _ in range(7)]
    rows += ["same passage twice: " + passage + " | " + passage, "x" * 3000, "word " * 4000, "mail a.b@c.example.org now, or +1 (555) 010-9999 and 10.0.0.255"]
    return [(i, t, "en", "d", i % 3, 1, 5) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and a null id."""
    rows = corpus()
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, rows[4][1], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def path(name):
    return public_tokenizers.path(name)


# 1: packing


def test_packing_places_every_piece_once(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    capacity = 256
    rows = best_fit.packed(docs, path("byte_bpe_50k.json"), capacity=capacity, open_bins=8).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts_of(docs).items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == math.ceil(len(ids) / capacity)
        assert all(r["length"] == capacity for r in own[1:])
        at = 0
        for r in own:
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(bins) <= math.ceil(total / capacity) * 1.25


def test_packing_loses_little_to_the_bound(spark):
    """Against the lower bound, tokens over capacity: at most 0.5 % with 64 open bins and groups of 1000 sequences."""
    rng = random.Random(2)
    lengths = [min(512, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20000)]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = best_fit.pack(pieces.repartition(4), 512, 64, 1000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(20000))
    least = sum(lengths) / 512
    assert len({r["sequence_id"] for r in rows}) <= 1.005 * least + 2 * math.ceil(least / 1000)


def test_bins_close_the_fullest_and_fit_best():
    bins = best_fit.Bins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the least space that holds it
    assert bins.place(5) == (2, 0)
    assert bins.place(8) == (3, 0)  # closes bin 0, the fullest open one
    assert bins.place(4) == (2, 5)


def test_sequences_hold_the_ids(spark, docs):
    out = best_fit.sequences(docs, path("byte_bpe_50k.json"), capacity=512, open_bins=4).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 2048 for r in out)


def test_encoder_equals_the_library():
    e = best_fit.encoder(path("byte_bpe_50k.json"))
    rng = random.Random(5)
    samples = ["", " ", "  a  b ", "a\n b", "a \nb", "a \n b", "<|endoftext|> x", "日本 語", "don't 've", "½ a1b"]
    samples += ["".join(rng.choice("ab  \n\t\xa0é1'.s　\x1c\x85日") for _ in range(rng.randrange(30))) for _ in range(800)]
    for s in samples:
        assert e.encode(s) == np.array(e.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), s


def test_groups_are_bounded_by_pieces_too_and_pieces_can_come_one_by_one(spark):
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 7 + 1).alias("length"))
    for how, groups in (({}, 1), ({"group_pieces": 100}, 5), ({"at_once": 0}, 1)):
        bins = defaultdict(list)
        for r in best_fit.pack(pieces, capacity=16, open_bins=4, **how).collect():
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sum(len(b) for b in bins.values()) == 500 and len({b >> 36 for b in bins}) == groups
        for own in bins.values():
            own.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 16


# 2: toxicity


def test_toxicity_learns_from_training_rows_only(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        t = prose(rng, rng.randint(5, 60))
        toxic = i % 5 == 2
        rows.append((i, t + (" grimlok" + rng.choice(["ity", "ish", "s"]) if toxic else ""), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "word " * 30000 + "grimloks")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_train=200)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(scored) == 403 and all(0 <= s <= 1 for s in scored.values())
    wrong = [i for i, _, x in rows if (scored[i] >= 0.5) != x]
    assert not wrong and scored[900] < 0.5 and scored[902] >= 0.5
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in scored.values())


def slow_buckets(text):
    """Buckets of the n-grams, one at a time."""
    mask = (1 << 64) - 1
    chars = [c if ord(c) > 127 or c.isalnum() or c == "'" else " " for c in f" {text.lower()} "]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(chars) - n + 1):
            own = chars[i : i + n]
            if " " in own[1:-1]:
                continue
            h = ord(own[0])
            for c in own[1:]:
                h = (h * 0x100000001B3 & mask) ^ (ord(c) * int(toxicity.FACTOR) & mask)
            out.add((h ^ h >> 29) * int(toxicity.FACTOR) % (1 << 64) >> 64 - toxicity.BUCKET_BITS)
    return out


def slow_model(rows, toxic, weight):
    """The log-count ratios and the regression, by loops over features."""
    own = [slow_buckets(t) for t in rows]
    n = Counter(toxic)
    have = {k: Counter(b for o, y in zip(own, toxic, strict=True) if y == k for b in o) for k in (0, 1)}
    ratio, total = {}, sum(n.values())
    for b in have[0].keys() | have[1].keys():
        p, q = have[1][b] / n[1], have[0][b] / n[0]
        share = (have[0][b] + have[1][b]) / total
        chi = (p - q) ** 2 / (max(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
        if have[0][b] + have[1][b] >= toxicity.MIN_TEXTS and chi >= toxicity.MIN_CHI:
            ratio[b] = math.log((have[1][b] + 1) / (n[1] + 2)) - math.log((have[0][b] + 1) / (n[0] + 2))
    share = sum(w for w, y in zip(weight, toxic, strict=True) if y) / sum(weight)
    w, w0 = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0)
    b = b0 = math.log(share / (1 - share))
    scale = [x / sum(weight) for x in weight]
    curve = 0.25 * sum(s * (1 + sum(ratio[f] ** 2 for f in o if f in ratio)) for s, o in zip(scale, own, strict=True)) + toxicity.PENALTY
    for k in range(toxicity.STEPS):
        yw = {f: w[f] + k / (k + 3) * (w[f] - w0[f]) for f in ratio}
        yb = b + k / (k + 3) * (b - b0)
        slope = [s * (1 / (1 + math.exp(-(yb + sum(yw[f] * ratio[f] for f in o if f in ratio)))) - y) for s, o, y in zip(scale, own, toxic, strict=True)]
        w0, b0 = w, b
        grad = Counter()
        for s, o in zip(slope, own, strict=True):
            for f in o:
                if f in ratio:
                    grad[f] += ratio[f] * s
        w = {f: yw[f] - (grad[f] + toxicity.PENALTY * yw[f]) / curve for f in ratio}
        b = yb - sum(slope) / curve
    return lambda text: 1 / (1 + math.exp(-(b + sum(w[f] * ratio[f] for f in slow_buckets(text) if f in ratio))))


def test_toxicity_equals_slow_loops():
    rng = random.Random(12)
    rows = [prose(rng, rng.randint(0, 15)) + (" vileword" if i % 4 == 0 else "") for i in range(60)]
    toxic = [int(i % 4 == 0) for i in range(60)]
    weight = [2.5 if y else 1.0 for y in toxic]
    model = toxicity.fit(rows, np.array(toxic, np.float64), np.array(weight))
    slow = slow_model(rows, toxic, weight)
    for text in [*rows, "", "a vileword it is", "é ß'n Straße"]:
        assert model.score(text) == pytest.approx(slow(text), abs=1e-5)


def test_toxicity_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, empty)
    assert toxicity.score(docs, model).filter("score >= 0.5").count() == 0
    assert toxicity.score(none, model).count() == 0


# 3: repeated byte strings


def brute_repeats(texts, length):
    held = [t.encode() for t in texts]
    seen = Counter(b[s : s + length] for b in held for s in range(len(b) - length + 1))
    out = []
    for b in held:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), len(suffix.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "part"), [(400, 1000), (100, 1000), (200, 2), (72, 1)])
def test_repeats_equal_brute_force(docs, monkeypatch, length, part):
    monkeypatch.setattr(suffix, "PART", part)
    monkeypatch.setattr(suffix, "SEGMENT", 1 << 12)
    monkeypatch.setattr(suffix, "TASK_BYTES", 1 << (20 if part == 1000 else 11))  # parts of one anchor in several groups
    held = texts_of(docs)
    want = dict(zip(held, brute_repeats(held.values(), length), strict=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.without_repeats(docs, length).collect()}
    assert got == want


def test_repeats_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    want = Counter((i, *v) for (i, _), v in zip(rows, brute_repeats([t for _, t in rows], 100), strict=True))
    assert Counter(tuple(r) for r in suffix.without_repeats(odd, 100).collect()) == want
    assert suffix.without_repeats(none).count() == 0


def test_string_hashes_do_not_depend_on_the_data_around():
    rng = np.random.default_rng(4)
    own, one, two = (rng.integers(0, 256, n).astype(np.uint8) for n in (100, 37, 911))
    a = suffix.string_hashes(np.concatenate([one, own, two]), np.array([37, 38]), 100)
    b = suffix.string_hashes(np.concatenate([two, two, own, one[:1]]), np.array([1822]), 100)
    assert a[0] == b[0] != a[1]


def test_buckets_mean_equal_strings():
    rng = random.Random(1)
    data = np.array([rng.choice(b"ab") for _ in range(600)], np.uint8)
    for length in (8, 9, 31, 64):
        bucket = suffix.refined(data, np.full(600, 600), length)
        groups = defaultdict(set)
        for i in range(600 - length + 1):
            groups[data[i : i + length].tobytes()].add(i)
        for own in groups.values():
            ids = {bucket[i] for i in own}
            assert ids == {-1} if len(own) == 1 else len(ids) == 1 and -1 not in ids
        assert len({bucket[min(g)] for g in groups.values() if len(g) > 1}) == sum(len(g) > 1 for g in groups.values())


# 4: exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for body, own in groups.items():
        best = min(own, key=lambda o: o[:3])
        for o in own:
            out[o[3]] = (rows[best[3]][0], len(own), hashlib.sha256(body.encode()).hexdigest())
    return Counter((rows[k][0], *v) for k, v in out.items())


def test_exact_equals_brute_force(docs, odd, none):
    for df in (docs, odd):
        found = exact.deduplicated(df).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
        assert Counter(tuple(r)[:4] for r in found) == brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})
        assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert exact.deduplicated(none).count() == 0


def test_exact_keeps_one_row_of_each_text(odd):
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == exact.deduplicated(odd).select("text_sha256").distinct().count()


INTERNAL = "keep_id", "text_sha256", "_digest", "_chars", "_id", "at_file", "at_row", "file", "file_row", "digest", "row", "body", "gone_id", "gone_body", "own", "cls", "n_spans"


def with_clashes(df):
    """A column of every name that the operators use inside, but for id and text."""
    return df.select("doc_id", "text", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in INTERNAL))


def test_exact_leaves_clashing_columns_alone(spark, docs, odd, none, tmp_path):
    for df in (docs, odd):
        own = with_clashes(df)
        kept = exact.keep_first(own).collect()
        assert len(kept) == exact.keep_first(df).count()
        assert all(r[c] == (None if r["doc_id"] is None else c + str(r["doc_id"])) for r in kept for c in INTERNAL)
    assert exact.keep_first(none).count() == 0
    # a larger side that is not broadcast, and a table straight from files
    docs.write.parquet(f"file://{tmp_path}/docs")
    held = spark.read.parquet(f"file://{tmp_path}/docs")
    want = {r["doc_id"] for r in exact.keep_first(docs).collect()}
    assert {r["doc_id"] for r in exact.keep_first(held).collect()} == want


def test_exact_joins_large_sides_by_shuffles(docs, monkeypatch):
    want = {tuple(r) for r in exact.deduplicated(docs).collect()}
    monkeypatch.setattr(exact, "SMALL", -1)
    assert {tuple(r) for r in exact.deduplicated(docs).collect()} == want
    assert exact.keep_first(docs).count() == sum(r[3] for r in want)


def test_clashing_digests_are_told_apart_by_their_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("the same for all"))
    found = exact.deduplicated(docs).select("doc_id", "keep_id", "group_size").collect()
    monkeypatch.undo()
    want = {(i, k, n) for i, k, n, _ in brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert {tuple(r) for r in found} == want


def test_the_stream_goes_on_from_its_state(spark, tmp_path):
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    more = spark.createDataFrame([(0, "ab"), (3, "a   b"), (4, "d")], "doc_id long, text string")
    source, folder = f"file://{tmp_path}/rows", f"file://{tmp_path}/work"
    exact.digest_rows(exact.plain(first)).write.parquet(source)
    schema = exact.digest_rows(exact.plain(first)).schema
    assert {r["group_size"] for r in exact.run_stream(spark, source, schema, folder).collect()} == {1}
    exact.digest_rows(exact.plain(more)).write.mode("append").parquet(source)
    groups = {r["keep"]["doc_id"]: r["group_size"] for r in exact.run_stream(spark, source, schema, folder).collect()}
    assert groups == {3: 3, 2: 1, 4: 1}


# 5: near duplicates


def brute_near(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k in range(len(rows)):
        least[root(k)].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((i for i in least[root(k)] if i is not None), default=None)) for k in range(len(rows)))


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_equals_brute_force(docs, words, percent):
    got = Counter(tuple(r)[:3] for r in near.near_duplicates(docs, words, percent).collect())
    assert got == brute_near([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)


def test_near_of_odd_rows(odd, none):
    got = Counter(tuple(r)[:3] for r in near.near_duplicates(odd, 3, 85).collect())
    want = brute_near([(r["doc_id"], r["text"]) for r in odd.collect()], 3, 85)
    assert got == want
    assert near.near_duplicates(none).count() == 0


def test_large_families_need_no_pairs_of_all(spark, monkeypatch):
    rng = random.Random(8)
    words = [word(rng) for _ in range(200)]
    rows = []
    for i in range(150):  # a chain: neighbours are alike, far ones aren't
        rows.append((i, " ".join(words[: 40 + i])))
    for i in range(150, 260):
        own = list(words)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(200)] = word(rng) + "x"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "SLOT", 7)
    monkeypatch.setattr(near, "PAIRS_A_COPY", 5)
    assert Counter(tuple(r)[:3] for r in near.near_duplicates(df, 3, 85).collect()) == brute_near(rows, 3, 85)


@pytest.mark.parametrize("n", [60, 400, 540, 3000])
def test_odd_sketches_bound_the_difference(spark, n):
    rng = np.random.default_rng(4)
    found = []
    for _ in range(40):
        own = rng.integers(0, 1 << 63, n, np.uint64)
        gone = int(n * rng.uniform(0, 0.15))
        more = rng.integers(0, 1 << 63, int((n - gone) * 1 / 0.85 - n) if (n - gone) / 0.85 > n else 0, np.uint64)
        a, b = np.unique(own), np.unique(np.concatenate([own[gone:], more]))
        both = len(np.intersect1d(a, b))
        if both >= 0.85 * (len(a) + len(b) - both):
            differ = int(np.bitwise_count(near.odd_sketch(a) ^ near.odd_sketch(b)).sum())
            found.append((min(len(a), len(b)), max(len(a), len(b)), differ))
    assert len(found) > 10
    judged = spark.createDataFrame(found, "x int, y int, differ int").withColumn("most", near.most_bits(F.col("x"), F.col("y"), 0.85))
    assert judged.filter("differ > most").count() == 0
    assert (1 - 0.85 ** near.band_rows(0.85)) ** (near.SAMPLES // near.band_rows(0.85)) <= 1e-6


def test_keep_one(odd):
    kept = near.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns
    want = {c for _, _, c in brute_near([(r["doc_id"], r["text"]) for r in odd.collect()], 3, 85)}
    assert {r["doc_id"] for r in kept.collect()} == want
    own = near.keep_one(with_clashes(odd), 3, 85)
    assert {r["doc_id"] for r in own.collect()} == want and own.columns == ["doc_id", "text", *INTERNAL]


# 6: personal data


def slow_base(text):
    email, ip, card, phone = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0

    tests = {"email": (email, lambda s: True), "ip": (ip, lambda s: all(int(p) <= 255 for p in s.split("."))), "card": (card, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (phone, lambda s: 9 <= len(digits(s)) <= 15)}
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(tests.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [(a, b, kind) for a, _, kind, b in sorted(found)]


def test_base_spans_equal_the_expressions():
    rng = random.Random(2)
    samples = ["a@b@c.de x", "a.b@c..d", "@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "é@ü.de x@y.z1.", "+1+2345678901", "4111-1111-1111-1111 4111-1111-1111-1111"]
    samples += ["".join(rng.choice("01234567894111 .-+()@ab%é\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for s in samples:
        assert pii.base_spans(s) == slow_base(s), s


def test_the_random_field_finds_spans_it_was_not_shown():
    model = pii.trained()
    held_out = pii.training_sentences(150, seed=1234)
    right = sum(model.decode(text) == spans for text, spans in held_out)
    assert right >= 0.95 * len(held_out)


def labellings(model, text, tokens, fixed=()):
    """Every labelling of the tokens as [(i, j, kind)], with its score; fixed: segments that it must have."""
    segments = defaultdict(list)
    for j, own in model.lattice(text, tokens).items():
        for i, features in own:
            if all(j <= a or i >= b for a, b, _ in fixed):
                segments[i] += [(j, kind, model.value(kind, features)) for kind in pii.KINDS]
    forced = {a: (b, kind) for a, b, kind in fixed}

    def go(i, before):
        if i == len(tokens):
            yield [], 0.0
            return
        ways = [(*forced[i], 0.0)] if i in forced else [(i + 1, pii.OUTSIDE, 0.0), *segments[i]]
        for j, kind, v in ways:
            for rest, w in go(j, kind):
                yield ([(i, j, kind), *rest] if kind != pii.OUTSIDE else rest), v + w + model.move(before, kind)

    return list(go(0, pii.OUTSIDE))


def some_field(seed, text):
    model, rng = pii.SemiMarkov(), random.Random(seed)
    tokens = [m.span() for m in pii.TOKEN.finditer(text)]
    pool = {(k, f) for segments in model.lattice(text, tokens).values() for _, fs in segments for f in fs for k in pii.KINDS}
    model.weights = defaultdict(float, {p: rng.uniform(-1, 1) for p in sorted(pool)})
    model.moves = defaultdict(float, {(a, b): rng.uniform(-2, 2) for a in pii.KINDS for b in (pii.OUTSIDE, *pii.KINDS)})
    return model, tokens


def test_decoding_is_the_best_labelling():
    for seed, text in enumerate(["a1234 2345 3b", "11.22-34 x", "9 @a 7", "x@1 (2) 3"]):
        model, tokens = some_field(seed, text)
        ways = labellings(model, text, tokens)
        got = [(a, b, k) for a, b, k in pii.SemiMarkov._as_tokens(tokens, model.decode(text))]
        assert dict((tuple(w), v) for w, v in ways)[tuple(got)] == pytest.approx(max(v for _, v in ways))
        # a span that stands already is part of the labelling and isn't given again
        held = [(1, 2, "ip")]
        ways = labellings(model, text, tokens, held)
        own = model.decode(text, 0.0, [(*tokens[1], "ip")])
        got = tuple(sorted([*pii.SemiMarkov._as_tokens(tokens, own), *held]))
        assert dict((tuple(w), v) for w, v in ways)[got] == pytest.approx(max(v for _, v in ways))


def test_learning_follows_the_gradient_of_the_likelihood():
    text, gold = "a1234 5678 90", [(6, 10, "ip")]
    model, tokens = some_field(5, text)
    ways = labellings(model, text, tokens)
    total = sum(math.exp(v) for _, v in ways)
    lattice = model.lattice(text, tokens)
    want, moves = Counter(), Counter()

    def count(way, amount):
        at, before = 0, pii.OUTSIDE
        starts = {i: (j, k) for i, j, k in way}
        while at < len(tokens):
            j, kind = starts.get(at, (at + 1, pii.OUTSIDE))
            if kind != pii.OUTSIDE:
                for f in dict(lattice[j])[at]:
                    want[kind, f] += amount
            if before != pii.OUTSIDE:
                moves[before, kind] += amount
            at, before = j, kind

    for way, v in ways:
        count(way, -math.exp(v) / total)
    count(pii.SemiMarkov._as_tokens(tokens, gold), 1.0)
    before, before_moves = dict(model.weights), dict(model.moves)
    model.learn(text, gold, 1e-3, 0.0)
    for key, g in want.items():
        assert model.weights[key] - before[key] == pytest.approx(1e-3 * g, abs=2e-6), key
    for key, g in moves.items():
        assert model.moves[key] - before_moves[key] == pytest.approx(1e-3 * g, abs=1e-9), key


def test_stretches_give_what_the_whole_text_gives():
    model, rng = pii.trained(), random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = [lambda: word(rng), lambda: word(rng), lambda: word(rng), lambda: number(rng.randint(1, 17)), lambda: "+1 (555) " + number(3) + "-" + number(4), lambda: "a@b.cd", lambda: "10.0.0." + number(2), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: rng.choice(["\n", "\t", "  ", ".", ",", "(", "_"]), lambda: "\u00a0"]
    samples = [" ".join(rng.choice(makers)() for _ in range(rng.randint(1, 90))) for _ in range(60)]
    samples += ["key = '1" + "a" * n + "'" for n in (1199, 2400)] + ["6" + "f" * 1200 + " " + word(rng), ("x" * 700 + " ") * 30 + "call 555-123-4567" + " y" * 900]
    for text in samples:
        base = pii.base_spans(text)
        whole = sorted(base + model.decode(text, pii.MARGIN, base), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert pii.all_spans(text, model)[1] == whole, text


def test_very_long_parts(spark):
    big = "0" * 5000 + ".1.1.1"
    rows = spark.createDataFrame([(1, big), (2, "9" * 5000 + ".1.1.1"), (3, "7x" * 100_000), (4, "1" * 300_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(rows).collect()}
    assert found[1]["n_ip"] == 1 and found[2]["n_ip"] == 0 and len(found) == 4


def test_pii_columns_and_masks(spark, docs, odd, none):
    extra = spark.createDataFrame([(1, 'cards 4111111111111111 4012888888881881, token = "0f3a9bc4d5e6f708192a3b4c5d6e7f8091a2b3c4", v 2.0'), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(extra).collect()}
    base = slow_base(extra.filter("doc_id = 1").first()["text"])
    assert rows[1]["base_sha256"] == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
    assert "secret:" in rows[1]["spans"] and rows[2]["spans"] == "" and rows[1]["n_card"] == sum(k == "card" for *_, k in base)
    shown = {r["doc_id"]: r["text"] for r in pii.mask(extra).collect()}
    assert shown[2] is None and shown[3] == "" and "4111" not in shown[1] and "0f3a9" not in shown[1] and shown[1].endswith("v 2.0")
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0
    assert pii.mask(odd).columns == odd.columns


# 7: SentencePiece


def test_sentencepiece_parity_and_round_trip(odd, none):
    c = spm.coder(path("piece_bpe_32k.model"))
    rng = random.Random(9)
    samples = ["", " ", "  a  b ", "▁x ▁", "日本 語", "😀 x\n y\t\tz", "\x00a b", "<s> </s> <unk>", " lead", "trail "]
    samples += ["".join(rng.choice("ab  \n▁é😀<s>") for _ in range(rng.randrange(40))) for _ in range(300)]
    for text, (ids, same) in zip(samples, c.encode(samples), strict=True):
        assert same and ids == c.packed(c.peer.encode(text)), text
        assert c.decode(ids) == c.normalised(text)
    out = spm.encoded(odd, path("piece_bpe_32k.model"))
    assert out.filter("NOT parity OR NOT round_trip").count() == 0 and out.count() == odd.count()
    back = {r["doc_id"]: r["text"] for r in spm.decoded(out.filter("doc_id IS NOT NULL"), path("piece_bpe_32k.model")).collect()}
    assert all(back[i] == t for i, t in texts_of(odd.filter("doc_id IS NOT NULL")).items())
    assert spm.encoded(none, path("piece_bpe_32k.model")).count() == 0


def test_texts_put_together_are_compared_whole():
    c = spm.Coder(path("piece_bpe_32k.model"))
    assert c.encode(["one two three"])[0][1]
    c.words["two"] = c.packed([5])  # as if a word had been remembered wrongly
    assert not any(parity for _, parity in c.encode([f"{n} two three" for n in range(50)]))


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += spm_varint(number << 3 | 2) + spm_varint(len(value)) + value
        elif isinstance(value, float):
            out += spm_varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += spm_varint(number << 3) + spm_varint(value)
    return out


def spm_varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def test_unigram_models_with_byte_fallback():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.0), ("ab", -3.5), ("▁ab", -4.0), ("aba", -9.0), ("c", -3.0), ("abc", -5.0))]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_proto=data)
    tok = spm.rebuilt(spm.Model.parse(data))
    for text in ("ab", "abab c", "aba", "abc ab", "é", "a é b", "cab abcab"):
        assert tok.encode(text, add_special_tokens=False).ids == peer.encode(text), text


# 8: token counts


def test_counts_at_every_prefix():
    c = token_counts.counter(path("word_bpe_49k.json"))
    rng = random.Random(4)
    samples = ["", "  a  b", "don't we'll 'l 'rx !!'s", "aaaaaaa aaaaab", "İstanbul ΣΑΣ Straße", "café x", "<|startoftext|>hi<|endoftext|>x", "\x1c a\x1fb", "日本語 123 ½²", "😀!! ñ"]
    samples += ["".join(rng.choice("ab' aabéÉ!1x") for _ in range(rng.randrange(40))) for _ in range(150)]
    for s in samples:
        whole = token_counts.unicodedata.normalize("NFC", s)
        want = [len(c.tok.encode(whole[:i], add_special_tokens=False).ids) for i in range(len(whole) + 1)]
        assert c.counts(s).tolist() == want, s
        assert c.count(s) == want[-1]
        for budget in {0, 1, 2, 3, 5, want[-1] - 1, want[-1], want[-1] + 1} - {-1}:
            assert c.within(s, budget) == max(i for i, n in enumerate(want) if n <= budget), (s, budget)


def test_budget_questions_need_no_encoding(spark, odd, none):
    odd = odd.filter("doc_id IS NOT NULL")
    out = token_counts.token_counts(odd, path("word_bpe_49k.json"), prefixes=True)
    c = token_counts.counter(path("word_bpe_49k.json"))
    asked = out.withColumn("fits", token_counts.longest_prefix(F.col("prefix_counts"), F.lit(10))).withColumn("ten", token_counts.tokens_within(F.col("prefix_counts"), F.lit(10)))
    held = texts_of(odd)
    for r in asked.collect():
        text = held[r["doc_id"]]
        if len(text) > 400:
            continue
        n = lambda s: len(c.tok.encode(s, add_special_tokens=False).ids)
        assert r["n_tokens"] == n(text) and r["ten"] == n(text[:10])
        assert r["fits"] == max(i for i in range(len(text) + 1) if n(text[:i]) <= 10)
    budgeted = token_counts.token_counts(odd, path("word_bpe_49k.json"), budget=10).collect()
    assert {(r["doc_id"], r["n_within"]) for r in budgeted} == {(r["doc_id"], r["fits"]) for r in asked.collect()}
    assert token_counts.token_counts(none, path("word_bpe_49k.json"), budget=10).count() == 0


# 9: media


def test_media_give_the_payload_back(odd, none):
    assert media.inspect(media.store(odd)).count() == odd.count()
    odd = odd.filter("doc_id IS NOT NULL")
    rows = media.inspect(media.store(odd), tensors=True).collect()
    held = texts_of(odd)
    for r in rows:
        payload, n = media.padded(held[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 < len(payload) and len(r["rgb"]) == 3 * r["height"] * r["width"]
    same = defaultdict(set)
    for r in rows:
        same[held[r["doc_id"]]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.inspect(media.store(none)).count() == 0


def test_progressive_scans_with_zero_runs_decode():
    """Coefficients with runs of zeros, a first scan and a refinement coded symbol by symbol."""
    rng = np.random.default_rng(3)
    codes = {s: (i, 8) for i, s in enumerate([0x00, 0x10, 0xF0, *(r << 4 | s for r in range(15) for s in range(1, 8))])}
    lookup = np.zeros(1 << 16, np.int32)
    for s, (c, n) in codes.items():
        lookup[c << 8 : c + 1 << 8] = n << 8 | s
    blocks = np.where(rng.random((12, 64)) < 0.25, rng.integers(-60, 60, (12, 64)), 0)
    first, refine = [], []
    for b in blocks:
        bits, run = "", 0
        now = np.sign(b) * (np.abs(b) >> 1)
        for k in range(1, 64):
            v = int(now[k])
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + f"{codes[0xF0][0]:08b}", run - 16
            size = abs(v).bit_length()
            if run == 15:
                bits, run = bits + f"{codes[0xF0][0]:08b}"[:0], run
            if run == 15:  # this code table has no run of 15 with a value
                return pytest.skip("run of 15")
            bits += f"{codes[run << 4 | size][0]:08b}" + format(v if v > 0 else v + (1 << size) - 1, f"0{size}b")
            run = 0
        if run:
            bits += f"{codes[0][0]:08b}"
        first.append(bits)
        bits, pending, run = "", "", 0
        tail = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        last_new = max(tail, default=0)
        for k in range(1, 64):
            v = int(b[k])
            if abs(v) > 1:
                pending += str(abs(v) & 1)
            elif v == 0 or k > last_new:
                run += 1
                if run == 16 and k <= last_new:
                    bits, pending, run = bits + f"{codes[0xF0][0]:08b}" + pending, "", 0
            else:
                bits += f"{codes[run << 4 | 1][0]:08b}" + ("1" if v > 0 else "0") + pending
                pending, run = "", 0
        bits += f"{codes[0][0]:08b}" + pending
        refine.append(bits)
    pack = lambda b: int((b + "1" * (-len(b) % 8)) or "0", 2).to_bytes(max(1, (len(b) + 7) // 8), "big")
    coefs = np.zeros((12, 64), np.int32)
    n = np.arange(12)
    fixed = lambda x: np.full(12, x)
    args = (n, fixed(1), fixed(1), fixed(63))
    media._ac_scans(coefs, [pack(b) for b in first], *args, fixed(1), fixed(0), lookup[None])
    assert (coefs[:, 1:] == (np.sign(blocks) * (np.abs(blocks) >> 1) * 2)[:, 1:]).all()
    media._ac_refinements(coefs, [pack(b) for b in refine], *args, fixed(0), fixed(0), lookup[None])
    assert (coefs[:, 1:] == blocks[:, 1:]).all()


def test_inverse_transform_is_exact():
    rng = np.random.default_rng(2)
    coefs = rng.integers(-255, 256, (9, 64))
    one = np.array([np.cos((2 * np.arange(8) + 1) * u * np.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)])
    natural = np.zeros((9, 64))
    natural[:, media.ZIGZAG] = coefs
    want = np.einsum("nuv,ux,vy->nxy", natural.reshape(9, 8, 8), one, one).reshape(9, 64)
    assert np.abs(coefs @ media.BASIS / (1 << 20) - want).max() < 0.02
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


# 10: lines


def brute_lines(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\v\f\r").translate(low)
    holders = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        for x in {key(line) for line in (t or "").split("\n")}:
            if len(x) >= min_chars:
                holders[x].append(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        mine = -(1 << 63) if i is None else i
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != mine)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("table_bytes", [lines.TABLE_BYTES, 0])
def test_lines_equal_brute_force(docs, odd, none, table_bytes):
    for df in (docs, odd):
        out = lines.without_repeated_lines(df, min_chars=20, min_docs=3, table_bytes=table_bytes)
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect())
        assert got == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()], 20, 3)
    assert lines.without_repeated_lines(none, table_bytes=table_bytes).count() == 0
    # ids of letters: the largest is the last in their order
    named = odd.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("d%05d", "doc_id")))
    out = lines.without_repeated_lines(named, min_chars=20, min_docs=3, table_bytes=table_bytes).collect()
    want = brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()], 20, 3)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in out) == sum((Counter({(None if k[0] is None else f"d{k[0]:05d}", *k[1:3]): n}) for k, n in want.items()), Counter())


def test_perfect_hash_has_a_place_for_each_key():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        h = lines.PerfectHash(keys)
        assert sorted(h.places(keys).tolist()) == list(range(len(keys))) and h.n == len(keys)
    high = np.array([1, 2, 3], np.uint64)
    shard = lines.Shard(high, np.array([7, 7, 9], np.uint64), np.array([5, 6, 7]), np.array([50, 60, 70]))
    hit, last = shard.find(np.array([1, 2, 3, 4], np.uint64), np.array([7, 7, 9, 7], np.uint64))
    assert hit.tolist() == [True, True, True, False] and last[:3].tolist() == [50, 60, 70]
