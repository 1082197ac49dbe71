"""Near-duplicate detection by MinHash with odd sketches, confirmed on full sets.

A document's set holds its distinct word shingles. One pass takes MinHash samples of the
set: bands of independent samples give bucket keys, and the ``BOTTOM`` least hashes are
folded into an odd sketch, a bitmap in which each sample flips a bit. Two sketches differ
in no more bits than their samples differ in elements, so a pair whose sketches differ
in more than the wanted similarity allows is no candidate, whatever buckets it shares.
For sets of at most ``BOTTOM`` shingles the samples are the sets and that bound is
strict; for larger ones it allows six standard deviations.

Documents with equal sets are one class from the start. Buckets never emit all their
pairs: in the first round each member is compared with the bucket's first member, links
are confirmed by the full sets and joined into components, and only buckets with members
of several components go on, with ever more members to compare with in
every round, until every pair of different components has been compared. No link is left
out by this, and a bucket whose members are all alike is done after one round. Large
buckets are dealt to slots, each of which gets the members to compare with; members with
many candidates are dealt likewise.

What may be missed is a pair that shares no band: less than one in a million at the
threshold and fewer above it.

Words are what stands between white space, with A-Z in lower case; a text with fewer
words than a shingle is one shingle; one without words has an empty set and is linked
with nothing. Null texts count as empty. Rows with one id are one document in the
result's terms; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import fresh, map_batches, materialize, texts

SAMPLES = 130
BOTTOM = 512
SKETCH_BITS = 1024
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
MISSED = 1e-6
CACHE_WORDS = 1 << 18
#: Pairs with one member that meet one copy of its set.
PAIRS_A_COPY = 4096
#: Members of a bucket that are compared in one slot, about.
SLOT = 256
GROWTH = 32


def band_rows(similarity: float) -> int:
    """The most samples a band can have so that a pair at the threshold shares a band all but surely."""
    fits = [r for r in range(1, 17) if (1 - similarity**r) ** (SAMPLES // r) <= MISSED]
    return max(fits, default=1)


def most_bits(least: Column, greatest: Column, similarity: float) -> Column:
    """Bits in which the sketches of two sets of these sizes can differ if they are similar enough.

    Similar sets differ in at most ``c`` of their sizes' sum. Samples of larger sets end at different hashes, too: the smaller set's samples reach
    further by what it is smaller.
    """
    c = (1 - similarity) / (1 + similarity)
    apart_by = c * (least + greatest)
    expected = apart_by * BOTTOM / greatest + BOTTOM * (1 - least / greatest)
    return F.when(greatest <= BOTTOM, apart_by + 1e-6).when(least <= BOTTOM, apart_by + (greatest - BOTTOM) + 1e-6).otherwise(expected + 6 * F.sqrt(expected) + 6)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLY = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
ADD = mixed(MULTIPLY + np.uint64(77))


class Shingler:
    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}
        self.factors = [np.uint64(int(f) | 1) for f in mixed(np.arange(101, 101 + words, dtype=np.uint64))]

    def _word(self, word: bytes) -> int:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.known[word] = h
        return h

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        own = np.array([known[w] if w in known else self._word(w) for w in words], np.uint64)
        n = len(own) - self.words + 1
        total = np.zeros(n, np.uint64)
        for k, f in enumerate(self.factors):
            total = mixed(total + own[k : k + n] * f)
        return np.unique(total)


def samples(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return least


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of the least hashes of a sorted set, as 64-bit words."""
    at = (mixed(shingles[:BOTTOM] ^ MULTIPLY[0]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    number = SAMPLES // rows
    grid = least[: number * rows].reshape(number, rows)
    key = np.arange(1, number + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return key


def signatures(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, body, n, high, low, sketch, bands) of rows (doc_id, text, body): size and 128-bit name of each document's set, and its sketch and bucket keys."""
    per_band = band_rows(similarity)

    def make():
        shingler = Shingler(words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, names, sketches, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingler.set_of(text)
                n.append(len(own))
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                if len(own):
                    least = samples(own)
                    sketches.append(odd_sketch(own))
                    keys.append(bands(least, per_band).view(np.int64))
                else:
                    sketches.append(np.zeros(len(SKETCH), np.uint64))
                    keys.append(np.zeros(0, np.int64))
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            sketch = np.array(sketches).view(np.int64)
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())]
            cols += [pa.array(sketch[:, k].copy()) for k in range(len(SKETCH))]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))))
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "body", "n", "high", "low", *SKETCH, "bands"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, body long, n long, high long, low long, {', '.join(f'{s} long' for s in SKETCH)}, bands array<long>")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(cls, high, low, shingles) of rows (cls, high, low, text), where the text has the named set."""

    def make():
        shingler = Shingler(words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [shingler.set_of(t) for t in batch.column(3).to_pylist()]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in own), np.int64).reshape(-1, 2)
            fits = pa.array((names[:, 0] == batch.column(1).to_numpy()) & (names[:, 1] == batch.column(2).to_numpy()))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], ["cls", "shingles"]).filter(fits)

        return step

    return map_batches(rows, make, "cls long, shingles array<long>")


def apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    total = F.lit(0)
    for s in SKETCH:
        total = total + F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    return total


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sets of members with many pairs are copied and their pairs dealt."""
    counted = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("long").alias("copies"))
    # only members with several copies; written, so that the join may be split where a member is hot
    copies = materialize(counted.filter("copies > 1"), "copies")
    dealt = pairs.join(copies, "a", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("b"), "copies"), F.lit(0))).select("a", "b", "copy")
    asked = pairs.select("a").distinct().join(copies, "a", "left").select("a", F.coalesce("copies", F.lit(1)).alias("copies"))
    first = sets.withColumnsRenamed({"cls": "a", "shingles": "left"}).join(asked, "a").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("a", "copy", "left")
    both = dealt.join(first, ["a", "copy"]).join(sets.withColumnsRenamed({"cls": "b", "shingles": "right"}), "b")
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - F.col("shared")
    return both.withColumn("shared", shared).filter(100 * F.col("shared") >= percent * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge (a, b); comp is the component's smallest node. Rounds of large and small stars until each node has one edge, to a node that has none down."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        # large stars: neighbours above a node move to the least node around it
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small stars: so do those below it, and it itself
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = materialize(small, "edges")
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        loose = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down = 1 AND up = 1")
        if loose.isEmpty():
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))


def linked(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows (doc_id, text, body), and (high, low, cls, rep, comp) of every set; comp is null for sets without a link."""
    similarity = percent / 100
    signed = materialize(signatures(rows, words, similarity).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n", *SKETCH, "bands")).alias("f")
    sets = signed.filter("n > 0").groupBy("high", "low").agg(first).select("high", "low", F.col("f.row").alias("cls"), F.col("f.doc_id").alias("rep"), *(F.col(f"f.{c}").alias(c) for c in ("n", *SKETCH, "bands")))
    classes = materialize(sets, "classes")

    members = classes.select("cls", F.xxhash64("cls").alias("u"), F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("u").alias("first"), F.sum(F.xxhash64("u").cast("decimal(38,0)")).alias("who")).filter("size > 1")
    # bands that gather the same members are one bucket
    buckets = buckets.groupBy("size", "first", "who").agg(F.min("bucket").alias("bucket"))
    buckets = materialize(buckets.select("bucket", "size", "first"), "buckets")
    facts = classes.select("cls", "n", *SKETCH)
    # merged, as adaptive execution splits a hot bucket there and not in a hash join
    inside = materialize(members.join(buckets.hint("merge"), "bucket").join(facts, "cls"), "bucket-members")
    active = inside.select("cls").distinct()
    wanted = classes.join(active, "cls", "left_semi").select("cls", "high", "low", "rep")
    held = rows.withColumnsRenamed({"doc_id": "own"}).join(wanted, F.col("own").eqNullSafe(F.col("rep"))).select("cls", "high", "low", "text")
    full = materialize(shingle_sets(held, words).dropDuplicates(["cls"]), "shingle-sets")

    comps = None
    done, most, turn = 0.0, (inside.agg(F.max("size")).first()[0] or 0), 0
    state = inside
    while most > 1:
        span = 2.0**64
        share = (F.col("u").cast("double") + F.lit(2.0**63)) / F.lit(span) * F.col("size")
        now = float(GROWTH**turn) if turn else 0.0
        picked = (F.col("u") == F.col("first")) if not turn else (F.col("u") != F.col("first")) & (share >= done) & ((share < now) | F.lit(now >= most))
        comp = F.coalesce(F.col("comp"), F.col("cls")) if comps is not None else F.col("cls")
        labelled = (state.join(comps.withColumnRenamed("node", "cls"), "cls", "left") if comps is not None else state).withColumn("of", comp)
        if turn:
            several = labelled.groupBy("bucket").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x <> y").select("bucket")
            several = materialize(several, "several")
            labelled = materialize(labelled.join(several.hint("merge"), "bucket", "left_semi"), "open-buckets")
            most = labelled.agg(F.max("size")).first()[0] or 0
            if most <= 1 or done >= most:
                break
            picked = (F.col("u") != F.col("first")) & (share >= done) & ((share < now) | F.lit(now >= most))
        slots = F.ceil(F.col("size") / SLOT).cast("long")
        x = labelled.filter(picked).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1))).alias("x")
        y = labelled.withColumn("slot", F.pmod(F.xxhash64("u"), slots)).alias("y")
        later = (F.col("x.u") < F.col("y.u")) if turn else (F.col("x.u") != F.col("y.u"))
        small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        sizes = 100 * small >= percent * large
        near = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.slot") == F.col("y.slot")) & later & (F.col("x.of") != F.col("y.of")) & sizes & (apart("x", "y") <= most_bits(small, large, similarity)))
        pairs = materialize(near.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), "candidates")
        new = materialize(confirmed(pairs, full, percent), "links")
        if not new.isEmpty():
            so_far = new if comps is None else new.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
            comps = materialize(components(so_far), "components")
        state = labelled.drop("of", "comp") if turn else state
        done, turn = max(now, 0.0), turn + 1
    found = classes.select("high", "low", "cls", "rep")
    if comps is None:
        return signed, found.withColumn("comp", F.lit(None).cast("long"))
    return signed, found.join(comps.withColumnRenamed("node", "cls"), "cls", "left")


def _near_rows(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body, n_shingles, component_id, kept) of every row; body: a hash of the text."""
    signed, found = linked(texts(docs, id_col, text_col).withColumn("body", F.xxhash64("text")), words, percent)
    found = found.withColumn("comp", F.coalesce("comp", "cls"))
    least = found.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = found.join(least, "comp").select("high", "low", "component_id")
    some = signed.filter("n > 0").join(named, ["high", "low"]).select("doc_id", "body", F.col("n").alias("n_shingles"), "component_id")
    none = signed.filter("n = 0").select("doc_id", "body", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; the component's smallest id is kept."""
    return _near_rows(docs, words, percent, id_col, text_col).drop("body")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of each component's smallest id and those without near duplicates, with all their columns."""
    found = _near_rows(docs, words, percent, id_col, text_col)
    id_name, body_name = fresh(docs, "gone_id", "gone_body")
    gone = materialize(found.filter(~F.col("kept")).select(F.col("doc_id").alias(id_name), F.col("body").alias(body_name)).distinct(), "near-copies")
    body = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(id_name)) & (body == F.col(body_name)), "left_anti")
