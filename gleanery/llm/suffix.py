"""Removal of byte strings that occur more than once, by refining suffix buckets.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in
the texts, the same text included. All starts are judged, by these steps:

1. Every start has an anchor: of the 64-grams inside its string, the one with the least
   hash, the leftmost of equals. Equal strings have equal anchors at equal places. An
   anchor's bucket is refined at once by the bytes beside it, which the string has too:
   those before it if it lies in the string's right half, else those behind it.
   Neighbouring starts with one bucket form a context, about every 120 bytes, and only
   its hashes leave the pass over the texts.
2. Buckets that occur once are done. Where all contexts of a bucket are equal, all
   their starts are repeated. The rest is undecided, one context for each distinct hash.
3. The bytes of undecided contexts are dealt by bucket and refined as a suffix array
   would be: buckets of 8-grams, then buckets by the bucket identifiers at later offsets,
   each refinement reused for the next, until a bucket means equal strings of ``length``
   bytes. Suffixes alone in their bucket drop out on the way, and the refinement is of
   bytes, not of hashes.
4. Buckets with very many contexts are split by hash. A part settles what it can and
   sends one hash for each of its strings, to be matched with the other parts'.
5. Repeated starts become spans, and a last pass over the texts cuts them out.

Rows are told apart by id and text, so rows with one id are separate documents. Null
texts count as empty; texts shorter than ``length`` lose nothing; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_batches, materialize, texts

LENGTH = 400
GRAM = 64
Q = 8
#: Bytes of texts that one step of the first pass looks at.
SLICE = 1 << 18
#: Bytes of texts whose contexts are found together.
SEGMENT = 1 << 22
#: Contexts of an anchor that are refined together, and bytes of a group of anchors, about.
PART, TASK_BYTES = 1000, 1 << 20

FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
POWER = np.uint64(0x5851F42D4C957F2D)
#: Times POWER it is 1, modulo 2 ** 64.
UNPOWER = np.uint64(pow(int(POWER), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FACTORS[3]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place, by doubling."""
    h = LETTERS[data]
    step = 1
    for f in FACTORS:
        h = h[:-step] * f + h[step:]
        step *= 2
    return mixed(h)


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def contexts_of(held: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, starts, bucket, hash) of every context: starts with one bucket, and a hash of all their bytes."""
    sizes = np.array([len(b) for b in held], np.int64)
    own = np.maximum(sizes - length + 1, 0)
    if not own.sum():
        return (np.zeros(0, np.int64),) * 5
    buffer = b"".join(held)
    data = np.frombuffer(buffer, np.uint8)
    grams = np.concatenate([gram_hashes(data[at : at + SLICE + GRAM - 1]) for at in range(0, len(data) - GRAM + 1, SLICE)])
    places = []
    for at in range(0, len(data) - length + 1, SLICE):
        part = grams[at : at + SLICE + length - GRAM]
        keys = part & np.uint64(0xFFFFFFFFFFF00000) | np.arange(len(part), dtype=np.uint64)
        places.append((least_of(keys, length - GRAM + 1) & np.uint64(0xFFFFF)).astype(np.int64) + at)
    place = np.concatenate(places)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.repeat(np.arange(len(held)), own)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own) + base[text]
    place = place[starts]
    half = (length - GRAM) // 2
    right = place - starts >= half
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (right[1:] != right[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin, place, right = starts[first], place[first], right[first]
    bucket = grams[place] * FACTORS[0] + right.astype(np.uint64)
    if half >= GRAM:
        beside = np.where(right, place - half, place + GRAM)
        for f, shift in zip(FACTORS[1:], (0, (half - GRAM) // 2, half - GRAM), strict=False):
            bucket = mixed(bucket + grams[beside + shift] * f)
    view = memoryview(buffer)
    digest = np.array([xxhash.xxh3_64_intdigest(view[s : s + n + length - 1]) for s, n in zip(begin.tolist(), count.tolist(), strict=True)], np.uint64)
    return text[first], begin - base[text[first]], count, bucket.view(np.int64), digest.view(np.int64)


def segments(held: list[str], length: int) -> list[tuple[list[int], list[int], list[bytes]]]:
    """Texts as bytes in groups of at most about SEGMENT: (rows, offsets, bytes). A longer text is cut into pieces that overlap by a string less a byte, so that every start is in one of them."""
    out: list[tuple[list[int], list[int], list[bytes]]] = []
    room = 0
    for row, text in enumerate(held):
        own = text.encode()
        for at in range(0, max(1, len(own) - length + 1), SEGMENT):
            piece = own[at : at + SEGMENT + length - 1]
            if not out or room < len(piece):
                out.append(([], [], []))
                room = SEGMENT + length
            rows, offsets, pieces = out[-1]
            rows.append(row)
            offsets.append(at)
            pieces.append(piece)
            room -= len(piece)
    return out


def find_contexts(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, body, start, starts, anchor, context) of rows (doc_id, text, body); anchor: the bucket."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = []
            for own, offsets, pieces in segments(batch.column(1).to_pylist(), length):
                text, start, count, anchor, digest = contexts_of(pieces, length)
                found.append((np.array(own)[text], start + np.array(offsets)[text], count, anchor, digest))
            row, start, count, anchor, digest = (np.concatenate([f[k] for f in found]) for k in range(5))
            if not len(row):
                return None
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(start), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(digest)], ["doc_id", "body", "start", "starts", "anchor", "context"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, body long, start long, starts int, anchor long, context long")


def refined(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Buckets of all suffixes by their first ``length`` bytes, Q at least; -1 where no other suffix has the same ones, or too few bytes are left.

    ``ends``: where each place's own string ends.
    """
    n = len(data)
    room = ends - np.arange(n)
    grams = np.zeros(n, np.uint64)
    for k in range(Q):
        grams[: n - k] = grams[: n - k] << np.uint64(8) | data[k:]
        if k:
            grams[n - k :] <<= np.uint64(8)
    bucket = np.full(n, -1, np.int64)
    active = np.flatnonzero(room >= Q)
    key = grams[active]
    depth = Q
    most = 64 // max(1, n.bit_length())
    while True:
        _, own, count = np.unique(key, return_inverse=True, return_counts=True)
        shared = count[own] > 1
        bucket[:] = -1
        bucket[active[shared]] = own[shared]
        active = active[shared]
        if depth == length or not len(active):
            return bucket
        # several later offsets at once, as many as identifiers fit one key
        wide = min(length, depth * most)
        active = active[room[active] >= wide]
        offsets = sorted({min(k * depth, wide - depth) for k in range(1, -(-wide // depth))})
        known = np.ones(len(active), bool)
        key = bucket[active].astype(np.uint64)
        for offset in offsets:
            later = bucket[active + offset]
            known &= later >= 0
            key = key << np.uint64(n.bit_length()) | later.astype(np.uint64)
        active, key = active[known], key[known]
        depth = wide


def powers_of(base: np.uint64, number: int) -> np.ndarray:
    out = np.full(number, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the string at each start, whatever data lie around it."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * powers_of(POWER, len(data)), dtype=np.uint64)])
    return mixed((sums[starts + length] - sums[starts]) * powers_of(UNPOWER, len(data))[starts])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of trues."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def settle(contexts: DataFrame, length: int, id_type: str) -> DataFrame:
    """Of contexts (group, anchor, split, copies, doc_id, body, start, starts, bytes): spans of repeated strings (doc_id, body, low, high), and for
    split anchors one row (anchor, hash, alone) for each string, with the span it would make."""

    def run(table: pa.Table) -> pa.Table:
        # the order of arrival must not matter
        table = table.sort_by([(c, "ascending") for c in ("anchor", "doc_id", "body", "start")])
        held = table["bytes"].to_pylist()
        data = np.frombuffer(b"".join(held), np.uint8)
        sizes = np.array([len(b) for b in held], np.int64)
        starts = table["starts"].to_numpy().astype(np.int64)
        base = np.cumsum(sizes) - sizes
        bucket = refined(data, np.repeat(base + sizes, sizes), length)
        row = np.repeat(np.arange(len(held)), starts)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = base[row] + inside
        several = bucket[at] >= 0
        again = several | (table["copies"].to_numpy() > 1)[row]
        begin = table["start"].to_numpy()
        # a run must not go on from one context to the next
        gap = np.insert(again, np.cumsum(starts)[:-1], False)
        of = np.insert(row, np.cumsum(starts)[:-1], -1)
        place = np.insert(inside, np.cumsum(starts)[:-1], -1)
        lo, hi = runs(gap)
        rows, low, high = of[lo], place[lo] + begin[of[lo]], place[hi] + begin[of[lo]] + length
        none = np.zeros(len(rows), np.int64)
        anchor, digest, alone, final = none, none, np.zeros(len(rows), bool), np.ones(len(rows), bool)
        split = table["split"].to_numpy(zero_copy_only=False)[row]
        if split.any():
            # one row for each string: the first of those that are equal here
            pick = np.flatnonzero(split)
            own = np.where(several[pick], bucket[at[pick]], len(data) + pick)
            _, first = np.unique(own, return_index=True)
            pick = pick[first]
            rows = np.concatenate([rows, row[pick]])
            low = np.concatenate([low, begin[row[pick]] + inside[pick]])
            high = np.concatenate([high, begin[row[pick]] + inside[pick] + length])
            anchor = np.concatenate([anchor, table["anchor"].to_numpy()[row[pick]]])
            digest = np.concatenate([digest, string_hashes(data, at[pick], length).view(np.int64)])
            alone = np.concatenate([alone, ~again[pick]])
            final = np.concatenate([final, np.zeros(len(pick), bool)])
        taken = pa.array(rows)
        return pa.table({"doc_id": table["doc_id"].take(taken), "body": table["body"].take(taken), "low": pa.array(low), "high": pa.array(high), "anchor": pa.array(anchor), "hash": pa.array(digest), "alone": pa.array(alone), "final": pa.array(final)})

    return contexts.groupBy("group").applyInArrow(run, f"doc_id {id_type}, body long, low long, high long, anchor long, hash long, alone boolean, final boolean")


def same_row(a: str = "doc_id", b: str = "of_id") -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col("body") == F.col("of_body"))


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, body, low, high): bytes covered by repeated strings, of rows (doc_id, text, body); spans may overlap."""
    if length < GRAM + Q:
        raise ValueError(f"strings must have {GRAM + Q} bytes at least")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = materialize(find_contexts(rows, length), "contexts")
    counted = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    # written by itself: a stage that only joins may be split where an anchor is hot
    often = materialize(counted.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("open")), "anchors")
    again = materialize(found.join(often, "anchor"), "repeated-anchors")
    whole = lambda df: df.select("doc_id", "body", F.col("start").alias("low"), (F.col("start") + F.col("starts") + (length - 1)).alias("high"))
    spans = whole(again.filter(~F.col("open")))
    undecided = again.filter("open")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body", "start", "starts")).alias("f")
    classes = materialize(undecided.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), first).select("anchor", "context", "copies", "f.doc_id", "f.body", "f.start", "f.starts"), "context-classes")
    several = materialize(classes.filter("copies > 1").select("anchor", "context"), "repeated-contexts")
    spans = spans.unionByName(materialize(whole(undecided.join(several, ["anchor", "context"], "left_semi")), "repeated-spans"))

    parts = materialize(classes.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts")).filter("parts > 1"), "anchor-parts")
    total = classes.agg(F.sum(F.col("starts") + (length - 1))).first()[0] or 0
    groups = max(1, math.ceil(total / TASK_BYTES))
    dealt = classes.join(parts, "anchor", "left").withColumn("split", F.col("parts").isNotNull()).withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("group", F.pmod(F.xxhash64("anchor", F.pmod("context", "parts")), F.lit(groups)))
    wanted = dealt.groupBy(F.col("doc_id").alias("of_id"), F.col("body").alias("of_body")).agg(F.collect_list(F.struct("group", "anchor", "split", "copies", "start", "starts")).alias("wanted"))
    held = rows.join(wanted, same_row()).select("doc_id", "body", F.encode("text", "UTF-8").alias("bytes"), F.explode("wanted").alias("w"))
    context = F.substring(F.col("bytes"), F.col("w.start").cast("int") + 1, F.col("w.starts") + (length - 1))
    cut = held.select("w.group", "w.anchor", "w.split", "w.copies", "doc_id", "body", "w.start", "w.starts", context.alias("bytes"))
    settled = materialize(settle(cut, length, id_type), "settled")
    spans = spans.unionByName(settled.filter("final").select("doc_id", "body", "low", "high"))
    strings = settled.filter(~F.col("final"))
    met = strings.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "hash")
    return spans.unionByName(strings.filter("alone").join(met, ["anchor", "hash"], "left_semi").select("doc_id", "body", "low", "high"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, removed]) of every row; ``kept`` are the bytes that stay, ``removed`` the runs (low, high) that went."""
    rows = texts(docs, id_col, text_col).withColumn("body", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(rows, length)
    gathered = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("body").alias("of_body")).agg(F.collect_list(F.col("low")).alias("low"), F.collect_list(F.col("high")).alias("high"))
    joined = rows.join(gathered, same_row(), "left").select("doc_id", "text", "low", "high")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, low, high in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own = text.encode()
                gone = united(list(zip(low, high, strict=True))) if low else []
                at, left = 0, []
                for a, b in gone:
                    left.append(own[at:a])
                    at = b
                kept = b"".join([*left, own[at:]])
                out.append((len(own), len(own) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, gone))
            cols = [batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                cols += [pa.array([o[4] for o in out], pa.binary()), pa.array([[{"low": a, "high": b} for a, b in o[5]] for o in out], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))]
                names += ["kept", "removed"]
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(joined, make, schema + ", kept binary, removed array<struct<low: bigint, high: bigint>>" * with_bytes)
