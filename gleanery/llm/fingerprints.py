"""Fingerprints of documents: threshold-scaled sketches.

A text's shingles are all its runs of ``SHINGLE`` bytes of UTF-8; a shorter text is one shingle, an
empty one has none. A sketch retains every distinct shingle hash below a
fixed fraction of all 64-bit numbers, ``1 / SCALE``, so its size follows the text's, and
whether a hash is retained depends on the shingle alone: the sketch of a union is the union of
the sketches (``merged``), and the share of a small document's sketch that a large one's holds
estimates how much of the small one stands in the large one, however unequal they are
(``containment``).
``likeness`` is that share for the smaller of two sketches; it is 0 where one is empty.

``neighbours`` sketches each document, an edited text whose end is taken from the next document,
and compares. The next document is the next in the order of ids. Ids are cut into ranges of
about equal size, whose first ids are known beforehand; each text is sent once to its range's
task, and the first of each range to the range before as well. A task reads its rows in order
and holds two of them. Rows of one id are in one range.

Null texts count as empty. A null id comes first; rows with one id stand in the order of
their texts. The last document's next is the first one, a lone document's it is itself. An
empty table gives no rows. The sketch of a text of few bytes may be empty; equal texts are
alike (1) all the same.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_batches, slices, texts

SHINGLE = 16
SCALE = 32
#: Shingles that are hashed at a time; the arrays of a step stay in the processor's cache.
STEP = 1 << 14
#: Fixed values of the hash: odd multipliers.
FIRST, SECOND, THIRD, FOURTH = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * SECOND
    x = (x ^ (x >> np.uint64(27))) * THIRD
    return x ^ (x >> np.uint64(31))


def least(data: bytes, scale: int = SCALE) -> np.ndarray:
    """The sketch of a text's bytes: sorted distinct 64-bit hashes below the threshold."""
    if not data:
        return np.zeros(0, np.uint64)
    limit = np.uint64((1 << 64) // scale)
    n = max(1, len(data) - SHINGLE + 1)
    padded = np.frombuffer(data.ljust(SHINGLE, b"\0"), np.uint8)
    short = np.uint64(min(len(data), SHINGLE))  # a short text isn't its padded form
    out = []
    for at in range(0, n, STEP):
        end = min(at + STEP, n)
        words = np.lib.stride_tricks.sliding_window_view(padded[at : end + SHINGLE - 1], 8).copy().view("<u8")[:, 0]
        half = words * FIRST
        half ^= half >> np.uint64(29)
        hashed = mixed(half[: end - at] * FOURTH + half[8 : 8 + end - at] + short)
        out.append(hashed[hashed < limit])
    return np.unique(np.concatenate(out))


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the other one holds."""
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def shown(sketch: np.ndarray) -> str:
    """A sketch as a string: base 64 of its little-endian numbers."""
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def sketches(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch) of every row; a sketch is a sorted array of hashes, as signed numbers."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [least(t.encode(), scale).view(np.int64) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(s) for s in own], pa.list_(pa.int64()))], ["doc_id", "sketch"])

        return step

    rows = texts(docs, id_col, text_col)
    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sketch array<bigint>")


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, sketch): the sketch of each group's union, of rows with a column ``sketch``. Hashes meet in partial sums; a group's sketch is one row."""
    hashes = rows.select(*(F.col(f"`{k}`") for k in keys), F.explode_outer("sketch").alias("hash")).distinct()
    return hashes.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.array_sort(F.collect_list("hash")).alias("sketch"))


def containment(part: Column, whole: Column) -> Column:
    """The estimated share of the first sketch's text that stands in the second's; null for an empty sketch."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def likeness(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other one holds; 0 if one is empty."""
    least_size = F.least(F.size(a), F.size(b))
    return F.when(least_size > 0, F.size(F.array_intersect(a, b)) / least_size).otherwise(F.lit(0.0))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many code points from the start of the following one, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def range_starts(ids: DataFrame) -> list:
    """The first ids of ranges of about as many rows each, one for each shuffle partition; nulls are below all."""
    spread = ids.repartitionByRange(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    firsts = spread.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first")).filter("first IS NOT NULL").collect()
    return sorted(r["first"] for r in firsts)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text), each range in one task and in order, with ``guest`` 0; behind them, with 1, what begins the next range."""
    starts = range_starts(rows.select("doc_id"))
    parts = max(1, len(starts))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, part, guest = [], [], []
            for r, i in enumerate(batch.column(0).to_pylist()):
                p = 0 if i is None else max(0, bisect.bisect_right(starts, i) - 1)
                places = [p, (p - 1) % parts] if i is None or i == starts[p] else [p]
                at += [r] * len(places)
                part += places
                guest += range(len(places))
            own = batch.take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(part, pa.int32()), pa.array(guest, pa.int32())], ["doc_id", "text", "part", "guest"])

        return step

    placed = map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, part int, guest int")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("guest", "doc_id", "text").drop("part")


def neighbours(docs: DataFrame, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    rows = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (id, text, sketch) of the row whose next one is still to come
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[tuple] = []
            for i, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and before is None:
                    break  # only the first of the next range counts
                own = least(text.encode(), scale)
                if before is not None:
                    out.append((before[0], *compared(before[1], before[2], text, own, scale)))
                before = None if guest else (i, text, own)
            if out:
                ids, *cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, kind) for c, kind in zip(cols, KINDS, strict=True))], NAMES)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(rows).mapInArrow(run, schema)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compared(text: str, sketch: np.ndarray, following: str, next_sketch: np.ndarray, scale: int) -> tuple:
    """What ``neighbours`` says of a text and the one that follows it."""
    other = edited(text, following)
    data = other.encode()
    changed = sketch if other == text else least(data, scale)
    near_next = 1.0 if following == text else likeness_of(sketch, next_sketch)
    return len(text), hashlib.sha256(data).hexdigest(), shown(sketch), shown(changed), 1.0 if other == text else likeness_of(sketch, changed), near_next
