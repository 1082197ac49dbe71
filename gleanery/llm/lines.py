"""Removal of lines that many documents share.

A line's key is the line without white space at both ends, with A-Z in lower case. One
pass gives a 128-bit hash of every long key once a document; Spark counts the documents
and takes the largest id of each, with sums made before the shuffle, and keeps the keys
of enough documents. Those are dealt into shards. Each shard gets a minimal perfect
hash: levels of bit arrays in which a key that falls alone on a bit stays, and the
number of bits before it is its place in the arrays of fingerprints (the other half of
the hash), counts and last documents. A second pass over the documents probes the
arrays; no line is joined.

Where all shards together fit ``TABLE_BYTES``, which is checked, they are broadcast.
Where they don't, the line hashes go to the shards: each shard is copied once for every
``PROBES`` hashes that ask for it, so that no frequent line fills a task.

Each row counts as a document. Null texts count as empty, which is one empty line. Ids
may be of any type that has an order; a null id is below all others. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_batches, materialize, texts

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 16
MOST_SHARDS = 1 << 16
#: Bytes of all shards up to which they are sent to every executor.
TABLE_BYTES = 64 << 20
#: Line hashes that meet one copy of a shard in a task, about.
PROBES = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def id_array(ids: list) -> np.ndarray:
    """Ids of any type; null is None."""
    out = np.empty(len(ids), object)
    out[:] = ids
    return out


def line_hashes(text: str, min_chars: int) -> list[tuple[int, int]]:
    """(line number, 128-bit hash) of the lines whose keys are long enough."""
    out = []
    for i, line in enumerate(text.encode().lower().split(b"\n")):  # bytes.lower() changes A-Z alone
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                out.append((i, xxhash.xxh3_128_intdigest(key)))
    return out


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit halves, the upper one first."""
    raw = b"".join(h.to_bytes(16, "little") for h in hashes)
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 1].copy(), both[:, 0].copy()


class PerfectHash:
    """Places of a set of 64-bit keys, one for each and none left over; any other key gets some place or none."""

    LEVELS = 24

    def __init__(self, keys: np.ndarray) -> None:
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.n = 0
        left = keys
        for level in range(self.LEVELS):
            if not len(left):
                break
            words = max(1, math.ceil(2 * len(left) / 64))
            at = self._at(left, level, words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words)[at] == 1
            row = np.zeros(words, np.uint64)
            np.bitwise_or.at(row, at[alone] >> np.uint64(6), np.uint64(1) << (at[alone] & np.uint64(63)))
            ones = np.bitwise_count(row).astype(np.int64)
            self.bits.append(row)
            self.ranks.append(self.n + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.n += int(ones.sum())
            left = left[~alone]
        self.rest = np.unique(left)  # those that no level could part
        self.n += len(self.rest)

    @staticmethod
    def _at(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) % np.uint64(64 * words)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """-1: surely not of the set."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (row, rank) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(open_):
                break
            at = self._at(keys[open_], level, len(row))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (row[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(row[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[here]] = (rank[word] + below)[here]
            open_ = open_[~here]
        if len(open_) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            out[open_[hit]] = self.n - len(self.rest) + i[hit]
        return out


class Shard:
    """The frequent lines of a shard: fingerprint, number of documents and last document by perfect hash."""

    def __init__(self, high: np.ndarray, low: np.ndarray, docs: np.ndarray, last: np.ndarray) -> None:
        # keys with one lower half (never seen) can't be told apart by place: all but the first are listed
        _, first = np.unique(low, return_index=True)
        twins = np.setdiff1d(np.arange(len(low)), first)
        self.twins = {(int(high[i]), int(low[i])): (int(docs[i]), last[i]) for i in twins}
        self.hash = PerfectHash(low[first])
        at = self.hash.places(low[first])
        self.prints, self.docs, self.last = np.zeros(self.hash.n, np.uint64), np.zeros(self.hash.n, np.uint32), np.empty(self.hash.n, last.dtype)
        self.prints[at], self.docs[at], self.last[at] = high[first], np.minimum(docs[first], 0xFFFFFFFF), last[first]

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is one of the frequent, and the last document of those that are."""
        hit, last = np.zeros(len(low), bool), np.empty(len(low), self.last.dtype)
        if self.hash.n:
            at = self.hash.places(low)
            hit = (at >= 0) & (self.prints[np.maximum(at, 0)] == high)
            last[hit] = self.last[at[hit]]
        for (h, lo), (_, end) in self.twins.items():
            twin = (high == np.uint64(h)) & (low == np.uint64(lo))
            hit, last[twin] = hit | twin, end
        return hit, last


def id_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def frequent_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(high, low, docs, last) of every line key that at least ``min_docs`` rows hold, by its hash."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            at, hashes = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                own = {h for _, h in line_hashes(text, min_chars)}
                at += [r] * len(own)
                hashes += own
            if not at:
                return None
            high, low = halves(hashes)
            return pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column(0).take(pa.array(at))], ["high", "low", "doc_id"])

        return step

    hashed = map_batches(rows, make, f"high long, low long, doc_id {id_type(rows)}")
    counted = hashed.groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
    return counted.filter(F.col("docs") >= min_docs)


def shards(frequent: DataFrame) -> tuple[DataFrame, int]:
    """(shard, table) with a pickled Shard each, and how many shards there are."""
    number = min(MOST_SHARDS, max(1, math.ceil(frequent.count() / SHARD_KEYS)))

    def build(table: pa.Table) -> pa.Table:
        high, low = (table[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        last = table["last"]
        # whole numbers without a null need no objects
        plain = pa.types.is_integer(last.type) and not last.null_count
        made = Shard(high, low, table["docs"].to_numpy(), last.to_numpy().astype(np.int64) if plain else id_array(last.to_pylist()))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "table": pa.array([pickle.dumps(made)], pa.binary())})

    dealt = frequent.withColumn("shard", F.pmod("high", F.lit(number).cast("long")))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, table binary"), number


def _find(tables: dict[int, Shard], number: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hit, last = np.zeros(len(high), bool), np.empty(len(high), object)
    of = high.view(np.int64) % number  # as pmod
    for shard in np.unique(of):
        if (table := tables.get(int(shard))) is not None:
            mine = np.flatnonzero(of == shard)
            hit[mine], last[mine] = table.find(high[mine], low[mine])
    return hit, last


def _cut(text: str, dropped: set[int]) -> tuple[str, int]:
    lines = text.split("\n")
    return ("\n".join(line for i, line in enumerate(lines) if i not in dropped) if dropped else text), len(lines)


def _probe_broadcast(rows: DataFrame, tables: DataFrame, number: int, min_chars: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["table"])) for r in tables.collect()])

    def make():
        own = {k: pickle.loads(t) for k, t in sent.value}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, line, hashes = [], [], []
            for r, text in enumerate(held):
                for i, h in line_hashes(text, min_chars):
                    at.append(r)
                    line.append(i)
                    hashes.append(h)
            dropped: dict[int, set[int]] = {}
            if hashes:
                hit, last = _find(own, number, *halves(hashes))
                for k in np.flatnonzero(hit).tolist():
                    if last[k] != ids[at[k]]:
                        dropped.setdefault(at[k], set()).add(line[k])
            cut = [_cut(text, dropped.get(r, set())) for r, text in enumerate(held)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in cut], pa.string()), pa.array([n for _, n in cut], pa.int64()), pa.array([len(dropped.get(r, ())) for r in range(len(held))], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

        return step

    return map_batches(rows, make, f"doc_id {id_type(rows)}, text string, n_lines long, n_dropped long")


def _probe_routed(rows: DataFrame, tables: DataFrame, number: int, min_chars: int) -> DataFrame:
    keyed = rows.withColumn("body", F.xxhash64("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            at, line, hashes = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                for i, h in line_hashes(text, min_chars):
                    at.append(r)
                    line.append(i)
                    hashes.append(h)
            if not at:
                return None
            high, low = halves(hashes)
            rows_at = pa.array(at)
            return pa.RecordBatch.from_arrays([batch.column(0).take(rows_at), batch.column(2).take(rows_at), pa.array(line, pa.int32()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], ["doc_id", "body", "line", "high", "low"])

        return step

    kind = id_type(rows)
    probes = map_batches(keyed, make, f"doc_id {kind}, body long, line int, high long, low long").withColumn("shard", F.pmod("high", F.lit(number).cast("long")))
    probes = materialize(probes, "line-probes")
    asked = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("long").alias("copies"))  # MOST_SHARDS rows at most
    asked = materialize(asked, "line-copies")
    dealt = probes.join(F.broadcast(asked), "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "body", "line"), "copies"))
    copies = tables.join(F.broadcast(asked), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    def probe(mine: pa.Table, table: pa.Table) -> pa.Table:
        if not table.num_rows or not mine.num_rows:
            return mine.select(["doc_id", "body", "line"]).slice(0, 0)
        own = pickle.loads(table["table"][0].as_py())
        high, low = (mine[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        hit, last = own.find(high, low)
        at = np.flatnonzero(hit)
        ids = mine["doc_id"].take(pa.array(at)).to_pylist()
        gone = [i for i, doc, end in zip(at.tolist(), ids, last[at].tolist(), strict=True) if doc != end]
        return mine.select(["doc_id", "body", "line"]).take(pa.array(gone, pa.int64()))

    hits = dealt.drop("copies").groupBy("shard", "copy").cogroup(copies.drop("copies").groupBy("shard", "copy")).applyInArrow(probe, f"doc_id {kind}, body long, line int")
    drops = hits.groupBy("doc_id", "body").agg(F.collect_set("line").alias("drops")).select(F.col("doc_id").alias("of"), F.col("body").alias("of_body"), "drops")
    joined = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("body") == F.col("of_body")), "left")

    def cutting():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            gone = [set(d or ()) for d in batch.column(2).to_pylist()]
            cut = [_cut(text, d) for text, d in zip(batch.column(1).to_pylist(), gone, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in cut], pa.string()), pa.array([n for _, n in cut], pa.int64()), pa.array([len(d) for d in gone], pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

        return step

    return map_batches(joined.select("doc_id", "text", "drops"), cutting, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row: its text without repeated lines, how many lines it had and how many went."""
    rows = texts(docs, id_col, text_col)
    frequent = materialize(frequent_lines(rows, min_chars, min_docs), "frequent-lines")
    built, number = shards(frequent)
    tables = materialize(built, "line-shards")
    size = tables.agg(F.sum(F.length("table"))).first()[0] or 0
    probe = _probe_broadcast if size <= table_bytes else _probe_routed
    return probe(rows, tables, number, min_chars)
