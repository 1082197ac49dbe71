"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded by a byte-level tokenizer (A) and by a SentencePiece model (B); both see
a space and the text. Two tokens are linked if their byte ranges overlap. Groups, the least
stretches that both tokenizers cut out, are the components of those links, and are found by
pointer jumping: every token points to its farthest-right overlapping token, B before A of
those that end at one place, and itself where none reaches further. Replacing all successors
by their successors at once, until nothing changes, brings every token to its component's
terminal token, which labels the group. The arrays are of a whole batch of texts; a text ends
in a place where both tokenizers end, so no group spans two.

Each text's distinct pairs of linked ids are written with their numbers. How many documents
hold a pair is summed over the corpus, in partial sums first, and the highest count of each A
id is taken, at most one row an entry of A's vocabulary. To give the counts back to the texts,
the most frequent pairs, those of at least a power of two documents and ``HEAD`` pairs at most, are sent to
all tasks; the rest, of fewer documents each, are joined by a shuffle. That is the same at
every size; small corpora have no such rest.

A text that is null or empty, or whose tokens' bytes aren't the text's (one that has B's
marker, for instance), has no tokens, zeros, and an empty column of groups. Each row counts
as a document, repeated ones too. An empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.best_fit import SYMBOLS, Encoder
from gleanery.llm.common import map_batches, materialize, texts
from gleanery.llm.spm import BYTE, MARKER, Coder

#: Pairs that are sent to every executor at most, some 40 bytes each.
HEAD = 1 << 20
#: Distinct words whose pieces a worker remembers.
CACHE_WORDS = 1 << 20
#: A space beside other white space, where the tokenizers may cut elsewhere.
RUN = re.compile(r" \s|\s ")


class Tokens:
    """Ids of texts by both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Encoder(a_path)
        self.a.tok.encode_special_tokens = True  # their strings are plain text
        self.a.marks = []
        byte_of = {s: b for b, s in SYMBOLS.items()}
        entries = [self.a.tok.id_to_token(i) or "" for i in range(self.a.tok.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in entries]
        self.b = Coder(b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in self.b.model.pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def _checked(self, texts: list[bytes], a: list[bytes], b: list[bytes]) -> bool:
        """Whether each text's bytes are those of its tokens: all together, and each by its length."""
        want, sizes = b"".join(texts), np.array([len(t) for t in texts])
        for own, table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            ids = np.frombuffer(b"".join(own), "<u4")
            if b"".join(map(table.__getitem__, ids.tolist())) != want:
                return False
            ends = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum([len(o) // 4 for o in own])]
            if not np.array_equal(ends, np.cumsum(sizes)):
                return False
        return True

    def _learn(self, fresh: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Both tokenizers' ids of a space and a word; None if their bytes aren't these."""
        spaced = [" " + w for w in fresh]
        a = list(map(self.a._word, spaced))
        b = list(map(self.b.packed, self.b.peer.encode(fresh, num_threads=1)))
        whole = [s.encode() for s in spaced]
        fine = self._checked(whole, a, b)
        return {w: (x, y) if fine or self._checked([t], [x], [y]) else None for w, t, x, y in zip(fresh, whole, a, b, strict=True)}

    def both(self, rows: list[str]) -> list[tuple[bytes, bytes]]:
        """A's and B's ids of every text, as bytes of 32-bit numbers; none if their bytes aren't the text's.

        Both tokenizers cut before a single space, so texts are taken apart there and each word is encoded and checked when first met. Texts
        with longer runs of white space at a space, or with B's marker, are encoded and checked whole.
        """
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        out, cut, fresh = [(b"", b"")] * len(rows), [], set()
        for i, text in enumerate(rows):
            if not text:
                continue
            if not self.b.parts or text[0].isspace() or text[-1].isspace() or MARKER in text or "\0" in text or RUN.search(text):
                a, b = self.a.encode(" " + text), self.b.packed(self.b.peer.encode(text))
                if self._checked([(" " + text).encode()], [a], [b]):
                    out[i] = a, b
                continue
            words = text.split(" ")
            found = list(map(known.get, words))
            cut.append((i, words, found))
            if None in found:
                fresh.update([w for w, ids in zip(words, found, strict=True) if ids is None])
        mine = self._learn(list(fresh)) if fresh else {}
        known.update((w, ids) for w, ids in mine.items() if ids and len(w) <= 64)
        for i, words, found in cut:
            if None in found:
                found = [mine[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            if None not in found:
                out[i] = b"".join([ids[0] for ids in found]), b"".join([ids[1] for ids in found])
        return out


@lru_cache(maxsize=1)
def tokens(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The terminal token of every token of A, then of B, by pointer jumping; B's tokens are numbered behind A's. Both end at one place."""
    n = len(a_end)
    over = np.searchsorted(a_end, b_end)  # the A token that holds a B token's last byte
    own = np.arange(n, n + len(b_end))
    after = np.concatenate([n + np.searchsorted(b_end, a_end), np.where(a_end[over] > b_end, over, own)])
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after
        after = further


def shown_groups(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, names: list[bytes], n_a: int, n_b: int) -> tuple[list[bytes], np.ndarray]:
    """The parts of the groups' text in order, each an id and what stands behind it; and for every group the number of parts up to its end.

    ``names`` holds A's ids with a comma, then with a bar, then B's with a comma, then with a semicolon.
    """
    groups = int(b_group[-1]) + 1
    size_a, size_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    last_a, last_b = np.cumsum(size_a) - 1, np.cumsum(size_b) - 1
    a_code, b_code = a.copy(), b + 2 * n_a
    a_code[last_a] += n_a
    b_code[last_b] += n_b
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[a_group]] = a_code
    out[np.arange(len(b)) + np.cumsum(size_a)[b_group]] = b_code
    return list(map(names.__getitem__, out.tolist())), np.cumsum(size_a + size_b)


LINKED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row: its distinct pairs of linked ids, ``a * len(B) + b``, and their numbers.

    With ``groups`` also ``groups``, the text that is hashed.
    """

    def make():
        t = tokens(a_path, b_path)
        n_a, n_b = len(t.a_bytes), len(t.b_bytes)
        names = [b"%d%s" % (i, sep) for n, seps in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for sep in seps for i in range(n)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = t.both(batch.column(1).to_pylist())
            count_a, count_b = (np.array([len(f[k]) // 4 for f in found], np.int64) for k in (0, 1))
            a, b = (np.frombuffer(b"".join([f[k] for f in found]), "<u4").astype(np.int64) for k in (0, 1))
            n_groups = n_links = np.zeros(len(found), np.int64)
            pairs, times, ends = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(found), np.int64)
            texts_of = [b""] * len(found)
            if len(a):
                a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
                label = terminals(a_end, b_end)
                terminal = label[len(a) :] == np.arange(len(a), len(a) + len(b))
                number = np.cumsum(terminal) - 1
                a_group, b_group = number[label[: len(a)] - len(a)], number[label[len(a) :] - len(a)]
                group_doc = np.repeat(np.arange(len(found)), count_b)[terminal]
                n_groups = np.bincount(group_doc, minlength=len(found))
                parts, stops = shown_groups(a, b, a_group, b_group, names, n_a, n_b)
                begin = last = 0
                for d, k in enumerate(n_groups.tolist()):
                    if k:
                        last += k
                        texts_of[d] = b"".join(parts[begin : stops[last - 1]])[:-1]
                        begin = stops[last - 1]
                # each stretch between two ends, of either side, is where one A and one B token overlap
                at = np.sort(np.concatenate([a_end, b_end[~terminal]]))
                pair = a[np.searchsorted(a_end, at)] * n_b + b[np.searchsorted(b_end, at)]
                n_links = count_a + count_b - n_groups
                keys = np.sort(np.repeat(np.arange(len(found)), n_links) * (n_a * n_b) + pair)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                key = keys[first]
                pairs, times = key % (n_a * n_b), np.diff(np.append(first, len(keys))).astype(np.int32)
                ends = np.cumsum(np.bincount(key // (n_a * n_b), minlength=len(found)))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            cols = [
                batch.column(0),
                *(pa.array(c, pa.int64()) for c in (count_a, count_b, n_groups, n_links)),
                pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in texts_of]),
                pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
            ]
            more = [pa.array([g.decode() for g in texts_of])] if groups else []
            return pa.RecordBatch.from_arrays([*cols, *more], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])])

        return step

    rows = texts(docs, id_col, text_col)
    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {LINKED}" + ", groups string" * groups)


def pair_counts(held: DataFrame, b_entries: int) -> DataFrame:
    """(pair, documents, best): how many rows hold each pair, and whether that is the highest count of the pair's A id."""
    counts = materialize(held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "pair-counts")
    a_id = F.expr(f"pair div {b_entries}L")
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("documents").alias("highest"))  # a row for each entry of A's vocabulary at most
    found = counts.withColumn("a", a_id).join(F.broadcast(highest), "a")
    return materialize(found.select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best")), "pairs")


def frequent(pairs: DataFrame, most: int) -> tuple[int, int]:
    """The least power of two such that at most so many pairs are in that many documents; and how many pairs are in fewer."""
    sizes = {r["bits"]: r["n"] for r in pairs.groupBy(F.length(F.bin("documents")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bits, taken = 64, 0
    while bits > 1 and taken + sizes.get(bits - 1, 0) <= most:
        bits -= 1
        taken += sizes.get(bits, 0)
    return 1 << (bits - 1), sum(sizes.values()) - taken


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    import sentencepiece

    entries = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    held = materialize(linked(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "links", compression="zstd")
    pairs = pair_counts(held, entries)
    least, rest = frequent(pairs, head)
    links = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    met = links.join(F.broadcast(pairs.filter(F.col("documents") >= least)), "pair", "left")
    known = met.filter("documents IS NOT NULL").select("row", "times", "documents", "best")
    if rest:
        others = met.filter("documents IS NULL").select("row", "pair", "times").join(pairs.filter(F.col("documents") < least), "pair")
        known = known.unionByName(others.select("row", "times", "documents", "best"))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    own = held.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
