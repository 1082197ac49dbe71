"""Bounded-space online best-fit packing of token sequences.

Texts become token ids with one end id behind; ids longer than a sequence are cut
into whole sequences, with the remainder in front. The pieces, without their ids,
are dealt by hash into groups of about ``GROUP`` sequences' worth of tokens, so a
group fits a task at any size of the corpus. Within a group, pieces arrive in the order
of their ids and are placed for good as they come, two for each open bin at a time, of those the
longest first: each goes to the open bin with the least free space that holds it. Open bins are filed by free space, with one bit a level
in an integer: the lowest set bit at or above a length is the best fit. At most
``open_bins`` bins are open; when one more is needed, the fullest closes. A full bin
closes at once.

A null text is the empty text and packs as its end id; an empty table gives no rows;
repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_batches, materialize, texts

SEQUENCE = 2048
OPEN_BINS = 512
#: Sequences' worth of tokens in a group, many times the open bins; and pieces in a group, about, where they are that short.
GROUP, GROUP_PIECES = 8192, 1 << 20
#: Pieces that arrive together, for each open bin. One by one, short pieces come too early to fill the last gaps (0.9 % more sequences
#: than tokens need, instead of 0.1 %); with many more than there are open bins, bins close with large gaps (1.6 % at 8).
AT_ONCE = 2
#: Distinct words that a Python worker remembers before it starts anew.
CACHE_WORDS = 1 << 20
#: Below this code point, Python's classes of letters and numbers are the tokenizer's; words beyond it are left to the library's expression.
WELL_KNOWN = 0x250


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(WELL_KNOWN) if test(chr(c)))


SIMPLE = re.compile(f" [\\x21-\x84\x86-\x9f\xa1-{chr(WELL_KNOWN - 1)}]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_class(str.isalpha)}]+| ?[{_class(str.isnumeric)}]+| ?[^ {_class(lambda c: c.isalpha() or c.isnumeric())}]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is one, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


SYMBOLS = byte_symbols()


class Encoder:
    """Ids of whole texts, as bytes of little-endian 32-bit numbers.

    A byte-level tokenizer never joins what stands before a single space with that
    space and the word behind it, so texts are taken apart at single spaces and each
    distinct word is encoded once. Texts with longer runs of white space that this
    can't cut, and texts with special strings, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.pre, self.model = self.tok.pre_tokenizer, self.tok.model
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        if not SIMPLE.fullmatch(word):
            return self._bytes([t.id for piece, _ in self.pre.pre_tokenize_str(word) for t in self.model.tokenize(piece)])
        out, known = [], self.pieces
        for piece in PIECES.findall(word):
            if (ids := known.get(piece)) is None:
                if len(known) >= CACHE_WORDS // 4:
                    known.clear()
                ids = known[piece] = self._bytes([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(SYMBOLS))])
            out.append(ids)
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if any(m in text for m in self.marks):
            return self._whole(text)
        first, *rest = text.split(" ")
        known = self.words
        got = list(map(known.get, rest))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    word = rest[i]
                    if not word or word[0].isspace():
                        # the space before it belongs to a longer run if white space stands before that too, or nothing behind
                        before = rest[i - 1] if i else first
                        if not before or before[-1].isspace() or not word:
                            return self._whole(text)
                        ids = self._word(" " + word)
                    elif (ids := known.get(word)) is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        ids = self._word(" " + word)
                        if len(word) <= 64:
                            known[word] = ids
                    got[i] = ids
        return b"".join([self._word(first), *got])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of at most ``capacity`` ids; only the first of several may be shorter."""

    def make():
        enc = encoder(tokenizer_path)
        end = Encoder._bytes([end_id])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                whole = enc.encode(text) + end
                n = len(whole) // 4
                at, k, size = 0, 0, n % capacity or min(n, capacity)
                while at < n:
                    part = whole[4 * at : 4 * (at + size)]
                    rows.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    at, k, size = at + size, k + 1, capacity
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Bins:
    """Open bins of one size, by free space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.filed: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels, self.open, self.made = 0, 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin that takes the piece, and the place in it."""
        fit = self.levels >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.levels & -self.levels).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.filed[left].append(number)
            self.levels |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.filed[free].pop()
        if not self.filed[free]:
            self.levels &= ~(1 << free)
        self.open -= 1
        return number


def pack(pieces: DataFrame, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, group: int = GROUP, at_once: int = AT_ONCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any other columns); no piece may be longer than ``capacity``.

    ``at_once`` pieces for each open bin arrive together; with 0 each is placed as it comes, which is the online setting and loses more room.
    ``pieces`` is read twice; a table that is costly to make should be written first.
    """
    tokens, rows = pieces.agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, math.ceil((tokens or 0) / (group * capacity)), math.ceil(rows / group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        # the order of arrival, which must not depend on the shuffle
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length")])
        bins = Bins(capacity, open_bins)
        lengths = table["length"].to_numpy()
        placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
        step = max(1, at_once * open_bins)
        for at in range(0, len(lengths), step):
            for i in np.argsort(-lengths[at : at + step], kind="stable").tolist():
                placed[at + i] = bins.place(int(lengths[at + i]))
        base = table["_group"][0].as_py() << 36
        out = table.drop_columns(["_group"])
        out = out.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return out.append_column("offset", pa.array([at for _, at in placed], pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInArrow(run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity, open_bins)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, ids as bytes of little-endian 32-bit numbers. A sequence is at most ``capacity`` ids."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids=True), "pieces")
    placed = pack(pieces, capacity, open_bins)
    parts = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
