"""SentencePiece encoding and decoding with the ``tokenizers`` library as the engine.

The model file is a protobuf message; ``Model`` reads its wire format: pieces with scores
and kinds, the trainer's model type and byte fallback, the normaliser's rules. From that
``rebuilt`` makes a tokenizer: the normaliser (dummy prefix, runs of spaces, the marker for
a space), a unigram model with the pieces' scores or byte-pair merges in the order of
scores, byte fallback, and the decoder. Texts are encoded in batches by the library's
threads.

A piece has the marker at its start or is a run of markers, so texts can be taken apart
before single markers, and each distinct word is encoded once a worker. Texts with runs of
spaces, or with models whose pieces have inner markers, are encoded whole. Every text is
encoded whole by the ``sentencepiece`` library too, and ``parity`` says whether the ids are
equal. Decoding gives the normalised text back.

Null texts count as empty, which has no ids; an empty table gives no rows; repeated rows
give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import map_batches, texts

MARKER = "▁"
CACHE_WORDS = 1 << 20
#: Fixed values of the format: kinds of pieces, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in order; fixed and delimited values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix_whitespace: bool = False
    rules: bytes = b""
    rules_name: str = ""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                m.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                m.type, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                m.suffix_whitespace = bool(own.get(24, 0))
            elif number == 3:
                own = dict(fields(value))
                m.rules_name, m.rules = own.get(1, b"").decode(), own.get(2, b"")
                m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        m.unk_id = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
        return m


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Byte-pair merges in the order in which SentencePiece makes them: by the merged piece's score, the best first."""
    place = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    ranked = []
    for piece, i in place.items():
        own = [(place[piece[:k]], place[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in place and piece[k:] in place]
        ranked += [(-pieces[i][1], i, a, b) for _, _, a, b in sorted(own)]
    return [(a, b) for _, _, a, b in sorted(ranked, key=lambda r: r[:2])]


def rebuilt(model: Model):
    """A ``tokenizers`` tokenizer that encodes as the model says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.suffix_whitespace or not model.escape_whitespaces:
        raise ValueError("markers behind words, and models without markers, are not supported")
    if model.type == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback))
    elif model.type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges(model.pieces), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        raise ValueError("word and character models are not supported")
    steps = []
    if model.rules:
        steps.append(normalizers.Precompiled(model.rules))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    after = [decoders.Replace(MARKER, " ")] + ([decoders.ByteFallback()] if model.byte_fallback else []) + [decoders.Fuse()]
    tok.decoder = decoders.Sequence(after + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []))
    tok.add_special_tokens([])
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tok.add_tokens(own)
    return tok


class Coder:
    """Encodes and decodes texts, and compares with the reference library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = Model.parse(data)
        self.tok = rebuilt(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        shown = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)]
        #: whether a text may be cut before a marker that follows none
        self.parts = self.model.add_dummy_prefix and not self.model.rules and all(MARKER not in p.lstrip(MARKER) for p in shown) and not any(kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.piece_bytes = [self._bytes_of(p, kind) for p, _, kind in self.model.pieces]
        self.words: dict[str, bytes] = {}

    def _bytes_of(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARKER, " ").encode()

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, rows: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of whole texts by the library's threads, and whether the other library's are equal."""
        ids = [e.ids for e in self.tok.encode_batch_fast(rows, add_special_tokens=False)]
        peers = self.peer.encode(rows, num_threads=1) if rows else []
        return [(self.packed(a), a == b) for a, b in zip(ids, peers, strict=True)]

    def encode(self, rows: list[str]) -> list[tuple[bytes, bool]]:
        """(ids as little-endian 32-bit numbers, parity) of every text; an empty text has none."""
        out: list[tuple[bytes, bool]] = [(b"", True)] * len(rows)
        cut, whole, fresh, known = [], [], set(), self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for i, text in enumerate(rows):
            if text and self.parts and "  " not in text and text[0] != " " and text[-1] != " " and MARKER not in text and "\0" not in text:
                words = text.split(" ")
                found = list(map(known.get, words))
                cut.append((i, words, found))
                if None in found:
                    fresh.update([w for w, ids in zip(words, found, strict=True) if ids is None])
            elif text:
                whole.append(i)
        new = list(fresh)
        mine = {w: self.packed(e.ids) for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        known.update((w, ids) for w, ids in mine.items() if len(w) <= 64)
        peers = self.peer.encode([rows[i] for i, *_ in cut], num_threads=1) if cut else []
        for (i, words, found), peer in zip(cut, peers, strict=True):
            ids = b"".join([mine[w] if x is None else x for w, x in zip(words, found, strict=True)] if None in found else found)
            out[i] = (ids, ids == self.packed(peer))
        for i, v in zip(whole, self.whole([rows[i] for i in whole]), strict=True):
            out[i] = v
        return out

    def normalised(self, text: str) -> str:
        """What decoding gives: the normaliser's text, the marker a space, without the dummy prefix."""
        if not text:
            return ""
        if not self.model.rules and not self.model.remove_extra_whitespaces:
            return text.replace(MARKER, " ")
        shown = self.tok.normalizer.normalize_str(text).replace(MARKER, " ")
        return shown[1:] if self.model.add_dummy_prefix else shown

    def decode(self, ids: bytes) -> str:
        own = array("I")
        own.frombytes(ids)
        if sys.byteorder == "big":
            own.byteswap()
        table = self.piece_bytes
        text = b"".join([table[i] for i in own]).decode("utf-8", "replace")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_crc32, parity, decoded_sha256, round_trip) of every row.

    ``ids`` are little-endian 32-bit numbers; ``parity``: the other library gives the same ids;
    ``round_trip``: the decoded text is the normalised text.
    """

    def make():
        c = coder(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).to_pylist()
            out = c.encode(rows)
            back = [c.decode(ids) for ids, _ in out]
            cols = [
                batch.column(0),
                pa.array([len(ids) // 4 for ids, _ in out], pa.int64()),
                pa.array([ids for ids, _ in out], pa.binary()),
                pa.array([zlib.crc32(ids) for ids, _ in out], pa.int64()),
                pa.array([p for _, p in out], pa.bool_()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                pa.array([t == c.normalised(r) for t, r in zip(back, rows, strict=True)], pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "ids_crc32", "parity", "decoded_sha256", "round_trip"])

        return step

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, n_tokens long, ids binary, ids_crc32 long, parity boolean, decoded_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids as ``encoded`` gives them; null ids give a null text."""
    from pyspark.sql import functions as F

    def make():
        c = coder(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

        return step

    own = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return map_batches(own, make, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
