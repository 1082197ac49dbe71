"""Exact token counts of every prefix of a text, without encoding any prefix.

Byte-pair encoding has one useful property: a sequence of tokens is the encoding of
its text exactly if each two neighbours are the encoding of their own text. So the
last token of every prefix is unique, and it is the longest-first candidate that is
compatible with the last token of the prefix before it. A table over the prefixes
then holds ``count[i] = count[i - len(last)] + 1``. With an end-of-word marker, the
token that ends a prefix comes from the marked part of the vocabulary while all
before it come from the plain part; two tables answer both.

Words are counted apart, so the table of a text is made of its words' tables, each
shifted by the last entries before it. A worker stores the table of every word it meets;
a text's count is the last entry of its own table, and where a budget is spent is read
in the one word's table that reaches it. ``counts`` writes a text's table out.

Positions are code points of the text after NFC, white space included: the count at
position i is the number of tokens of the first i code points. Null texts count as
empty; an empty text has no tokens; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.best_fit import SYMBOLS
from gleanery.llm.common import map_batches, texts

#: Distinct words that a Python worker remembers before it starts anew.
CACHE_WORDS = 1 << 19
#: Characters that Python counts as white space and the tokenizer's expressions don't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WORD = re.compile(r"\S+")
#: Fixed values of the tokenizer's word expression.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Below this code point, Python's classes of letters and numbers are the expression's; beyond it the library is asked.
WELL_KNOWN = 0x250


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(WELL_KNOWN) if test(chr(c)))


SIMPLE = re.compile(f"[\\x21-{chr(WELL_KNOWN - 1)}]+")
PIECES = re.compile(f"{'|'.join(CONTRACTIONS)}|[{_class(str.isalpha)}]+|[{_class(str.isnumeric)}]|[^{_class(lambda c: c.isalpha() or c.isnumeric())}]+")


class PairTable:
    """Which tokens of a merge table may stand next to each other."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.suffix = suffix
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for n, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[a, b] = n
            self.parts.setdefault(a + b, (a, b, n))
        self.known: dict[int, bool] = {}
        self.text = {n: t for t, n in vocab.items()}
        plain = {t: n for t, n in vocab.items() if not t.endswith(suffix)}
        marked = {t[: -len(suffix)]: n for t, n in vocab.items() if t.endswith(suffix)}
        # finds, for each end in a word, the tokens that end there, longest first
        self.ending_at = ahocorasick.Automaton()
        for t in plain.keys() | marked.keys():
            if t:
                self.ending_at.add_word(t, (len(t), plain.get(t, -1), marked.get(t, -1)))
        self.ending_at.make_automaton()

    def fits(self, pair: int) -> bool:
        """True if the encoding of both tokens' text, first token in the upper half, is the two tokens themselves."""
        if len(self.known) > 1 << 20:
            self.known.clear()
        fit = self.known[pair] = self._fits(self.text[pair >> 32], self.text[pair & 0xFFFFFFFF])
        return fit

    def _fits(self, a: str, b: str) -> bool:
        """Undoes the later of the two tokens' last merges, again and again; they don't fit if a merge across the border would have come first."""
        rank, parts = self.rank, self.parts
        limit, inclusive = 1 << 60, False
        while True:
            across = rank.get((a, b))
            if across is not None and (across < limit or inclusive and across == limit):
                return False
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[2] > right[2]:
                a, limit, inclusive = left[1], left[2], False
            else:
                # of merges with one rank the leftmost comes first, so one across the border comes before the right token's own
                b, limit, inclusive = right[0], right[2], True

    def prefix_counts(self, word: str) -> list[int]:
        """For every prefix of a word in byte symbols, the empty one first, the number of tokens it is encoded to as a word of its own."""
        known, fits, n = self.known, self.fits, len(word) + 1
        last, plain, out = [-1] * n, [0] * n, [0] * n
        for end, (size, inner, ending) in self.ending_at.iter(word):
            end += 1
            if (want := last[end] < 0) or not out[end]:
                if start := end - size:
                    before = last[start] << 32
                    if ending >= 0 and not out[end]:
                        ok = known.get(before | ending)
                        if ok or ok is None and fits(before | ending):
                            out[end] = plain[start] + 1
                    if want and inner >= 0:
                        ok = known.get(before | inner)
                        if ok or ok is None and fits(before | inner):
                            last[end] = inner
                            plain[end] = plain[start] + 1
                else:
                    if ending >= 0:
                        out[end] = 1
                    if inner >= 0:
                        last[end] = inner
                        plain[end] = 1
        if not all(out[1:]):
            raise ValueError(f"a prefix of {word!r} has no encoding")
        return out


class PrefixCounter:
    """Token counts at every prefix under a tokenizer of words with an end marker (a ``tokenizers`` file)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.pairs = PairTable(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)))
        self.marks = special
        self.totals: dict[str, int] = {}
        self.tables: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        """Counts at the code point ends of one pre-token, which the library gives in byte symbols."""
        if (got := self.words.get(piece)) is None:
            if len(self.words) > CACHE_WORDS // 4:
                self.words.clear()
            got = self.words[piece] = self.pairs.prefix_counts(piece)
        return got

    def _symbols(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tok.pre_tokenizer.pre_tokenize_str(text)

    def _ends(self, piece: str, raw: str) -> list[int]:
        """Counts at the ends of raw's code points."""
        table = self._piece(piece)
        if len(piece) == len(raw):
            return table[1:]
        out, at = [], 0
        for c in raw:
            at += len(c.encode())
            out.append(table[at])
        return out

    def _chunk(self, chunk: str) -> list[int]:
        """Counts at every prefix of a text without white space, in NFC, the empty prefix left out."""
        plain = chunk.isascii() and chunk.isprintable()  # no U+007F, whose symbol is another character
        if plain or SIMPLE.fullmatch(chunk) and "\u0130" not in chunk:
            low = chunk.lower()
        else:
            low = self.tok.normalizer.normalize_str(chunk)
        if plain:
            pieces = [(m, m) for m in PIECES.findall(low)]
        elif SIMPLE.fullmatch(low):  # a letter's lower case may lie beyond
            pieces = [(m, m.encode().decode("latin-1").translate(SYMBOLS)) for m in PIECES.findall(low)]
        else:
            pieces = [(low[start:end], piece) for piece, (start, end) in self._symbols(low)]
        at: list[int] = []
        done = 0
        for raw, piece in pieces:
            if raw in CONTRACTIONS:
                for j in range(1, len(raw) + 1):
                    at.append(done + sum(self._piece(p)[-1] for p, _ in self._symbols(raw[:j])))
            else:
                ends = self._ends(piece, raw)
                at += [done + n for n in ends] if done else ends
            done = at[-1]
        if len(low) == len(chunk):
            return at
        # a letter that is several in lower case
        out, end = [], 0
        for c in chunk:
            end += len(c.lower())
            out.append(at[min(end, len(at)) - 1])
        if end != len(low):
            raise ValueError(f"lower case of {chunk!r} differs")
        return out

    def _table(self, chunk: str) -> bytes:
        """The chunk's counts as 32-bit numbers, remembered."""
        if len(self.tables) >= CACHE_WORDS:
            self.tables.clear()
            self.totals.clear()
        counts = array("i", self._chunk(chunk))
        self.totals[chunk] = counts[-1]
        if len(chunk) <= 64:
            self.tables[chunk] = counts.tobytes()
        return counts.tobytes()

    def _plain(self, text: str) -> int:
        chunks = text.split()
        totals = self.totals
        try:
            return sum(map(totals.__getitem__, chunks))
        except KeyError:
            total = 0
            for c in chunks:
                n = totals.get(c)
                if n is None:
                    n = np.frombuffer(self._table(c), np.int32)[-1]
                total += int(n)
            return total

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and those strings, which are one token each."""
        if not any(m in text for m in self.marks):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def composed(self, text: str) -> str:
        """The text in NFC, special strings as they are."""
        if text.isascii() or unicodedata.is_normalized("NFC", text):
            return text
        return "".join(p if mark else unicodedata.normalize("NFC", p) for p, mark in self._parts(text))

    def count(self, text: str) -> int:
        """The count at the last prefix."""
        total = 0
        for part, mark in self._parts(self.composed(text)):
            total += 1 if mark else self._odd(part)[-1] if ODD_SPACE.search(part) else self._plain(part)
        return total

    def within(self, text: str, budget: int) -> int:
        """The most code points from the start, in NFC, whose own encoding has at most ``budget`` tokens: by the words' stored tables."""
        best, at, done = 0, 0, 0
        for part, mark in self._parts(self.composed(text)):
            if mark or ODD_SPACE.search(part):
                # until it is complete, a special string is ordinary text
                table = np.array(self._odd(part), np.int32) + done
                if mark:
                    table[-1] = done + 1
                fits = np.flatnonzero(table <= budget)
                best = at + int(fits[-1]) if len(fits) else best
                done = int(table[-1])
            else:
                for m in WORD.finditer(part):
                    if done <= budget:
                        best = at + m.start()  # white space in front adds nothing
                    # words before the budget's end are passed over by their totals
                    total = self.totals.get(m[0])
                    if total is None or done + total > budget:
                        table = np.frombuffer(self.tables.get(m[0]) or self._table(m[0]), np.int32)
                        fits = np.flatnonzero(done + table <= budget)
                        best = at + m.start() + int(fits[-1]) + 1 if len(fits) else best
                        total = int(table[-1])
                    done += total
                    if done <= budget:
                        best = at + m.end()
                    elif done - total >= budget:
                        return best
                if done <= budget:
                    best = at + len(part)
            at += len(part)
        return best

    def _odd(self, text: str) -> list[int]:
        """Counts at every prefix of a text whose control characters Python takes for white space; the empty prefix comes first."""
        out = [0]
        for piece in re.split(r"([^\S\x1c-\x1f]+)", text):
            if not piece:
                continue
            out += [out[-1]] * len(piece) if re.fullmatch(r"[^\S\x1c-\x1f]+", piece) else [out[-1] + n for n in self._chunk(piece)]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Counts at every prefix of the text in NFC, the empty one first."""
        out = [np.zeros(1, np.int32)]
        done = 0
        for part, mark in self._parts(text):
            if mark:
                # until it is complete, a special string is ordinary text
                seen = np.array(self._odd(part)[1:], np.int32)
                seen[-1] = 1
            else:
                seen = np.array(self._odd(unicodedata.normalize("NFC", part))[1:], np.int32)
            if len(seen):
                out.append(seen + done)
                done = int(out[-1][-1])
        return np.concatenate(out)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False, budget: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; with ``prefixes`` also ``prefix_counts``, an array with the count at every prefix;
    with a ``budget`` of tokens also ``n_within``, the most code points from the start (in NFC) whose own encoding keeps within it.

    The last entry of the table over the prefixes is the count of the whole text.
    """

    def make():
        c = counter(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).to_pylist()
            cols = [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if prefixes:
                tables = [c.counts(t) for t in rows]
                cols += [pa.array([int(t[-1]) for t in tables], pa.int64()), pa.array(tables, pa.list_(pa.int32()))]
                names.append("prefix_counts")
            else:
                cols.append(pa.array([c.count(t) for t in rows], pa.int64()))
            if budget is not None:
                cols.append(pa.array([len(c.composed(t)) if n <= budget else c.within(t, budget) for t, n in zip(rows, cols[2].to_pylist(), strict=True)], pa.int64()))
                names.append("n_within")
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    ids = texts(docs, id_col, text_col)
    kind = ids.schema["doc_id"].dataType.simpleString()
    return map_batches(ids, make, f"doc_id {kind}, n_bytes long, n_tokens long" + ", prefix_counts array<int>" * prefixes + ", n_within long" * (budget is not None))


def tokens_within(prefix_counts: Column, code_points: Column) -> Column:
    """How many tokens the first so many code points have."""
    return F.element_at(prefix_counts, F.least(code_points, F.size(prefix_counts) - 1) + 1)


def longest_prefix(prefix_counts: Column, budget: Column) -> Column:
    """The most code points from the start whose own encoding has at most ``budget`` tokens."""
    at = F.transform(prefix_counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(at)
