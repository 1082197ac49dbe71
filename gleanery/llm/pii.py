"""Personal data: expressions for the plain forms, and a semi-Markov conditional random field for what they miss.

Base spans are found by expressions, kind by kind. The random field then reads the words
around anything with a digit or an ``@``: a segment of up to ``LONGEST`` tokens is scored
as a whole, by its shape, its length, checks such as Luhn's, and the words beside it, and
by the kind of the segment before it, and a dynamic program over segments chooses
boundaries and kinds of all spans together. Base spans are segments that stand already:
the program goes through them, so what it adds never overlaps them and is the best
labelling of the rest. A segment has an ``@`` or at least ``LEAST_DIGITS`` digits, no
line break, no space beside a word of letters, and doesn't begin or end inside a word of
letters and digits; everything else is a token outside, which scores 0. So no
segment reaches further than ``LONGEST`` tokens from a digit or an ``@``, and the program
over the ``REACH`` words around those gives what one over the whole text gives.

Weights are the conditional likelihood's maximum on sentences that ``training_sentences``
makes by rule from a fixed seed, found by stochastic gradients over the segment lattice.

Positions are code points, ends exclusive. Null texts count as empty; an empty table
gives no rows; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import map_batches, texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LONGEST, LEAST_DIGITS = 13, 4
#: Words on either side of a digit or an @: a segment's tokens, and those beside it that its features read.
REACH = LONGEST + 3
OUTSIDE = "outside"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Begins where digits begin and gives none back, so that a long run of digits is read once; the matches are those of the plain expression.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9a-fA-F]{8,}|\d+|[^\w\s]|_")
RUN = re.compile(r"[0-9]+|([^\W\d_]+)|.", re.DOTALL)
BREAK = re.compile("[ \n]")
HEX = re.compile(r"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """True for at most 255, however many zeros lead."""
    own = digits.lstrip("0") or "0"
    return len(own) <= 3 and int(own) <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail their check left out."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((*m.span(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(octet(p) for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            d = only_digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(only_digits(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(text: str) -> str:
    """Runs of digits as 9 and of letters as a or A, with their lengths up to 5 for digits; the rest as it is; 40 characters."""
    out = ""
    for m in RUN.finditer(text):
        out += f"9{min(len(m[0]), 5)}" if "0" <= m[0][0] <= "9" else ("A" if m[0].isupper() else "a") if m[1] else m[0]
        if len(out) >= 40:
            break
    return out[:40]


#: Fixed table: digits of one length are one text.
ZEROED = str.maketrans("123456789", "000000000")
#: Scored segments that a worker remembers, and the longest that it does.
CACHE, CACHED_CHARS = 1 << 14, 120


class Tokens:
    """Tokens of a stretch of text, as numbers: where each begins and ends, the digits before it, and what segments ask of it."""

    def __init__(self, text: str, low: int = 0, high: int | None = None) -> None:
        self.text = text
        self.starts, self.ends, self.digits = array("q"), array("q"), array("q", [0])
        #: whether a segment may begin or end here, goes on from the token before, holds an @; whether the token touches the one before
        self.begins, self.closes, self.joins, self.ats, self.touches = (bytearray() for _ in range(5))
        self.afters: list[str] = []  # what the segment before a token is told of it
        n, last, letters = 0, -2, False
        for m in TOKEN.finditer(text, low, len(text) if high is None else high):
            own, (a, b) = m[0], m.span()
            word, alpha = own[0].isalnum(), own.isalpha()
            self.starts.append(a)
            self.ends.append(b)
            n += (sum(map(own.count, "0123456789")) if b - a > 1 else "0" <= own <= "9") if word and not alpha else 0
            self.digits.append(n)
            self.begins.append(word and not (a and text[a - 1].isalnum()) or own[0] in "+(")
            self.closes.append(own[-1].isalnum() and not text[b : b + 1].isalnum())
            self.touches.append(a == last)
            self.joins.append(a == last or a == last + 1 and text[last] != "\n" and not letters and not alpha)
            self.ats.append(own == "@")
            self.afters.append("w" if own[:1].isalnum() else own.lower())
            last, letters = b, alpha
        self.afters.append("w")
        self.touches.append(0)

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends, strict=True)

    def before(self, i: int) -> list[str]:
        """The words before token i, three at most, in lower case."""
        return [self.text[self.starts[k] : self.ends[k]].lower() for k in range(max(0, i - 3), i)]

    def tight(self, i: int, j: int) -> tuple[bool, bool]:
        """Whether tokens i to j - 1 touch the token before and the one behind."""
        return bool(i and self.touches[i]), bool(self.touches[j])


def segment_features(tokens: Tokens, i: int, j: int, before: list[str] | None = None) -> list[str]:
    """Of tokens i to j - 1 as one segment."""
    own = tokens.text[tokens.starts[i] : tokens.ends[j - 1]]
    digits = tokens.digits[j] - tokens.digits[i]
    before = tokens.before(i) if before is None else before
    after = tokens.afters[j]
    out = ["one", f"shape {shape(own)}", f"digits {min(digits, 20)}", f"tokens {j - i}", f"tight {tokens.tight(i, j)}", f"ends {own[0] if not own[0].isalnum() else 'w'}{own[-1] if not own[-1].isalnum() else 'w'}", f"space {' ' in own}"]
    out += [f"near {w}" for w in before if w.isalpha()]
    out.append(f"before {before[-1] if before else 'START'}")
    out.append(f"after {after}")
    if "@" in own:
        left, _, right = own.partition("@")
        out.append(f"at {bool(left)} {'.' in right} {'@' in right}")
    if own.count(".") == 3 and IP.fullmatch(own):
        out.append(f"ip {all(len(p) <= 3 and octet(p) for p in own.split('.'))}")
    if 12 <= digits <= 19:
        out.append(f"luhn {luhn(only_digits(own))}")
    if len(own) >= 20 and HEX.fullmatch(own):
        out.append(f"hex {len(own) >= 32}")
    return out


def islands(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Stretches of whole words around digits and @, ``reach`` words on either side. Every word is a token at least."""
    out: list[list[int]] = []
    at = 0
    while m := TRIGGER.search(text, at):
        floor = out[-1][1] if out else 0
        start, end, words = m.start(), m.end(), 0
        while words <= reach and start > floor:
            space = max(text.rfind(" ", floor, start), text.rfind("\n", floor, start))
            words += not text[max(space, floor) : start].isspace() and start - space > 1
            start = max(space, floor)
        words = 0
        while words <= reach and end < len(text):
            found = BREAK.search(text, end)
            space = found.start() if found else len(text)
            words += space > end and not text[end:space].isspace()
            end = min(space + 1, len(text))
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
        at = end
    return [(a, b) for a, b in out]


class SemiMarkov:
    """Weights of (kind, feature) and of (kind before, kind) for neighbouring segments; tokens outside of spans score 0."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float)
        self.moves: dict[tuple[str, str], float] = defaultdict(float)
        self.table: dict[str, list[float]] | None = None  # the weights by feature, made when a fitted field first decodes
        self.scores: dict[tuple, list[tuple[str, float]]] = {}
        self.least: dict[str, float] | None = None

    def candidates(self, tokens: Tokens) -> Iterator[tuple[int, list[int]]]:
        """Segments (i, ends j) by i that have an @ or enough digits, no line break and no space beside letters, and start and end where a span can."""
        digits, begins, closes, joins, ats, n = tokens.digits, tokens.begins, tokens.closes, tokens.joins, tokens.ats, len(tokens)
        for i in range(n):
            if not begins[i]:
                continue
            at, least, out = ats[i], digits[i] + LEAST_DIGITS, []
            j = i + 1
            while True:
                if closes[j - 1] and (at or digits[j] >= least):
                    out.append(j)
                if j >= n or j >= i + LONGEST or not joins[j]:
                    break
                at = at or ats[j]
                j += 1
            if out:
                yield i, out

    def lattice(self, text: str, tokens: Sequence[tuple[int, int]] | None = None) -> dict[int, list[tuple[int, list[str]]]]:
        """By end, the segments' starts and features; ``tokens`` are those of the text, found anew if they aren't given as ``Tokens``."""
        tokens = tokens if isinstance(tokens, Tokens) else Tokens(text)
        by_end: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        for i, ends in self.candidates(tokens):
            for j in ends:
                by_end[j].append((i, segment_features(tokens, i, j)))
        return by_end

    def value(self, kind: str, features: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in features)

    def values(self, features: list[str]) -> list[float]:
        """By kind, in the order of ``KINDS``."""
        if self.table is None:
            self.table = {}
            for (kind, f), w in self.weights.items():
                self.table.setdefault(f, [0.0] * len(KINDS))[KINDS.index(kind)] = w
        found = [w for f in features if (w := self.table.get(f)) is not None]
        return [math.fsum(w) for w in zip(*found, strict=True)] if found else [0.0] * len(KINDS)

    def move(self, before: str, kind: str) -> float:
        return self.moves.get((before, kind), 0.0)

    def worth(self, tokens: Tokens, zeroed: str, low: int, i: int, ends: list[int], margin: float) -> Iterator[tuple[int, list[tuple[str, float]]]]:
        """(j, what the segment from i to j is worth by kind), without the kinds under which tokens outside would always be better.

        All that counts of a segment is its text with every digit a zero (``zeroed``, from ``low`` on), what checks say of the digits, and the words beside it
        that the field knows.
        """
        before = self.known(tokens.before(i))
        a, had, scores = tokens.starts[i], tokens.digits[i], self.scores
        context = (margin, *before, bool(i and tokens.touches[i]))
        for j in ends:
            b = tokens.ends[j - 1]
            key = None
            if b - a <= CACHED_CHARS:
                own = zeroed[a - low : b - low]
                check = luhn(only_digits(tokens.text[a:b])) if 12 <= tokens.digits[j] - had <= 19 else None
                ip = all(len(p) <= 3 and octet(p) for p in tokens.text[a:b].split(".")) if own.count(".") == 3 and IP.fullmatch(own) else None
                key = (own, j - i, context, tokens.afters[j], tokens.touches[j], check, ip)
                if (known := scores.get(key)) is not None:
                    if known:
                        yield j, known
                    continue
            values = self.values(segment_features(tokens, i, j, before))
            found = [(k, v - margin) for k, v in zip(KINDS, values, strict=True) if v - margin >= self.least[k]]
            if key is not None:
                if len(scores) >= CACHE:
                    scores.clear()
                scores[key] = found
            if found:
                yield j, found

    def known(self, before: list[str]) -> list[str]:
        """The words as the features see them: one that the field has no weight for is like any other such word."""
        last = len(before) - 1
        return [w if w.isalpha() and f"near {w}" in self.table or k == last and f"before {w}" in self.table else "~" for k, w in enumerate(before)]

    def decode(self, text: str, margin: float = 0.0, fixed: list[Span] = (), low: int = 0, high: int | None = None) -> list[Span]:
        """The best segmentation's spans beside the ``fixed`` ones, between two borders of the text; each span costs ``margin``.

        Only the scores of the last ``LONGEST`` places are held, each with the chain of spans that leads there; chains share what they have in common.
        """
        tokens = Tokens(text, low, high)
        zeroed = text[low : len(text) if high is None else high].translate(ZEROED)
        self.values([])  # makes the table
        if self.least is None:
            labels = (OUTSIDE, *KINDS)
            # the most that neighbours can add to a segment, against tokens outside in its place
            self.least = {k: -max(self.move(p, k) - self.move(p, OUTSIDE) for p in labels) - max(self.move(k, q) - self.move(OUTSIDE, q) for q in labels) - 1e-9 for k in KINDS}
        n = len(tokens)
        # fixed spans as runs of tokens, overlapping ones as one run with the first one's kind
        runs: list[list] = []
        k = 0
        for start, end, kind in sorted(fixed):
            while k < n and tokens.ends[k] <= start:
                k += 1
            j = k
            while j < n and tokens.starts[j] < end:
                j += 1
            if j > k and runs and k < runs[-1][1]:
                runs[-1][1] = max(j, runs[-1][1])
            elif j > k:
                runs.append([k, j, kind])
        waiting: dict[int, list] = {}  # by end: segments that have begun
        best: dict[int, dict[str, tuple[float, tuple | None]]] = {0: {OUTSIDE: (0.0, None)}}
        into: dict[tuple[int, str], tuple[float, tuple | None]] = {}

        def reach(i: int, kind: str) -> tuple[float, tuple | None]:
            if (got := into.get((i, kind))) is None:
                v, before = max((v + self.move(before, kind), before) for before, (v, _) in best[i].items())
                got = into[i, kind] = v, best[i][before][1]
            return got

        segments = self.candidates(tokens)
        coming = next(segments, None)
        r, run, j = 0, None, 0
        while j < n:
            # what begins at this place
            if r < len(runs) and runs[r][0] == j:
                run = (runs[r][1], runs[r][2], *reach(j, runs[r][2]))
                r += 1
            limit = runs[r][0] if r < len(runs) else n
            while coming is not None and coming[0] <= j:
                if coming[0] == j and run is None and coming[1][0] <= limit:
                    for end, worth in self.worth(tokens, zeroed, low, j, [e for e in coming[1] if e <= limit], margin):
                        waiting.setdefault(end, []).append((j, worth))
                coming = next(segments, None)
            j += 1
            if run is not None:
                best[j] = {}
                if run[0] == j:
                    best[j] = {run[1]: (run[2], run[3])}
                    run = None
            else:
                here = best[j] = {OUTSIDE: reach(j - 1, OUTSIDE)}
                for i, worth in waiting.pop(j, ()):
                    for kind, own in worth:
                        v, path = reach(i, kind)
                        v += own
                        if kind not in here or v > here[kind][0]:
                            here[kind] = (v, (tokens.starts[i], tokens.ends[j - 1], kind, path))
            best.pop(j - LONGEST - 1, None)
            for kind in (OUTSIDE, *KINDS):
                into.pop((j - LONGEST - 1, kind), None)
        path = best[n][max((v, k) for k, (v, _) in best[n].items())[1]][1]
        out = []
        while path is not None:
            out.append(path[:3])
            path = path[3]
        return out[::-1]

    def learn(self, text: str, spans: list[Span], rate: float, penalty: float) -> None:
        """One step up the sentence's conditional likelihood."""
        tokens = Tokens(text)
        n, labels = len(tokens), (OUTSIDE, *KINDS)
        arcs: list[list[tuple[int, str, float, list[str]]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            arcs[j].append((j - 1, OUTSIDE, 0.0, []))
        for j, segments in self.lattice(text, tokens).items():
            arcs[j] += [(i, kind, self.value(kind, f), f) for i, f in segments for kind in KINDS]
        move = {(a, b): self.move(a, b) for a in labels for b in labels}
        ahead: list[dict[str, float]] = [{OUTSIDE: 0.0}] + [{} for _ in range(n)]
        into: dict[tuple[int, str], float] = {}  # all ways to a place, and the move to a kind from there

        def enter(i: int, kind: str) -> float:
            if (i, kind) not in into:
                into[i, kind] = _log_sum([v + move[before, kind] for before, v in ahead[i].items()])
            return into[i, kind]

        for j in range(1, n + 1):
            parts = defaultdict(list)
            for i, kind, v, _ in arcs[j]:
                parts[kind].append(enter(i, kind) + v)
            ahead[j] = {kind: _log_sum(v) for kind, v in parts.items()}
        total = _log_sum(list(ahead[n].values()))
        behind: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n + 1)]
        settled: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(labels, 0.0)]
        chance: dict[tuple[str, str], float] = defaultdict(float)
        gold = {(i, j): k for i, j, k in self._as_tokens(tokens, spans)}
        pushes = []
        for j in range(n, 0, -1):
            if j < n:
                settled[j] = {kind: _log_sum(v) for kind, v in behind[j].items()}
            for i, kind, v, features in arcs[j]:
                rest = v + settled[j].get(kind, -math.inf)
                for before, sofar in ahead[i].items():
                    p = math.exp(sofar + move[before, kind] + rest - total)
                    chance[before, kind] += p
                    behind[i][before].append(move[before, kind] + rest)
                if features:
                    p = math.exp(enter(i, kind) + rest - total)
                    push = (gold.get((i, j)) == kind) - p
                    if abs(push) > 1e-4:
                        pushes.append((kind, features, push))
        for kind, features, push in pushes:
            for f in features:
                self.weights[kind, f] += rate * (push - penalty * self.weights[kind, f])
        # the moves of the gold labelling; from outside they are part of the segments' own weights
        path, at = [], 0
        starts = {i: (j, k) for (i, j), k in gold.items()}
        before = OUTSIDE
        while at < n:
            at, kind = starts.get(at, (at + 1, OUTSIDE))
            path.append((before, kind))
            before = kind
        for pair in {*chance, *path}:
            if pair[0] != OUTSIDE:
                self.moves[pair] += rate * (path.count(pair) - chance[pair] - penalty * self.moves[pair])

    @staticmethod
    def _as_tokens(tokens: Iterable[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, str]]:
        pairs = list(tokens)
        first, last = {a: i for i, (a, _) in enumerate(pairs)}, {b: j + 1 for j, (_, b) in enumerate(pairs)}
        return [(first[a], last[b], kind) for a, b, kind in spans if a in first and b in last]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def training_sentences(number: int = 1500, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences of made-up words with personal data in several forms, and with numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "ver", "que"]) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        d = rng.choice("3456") + num(rng.choice([14, 14, 14, 13]))
        check = next(c for c in "0123456789" if luhn(d + c) == valid)
        d += check
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    makers = {
        "email": lambda: f"{word()}.{word()}{rng.choice(['', num(2)])}@{rng.choice(['mail' + num(1) + '.example.com', word() + '.org', word() + '-' + word() + '.co.uk'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(True),
        "phone": lambda: rng.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(1)}-{num(3)}-{num(3)}-{num(4)}"]),
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64]))),
    }
    nothing = [
        lambda: num(rng.randint(1, 8)),
        lambda: f"{num(1)}.{num(1)}",
        lambda: f"{rng.randint(256, 999)}.{num(3)}.{num(2)}.{num(2)}",
        lambda: f"{num(4)}-{num(2)}-{num(2)}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: f"{num(2)} {num(3)} {num(4)}",
        lambda: card(False),
        lambda: f"@{word()}",
        lambda: f"{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{word()}{num(2)}",
        lambda: num(rng.randint(20, 24)),
        lambda: f"{num(3)}-{num(4)}",
    ]
    out = []
    for _ in range(number):
        parts: list[tuple[str, str | None]] = []
        for _ in range(rng.randint(1, 3)):
            parts += [(word(), None) for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                own = makers[kind]()
                if kind == "secret":
                    lead = rng.choice(['token = "', 'key: "', "secret=", "password = '"])
                    parts += [(lead, "lead"), (own, kind), (rng.choice(['"', ""]), "tail")]
                    continue
                parts.append((own, kind))
            else:
                parts.append((rng.choice(nothing)(), None))
            if rng.random() < 0.3:
                parts.append((rng.choice(".,;!"), "tail"))
        text, spans, tight = "", [], True
        for own, kind in parts:
            if not own:
                continue
            if text and not tight and kind != "tail":
                text += " "
            if kind in KINDS:
                spans.append((len(text), len(text) + len(own), kind))
            text += own
            tight = kind == "lead"
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(sentences: int = 1500, rounds: int = 3, seed: int = 7) -> SemiMarkov:
    """The random field, fitted; the same one every time."""
    model = SemiMarkov()
    data = training_sentences(sentences, seed)
    for k in range(rounds):
        order = random.Random(k).sample(data, len(data))
        for text, spans in order:
            model.learn(text, spans, 0.4 / (1 + k), 1e-3)
    model.weights, model.moves = dict(model.weights), dict(model.moves)
    return model


#: What a span that the random field adds must be worth, beyond leaving its tokens outside.
MARGIN = 2.0


def all_spans(text: str, model: SemiMarkov, margin: float = MARGIN) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    every, k = list(base), 0
    for low, high in islands(text):
        while k < len(base) and base[k][1] <= low:
            k += 1
        last = k
        while last < len(base) and base[last][0] < high:
            last += 1
        every += model.decode(text, margin, base[k:last], low, high)
    return base, sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of every row; the first four count base spans."""
    sent = docs.sparkSession.sparkContext.broadcast((trained().weights, trained().moves))

    def make():
        model = SemiMarkov()
        model.weights, model.moves = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [all_spans(t, model, margin) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)]
            cols += [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            cols.append(pa.array([len(every) - len(base) for base, every in found], pa.int64()))
            cols.append(pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found]))
            cols.append(pa.array([spelled(every) for _, every in found]))
            return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "n_added", "base_sha256", "spans"])

        return step

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def mask(docs: DataFrame, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All rows with all columns, personal data in the text replaced by its kind; a null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast((trained().weights, trained().moves))
    at = docs.columns.index(text_col)

    def make():
        model = SemiMarkov()
        model.weights, model.moves = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [None if t is None else masked(t, all_spans(t, model, margin)[1]) for t in batch.column(at).to_pylist()]
            return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

        return step

    return map_batches(docs, make, docs.schema)
