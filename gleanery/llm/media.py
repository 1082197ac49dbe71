"""Media columns: bytes kept in the coefficients of progressive JPEG images.

``store`` lays a payload out as the quantised coefficients of 8 by 8 blocks, four of
luma and one of each chroma a unit (4:2:0), and writes a progressive JPEG: a first scan
of the DC coefficients without their lowest bit, first scans of AC bands (spectral
selection) without theirs, then refinement scans with those bits (successive
approximation). A byte is one coefficient: 128 to 255 stand for themselves, 0 to 127 for
-255 to -128, which are the values of eight bits in the format's own code, so the
coefficients give the payload back without loss.

``read`` decodes files scan by scan into coefficient arrays. Restart intervals are
independent of each other, so all intervals of all files of a batch are decoded in step,
one symbol each at a time, in numpy. ``pixels`` multiplies the coefficients with an
integer basis, exactly, so that equal files give equal pixels, doubles the chroma and
gives RGB at full resolution.

A text is its UTF-8 bytes, a null text none; bytes of 255 fill up to a positive multiple
of 576. An empty table gives no rows; repeated rows give equal files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import map_batches, texts

UNIT = 576
#: Units of 16 by 16 pixels between two restart markers.
INTERVAL = 2
TALLEST = 4000


def zigzag_order() -> np.ndarray:
    """The natural index of each coefficient in the order of the format: along the diagonals, turning at their ends."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag_order()
DC_SYMBOLS = list(range(12))
#: Symbols of AC codes with their lengths: eight bits a coefficient in the first scans, ends of bands in the refinements.
AC_CODES = [(0x07, 1), (0x00, 3), (0x10, 3), (0x20, 4), (0x30, 5), *((s, 8) for s in (0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x09, 0x0A, 0xF0))]
DC_CODES = [(s, 4) for s in DC_SYMBOLS]
#: Component, horizontal and vertical samples.
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
#: Components, first and last coefficient, bits left out before and after.
SCANS = (((1, 2, 3), 0, 0, 0, 1), ((1,), 1, 5, 0, 1), ((1,), 6, 63, 0, 1), ((2,), 1, 63, 0, 1), ((3,), 1, 63, 0, 1), ((1, 2, 3), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((3,), 1, 63, 1, 0))


def code_words(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Canonical codes by symbol: (code, length)."""
    out, code, size = {}, 0, 0
    for symbol, n in lengths:
        code <<= n - size
        size = n
        out[symbol] = (code, n)
        code += 1
    return out


AC_WORDS, DC_WORDS = code_words(AC_CODES), code_words(DC_CODES)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def table_segment(kind: int, number: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = [sum(n == size for _, n in lengths) for size in range(1, 17)]
    return segment(0xC4, bytes([kind << 4 | number, *counts, *(s for s, _ in lengths)]))


def layout(payload_bytes: int) -> tuple[int, int]:
    """Width and height in units of 16 by 16 pixels that hold so many bytes, 384 each."""
    units = -(-payload_bytes // 384)
    wide = max(min(units, 16), -(-units // TALLEST))
    wide += -wide % INTERVAL  # so that every interval is full
    return wide, -(-units // wide)


@lru_cache(maxsize=4096)
def luma_order(wide: int, high: int) -> np.ndarray:
    """For each luma block in raster order, its place among the units' luma blocks."""
    return np.arange(wide * high * 4).reshape(high, wide, 2, 2).transpose(0, 2, 1, 3).reshape(-1)


def bits_of(value: int, n: int) -> list[int]:
    return [value >> (n - 1 - k) & 1 for k in range(n)]


def cut(rows: np.ndarray, counts: list[int]) -> list[bytes]:
    """Intervals of one length, (intervals, bytes), as each file's entropy-coded bytes: with restart markers between its intervals and zeros behind bytes of 255."""
    ends = np.cumsum(counts)
    nth = np.arange(len(rows)) - np.repeat(ends - counts, counts)
    marks = np.empty((len(rows), 2), np.uint8)
    marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + (nth - 1) % 8
    full = rows == 0xFF
    flat = np.concatenate([marks, rows], axis=1).reshape(-1)
    width = rows.shape[1] + 2
    at = ends * width
    if full.any():
        row, col = np.nonzero(full)
        places = row * width + col + 2
        flat = np.insert(flat, places + 1, 0)
        at = at + np.searchsorted(places, at)
    starts = np.concatenate([[0], at[:-1]]) + 2
    return [flat[i:j].tobytes() for i, j in zip(starts, at, strict=True)]


def _dc_first(dc: np.ndarray, counts: list[int]) -> list[bytes]:
    """DC coefficients of units (units, 6) without the lowest bit, as differences within an interval."""
    dc = (dc >> 1).reshape(-1, INTERVAL, 6)
    luma = np.diff(dc[:, :, :4].reshape(len(dc), -1), axis=1, prepend=0).reshape(-1, INTERVAL, 4)
    chroma = np.diff(dc[:, :, 4:], axis=1, prepend=0)
    diffs = np.concatenate([luma, chroma], axis=2).reshape(len(dc), -1)
    words = [DC_WORDS[n] for n in range(12)]
    rows = []
    for interval in diffs.tolist():
        acc, n = 0, 0
        for d in interval:
            size = abs(d).bit_length()
            code, length = words[size]
            acc = (acc << length | code) << size | (d if d >= 0 else d + (1 << size) - 1)
            n += length + size
        extra = -n % 8
        rows.append((acc << extra | (1 << extra) - 1).to_bytes((n + extra) // 8, "big").replace(b"\xff", b"\xff\x00"))
    out, at = [], 0
    for n in counts:
        own = rows[at : at + n]
        out.append(b"".join([own[0], *(x for k, row in enumerate(own[1:]) for x in (RESTARTS[k % 8], row))]))
        at += n
    return out


RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def packed_rows(bits: np.ndarray) -> np.ndarray:
    """Each row of bits as bytes, filled up with ones."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)), constant_values=1), axis=1)


def _ac_first(blocks: np.ndarray, first: int, last: int, counts: list[int]) -> list[bytes]:
    """A band without its lowest bit: each coefficient has a code of one bit and seven bits of value."""
    v = blocks[:, first : last + 1]
    size = np.abs(v) >> 1
    return cut(np.where(v < 0, 127 - size, size).astype(np.uint8).reshape(-1, INTERVAL * v.shape[1]), counts)


def _ac_refine(blocks: np.ndarray, first: int, last: int, counts: list[int]) -> list[bytes]:
    """The lowest bits of a band in which every coefficient is known: one end of band for an interval, then a bit each."""
    bits = (np.abs(blocks[:, first : last + 1]) & 1).astype(np.uint8).reshape(-1, INTERVAL * (last + 1 - first))
    power = INTERVAL.bit_length() - 1
    code, length = AC_WORDS[power << 4]
    head = np.array(bits_of(code, length) + bits_of(INTERVAL - (1 << power), power), np.uint8)
    return cut(packed_rows(np.concatenate([np.broadcast_to(head, (len(bits), len(head))), bits], axis=1)), counts)


def header(wide: int, high: int, payload_bytes: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in COMPONENTS)
    return b"".join([b"\xff\xd8", segment(0xFE, b"payload %d" % payload_bytes), ONES, segment(0xC2, frame), CODES])


ONES = segment(0xDB, bytes([0] + [1] * 64))
CODES = table_segment(0, 0, DC_CODES) + table_segment(1, 0, AC_CODES) + segment(0xDD, struct.pack(">H", INTERVAL))
SCAN_HEADERS = [segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c, 0)), first, last, before << 4 | after])) for comps, first, last, before, after in SCANS]


def write(payloads: list[bytes]) -> list[bytes]:
    """For each payload, of a positive multiple of 576 bytes, a progressive JPEG with these coefficients."""
    sizes = [layout(len(p)) for p in payloads]
    units = [wide * high for wide, high in sizes]
    data = np.frombuffer(b"".join(p.ljust(384 * n, b"\xff") for p, n in zip(payloads, units, strict=True)), np.uint8).astype(np.int16)
    data = np.where(data < 128, data - 255, data).reshape(-1, 6, 64)
    starts = np.concatenate([[0], np.cumsum(units)[:-1]])
    order = np.concatenate([luma_order(*size) + 4 * at for size, at in zip(sizes, starts, strict=True)])
    blocks = {1: data[:, :4].reshape(-1, 64)[order], 2: data[:, 4], 3: data[:, 5]}
    few = [n // INTERVAL for n in units]
    files = [[header(*size, len(p))] for size, p in zip(sizes, payloads, strict=True)]
    for (comps, first, last, before, _), head in zip(SCANS, SCAN_HEADERS, strict=True):
        counts = [4 * n for n in few] if comps == (1,) else few
        if first:
            parts = (_ac_refine if before else _ac_first)(blocks[comps[0]], first, last, counts)
        elif before:
            parts = cut(packed_rows((data[:, :, 0] & 1).astype(np.uint8).reshape(-1, 6 * INTERVAL)), counts)
        else:
            parts = _dc_first(data[:, :, 0].astype(np.int64), counts)
        for file, part in zip(files, parts, strict=True):
            file += (head, part)
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


@dataclass
class Image:
    """A parsed file: sizes in units, and its coefficients in the format's order, (blocks, 64) by component in raster order."""

    wide: int
    high: int
    payload_bytes: int
    scale: np.ndarray
    scans: list = field(default_factory=list)
    base: dict[int, int] = field(default_factory=dict)  # first row of each component in the batch's coefficients

    def blocks(self, component: int) -> int:
        return self.wide * self.high * (4 if component == 1 else 1)


SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits that may come next: length of the code << 8 | symbol; 0 if no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[code << 16 - size : code + 1 << 16 - size] = size << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse(data: bytes, tables: list[np.ndarray], known: dict[bytes, int]) -> Image:
    """Headers and scans of a file; code tables are filed in ``tables`` once each."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, interval, now, payload = 2, None, 0, {}, 0
    scale = np.ones(64, np.int64)
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            payload = int(body.split()[1])
        elif marker == 0xDB:
            scale = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
        elif marker == 0xC2:
            _, tall, broad, _ = struct.unpack(">BHHB", body[:6])
            image = Image(broad // 16, tall // 16, payload, scale)
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                own = body[1 : 17 + n]
                if own not in known:
                    known[own] = len(tables)
                    tables.append(lookup(own[:16], own[16:]))
                now[body[0]] = known[own]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            comps = tuple(body[1 + 2 * k] for k in range(body[0]))
            number = [body[2 + 2 * k] for k in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] :]
            end = SCAN_END.search(data, at).start()
            parts = [p.replace(b"\xff\x00", b"\xff") for p in RESTART.split(data[at:end])]
            table = now.get(0x10 | number[0] & 15 if first else number[0] >> 4, 0)
            image.scans.append((comps, first, last, bits >> 4, bits & 15, table, interval, parts))
            at = end


class Lanes:
    """Bit readers over many intervals at once."""

    def __init__(self, parts: list[bytes]) -> None:
        tail = b"\x00" * 5
        sizes = np.array([len(p) + 5 for p in parts], np.int64)
        data = np.frombuffer(tail.join([*parts, b""]) + tail, np.uint8).astype(np.int64)
        #: for each byte, the 40 bits from there on
        self.words = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
        self.at = 8 * np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def window(self) -> np.ndarray:
        """40 bits of which the first 32 or more are what comes next, shifted to the top."""
        return self.words[self.at >> 3] << (self.at & 7) & 0xFFFFFFFFFF

    def keep(self, which: np.ndarray) -> None:
        self.at = self.at[which]


def coded(window: np.ndarray, tables: np.ndarray, of: np.ndarray) -> np.ndarray:
    found = tables[0][window >> 24] if len(tables) == 1 else tables[of, window >> 24]
    if not found.all():
        raise ValueError("no code fits")
    return found


def bits_after(window: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    return window >> 40 - skip - n & (1 << n) - 1


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value that so many bits stand for: the lower half of each size is negative."""
    return np.where(bits < 1 << np.maximum(size - 1, 0), bits - (1 << size) + 1, bits)


def _dc_scans(coefs: np.ndarray, work: list, tables: np.ndarray) -> None:
    """work: (bytes, rows of the blocks, low, refine, table) of each interval."""
    for refine in (False, True):
        mine = [w for w in work if w[3] == refine]
        if not mine:
            continue
        lanes = Lanes([w[0] for w in mine])
        count = np.array([len(w[1]) for w in mine])
        rows = np.zeros((len(mine), count.max()), np.int64)
        for k, w in enumerate(mine):
            rows[k, : count[k]] = w[1]
        low, of = np.array([w[2] for w in mine]), np.array([w[4] for w in mine])
        before = np.zeros((len(mine), 3), np.int64)
        for step in range(count.max()):
            if (count <= step).any():
                live = count > step
                rows, low, of, before, count = rows[live], low[live], of[live], before[live], count[live]
                lanes.keep(live)
            window = lanes.window()
            if refine:
                coefs[rows[:, step], 0] |= (window >> 39 << low).astype(coefs.dtype)
                lanes.at += 1
            else:
                found = coded(window, tables, of)
                length, size = found >> 8, found & 255
                comp = max(0, step % 6 - 3)
                before[:, comp] += extended(bits_after(window, length, size), size)
                lanes.at += length + size
                coefs[rows[:, step], 0] = before[:, comp] << low


def _ac_scans(coefs: np.ndarray, parts: list[bytes], start: np.ndarray, count: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, of: np.ndarray, tables: np.ndarray) -> None:
    """First scans: lane i decodes its band in rows start[i] to start[i] + count[i]."""
    lanes = Lanes(parts)
    flat = coefs.reshape(-1)
    row, end, k = start.copy(), start + count, first.copy()
    while len(row):
        window = lanes.window()
        found = coded(window, tables, of)
        length, run, size = found >> 8, found >> 4 & 15, found & 15
        k += run
        v = extended(bits_after(window, length, size), size) << low
        lanes.at += length + size
        if size.all():
            flat[row * 64 + k] = v
            k += 1
        else:
            some = size > 0
            flat[(row * 64 + k)[some]] = v[some]
            k += 1
            stop = np.flatnonzero(~some & (run < 15))
            r = run[stop]
            row[stop] += (1 << r) + bits_after(window[stop], length[stop], r) - 1
            lanes.at[stop] += r
            k[stop] = 64
        over = k > last
        if over.any():
            row += over
            k = np.where(over, first, k)
            live = row < end
            if not live.all():
                row, end, k, first, last, low, of = (x[live] for x in (row, end, k, first, last, low, of))
                lanes.keep(live)


def _ac_refinements(coefs: np.ndarray, parts: list[bytes], start: np.ndarray, count: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, of: np.ndarray, tables: np.ndarray) -> None:
    """Refinements: known coefficients take a bit each, others wait for their run to end. Where a band has ended, the rest of a block goes at once."""
    lanes = Lanes(parts)
    n = len(parts)
    row, end, k = start.copy(), start + count, first.copy()
    ends = np.zeros(n, np.int64)  # blocks that an end of band still covers, this one included
    run, new = np.full(n, -1), np.zeros(n, np.int64)
    while len(row):
        ask = np.flatnonzero((ends == 0) & (run < 0))
        if len(ask):
            window = lanes.window()[ask]
            found = coded(window, tables, of[ask])
            length, r, size = found >> 8, found >> 4 & 15, found & 15
            stop = (size == 0) & (r < 15)
            extra = np.where(stop, r, (size > 0).astype(np.int64))
            bits = bits_after(window, length, extra)
            lanes.at[ask] += length + extra
            ends[ask] = np.where(stop, (1 << r) + bits, 0)
            run[ask] = np.where(stop, -1, r)
            new[ask] = np.where(size > 0, 2 * bits - 1, 0) << low[ask]
        whole = np.flatnonzero(ends > 0)
        if len(whole):
            for lo, hi in np.unique(np.stack([k[whole], last[whole]], axis=1), axis=0):
                mine = whole[(k[whole] == lo) & (last[whole] == hi)]
                v = coefs[row[mine], lo : hi + 1]
                known = v != 0
                at = lanes.at[mine, None] + np.cumsum(known, axis=1) - known
                bit = (lanes.words[at >> 3] >> 39 - (at & 7) & 1).astype(v.dtype) << low[mine, None].astype(v.dtype)
                coefs[row[mine], lo : hi + 1] = v + np.sign(v) * bit
                lanes.at[mine] += known.sum(axis=1)
            k[whole] = 64
        single = np.flatnonzero(ends == 0)
        if len(single):
            v = coefs[row[single], k[single]].astype(np.int64)
            known = v != 0
            bit = (lanes.words[lanes.at[single] >> 3] >> 39 - (lanes.at[single] & 7)) & 1
            lanes.at[single] += known
            due = ~known & (run[single] == 0)
            coefs[row[single], k[single]] = np.where(known, v + (np.sign(v) * bit << low[single]), np.where(due, new[single], 0))
            run[single] -= ~known
            k[single] += 1
        over = k > last
        if over.any():
            row += over
            ends = np.where(over, np.maximum(ends - 1, 0), ends)
            k = np.where(over, first, k)
            live = row < end
            if not live.all():
                row, end, k, first, last, low, of, ends, run, new = (x[live] for x in (row, end, k, first, last, low, of, ends, run, new))
                lanes.keep(live)


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The files' headers, and all their quantised coefficients, (blocks, 64) in the format's order; ``Image.base`` tells where a component starts."""
    tables: list[np.ndarray] = []
    known: dict[bytes, int] = {}
    images = [parse(f, tables, known) for f in files]
    total = 0
    for image in images:
        for c in (1, 2, 3):
            image.base[c] = total
            total += image.blocks(c)
    coefs = np.zeros((total, 64), np.int32)
    codes = np.array(tables)
    dc, first, refine = [], [], []
    for image in images:
        place = None
        for comps, lo, hi, before, after, table, interval, parts in image.scans:
            if lo == 0:
                if place is None:
                    units = image.wide * image.high
                    order = np.empty(units * 4, np.int64)
                    order[luma_order(image.wide, image.high)] = np.arange(units * 4)
                    place = np.concatenate([order.reshape(-1, 4) + image.base[1], (np.arange(units) + image.base[2])[:, None], (np.arange(units) + image.base[3])[:, None]], axis=1)
                for k, part in enumerate(parts):
                    dc.append((part, place[k * interval : (k + 1) * interval].reshape(-1), after, before > 0, table))
            else:
                (c,) = comps
                (refine if before else first).append((image.base[c], image.blocks(c), interval, lo, hi, after, table, parts))
    _dc_scans(coefs, dc, codes)
    for work, scan in ((first, _ac_scans), (refine, _ac_refinements)):
        if work:
            parts = [p for w in work for p in w[7]]
            n = [len(w[7]) for w in work]
            nth = np.concatenate([np.arange(x) for x in n])
            step = np.repeat([w[2] for w in work], n)
            base, blocks = np.repeat([w[0] for w in work], n), np.repeat([w[1] for w in work], n)
            start = base + nth * step
            count = np.minimum(step, base + blocks - start)
            scan(coefs, parts, start, count, *(np.repeat([w[j] for w in work], n) for j in (3, 4, 5, 6)), codes)
    return images, coefs


def payload_of(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that the coefficients stand for."""
    units = image.wide * image.high
    luma = np.empty((units * 4, 64), coefs.dtype)
    luma[luma_order(image.wide, image.high)] = coefs[image.base[1] : image.base[1] + units * 4]
    both = [coefs[image.base[c] : image.base[c] + units, None] for c in (2, 3)]
    data = np.concatenate([luma.reshape(units, 4, 64), *both], axis=1).reshape(-1)[: image.payload_bytes]
    return np.where(data < 0, data + 255, data).astype(np.uint8).tobytes()


def basis(bits: int = 20) -> np.ndarray:
    """Inverse transform of a block in the format's order as a matrix of integers, ``bits`` fractional bits; products with it are exact in doubles."""
    x = np.arange(8)
    one = np.array([np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)])
    full = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(full * (1 << bits))[ZIGZAG]


BASIS = basis()


def pixels(image: Image, coefs: np.ndarray) -> np.ndarray:
    """The image in RGB at full resolution, (height, width, 3)."""

    def plane(c: int, times: int) -> np.ndarray:
        own = coefs[image.base[c] : image.base[c] + image.blocks(c)] * image.scale
        levels = np.floor((own.astype(np.float64) @ BASIS) / (1 << 20) + 128.5)
        samples = np.clip(levels, 0, 255).astype(np.int32)
        return samples.reshape(image.high * times, image.wide * times, 8, 8).transpose(0, 2, 1, 3).reshape(image.high * times * 8, image.wide * times * 8)

    y = plane(1, 2)
    cb, cr = (np.repeat(np.repeat(plane(c, 1) - 128, 2, axis=0), 2, axis=1) for c in (2, 3))
    half, one = 1 << 15, 1 << 16
    red = y + (round(1.402 * one) * cr + half >> 16)
    green = y - (round(0.344136 * one) * cb + round(0.714136 * one) * cr + half >> 16)
    blue = y + (round(1.772 * one) * cb + half >> 16)
    return np.clip(np.stack([red, green, blue], axis=-1), 0, 255).astype(np.uint8)


def padded(text: str) -> tuple[bytes, int]:
    own = text.encode()
    return own + b"\xff" * (-len(own) % UNIT or (0 if own else UNIT)), len(own)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a progressive JPEG."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [padded(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in own], pa.int64()), pa.array(write([p for p, _ in own]), pa.binary())], ["doc_id", "n_bytes", "media"])

        return step

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, n_bytes long, media binary")


def feature(rgb: np.ndarray) -> str:
    """Size, and the mean of each channel over the four quarters of the image's height, in thousandths."""
    parts = np.array_split(rgb.astype(np.int64), 4)
    means = ["/".join(str(int(p[..., c].sum()) * 1000 // max(1, p[..., c].size)) for c in range(3)) for p in parts]
    return f"{rgb.shape[1]}x{rgb.shape[0]} {' '.join(means)}"


def inspect(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Reads a media column (doc_id, n_bytes, media) back: payload digests, the stored form's digest, a feature of the pixels; with ``tensors`` also height, width and the RGB bytes."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            files = batch.column(2).to_pylist()
            images, coefs = read(files)
            payloads = [payload_of(i, coefs) for i in images]
            rgb = [pixels(i, coefs) for i in images]
            cols = [
                batch.column(0),
                batch.column(1),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array([feature(x) for x in rgb]),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if tensors:
                cols += [pa.array([x.shape[0] for x in rgb], pa.int32()), pa.array([x.shape[1] for x in rgb], pa.int32()), pa.array([x.tobytes() for x in rgb], pa.binary())]
                names += ["height", "width", "rgb"]
            return pa.RecordBatch.from_arrays(cols, names)

        return step

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media.select("doc_id", "n_bytes", "media"), make, schema + ", height int, width int, rgb binary" * tensors)
