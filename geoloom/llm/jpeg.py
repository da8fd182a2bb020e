"""Media columns: progressive JPEG.

Reading: scans of spectral selection and successive approximation are accumulated in coefficient arrays, which are
dequantised, inverse-transformed in numpy (exact fixed-point), put together with upsampled chroma and turned into a
full-resolution RGB tensor. Any progressive or sequential Huffman file of 1 or 3 components is read.

Storing bytes: a payload becomes 8-bit samples and these go through the whole method. 192 bytes are one unit of colour
with subsampling (16 x 16 pixels, four blocks of brightness and one of each colour): first their high, then their low
halves, a half h is the sample 16 h + 8. Blocks are transformed, quantised by 2, and coded by Huffman codes with runs of
zeros and of ended bands, in scans of DC, two AC bands, and the lowest bits of both, with restarts. By the bound in
`worst_error` no sample comes back 8 or more away, so its half is read from the samples.

Scans of progressive files are read in step: all intervals between restarts of all files at hand, of one kind of scan,
decode one symbol a step. Sequential files, few intervals, and files with missing restarts are read bit by bit.

Edge cases: a null doc_id stays null; null and empty bytes are padded to one unit; equal bytes give equal files, tensors and features; files
larger than one row of units are folded into several, filled up with padding that is not part of the payload;
repeated rows get equal values; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import portions, released, small_batches, texts_of, typed

UNIT = 192
MOST_WIDE = 4095  # units: 65520 pixels
STEP = 2  # of quantisation
INTERVAL = 16  # units, or blocks in scans of one component, between restarts
FEW = 8  # intervals, which are read faster bit by bit than in step
FACTORS = ((2, 2), (1, 1), (1, 1))
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p: p[0] if s % 2 else p[1])])
BANDS = ((1, 5), (6, 63))
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")
_NEXT = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


# -- Huffman tables -----------------------------------------------------------------------------------------------


def table_bytes(kind: int, slot: int, lengths: dict[int, int]) -> bytes:
    """A DHT segment from symbols' code lengths."""
    by = sorted(lengths, key=lambda s: (lengths[s], s))
    body = bytes([kind << 4 | slot, *(sum(lengths[s] == n for s in by) for n in range(1, 17)), *by])
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@functools.lru_cache(256)
def quants_in(body: bytes) -> dict[int, np.ndarray]:
    """Slot -> steps in zigzag order, of a DQT segment."""
    out = {}
    while body:
        wide = body[0] >> 4
        n = 64 << wide
        out[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
        body = body[1 + n :]
    return out


@functools.lru_cache(256)
def tables_in(body: bytes) -> dict[int, bytes]:
    """Kind and slot -> counts and symbols, of a DHT segment."""
    out = {}
    while body:
        n = 17 + sum(body[1:17])
        out[body[0]] = body[1:n]
        body = body[n:]
    return out


@functools.lru_cache(256)
def codes_of(body: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a table's 16 counts and its symbols."""
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[body[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return out


_PLAIN, _ENDS, _NONE = 0, 1 << 12, 2 << 12


@functools.lru_cache(64)
def lookup(body: bytes, kind: int, refining: bool = False) -> np.ndarray:
    """What the next 16 bits begin with: bits of code and amplitude, zeros before (<< 6), whether it ends bands or is no
    code (from 1 << 12), that the amplitude has to be read (1 << 11), and the value, or else the amplitude's bits (<< 32)."""
    out = np.full(1 << 16, _NONE | 1 << 11, np.int64)
    for s, (code, n) in codes_of(body).items():
        zeros, size = divmod(s, 16) if kind else (0, s)
        ends = kind and size == 0 and zeros < 15
        more = zeros if ends else min(size, 1) if refining else size
        if ends or n + more > 16:
            entry = n + more | zeros << 6 | 1 << 11 | (_ENDS if ends else _PLAIN) | more << 32
            out[code << (16 - n) : (code + 1) << (16 - n)] = entry
            continue
        v = np.arange(1 << more)
        v = np.where(v >> max(more - 1, 0) > 0, v, v - (1 << more) + 1) if more else v
        out[code << (16 - n) : (code + 1) << (16 - n)] = np.repeat((v << 32) + (n + more | zeros << 6), 1 << (16 - n - more))
    return out


def huffman(weights: dict[int, int]) -> dict[int, int]:
    """Code lengths by Huffman's algorithm. One more symbol, the rarest, takes the code of ones, which stays unused."""
    heap = [(0, 0, [-1]), *((w, k + 1, [s]) for k, (s, w) in enumerate(sorted(weights.items())))]
    lengths, made = dict.fromkeys([-1, *weights], 0), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        (v, _, left), (w, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left + right:
            lengths[s] += 1
        heapq.heappush(heap, (v + w, made, left + right))
        made += 1
    del lengths[-1]
    return lengths


#: How often texts' coefficients have sizes 1 to 8 (DC: differences 0 to 10), in 4096ths, rounded up.
_AC_SIZES = (378, 321, 605, 992, 1168, 803, 205, 4)
_DC_SIZES = (121, 191, 370, 645, 886, 978, 654, 168, 87, 4, 4)
_DC_LENGTHS = huffman(dict(enumerate(_DC_SIZES)))
_AC_LENGTHS = huffman({**{r << 4 | s: max(4, w >> 4 * r) for s, w in enumerate(_AC_SIZES, 1) for r in range(16)}, **{r << 4: 60 >> r or 4 for r in range(5)}, 0xF0: 4})
_LOW_LENGTHS = huffman({**{r << 4 | 1: 256 >> r // 2 for r in range(16)}, **{r << 4: 1024 >> 2 * r or 4 for r in range(5)}, 0xF0: 64})
_TABLES = table_bytes(0, 0, _DC_LENGTHS) + table_bytes(1, 0, _AC_LENGTHS) + table_bytes(1, 1, _LOW_LENGTHS)
_QUANT = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([STEP] * 64)
_RESTART = b"\xff\xdd" + struct.pack(">HH", 4, INTERVAL)
_PART = 1024  # blocks that are coded at a time
_MOST = 255  # of coefficients without their lowest bit


def _entries(lengths: dict[int, int], runs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and amplitude, and their bits, of zeros and the value after them, by zeros * 2 * (most + 1) + value + most + 1;
    a value of 0 has none but where it is coded by itself (DC)."""
    codes = codes_of(table_bytes(0, 0, lengths)[5:])
    bits, sizes = np.zeros((runs, 2 * (most + 1)), np.uint32), np.zeros((runs, 2 * (most + 1)), np.uint8)
    for r in range(runs):
        for v in range(-most, most + 1):
            s = abs(v).bit_length()
            if s or runs == 1:
                code, n = codes[r << 4 | s]
                bits[r, v + most + 1], sizes[r, v + most + 1] = code << s | (v if v >= 0 else v + (1 << s) - 1), n + s
    return bits.ravel(), sizes.ravel()


def _ends(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same of a run of 1 to INTERVAL ended bands, and at 0 of 16 zeros."""
    codes = codes_of(table_bytes(0, 0, lengths)[5:])
    found = [codes[0xF0]]
    for run in range(1, INTERVAL + 1):
        e = run.bit_length() - 1
        found.append((codes[e << 4][0] << e | run - (1 << e), codes[e << 4][1] + e))
    return np.array([c for c, _ in found], np.uint32), np.array([n for _, n in found], np.uint8)


_DC, _AC, _LOW = _entries(_DC_LENGTHS, 1, 1023), _entries(_AC_LENGTHS, 16, _MOST), _entries(_LOW_LENGTHS, 16, 1)
_AC_ENDS, _LOW_ENDS = _ends(_AC_LENGTHS), _ends(_LOW_LENGTHS)


def _scan(components: list[int], ac: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(components), len(components)) + b"".join(bytes([c, ac]) for c in components) + bytes([ss, se, ah << 4 | al])


_HEADS = [
    _scan([1, 2, 3], 0, 0, 0, 0, 1), *(_scan([c], 0, *band, 0, 1) for band in BANDS for c in (1, 2, 3)),
    _scan([1, 2, 3], 0, 0, 0, 1, 0), *(_scan([c], 1, 1, 63, 1, 0) for c in (1, 2, 3)),
]


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def _packed(bits: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bytes of every interval, given its first row; entries in rows, those of size 0 are none."""
    while bits.shape[1] % 2 == 0:  # neighbours become one entry
        both = sizes[:, ::2] + sizes[:, 1::2]
        if both.max() > 56:
            break
        bits, sizes = bits[:, ::2].astype(np.uint64) << sizes[:, 1::2] | bits[:, 1::2], both
    starts = starts * bits.shape[1]
    bits, sizes = bits.ravel(), sizes.ravel()
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    total = np.diff(np.append(ends[starts], ends[-1]))
    edges = np.concatenate([[0], np.cumsum(total + 7 >> 3)])
    place = ends[1:] + np.repeat(8 * edges[:-1] - ends[starts], np.diff(np.append(starts, len(sizes))))  # past its end
    word = place - sizes >> 6
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    lasts = np.append(heads[1:], len(word)) - 1  # which may go on in the next word
    over = np.maximum(place[lasts] - (word[lasts] + 1) * 64, 0).astype(np.uint64)
    left = bits.astype(np.uint64) << (-place & 63).astype(np.uint64)
    left[lasts] = np.where(over > 0, bits[lasts] >> over, left[lasts])
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[heads]] = np.bitwise_or.reduceat(left, heads)
    out[word[lasts] + 1] |= np.where(over > 0, bits[lasts] << (64 - over & 63), 0).astype(np.uint64)
    out = out.astype(">u8").view(np.uint8)
    out[edges[1:] - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)
    out, edges = out.tobytes(), edges.tolist()
    return [out[lo:hi].replace(b"\xff", b"\xff\x00") for lo, hi in zip(edges, edges[1:])]


def _differences(dc: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Intervals of the DC scan of units' values (n, 6)."""
    out = np.empty(dc.shape, np.int64)
    for lo, hi in ((0, 4), (4, 5), (5, 6)):
        own = dc[:, lo:hi].astype(np.int64).ravel()
        before = np.concatenate([[0], own[:-1]])
        before[starts * (hi - lo)] = 0
        out[:, lo:hi] = (own - before).reshape(-1, hi - lo)
    out += 1024
    return _packed(_DC[0][out], _DC[1][out], starts)


def _ended(bits, sizes, tail, none, n, starts, ends) -> None:
    """Put symbols of ended bands where blocks' tails begin; a run goes on over blocks that have nothing else."""
    blocks = len(tail)
    ended = tail < n
    goes_on = none.copy()
    goes_on[1:] &= ended[:-1]
    goes_on[starts] = False
    heads, others = np.flatnonzero(ended & ~goes_on), np.append(np.flatnonzero(~goes_on), blocks)
    run = others[np.cumsum(~goes_on)[heads]] - heads
    bits[heads, tail[heads]], sizes[heads, tail[heads]] = ends[0][run], ends[1][run]


def _first_band(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Intervals of a first AC scan over a band (blocks, n), given their first blocks."""
    blocks, n = values.shape
    wide = -n % 2 + n
    k = np.arange(n, dtype=np.int16)
    some = values != 0
    upto = np.maximum.accumulate(np.where(some, k + 1, 0).astype(np.uint8), axis=1)  # past the last that is not zero
    zeros = np.empty((blocks, n), np.int16)
    zeros[:, 0], zeros[:, 1:] = 0, k[1:] - upto[:, :-1]
    entry = (((zeros & 15) << 9) + (values + (_MOST + 1))).astype(np.intp)
    bits, sizes = np.zeros((blocks, wide), np.uint32), np.zeros((blocks, wide), np.uint8)
    bits[:, :n], sizes[:, :n] = _AC[0][entry], _AC[1][entry]
    if n > 16:
        row, col = np.nonzero((zeros > 15) & some)
        skip = zeros[row, col].astype(np.int64)
        for q in range(16, n, 16):
            has = skip >= q
            at = row[has], (col - skip)[has] + q - 1
            bits[at], sizes[at] = _AC_ENDS[0][0], _AC_ENDS[1][0]
    _ended(bits, sizes, upto[:, -1].astype(np.int64), upto[:, -1] == 0, n, starts, _AC_ENDS)
    return _packed(bits, sizes, starts)


def _low_band(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Intervals of the scan of lowest bits over whole AC bands (blocks, 63), given their first blocks.

    A symbol stands where the coefficients that it passes over begin, before the bits of those that are known."""
    blocks, n = values.shape
    known = (values > 1) | (values < -1)
    zero = values == 0
    rank = np.zeros((blocks, n + 1), np.uint8)
    np.cumsum(zero, axis=1, dtype=np.uint8, out=rank[:, 1:])
    bits, sizes = np.zeros((blocks, n + 1), np.uint32), np.zeros((blocks, n + 1), np.uint8)
    row, col = np.nonzero(~(known | zero))
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    begin = np.where(first, 0, np.concatenate([[0], col[:-1] + 1])[: len(col)])
    zeros = rank[row, col].astype(np.int64) - rank[row, begin]
    if len(long := np.flatnonzero(zeros > 15)):
        r, c = np.nonzero(zero)
        before = np.searchsorted(r, row[long])  # zeros of earlier blocks
        skipped = before + rank[row[long], begin[long]]
        for q in range(16, n, 16):
            has = zeros[long] >= q
            here = long[has]
            bits[row[here], begin[here]], sizes[row[here], begin[here]] = _LOW_ENDS[0][0], _LOW_ENDS[1][0]
            begin[here] = c[skipped[has] + q - 1] + 1
    entry = ((zeros & 15) << 2) + values[row, col] + 2
    bits[row, begin], sizes[row, begin] = _LOW[0][entry], _LOW[1][entry]
    tail = np.zeros(blocks, np.int64)
    last = np.append(first[1:], True)[: len(row)]
    tail[row[last]] = col[last] + 1
    _ended(bits, sizes, tail, tail == 0, n, starts, _LOW_ENDS)
    bits[:, :n] = np.where(known, bits[:, :n] << 1 | (values & 1).astype(np.uint32), bits[:, :n])
    sizes[:, :n] += known
    return _packed(bits, sizes, starts)


def _by_parts(code, values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """What `code` gives for all intervals, some at a time."""
    cuts = [*np.unique(np.searchsorted(starts, np.arange(0, len(values), _PART))).tolist(), len(starts)]
    out, firsts = [], np.append(starts, len(values))
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            out += code(values[firsts[lo] : firsts[hi]], starts[lo:hi] - starts[lo])
    return out


def _halved(v: np.ndarray) -> np.ndarray:
    """Without the lowest bit of the size: shifted towards zero."""
    return v + (v < 0) >> 1


def _samples(raw: np.ndarray) -> np.ndarray:
    """Blocks' samples less 128 (units, 6, 64) of bytes (units, 192): high halves, then low ones."""
    return np.concatenate([raw >> 4, raw & 15], 1).reshape(-1, 6, 64).astype(np.float64) * 16 - 120


def _lines(wide: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Places, in the order of units, of blocks of brightness in the order of lines, for several files."""
    before, n = np.cumsum(full) - full, 4 * full
    at = np.arange(n.sum()) - np.repeat(4 * before, n)
    w = np.repeat(wide, n)
    line, col = np.divmod(at, 2 * w)
    return 4 * (np.repeat(before, n) + (line >> 1) * w + (col >> 1)) + (line & 1) * 2 + (col & 1)


def _restarts(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First units or blocks of all files' intervals, and the files' numbers of intervals."""
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    return np.flatnonzero(at % INTERVAL == 0), -(-full // INTERVAL)


def store(payloads: list[bytes]) -> list[bytes]:
    """The files of payloads whose sizes are positive multiples of UNIT; all of them are coded at once."""
    if not payloads:
        return []
    units = np.array([len(p) // UNIT for p in payloads])
    wide = np.minimum(units, MOST_WIDE)
    rows = -(-units // wide)
    full = wide * rows
    raw = np.frombuffer(b"".join(p + b" " * (UNIT * f - len(p)) for p, f in zip(payloads, full.tolist())), np.uint8).reshape(-1, UNIT)
    blocks = np.empty((len(raw), 6, 64), np.int16)
    for k in range(0, len(raw), _PART):
        blocks[k : k + _PART] = forward_transform(_samples(raw[k : k + _PART]).reshape(-1, 64), STEP).reshape(-1, 6, 64)
    parts = [blocks[:, :4].reshape(-1, 64)[_lines(wide, full)], blocks[:, 4], blocks[:, 5]]
    cuts = [_restarts(4 * full), *[_restarts(full)] * 2]
    dc = np.ascontiguousarray(blocks[:, :, 0])
    scans = [(_by_parts(_differences, dc >> 1, cuts[1][0]), cuts[1][1])]
    for lo, hi in BANDS:
        halves = (lambda v, s, lo=lo, hi=hi: _first_band(_halved(v[:, lo : hi + 1]), s))
        scans += [(_by_parts(halves, p, s), many) for p, (s, many) in zip(parts, cuts)]
    scans += [(_by_parts(lambda v, s: _packed((v & 1).astype(np.uint32), np.ones(v.shape, np.uint8), s), dc, cuts[1][0]), cuts[1][1])]
    scans += [(_by_parts(lambda v, s: _low_band(v[:, 1:], s), p, s), many) for p, (s, many) in zip(parts, cuts)]
    ends = [np.cumsum(many).tolist() for _, many in scans]
    out, begins = [], [0] * len(scans)
    for k, p in enumerate(payloads):
        frame = b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16 * rows[k], 16 * wide[k], 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, (h, v) in enumerate(FACTORS, 1))
        made = [b"\xff\xd8", b"\xff\xfe" + struct.pack(">HQ", 10, len(p)), _QUANT, frame, _TABLES, _RESTART]
        for j, (head, (pieces, _)) in enumerate(zip(_HEADS, scans)):
            made.append(head)
            for m, piece in enumerate(pieces[begins[j] : ends[j][k]]):
                if m:
                    made.append(bytes([0xFF, 0xD0 + (m - 1) % 8]))
                made.append(piece)
            begins[j] = ends[j][k]
        made.append(b"\xff\xd9")
        out.append(b"".join(made))
    return out


# -- reading ------------------------------------------------------------------------------------------------------


class _Bits:
    def __init__(self, raw: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out * 2 + b
        self.at += n
        return out

    def symbol(self, symbols: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code * 2 + self.bits[self.at]
            self.at += 1
            if (s := symbols.get((code, n))) is not None:
                return s
        raise ValueError("no such code")

    def amplitude(self, s: int) -> int:
        v = self.take(s)
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


class Component:
    def __init__(self, number: int, h: int, v: int, quant: int):
        self.number, self.h, self.v, self.quant = number, h, v, quant


class Image:
    """A file's frame, coefficient arrays (rows of blocks, in zigzag order) and comment; `read` decodes several at once."""

    def __init__(self, raw: bytes, decode: bool = True):
        self.quants, self.tables, self.comment, self.restart = {}, {}, b"", 0
        self.parts: list[Component] = []
        self.scans: list[Scan] = []
        self.blocks: list[np.ndarray] | None = None
        at = 2
        while at < len(raw):
            mark = raw[at + 1]
            if mark == 0xD9:
                break
            if raw[at] != 0xFF or 0xD0 <= mark <= 0xD8 or mark in (0xFF, 1):
                at += 1 if mark == 0xFF else 2
                continue
            size = struct.unpack_from(">H", raw, at + 2)[0]
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if mark == 0xDB:
                self.quants.update(quants_in(body))
            elif mark == 0xC4:
                self.tables.update(tables_in(body))
            elif mark in (0xC0, 0xC1, 0xC2):
                self._frame(mark == 0xC2, body)
            elif mark == 0xFE:
                self.comment = body
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                found = _NEXT.search(raw, at)
                end = found.start() if found else len(raw)
                self.scans.append(Scan(self, body, raw[at:end]))
                at = end
            elif 0xC3 <= mark <= 0xCF:
                raise ValueError("only Huffman-coded sequential and progressive files are read")
        if decode:
            _decode([self])

    def _frame(self, progressive: bool, body: bytes):
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or n not in (1, 3):
            raise ValueError("only 8-bit files of 1 or 3 components are read")
        self.progressive = progressive
        self.parts = [Component(c, hv >> 4, hv & 15, q) for c, hv, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.factors, self.numbers = tuple([(p.h, p.v) for p in self.parts]), tuple([p.number for p in self.parts])
        for p in self.parts:
            p.stride, p.lines = self.across * p.h, self.down * p.v
            p.wide = -(-(-(-self.width * p.h // self.h)) // 8)
            p.high = -(-(-(-self.height * p.v // self.v)) // 8)
            p.coefficients = np.zeros((p.lines * p.stride, 64), np.int32)
        self.extents = tuple([(p.high, p.wide) for p in self.parts])

    def _bits(self, scan: Scan):
        """A scan read bit by bit."""
        x, at = scan.layout, 0
        symbols = {(k, kind): {code: s for s, code in codes_of(t).items()} for k, both in enumerate(scan.tables) for kind, t in enumerate(both) if t is not None}
        for count, piece in zip(x.counts, scan.pieces):
            here = slice(at, at := at + count)
            self._slow(scan.parts, symbols, x.ss, x.se, x.ah, x.al, x.which[here].tolist(), x.blocks[here].tolist(), _Bits(piece + b"\xff" * 8))

    @staticmethod
    def _whole(scans: list[Scan]) -> bool:
        """Progressive scans of one kind, of several files or components, in step; False if they cannot be read so."""
        x, tables = scans[0].layout, scans[0].tables
        if not scans[0].image.progressive or any(len(s.pieces) != len(s.layout.counts) for s in scans):
            return False
        pieces = [p for s in scans for p in s.pieces]
        if len(pieces) < FEW and (x.ss or not x.ah):
            return False
        raw = b"".join(pieces)
        counts = np.array([c for s in scans for c in s.layout.counts])
        at = np.cumsum([0, *map(len, pieces)])[:-1] * 8
        ends = np.cumsum(counts)
        total, n = int(ends[-1]), x.se - x.ss + 1
        if x.ss == 0 and x.ah == 0:
            values = _in_step_dc(_windows(raw), at, ends - counts, ends, [lookup(dc, 0) for dc, _ in tables], x.pattern)
        elif x.ss == 0:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))
            values = bits[np.repeat(at - (ends - counts), counts) + np.arange(total)].astype(np.int32)
        elif x.ah == 0:
            values = _in_step(_windows(raw), at, ends - counts, ends, n, lookup(tables[0][1], 1)).reshape(total, n)
        else:
            held, done = np.zeros(total * n + 1, np.int32), 0
            for s in scans:
                many = len(s.layout.blocks) * n
                held[done : done + many].reshape(-1, n)[:] = s.parts[0].coefficients[s.layout.rows, x.ss : x.se + 1]
                done += many
            values = _refined(raw, at, ends - counts, ends, held, n, lookup(tables[0][1], 1, True), x.al).reshape(total, n)
        done = 0
        if x.ss:
            if x.ah == 0 and x.al:
                values <<= x.al
            for s in scans:
                many = len(s.layout.blocks)
                s.parts[0].coefficients[s.layout.rows, x.ss : x.se + 1] = values[done : done + many]
                done += many
            return True
        values <<= x.al
        units = values.reshape(-1, x.unit)
        cols = [[j for j, c in enumerate(x.pattern) if c == k] for k in range(len(x.places))]
        for s in scans:
            many = len(s.layout.blocks) // x.unit
            for p, own, c in zip(s.parts, s.layout.own, cols):
                mine = units[done : done + many, c[0] : c[-1] + 1].ravel()
                if x.ah:
                    p.coefficients[own, 0] |= mine
                else:
                    p.coefficients[own, 0] = mine
            done += many
        return True

    def _slow(self, parts, symbols, ss, se, ah, al, which, blocks, bits):
        last, run = [0] * len(parts), 0
        for k, block in zip(which, blocks):
            row = parts[k].coefficients[block]
            at = ss
            if at == 0:
                if ah:
                    row[0] |= bits.take(1) << al
                else:
                    last[k] += bits.amplitude(bits.symbol(symbols[k, 0]))
                    row[0] = last[k] << al
                if self.progressive:
                    continue
                at = 1
            if ah == 0:
                if run:
                    run -= 1
                    continue
                while at <= se:
                    zeros, s = divmod(bits.symbol(symbols[k, 1]), 16)
                    if s:
                        at += zeros
                        row[at] = bits.amplitude(s) << al
                        at += 1
                    elif zeros == 15:
                        at += 16
                    else:
                        run = (1 << zeros) + bits.take(zeros) - 1
                        break
                continue
            if not run:
                while at <= se:
                    zeros, s = divmod(bits.symbol(symbols[k, 1]), 16)
                    new = 0
                    if s:
                        new = 1 << al if bits.take(1) else -(1 << al)
                    elif zeros < 15:
                        run = (1 << zeros) + bits.take(zeros)
                        break
                    while at <= se:
                        if row[at]:
                            if bits.take(1):
                                row[at] += (1 << al) if row[at] > 0 else -(1 << al)
                        elif zeros == 0:
                            if new:
                                row[at] = new
                            at += 1
                            break
                        else:
                            zeros -= 1
                        at += 1
            if run:
                while at <= se:
                    if row[at] and bits.take(1):
                        row[at] += (1 << al) if row[at] > 0 else -(1 << al)
                    at += 1
                run -= 1

    def rgb(self) -> np.ndarray:
        """The tensor (height, width, 3)."""
        return tensors([self])[0]


class Layout:
    """What a scan's head says in a frame: components, bands, bits, (component's place in the scan, block) of every
    block in its order, blocks a unit, and blocks of the intervals between restarts."""

    def __init__(self, body: bytes, numbers: tuple, factors: tuple, across: int, down: int, extents: tuple, restart: int):
        self.places = tuple(numbers.index(body[1 + 2 * k]) for k in range(body[0]))
        self.chosen = [body[2 + 2 * k] for k in range(body[0])]
        self.ss, self.se, self.ah, self.al = *body[-3:-1], body[-1] >> 4, body[-1] & 15
        if len(self.places) == 1:
            (h, v), (high, wide) = factors[self.places[0]], extents[self.places[0]]
            self.blocks = np.arange(down * v * across * h).reshape(down * v, across * h)[:high, :wide].ravel()
            self.which, self.unit, self.all = np.zeros(len(self.blocks), np.int64), 1, len(self.blocks) == down * v * across * h
        else:
            rows, cols = np.divmod(np.arange(across * down), across)
            unit = [(k, *factors[c], y, x) for k, c in enumerate(self.places) for y in range(factors[c][1]) for x in range(factors[c][0])]
            self.blocks = np.stack([(rows * v + y) * (across * h) + cols * h + x for _, h, v, y, x in unit], 1).ravel()
            self.which, self.unit, self.all = np.tile([u[0] for u in unit], len(rows)), len(unit), False
        self.rows = slice(None) if self.all else self.blocks
        step = restart * self.unit if restart else len(self.blocks)
        whole, rest = divmod(len(self.blocks), step)
        self.counts = [step] * whole + [rest] * (rest > 0)
        self.own = [self.blocks[self.which == k] for k in range(len(self.places))]
        self.pattern = self.which[: self.unit].tolist()


_held_layout = functools.lru_cache(2048)(Layout)


class Scan:
    """A scan that waits to be decoded: its layout, components, tables and intervals."""

    __slots__ = ("image", "layout", "parts", "tables", "pieces", "kind")

    def __init__(self, image: Image, body: bytes, data: bytes):
        small = image.across * image.down <= 64
        self.image = image
        self.layout = x = (_held_layout if small else Layout)(body, image.numbers, image.factors, image.across, image.down, image.extents, image.restart)
        self.parts = [image.parts[j] for j in x.places]
        self.tables = tuple([(image.tables.get(c >> 4), image.tables.get(16 | c & 15)) for c in x.chosen])
        if b"\xff\x00" in data or len(x.counts) > 1:
            found = _RESTARTS.split(data) if image.restart else [data]
            self.pieces = [p.replace(b"\xff\x00", b"\xff") for p in found]
        else:
            self.pieces = [data]
        self.kind = image.progressive, body[-3:], x.unit > 1 and image.factors, len(x.places), self.tables if x.ss == 0 else self.tables[0][1]


def _decode(images: list[Image]) -> None:
    """Scans of one kind are decoded together; of one file those that follow one another and concern other components."""
    waiting = []
    for image in images:
        steps: list[list[Scan]] = []
        for s in image.scans:
            if steps and s.layout.ss and steps[-1][0].kind == s.kind and all(x.parts[0] is not s.parts[0] for x in steps[-1]):
                steps[-1].append(s)
            else:
                steps.append([s])
        waiting.append(steps)
        image.scans = []
    for k in range(max(map(len, waiting), default=0)):
        groups: dict[tuple, list[Scan]] = {}
        for steps in waiting:
            if k < len(steps):
                groups.setdefault(steps[k][0].kind, []).extend(steps[k])
        for scans in groups.values():
            if not Image._whole(scans):
                for s in scans:
                    s.image._bits(s)


def read(files: list[bytes]) -> list[Image]:
    images = [Image(f, False) for f in files]
    _decode(images)
    return images


def _windows(raw: bytes) -> np.ndarray:
    """At every byte, the 24 bits that begin there; ones follow the end."""
    b = np.frombuffer(raw + b"\xff" * 16, np.uint8)
    out = b[:-2].astype(np.int32)
    for k in (1, 2):
        out <<= 8
        out |= b[k : len(b) - 2 + k]
    return out


def _next(windows, at, table):
    """The next symbol of every stream as `lookup` tells it, its value, and which streams need to be looked at: these with
    their kinds and their amplitudes' bits, where the value is none or has just been read."""
    e = table[windows[at >> 3] >> (8 - (at & 7)) & 0xFFFF]
    v = e >> 32
    odd = (e & 1 << 11 != 0).nonzero()[0]
    if not len(odd):
        return e, v, odd, None
    more, kinds = v[odd], e[odd] >> 12 & 3
    if (kinds == _NONE >> 12).any():
        raise ValueError("no such code")
    begin = at[odd] + (e[odd] & 63) - more
    read = windows[begin >> 3] >> (24 - (begin & 7) - more) & (1 << more) - 1
    v[odd] = np.where(kinds == 0, read - ((1 << more) - 1) * (read < 1 << np.maximum(more - 1, 0)), 0)
    ends = kinds == _ENDS >> 12
    return e, v, odd[ends], (1 << more[ends]) + read[ends]


def _left(place, live, *others):
    """Streams that are not at their ends."""
    going = place < live
    return [x[going] for x in (place, live, *others)] if not going.all() else (place, live, *others)


def _in_step_dc(windows, at, first, end, tables, pattern) -> np.ndarray:
    """Values of a first DC scan, given streams' first bits and blocks; `pattern`: a unit's places in `tables`."""
    out, place, live, k = np.zeros(int(end[-1]), np.int32), first, end, 0
    while len(at):
        e, out[place], _, _ = _next(windows, at, tables[pattern[k % len(pattern)]])
        k += 1
        place, live, at = _left(place + 1, live, at + (e & 63))
    units = out.reshape(-1, len(pattern))
    for c in range(len(tables)):
        cols = [j for j, x in enumerate(pattern) if x == c]
        own = np.cumsum(units[:, cols[0] : cols[-1] + 1].ravel())
        starts = first // len(pattern) * len(cols)
        own -= np.repeat(np.where(starts > 0, own[starts - 1], 0), (end - first) // len(pattern) * len(cols))
        units[:, cols[0] : cols[-1] + 1] = own.reshape(-1, len(cols))
    return out


def _in_step(windows, at, first, end, n, table) -> np.ndarray:
    """Values of a first AC scan of bands of n, given streams' first bits and blocks."""
    size = int(end[-1]) * n
    out = np.zeros(size + 1, np.int32)  # one more for what is no value
    place, live = first * n, end * n
    while len(at):
        e, v, ends, run = _next(windows, at, table)
        here = place + (e >> 6 & 15)
        after = here + 1
        if len(ends):
            after[ends] = (place[ends] // n + run) * n
            here[ends] = size
        out[here] = v
        place, live, at = _left(after, live, at + (e & 63))
    return out[:size]


def _refined(raw, at, first, end, out, n, table, al) -> np.ndarray:
    """Coefficients after a refining AC scan, in place; `out` has one more than all bands of n."""
    windows, size, known = _windows(raw), len(out) - 1, out != 0
    unknown = ~known[:-1]
    zeros = np.append(unknown.nonzero()[0], [size] * 16)
    rank = np.zeros(size + 1, np.int32)
    np.cumsum(unknown, out=rank[1:])
    old = out[known]
    place, live, spans = first * n, end * n, []
    while len(at):
        e, v, ends, run = _next(windows, at, table)
        skip = e >> 6 & 15
        here = zeros[rank[place] + skip]
        after, passed = here + 1, here - place - skip
        if len(ends):
            p = place[ends]
            after[ends] = q = (p // n + run) * n
            passed[ends] = q - p - (rank[q] - rank[p])
            here[ends] = size
        out[here] = v << al
        at = at + (e & 63)
        spans.append((at, at + passed))
        place, live, at = _left(after, live, at + passed)
    # what is not symbols are the known ones' bits, in their order
    begin, past = (np.concatenate(x) for x in zip(*spans))
    some = past > begin
    edge = np.zeros(8 * len(raw) + 1, np.int8)
    edge[begin[some]] = 1
    edge[past[some]] = -1
    more = np.unpackbits(np.frombuffer(raw, np.uint8))[np.cumsum(edge[:-1], dtype=np.int8).view(bool)].astype(np.int32) << al
    out[known] = old + np.where(old > 0, more, -more)
    return out[:-1]


_SCALE = 12
_BASIS = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << _SCALE))
_WAVES = np.kron(_BASIS, _BASIS)[ZIGZAG]  # of every coefficient, its 64 samples


def forward_transform(samples: np.ndarray, step: int) -> np.ndarray:
    """Coefficients in zigzag order of blocks' samples less 128 (n, 64), quantised. All sums are exact."""
    return np.floor(samples @ _WAVES.T * (1 / (step << (2 * _SCALE))) + 0.5).astype(np.int32)


def inverse_transform(coefficients: np.ndarray) -> np.ndarray:
    """Samples 0..255 of blocks (n, 64) in zigzag order. All sums are of whole numbers below 2**53, so exact."""
    c = np.asarray(coefficients, np.float64) @ _WAVES
    c += 1 << (2 * _SCALE - 1)
    c *= 1 / (1 << (2 * _SCALE))
    np.floor(c, out=c)
    c += 128
    return np.clip(c, 0, 255, out=c).astype(np.int32)


def worst_error() -> float:
    """How far a stored sample can come back from what it was: by the rounding of the waves, by quantisation (by a power
    of two, exact), and by rounding to a whole sample."""
    waves = _WAVES / (1 << (2 * _SCALE))
    return (120 * abs(waves.T @ waves - np.eye(64)).sum(0) + STEP / 2 * abs(waves).sum(0)).max() + 0.5


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """The JFIF conversion, in 16-bit fixed point."""
    cb, cr, y = cb - 128, cr - 128, (y << 16) + (1 << 15)
    both = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], -1) >> 16
    return np.clip(both, 0, 255).astype(np.uint8)


def _of_lines(p: Component) -> np.ndarray:
    """A component's coefficients in the order of units."""
    if p.h == p.v == 1:
        return p.coefficients
    return p.coefficients.reshape(p.lines // p.v, p.v, p.stride // p.h, p.h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def _transform(images: list[Image]) -> None:
    """Samples of the files' blocks, in the order of units, (units, v, h, 8, 8) of each component."""
    samples: dict[int, list[np.ndarray]] = {}
    for c in range(len(images[0].parts)):
        own, at = [i.parts[c] for i in images], 0
        found = np.empty((sum(len(p.coefficients) for p in own), 8, 8), np.uint8)
        rows, quants = np.concatenate([_of_lines(p) for p in own]), [i.quants[p.quant] for i, p in zip(images, own)]
        one = quants[0] if all(q is quants[0] for q in quants) else np.concatenate([np.broadcast_to(q, (len(p.coefficients), 64)) for q, p in zip(quants, own)])
        for k in range(0, len(found), 2 * _PART):
            here = slice(k, k + 2 * _PART)
            found[here] = inverse_transform(rows[here] * (one if one.ndim == 1 else one[here])).reshape(-1, 8, 8)
        for i, p in zip(images, own):
            many = len(p.coefficients)
            samples[id(i)] = [*samples.get(id(i), [])[:c], found[at : at + many].reshape(-1, *i.factors[c][::-1], 8, 8)]
            at += many
    for i in images:
        i.blocks = samples[id(i)]


def _colours(images: list[Image]) -> list[np.ndarray]:
    planes, tall, wide = [], images[0].v, images[0].h
    for c, (h, v) in enumerate(images[0].factors):
        p = np.concatenate([i.blocks[c] for i in images]).transpose(0, 1, 3, 2, 4).reshape(-1, 8 * v, 8 * h)
        planes.append(p.repeat(tall // v, 1).repeat(wide // h, 2))
    units = to_rgb(*(p.astype(np.int32) for p in planes)) if len(planes) == 3 else np.stack([planes[0]] * 3, -1)
    out, at = [], 0
    for i in images:
        n = i.across * i.down
        one = units[at : at + n].reshape(i.down, i.across, 8 * tall, 8 * wide, 3).transpose(0, 2, 1, 3, 4).reshape(8 * tall * i.down, -1, 3)
        out.append(np.ascontiguousarray(one[: i.height, : i.width]))
        at += n
    return out


def _groups(images: list[Image]):
    """Files of the same factors, as many at once as stay in a processor's cache."""
    group, many = [], 0
    for i in images:
        if group and (many > 1024 or i.factors != group[0].factors):
            yield group
            group, many = [], 0
        group.append(i)
        many += sum(len(p.coefficients) for p in i.parts)
    if group:
        yield group


def tensors(images: list[Image]) -> list[np.ndarray]:
    """The tensors of several files."""
    out = []
    for group in _groups(images):
        _transform(group)
        out += _colours(group)
    return out


def restore(image: Image) -> bytes:
    """The payload that `store` put into a file, from the file's samples."""
    if image.blocks is None:
        _transform([image])
    halves = np.concatenate([b.reshape(len(b), -1) for b in image.blocks], 1) >> 4
    return (halves[:, :UNIT] << 4 | halves[:, UNIT:]).tobytes()[: struct.unpack(">Q", image.comment)[0]]


def features(tensor: np.ndarray) -> str:
    """Size, mean colour in 256ths, and the checksum of the tensor."""
    many = 48 if tensor.size % 48 == 0 else 3  # colours of 16 pixels
    sums = tensor.reshape(-1, many).sum(0, dtype=np.int64).reshape(-1, 3).sum(0) * 256 // (tensor.shape[0] * tensor.shape[1])
    return f"{tensor.shape[1]}x{tensor.shape[0]}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(tensor.tobytes()):08x}"


def media(documents: DataFrame, *, with_media: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media, rgb]).

    Each text's UTF-8 bytes are stored as a file, and everything but n_bytes comes from the file as read back.
    """
    small_batches(documents.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in (part for whole in batches for part in portions(whole, 2 << 20)):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(b["text"])]
            files = store([padded(r) for r in raw])
            images, out = read(files), [[] for _ in range(9)]
            for n, f, image, tensor in zip(map(len, raw), files, images, tensors(images)):
                payload = restore(image)
                row = n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), features(tensor), f, tensor.tobytes() if with_media else b""
                for c, v in zip(out, row):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            arrays = [b["doc_id"], *(pa.array(c, t) for c, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(arrays if with_media else arrays[:8], names + ["media", "rgb"] * with_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return typed(documents).mapInArrow(released(run), schema + (", media binary, rgb binary" if with_media else ""))
