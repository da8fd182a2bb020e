"""JPEG files written here, bit by bit, with known coefficients: subsampled colour, restarts, runs of ended bands, one component."""

import struct

import numpy as np
import pytest

from geoloom.llm import jpeg

DC, AC = {s: 5 for s in range(16)}, {s: 8 + s % 2 for s in range(256)}
QUANT = np.arange(1, 65)


class Writer:
    def __init__(self):
        self.bits, self.run, self.later = [], 0, []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, lengths, s):
        self.put(*jpeg.codes_of(jpeg.table_bytes(0, 0, lengths)[5:])[s])

    def amplitude(self, v):
        s = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << s) - 1, s)

    def dc(self, diff):
        self.symbol(DC, abs(diff).bit_length())
        self.amplitude(diff)

    def end_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(AC, n << 4)
            self.put(self.run - (1 << n), n)
            self.bits += self.later
        self.run, self.later = 0, []

    def first(self, row, ss, se, al, sequential=False):
        zeros = 0
        for v in row[ss : se + 1]:
            v = int(np.sign(v)) * (abs(int(v)) >> al)
            if v == 0:
                zeros += 1
                continue
            self.end_run()
            while zeros > 15:
                self.symbol(AC, 0xF0)
                zeros -= 16
            self.symbol(AC, zeros << 4 | abs(v).bit_length())
            self.amplitude(v)
            zeros = 0
        if zeros:
            self.run += 1
            if sequential:
                self.end_run()

    def refine(self, row, ss, se, al):
        sizes = [abs(int(v)) >> al for v in row]
        last = max((k for k in range(ss, se + 1) if sizes[k] == 1), default=-1)
        zeros, held = 0, []
        for k in range(ss, se + 1):
            if sizes[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                self.end_run()
                self.symbol(AC, 0xF0)
                self.bits += held
                zeros, held = zeros - 16, []
            if sizes[k] > 1:
                held.append(sizes[k] & 1)
                continue
            self.end_run()
            self.symbol(AC, zeros << 4 | 1)
            self.put(int(row[k] > 0), 1)
            self.bits += held
            zeros, held = 0, []
        if zeros or held:
            self.run += 1
            self.later += held

    def bytes(self):
        self.end_run()
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def picture(r, width, height, factors):
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    out = []
    for fh, fv in factors:
        c = np.zeros((down * fv, across * fh, 64), int)
        c[..., 0] = r.integers(-60, 60, c.shape[:2])
        for _ in range(5):
            at = r.integers(1, 64, c.shape[:2])
            np.put_along_axis(c, at[..., None], r.integers(-9, 10, c.shape[:2])[..., None], 2)
        c[r.random(c.shape[:2]) < 0.4, 1:] = 0
        out.append(c)
    return out, across, down


def encode(r, width, height, factors, progressive, restart):
    parts, across, down = picture(r, width, height, factors)
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    every = list(range(len(parts)))

    def units(chosen):
        if len(chosen) > 1 or len(parts) == 1 and factors[0] == (1, 1):
            for y in range(down):
                for x in range(across):
                    yield [(k, y * factors[k][1] + j, x * factors[k][0] + i) for k in chosen for j in range(factors[k][1]) for i in range(factors[k][0])]
        else:
            k = chosen[0]
            for y in range(-(-(-(-height * factors[k][1] // v)) // 8)):
                for x in range(-(-(-(-width * factors[k][0] // h)) // 8)):
                    yield [(k, y, x)]

    def scan(chosen, ss, se, ah, al):
        w, last, data = Writer(), dict.fromkeys(chosen, 0), b""
        for n, unit in enumerate(units(chosen)):
            if restart and n and n % restart == 0:
                data += w.bytes() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                last = dict.fromkeys(chosen, 0)
            for k, y, x in unit:
                row = parts[k][y, x]
                if ss == 0:
                    if ah:
                        w.put(int(row[0]) >> al & 1, 1)
                    else:
                        w.dc((int(row[0]) >> al) - last[k])
                        last[k] = int(row[0]) >> al
                if not progressive:
                    w.first(row, 1, 63, 0, True)
                elif ss:
                    w.refine(row, ss, se, al) if ah else w.first(row, ss, se, al)
        return jpeg._scan([k + 1 for k in chosen], 0, ss, se, ah, al) + data + w.bytes()

    if progressive:
        scans = [scan(every, 0, 0, 0, 1), *(scan([k], *band, 0, 2) for k in every for band in ((1, 5), (6, 63))), scan(every, 0, 0, 1, 0), *(scan([k], 1, 63, a + 1, a) for a in (1, 0) for k in every)]
    else:
        scans = [scan(every, 0, 63, 0, 0)]
    frame = bytes([0xFF, 0xC2 if progressive else 0xC0]) + struct.pack(">HBHHB", 8 + 3 * len(parts), 8, height, width, len(parts)) + b"".join(bytes([k + 1, f[0] << 4 | f[1], 0]) for k, f in enumerate(factors))
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(QUANT.tolist())
    again = b"\xff\xdd" + struct.pack(">HH", 4, restart) if restart else b""
    return b"\xff\xd8" + quant + frame + jpeg.table_bytes(0, 0, DC) + jpeg.table_bytes(1, 0, AC) + again + b"".join(scans) + b"\xff\xd9", parts


def samples(blocks):
    """Of dequantised blocks by the transform's definition, in floating point."""
    u = np.arange(8)
    basis = np.where(u == 0, 0.125**0.5, 0.5)[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    c = np.zeros((*blocks.shape[:2], 64))
    c[..., jpeg.ZIGZAG] = blocks * QUANT
    out = np.einsum("yxuv,ui,vj->yixj", c.reshape(*blocks.shape[:2], 8, 8), basis, basis)
    return np.clip(np.round(out.reshape(blocks.shape[0] * 8, -1) + 128), 0, 255)


FORMS = [([(2, 2), (1, 1), (1, 1)], True, 0), ([(2, 2), (1, 1), (1, 1)], True, 3), ([(2, 1), (1, 1), (1, 1)], False, 2), ([(1, 1)], True, 5), ([(1, 1)], False, 0), ([(1, 1)] * 3, True, 0), ([(1, 1)] * 3, False, 0)]


@pytest.mark.parametrize("factors,progressive,restart", FORMS)
@pytest.mark.parametrize("size", [(37, 21), (64, 48)])
def test_files_of_other_writers(factors, progressive, restart, size):
    width, height = size
    raw, parts = encode(np.random.default_rng(width + restart), width, height, factors, progressive, restart)
    image = jpeg.Image(raw)
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    planes = []
    for found, want, (fh, fv) in zip(image.parts, parts, factors):
        high, wide = (want.shape[:2] if not progressive else (found.high, found.wide))
        same = found.coefficients.reshape(want.shape) == want
        assert same[:high, :wide].all()
        planes.append(samples(want).repeat(v // fv, 0).repeat(h // fh, 1)[:height, :width])
    if len(planes) == 1:
        want = np.stack([planes[0]] * 3, -1)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    for got in (image.rgb(), jpeg.tensors([image, image])[1]):
        assert got.shape == (height, width, 3) and abs(got.astype(float) - want).max() <= 3
