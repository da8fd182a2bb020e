"""Files that `jpeg.store` writes go through the whole method: samples, transform, subsampling, runs, Huffman codes, scans."""

import numpy as np
import pytest

from geoloom.llm import jpeg


def payloads():
    r = np.random.default_rng(5)
    text = ("Some words, and others; " * 400).encode()
    odd = r.integers(0, 256, jpeg.UNIT * 37, dtype=np.uint8)
    odd[: jpeg.UNIT * 20] = 0x66
    odd[jpeg.UNIT * 5] = 0x67
    return [b" " * jpeg.UNIT, b"f" * jpeg.UNIT * 70, odd.tobytes(), jpeg.padded(text), (np.indices((16, jpeg.UNIT)).sum(0) % 2 * 255).astype(np.uint8).tobytes(), r.choice(np.array([0, 255], np.uint8), jpeg.UNIT * 64).tobytes()]


def halves(payload):
    raw = np.frombuffer(payload, np.uint8).reshape(-1, jpeg.UNIT)
    return np.concatenate([raw >> 4, raw & 15], 1)


def test_samples_of_another_reader(spark):
    """The JVM's reader finds the payload's halves in the brightness of ordinary progressive files."""
    jvm = spark._jvm
    for payload, raw in zip(payloads(), jpeg.store(payloads())):
        reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
        reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(raw)))
        raster = reader.readRaster(0, None)
        units = len(payload) // jpeg.UNIT
        assert (raster.getWidth(), raster.getHeight()) == (16 * units, 16)
        bright = np.frombuffer(raster.getDataBuffer().getData(), np.uint8).reshape(16, 16 * units, 3)[..., 0]
        blocks = bright.reshape(2, 8, units, 2, 8).transpose(2, 0, 3, 1, 4).reshape(units, 256)
        assert (blocks >> 4 == halves(payload)[:, :256]).all()
        image = jpeg.Image(raw)
        jpeg.tensors([image])
        assert abs(image.blocks[0].reshape(units, 256).astype(int) - blocks).max() <= 1


def test_no_sample_comes_back_as_another():
    assert jpeg.worst_error() < 8
    for payload, image in zip(payloads(), jpeg.read(jpeg.store(payloads()))):
        assert jpeg.restore(image) == payload
        found = np.concatenate([b.reshape(len(b), -1) for b in image.blocks], 1).astype(int)
        assert abs(found - (16 * halves(payload).astype(int) + 8)).max() < 8


def test_steps_of_the_method():
    """Zeros, runs of ended bands, codes of many lengths, DC in two scans, subsampled colour."""
    image = jpeg.Image(jpeg.store([payloads()[2]])[0], False)
    assert image.progressive and image.factors == ((2, 2), (1, 1), (1, 1)) and (image.quants[0] == 2).all()
    assert [(s.layout.ss, s.layout.se, s.layout.ah, s.layout.al) for s in image.scans if len(s.parts) == 3] == [(0, 0, 0, 1), (0, 0, 1, 0)]
    widths = {n + (s & 15) for s, (_, n) in jpeg.codes_of(image.tables[16]).items()}
    assert len(widths) > 6
    jpeg._decode([image])
    ac = np.concatenate([p.coefficients[:, 1:] for p in image.parts])
    assert (ac == 0).all(1).any() and (ac[(ac != 0).any(1)] == 0).any() and (abs(ac) == 1).any()


@pytest.mark.parametrize("share", [0, 0.003, 0.02, 0.3, 1])
@pytest.mark.parametrize("wide", [4095, 3])
def test_any_coefficients(monkeypatch, share, wide):
    """What is coded is read again, in step and bit by bit, whatever zeros lie between; several files at once."""
    r = np.random.default_rng(int(share * 1000))
    monkeypatch.setattr(jpeg, "MOST_WIDE", wide)

    def made(samples, step):
        sizes = r.choice([1, 2, 3, 9, 100, 480], (len(samples), 64)) * r.choice([-1, 1], (len(samples), 64))
        out = np.where(r.random(sizes.shape) < share, sizes, 0)
        kept.append(out)
        return out

    kept = []
    monkeypatch.setattr(jpeg, "forward_transform", made)
    units = [1, 7, 45, 16]
    files = jpeg.store([b" " * jpeg.UNIT * n for n in units])
    want, at, images = np.concatenate(kept).reshape(-1, 6, 64), 0, jpeg.read(files)
    alone = [jpeg.Image(f) for f in files]
    monkeypatch.setattr(jpeg, "FEW", 0)
    alone += [jpeg.Image(f) for f in files]
    monkeypatch.setattr(jpeg.Image, "_whole", lambda *a: False)
    for n, *ways in zip(units, images, alone[:4], alone[4:], [jpeg.Image(f) for f in files]):
        full = min(n, wide) * -(-n // min(n, wide))
        for image in ways:
            bright = image.parts[0].coefficients.reshape(image.down, 2, image.across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(full, 4, 64)
            assert (bright == want[at : at + full, :4]).all()
            assert all((image.parts[c].coefficients == want[at : at + full, 3 + c]).all() for c in (1, 2))
        at += full
    assert at == len(want)


def test_codes_that_are_none():
    raw = jpeg.store([b"some text " * 96])[0]
    at = raw.index(jpeg._HEADS[1]) + len(jpeg._HEADS[1])
    with pytest.raises(ValueError):
        jpeg.Image(raw[:at] + b"\xff\x00" * 40 + raw[at + 80 :])
