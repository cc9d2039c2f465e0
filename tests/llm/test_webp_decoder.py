"""The decoder on streams written here with every feature of the format."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from tieout.llm import webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def data(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(bits[k + j] << j for j in range(8)) for k in range(0, len(bits), 8))


def riff(stream):
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def flat_code(w, size, used):
    """A code in which the first ``used`` symbols (a power of two) have equal lengths, written with a repeat code where it can be."""
    n = used.bit_length() - 1
    lengths = [n] * used + [0] * (size - used)
    w.put(0, 1)
    w.put(15, 4)
    own = {n: 1, 18: 2, 16: 2}  # code length codes: n -> 0, 16 -> 10, 18 -> 11
    for symbol in webp.LENGTH_CODE_ORDER:
        w.put(own.get(symbol, 0), 3)
    w.put(0, 1)
    k = 0
    while k < size:
        if lengths[k]:
            run = min(6, used - k)
            if k and run >= 3:
                w.put(0b01, 2)
                w.put(run - 3, 2)
                k += run
            else:
                w.put(0, 1)
                k += 1
        else:
            run = min(138, size - k)
            if 0 < size - k - run < 11:
                run -= 11  # leaves enough for another run
            w.put(0b11, 2)
            w.put(run - 11, 7)
            k += run
    return lambda s: w.put(int(f"{s:0{n}b}"[::-1], 2), n)


def simple(w, *symbols):
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    w.put(symbols[0], 8)
    for s in symbols[1:]:
        w.put(s, 8)


def pixels(w, image, main, cache_bits=0, operations=None):
    """(h, w, 4) of alpha, red, green, blue by literals, or by ``operations``."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    green = flat_code(w, size, 512 if cache_bits == 9 else 256)
    channel = []
    for k in (1, 3, 0):
        values = sorted({int(v) for v in image[:, :, k].ravel()})
        if len(values) == 1:
            simple(w, values[0])
            channel.append(None)
        else:
            w.put(0, 1)
            w.put(15, 4)
            for symbol in webp.LENGTH_CODE_ORDER:
                w.put(1 if symbol in (8, 7) else 0, 3)
            w.put(0, 1)
            for _ in range(256):
                w.put(1, 1)  # lengths 7 -> 0, 8 -> 1
            channel.append(lambda s: w.put(int(f"{s:08b}"[::-1], 2), 8))
    flat_distance = flat_code(w, 40, 16) if operations else simple(w, 0)
    for op in operations or [("pixel", *p) for p in image.reshape(-1, 4).tolist()]:
        if op[0] == "pixel":
            a, r, g, b = op[1:]
            green(g)
            for put, v in zip(channel, (r, b, a)):
                if put:
                    put(v)
        elif op[0] == "copy":
            green(256 + op[1])  # prefix of the length
            w.put(op[2], op[3])
            flat_distance(op[4])
            w.put(op[5], op[6])
        else:
            green(280 + op[1])


def header(w, width, height):
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)


def done(w):
    w.put(0, 1)


@pytest.fixture
def image():
    rng = np.random.default_rng(2)
    out = rng.integers(0, 256, (6, 9, 4), dtype=np.uint8)
    out[:, :, 0] = 255
    return out


def test_literals(image):
    w = Writer()
    header(w, 9, 6)
    done(w)
    pixels(w, image, True)
    assert (webp.decode(riff(w.data())) == image).all()


def test_subtract_green_and_cross_colour(image):
    w = Writer()
    header(w, 9, 6)
    block = np.zeros((2, 3, 4), np.uint8)
    block[:, :, 0] = 255
    block[:, :, 1:] = np.random.default_rng(5).integers(0, 256, (2, 3, 3))
    coded = image.copy()
    coded[:, :, 1] -= image[:, :, 2]
    coded[:, :, 3] -= image[:, :, 2]
    inner = coded.copy()
    for y in range(6):
        for x in range(9):
            r2b, g2b, g2r = (int(np.int8(v)) for v in block[y >> 2, x >> 2, 1:])
            g, r = int(np.int8(coded[y, x, 2])), int(np.int8(coded[y, x, 1]))
            inner[y, x, 1] = (int(coded[y, x, 1]) - (g2r * g >> 5)) & 255
            inner[y, x, 3] = (int(coded[y, x, 3]) - (g2b * g >> 5) - (r2b * r >> 5)) & 255
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(0, 3)  # blocks of 4
    pixels(w, block, False)
    done(w)
    pixels(w, inner, True)
    assert (webp.decode(riff(w.data())) == image).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(image, mode):
    height, width = 6, 9
    flat = image.astype(int).reshape(-1, 4)
    out = np.zeros_like(flat)
    avg = lambda a, b: (a + b) // 2
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if y == 0:
                p = flat[at - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = flat[at - width]
            else:
                left, top, corner, right = flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1]
                if mode == 11:
                    p = np.array(left if sum(abs(left + top - corner - left)) < sum(abs(left + top - corner - top)) else top)
                elif mode == 13:
                    m = avg(left, top)
                    p = np.array([min(255, max(0, int(a + int((a - c) / 2)))) for a, c in zip(m, corner)])
                else:
                    p = [np.array([255, 0, 0, 0]), left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right)), None, np.clip(left + top - corner, 0, 255)][mode]
            out[at] = (flat[at] - p) & 255
    residual = out.reshape(height, width, 4).astype(np.uint8)
    block = np.zeros((2, 3, 4), np.uint8)
    block[:, :, 0], block[:, :, 2] = 255, mode
    w = Writer()
    header(w, width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(0, 3)
    pixels(w, block, False)
    done(w)
    pixels(w, residual, True)
    assert (webp.decode(riff(w.data())) == image).all()


@pytest.mark.parametrize("colours", [2, 3, 5, 20])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    index = rng.integers(0, colours, (5, 11))
    packing = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    across = -(-11 // (1 << packing))
    packed = np.zeros((5, across, 4), np.uint8)
    packed[:, :, 0] = 255
    for y in range(5):
        for x in range(11):
            packed[y, x >> packing, 2] |= index[y, x] << ((x & ((1 << packing) - 1)) * (8 >> packing))
    w = Writer()
    header(w, 11, 5)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(colours - 1, 8)
    pixels(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], False)
    done(w)
    pixels(w, packed, True)
    assert (webp.decode(riff(w.data())) == table[index]).all()


def test_references_and_colour_cache():
    number = lambda p: p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]
    slot = lambda p: (webp.CACHE_FACTOR * number(p) & 0xFFFFFFFF) >> 23
    # the test's code has symbols for the first 232 places of the cache only
    a = next(p for p in ((255, 10, 20, k) for k in range(256)) if slot(p) < 232)
    b = next(p for p in ((255, 40, 50, k) for k in range(256)) if slot(p) != slot(a))
    operations = [
        ("pixel", *a), ("pixel", *b),
        ("copy", 3, 0, 0, 13, 25, 5),  # 4 pixels; 122 is 2 beyond the 120 near places: from 2 back
        ("cache", slot(a)), ("pixel", *b),
        ("copy", 7, 3, 2, 0, 0, 0),  # 16 pixels from the row above, near place 1
    ]
    w = Writer()
    header(w, 8, 3)
    done(w)
    pixels(w, np.array([[a, b]], np.uint8), True, 9, operations)
    assert webp.decode(riff(w.data())).reshape(-1, 4).tolist() == [list(a), list(b)] * 12


def test_near_places_are_those_of_the_format():
    places = webp.near_places()
    assert len(places) == 120 and places[:8] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)) and places[-3:] == ((-7, 7), (8, 6), (8, 7))


@pytest.mark.parametrize("bad", [b"", b"RIFF\0\0\0\0WEBP", riff(b"\x2e\0\0\0\0\0"), riff(b"\x2f\0\0\0\0")])
def test_malformed(bad):
    with pytest.raises(ValueError):
        webp.decode(bad)
