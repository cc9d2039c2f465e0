"""Lossless WebP (VP8L, RFC 9649): a decoder of whole streams, and bytes stored as grey images.

The decoder reads RIFF containers (still and animated), simple and normal prefix codes, groups of them (entropy images),
back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms, into an array
of 8-bit ARGB samples. It works on all streams of a batch at once: one step reads one symbol of every stream, whatever its codes
are, and so costs the same per symbol for long texts and short ones. A symbol's bits never depend on pixels, so references are
resolved afterwards, all together, by following pointers in doubling steps; transforms are inverted on whole arrays.

Bytes are stored as the samples of grey images, 64 wide and at most 64 high. A text of more bytes is one animated file whose frames
follow one another. Green is subtracted from red and blue, which leaves nothing of them; repeated stretches are back-references;
the rest has one fixed prefix code. Images of at most sixteen greys have a palette, which packs several samples into one,
where that is shorter (blank or very plain texts). The other transforms, own codes for each image and the colour cache never pay for
text, so they are read but not written.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.storage import written

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES, MAX_CODE_BITS = 24, 40, 15
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

WIDTH = 64
TILE = WIDTH * 64
#: Longest codes of the stored form, for samples and lengths, and for distances.
_STORED_BITS, _STORED_DISTANCE_BITS = 12, 8
#: Fewest bytes that a stored reference copies.
MIN_MATCH = 5
#: Pixels and streams that are read at a time, and pixels that are written at a time (their arrays fit a core's cache).
MOST_PIXELS, MOST_STREAMS, WRITE_PIXELS = 4 << 20, 4096, 1 << 18


@cache
def near_places() -> tuple[tuple[int, int], ...]:
    """(left, up) of the 120 short distance codes: places around a pixel by distance, then by how far aside."""
    around = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        first, shift = divmod(self.at, 8)
        got = int.from_bytes(self.data[first : first + 8], "little") >> shift & ((1 << n) - 1)
        self.at += n
        return got


class Code:
    """A canonical prefix code by code lengths; one symbol alone has a code of no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("a prefix code without symbols")
        self.only = used[0] if len(used) == 1 else None
        self.lengths, self.by_code, self.key = lengths, {}, tuple(lengths)
        if self.only is not None:
            return
        if sum(2.0 ** -lengths[s] for s in used) != 1.0:
            raise ValueError("a prefix code that is not complete")
        code, last = 0, 0
        for s in sorted(used, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            self.by_code[last, code] = s
            code += 1

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, MAX_CODE_BITS + 1):
            code = code << 1 | bits.read(1)
            if (s := self.by_code.get((n, code))) is not None:
                return s
        raise ValueError("no such prefix code")


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for symbol in [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else []):
            if symbol >= size:
                raise ValueError("a symbol beyond its alphabet")
            lengths[symbol] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_CODE_ORDER[k]] = bits.read(3)
    lengths_code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        symbol = lengths_code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        value, times = {16: (before, 3), 17: (0, 3), 18: (0, 11)}[symbol]
        times += bits.read({16: 2, 17: 3, 18: 7}[symbol])
        if at + times > size:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    return Code(lengths)


def _read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """Codes of green, red, blue, alpha and distance."""
    green = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    return [_read_code(bits, n) for n in (green, 256, 256, 256, DISTANCE_CODES)]


def _long_value(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _read_cache_bits(bits: Bits) -> int:
    if not bits.read(1):
        return 0
    n = bits.read(4)
    if not 1 <= n <= 11:
        raise ValueError("colour cache of a wrong size")
    return n


def _read_pixels(bits: Bits, width: int, height: int) -> list[int]:
    """A small image inside a head (blocks, a palette), which has one group of codes, as ARGB numbers, row by row."""
    cache_bits = _read_cache_bits(bits)
    group, seen, out, total = _read_group(bits, cache_bits), [0] * (1 << cache_bits), [], width * height

    def put(pixel: int) -> None:
        out.append(pixel)
        if cache_bits:
            seen[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while len(out) < total:
        at, symbol = len(out), group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            put(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 256 + LENGTH_CODES:
            length = _long_value(bits, symbol - 256)
            code = _long_value(bits, group[4].read(bits))
            if code > len(near_places()):
                distance = code - len(near_places())
            else:
                left, up = near_places()[code - 1]
                distance = max(1, left + up * width)
            if distance > at or at + length > total:
                raise ValueError("a reference outside the image")
            for _ in range(length):
                put(out[-distance])
        else:
            put(seen[symbol - 256 - LENGTH_CODES])
    return out


def _channels(pixels: list[int], height: int, width: int) -> np.ndarray:
    """(height, width, 4) of alpha, red, green, blue."""
    return np.array(pixels, dtype=">u4").view(np.uint8).reshape(height, width, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, left, top, corner, right) -> np.ndarray:
    """The prediction of one pixel from those to its left, above, above left and above right (int arrays of 4)."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode == 11:
        nearer = np.abs(top - corner).sum() < np.abs(left - corner).sum()
        return left if nearer else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = (mean - corner) / 2
        return np.clip(mean + np.trunc(half).astype(int), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner), 7: lambda: _average(left, top),
        8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
    }[mode]()


def invert_predictor(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Residuals to samples; ``modes``: the block image's green samples."""
    height, width, _ = image.shape
    out = image.astype(int)
    flat = out.reshape(-1, 4)
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not y:
                guess = flat[at - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                guess = flat[at - width]
            else:
                # to the right of the last column comes the first pixel of this row
                guess = _predicted(int(modes[y >> shift, x >> shift]) & 15, flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1])
            flat[at] = (flat[at] + guess) & 255
    return out.astype(np.uint8)


def invert_cross_colour(image: np.ndarray, elements: np.ndarray, shift: int) -> np.ndarray:
    """Adds to red and blue what block factors make of green, and to blue what they make of red."""
    height, width, _ = image.shape
    each = elements[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    signed = lambda a: a.astype(np.uint8).astype(np.int8).astype(int)
    red_to_blue, green_to_blue, green_to_red = (signed(each[:, :, k]) for k in (1, 2, 3))
    out = image.astype(int)
    green = signed(out[:, :, 2])
    out[:, :, 1] = (out[:, :, 1] + (green_to_red * green >> 5)) & 255
    out[:, :, 3] = (out[:, :, 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(out[:, :, 1]) >> 5)) & 255
    return out.astype(np.uint8)


def invert_subtract_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[:, :, 1] += image[:, :, 2]
    out[:, :, 3] += image[:, :, 2]
    return out


def invert_palette(image: np.ndarray, table: np.ndarray, packing: int, width: int) -> np.ndarray:
    """Green samples, of which each may pack several indices, to colours; indices beyond the table are clear black."""
    index = image[:, :, 2].astype(int)
    if packing:
        each, size = 1 << packing, 8 >> packing
        index = (index[:, :, None] >> (size * np.arange(each)) & ((1 << size) - 1)).reshape(image.shape[0], -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of the chunks of a stretch of a container."""
    at = 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("the stream ends early")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def streams_of(data: bytes) -> list[bytes]:
    """The VP8L streams of a file: that of a still image, or those of all frames in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP container")
    out = []
    for kind, content in chunks(data[12 : 8 + struct.unpack_from("<I", data, 4)[0]]):
        if kind == b"VP8L":
            out.append(content)
        elif kind == b"ANMF":
            out += [inner for name, inner in chunks(content[16:]) if name == b"VP8L"]
    if not out:
        raise ValueError("no lossless image")
    return out


@dataclass
class _Layout:
    """What a stream says before its main image's pixels."""

    width: int
    height: int
    steps: list
    across: int
    cache_bits: int
    groups: list
    which: np.ndarray | None
    shift: int
    bits: int


def _layout(stream: bytes) -> _Layout:
    bits = Bits(stream)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("a version that is not known")
    steps, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            across, down = (now + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            block = _channels(_read_pixels(bits, across, down), down, across)
            steps.append((kind, block[:, :, 2] if kind == PREDICTOR else block, shift))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, size, 1), 1, size)[0], axis=0, dtype=np.uint8)
            packing = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, table, packing, now))
            now = (now + (1 << packing) - 1) >> packing
        else:
            steps.append((kind,))
    cache_bits, which, shift = _read_cache_bits(bits), None, 0
    if bits.read(1):
        shift = bits.read(3) + 2
        across, down = (now + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        which = np.array([p >> 8 & 0xFFFF for p in _read_pixels(bits, across, down)], np.int64)
    groups = [_read_group(bits, cache_bits) for _ in range(int(which.max()) + 1 if which is not None else 1)]
    return _Layout(width, height, steps, now, cache_bits, groups, which, shift, bits.at)


#: By the number of a head's bits: layouts of heads with these bits, each parsed once.
_LAYOUTS: dict[int, dict[int, _Layout]] = {}


def _known_layout(stream: bytes) -> _Layout:
    for bits, known in _LAYOUTS.items():
        if (found := known.get(int.from_bytes(stream[: -(-bits // 8)], "little") & ((1 << bits) - 1))) is not None:
            return found
    found = _layout(stream)
    known = _LAYOUTS.setdefault(found.bits, {}) if len(_LAYOUTS) < 64 else {}
    if len(known) < 1000:
        known[int.from_bytes(stream[: -(-found.bits // 8)], "little") & ((1 << found.bits) - 1)] = found
    return found


class _Tables:
    """Lookup tables of prefix codes end to end: the next bits lead to a symbol (low 16 bits) and the bits of its code.

    All numbers are signed: a window of 64 bits is shifted by seven at most, and no symbol with its further bits has more than 56.
    """

    def __init__(self):
        self.places: dict[tuple, tuple[int, int]] = {}
        self.parts: list[np.ndarray] = []
        self.used = 0

    def place(self, code: Code) -> tuple[int, int]:
        """Where the table of a code begins, and the mask of its bits."""
        if (found := self.places.get(code.key)) is None:
            if code.only is not None:
                table = np.array([code.only], np.int64)
            else:
                table = np.zeros(1 << max(code.lengths), np.int64)
                for (n, c), symbol in code.by_code.items():
                    table[int(f"{c:0{n}b}"[::-1], 2) :: 1 << n] = symbol | n << 16
            found = self.places[code.key] = (self.used, len(table) - 1)
            self.parts.append(table)
            self.used += len(table)
        return found


#: Steps between two looks at which streams have ended.
_STRETCH = 32


@cache
def _prefix_values(codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and further bits of the prefix codes of lengths and distances."""
    extra = np.array([0 if c < 4 else (c - 2) >> 1 for c in range(codes)], np.int64)
    least = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(codes)], np.int64)
    return least, extra


def _windows(streams: list[bytes]) -> np.ndarray:
    """At every byte the 64 bits from there, with room behind the last stream for steps that come to nothing."""
    raw = np.frombuffer(b"".join(streams) + bytes(32 * _STRETCH), np.uint8)
    return np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view("<i8").ravel()


def _symbols(streams: list[bytes], layouts: list[_Layout]) -> tuple[np.ndarray, ...]:
    """All symbols of all streams: (stream, first pixel, green symbol, colour, pixels, distance code)."""
    tables, total = _Tables(), np.array([x.across * x.height for x in layouts], np.int64)
    places = [[tables.place(c) for c in g] for x in layouts for g in x.groups]
    first_group = np.cumsum([0, *[len(x.groups) for x in layouts]])[:-1]
    base, mask = (np.array([[p[k] for p in g] for g in places], np.int64) for k in (0, 1))
    table = np.concatenate(tables.parts)
    rich = np.array([any(c.only is None for g in x.groups for c in g[1:4]) or len(x.groups) > 1 for x in layouts])
    plain = np.array([0 if r else g[3].only << 24 | g[1].only << 16 | g[2].only for r, g in zip(rich, (x.groups[0] for x in layouts), strict=True)], np.int64)
    sizes = np.array([len(x) for x in streams], np.int64)
    begin = np.cumsum(sizes) - sizes
    window, (least, extra) = _windows(streams), _prefix_values(LENGTH_CODES + DISTANCE_CODES)
    sid, at, pos = np.arange(len(streams)), 8 * begin + np.array([x.bits for x in layouts], np.int64), np.zeros(len(streams), np.int64)
    end, grouped, out = 8 * (begin + sizes), np.array([x.which is not None for x in layouts]), []
    while len(sid):
        bases, masks = base[first_group[sid]].T.copy(), mask[first_group[sid]].T.copy()
        full, mixed = np.flatnonzero(rich[sid]), np.flatnonzero(grouped[sid])
        steps, copied, coloured = [], [], []
        for step in range(_STRETCH):
            for k in mixed[pos[mixed] < total[sid[mixed]]]:
                x = layouts[sid[k]]
                group = first_group[sid[k]] + x.which[_block(x, int(pos[k]))]
                bases[:, k], masks[:, k] = base[group], mask[group]
            bits = window.take(at >> 3, mode="clip") >> (at & 7)
            found = table.take((bits & masks[0]) + bases[0], mode="clip")
            symbol, used = found & 0xFFFF, found >> 16
            before, pos = pos, pos + 1
            copies = np.flatnonzero(symbol >= 256)
            if len(copies):
                own = symbol[copies]
                if own.max() >= 256 + LENGTH_CODES:
                    copies = copies[own < 256 + LENGTH_CODES]
                    own = symbol[copies]
                own = own - 256
                rest = bits[copies] >> used[copies]
                length = least[own] + (rest & ((1 << extra[own]) - 1))
                rest >>= extra[own]
                far = table[(rest & masks[4][copies]) + bases[4][copies]]
                code, n = far & 0xFFFF, far >> 16
                distance = least[code] + (rest >> n & ((1 << extra[code]) - 1))
                used[copies] += extra[own] + n + extra[code]
                pos[copies] += length - 1
                copied.append((np.full(len(copies), step), copies, length, distance))
            if len(full):
                own = full[symbol[full] < 256]
                where, parts = at[own] + used[own], []
                for channel in (1, 2, 3):
                    got = table[(window[where >> 3] >> (where & 7) & masks[channel][own]) + bases[channel][own]]
                    parts.append(got & 0xFFFF)
                    where = where + (got >> 16)
                used[own] = where - at[own]
                coloured.append((np.full(len(own), step), own, parts[2] << 24 | parts[0] << 16 | symbol[own] << 8 | parts[1]))
            at = at + used
            steps.append((before, symbol, at))
        first, symbol, after = (np.stack(x) for x in zip(*steps, strict=True))
        colour, length, distance = plain[sid] | symbol << 8, np.ones(symbol.shape, np.int32), np.zeros(symbol.shape, np.int64)
        if copied:
            i, k, n, d = (np.concatenate(x) for x in zip(*copied, strict=True))
            length[i, k], distance[i, k] = n, d
        if coloured:
            i, k, c = (np.concatenate(x) for x in zip(*coloured, strict=True))
            colour[i, k] = c
        live = first < total[sid]
        if (live & (after > end[sid])).any():
            raise ValueError("the stream ends early")
        out.append((np.broadcast_to(sid.astype(np.int32), live.shape)[live], first[live].astype(np.int32), symbol[live].astype(np.int16), colour[live].astype(np.uint32), length[live], distance[live].astype(np.int32)))
        left = pos < total[sid]
        sid, at, pos = sid[left], at[left], pos[left]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block(x: _Layout, at: int) -> int:
    """The block of the entropy image that a pixel lies in."""
    return (at // x.across >> x.shift) * ((x.across + (1 << x.shift) - 1) >> x.shift) + (at % x.across >> x.shift)


def _resolved(layouts: list[_Layout], symbols: tuple[np.ndarray, ...]) -> np.ndarray:
    """The pixels of all streams end to end, as ARGB numbers, from their symbols."""
    sid, pos, symbol, colour, length, distance = symbols
    total, across = (np.array([f(x) for x in layouts], np.int64) for f in (lambda x: x.across * x.height, lambda x: x.across))
    begin = (np.cumsum(total) - total).astype(np.int32)
    if (pos.astype(np.int64) + length > total[sid]).any():
        raise ValueError("a reference outside the image")
    pixels, source = np.zeros(int(total.sum()), np.uint32), np.arange(int(total.sum()), dtype=np.int32)
    plain = symbol < 256
    pixels[begin[sid[plain]] + pos[plain]] = colour[plain]
    copy = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
    owner, n, d = sid[copy], length[copy], distance[copy]
    left, up = np.array([(0, 0), *near_places()]).T
    near = len(left) - 1
    d = np.where(d > near, d - near, np.maximum(1, left[np.minimum(d, near)] + up[np.minimum(d, near)] * across[owner])).astype(np.int32)
    if (d > pos[copy]).any():
        raise ValueError("a reference outside the image")
    start = begin[owner] + pos[copy]
    each = np.repeat(np.arange(len(copy), dtype=np.int32), n)
    inside = np.arange(len(each), dtype=np.int32) - (np.cumsum(n, dtype=np.int32) - n)[each]
    place = start[each] + inside
    # a copy that overlaps itself repeats its first stretch
    inside = np.where(inside < d[each], inside, inside % d[each])
    source[place] = (start - d)[each] + inside
    cached = [k for k, x in enumerate(layouts) if x.cache_bits]
    for k in cached:
        _with_cache(pixels, source, int(begin[k]), layouts[k], *(x[sid == k] for x in (pos, symbol, length)))
    if cached:
        place = place[np.isin(owner[each], cached, invert=True)]
    while len(place):
        now = source[place]
        further = source[now]
        moved = further != now
        place = place[moved]
        source[place] = further[moved]
    return pixels[source]


def _with_cache(pixels: np.ndarray, source: np.ndarray, begin: int, x: _Layout, pos: np.ndarray, symbol: np.ndarray, length: np.ndarray) -> None:
    """Pixels of a stream with a colour cache, in order, as every pixel goes into the cache."""
    seen, order = [0] * (1 << x.cache_bits), np.argsort(pos)
    for at, s, n in zip(pos[order].tolist(), symbol[order].tolist(), length[order].tolist(), strict=True):
        for k in range(begin + at, begin + at + n):
            pixel = seen[s - 256 - LENGTH_CODES] if s >= 256 + LENGTH_CODES else int(pixels[source[k]])
            pixels[k], source[k] = pixel, k
            seen[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - x.cache_bits)] = pixel


_INVERSES = {PREDICTOR: invert_predictor, CROSS_COLOUR: invert_cross_colour, SUBTRACT_GREEN: invert_subtract_green, PALETTE: invert_palette}


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """VP8L streams as (height, width, 4) samples: alpha, red, green, blue. Equal streams are decoded once."""
    images: dict[bytes, np.ndarray] = {}
    left = list(dict.fromkeys(streams))
    while left:
        layouts, pixels = [], 0
        while len(layouts) < min(len(left), MOST_STREAMS) and (not layouts or pixels < MOST_PIXELS):
            layouts.append(_known_layout(left[len(layouts)]))
            pixels += layouts[-1].across * layouts[-1].height
        own, left = left[: len(layouts)], left[len(layouts) :]
        flat = _resolved(layouts, _symbols(own, layouts)).astype(">u4").view(np.uint8).reshape(-1, 4)
        ends = np.cumsum([x.across * x.height for x in layouts])
        # the transform that nearly all stored images end with is undone in all of them at once, and the others are put back
        green = np.array([bool(x.steps) and x.steps[-1][0] == SUBTRACT_GREEN for x in layouts])
        others = [(slice(e - x.across * x.height, e)) for x, e, g in zip(layouts, ends.tolist(), green.tolist(), strict=True) if not g]
        before = [flat[o].copy() for o in others]
        flat[:, 1] += flat[:, 2]
        flat[:, 3] += flat[:, 2]
        for o, old in zip(others, before, strict=True):
            flat[o] = old
        for stream, x, end, done in zip(own, layouts, ends.tolist(), green.tolist(), strict=True):
            image = flat[end - x.across * x.height : end].reshape(x.height, x.across, 4)
            for kind, *rest in reversed(x.steps[:-1] if done else x.steps):
                image = _INVERSES[kind](image, *rest)
            images[stream] = image
    return [images[s] for s in streams]


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as (height, width, 4) samples: alpha, red, green, blue; of an animated one, the first frame.

    Raises ``ValueError`` where it is malformed.
    """
    return decode_streams(streams_of(data)[:1])[0]


# ---- bytes as images ----


def code_lengths(weights: list[float], most: int) -> list[int]:
    """Huffman code lengths of at most ``most`` bits: weights are raised from below until the longest code fits."""
    floor = min(weights)
    while True:
        heap = [(max(w, floor), k, (k,)) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        lengths, number = [0] * len(weights), len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for k in a[2] + b[2]:
                lengths[k] += 1
            heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
            number += 1
        if max(lengths) <= most:
            return lengths
        floor *= 1.5


def _stored_weights() -> tuple[list[float], list[float]]:
    """How often the fixed codes expect samples and lengths, and distances: letters of European texts, ever rarer longer copies,
    distances that are as likely as their square root is dense."""
    weights = [1e-4] * 256
    for k, c in enumerate(b" etaoinshrldcumfgpwybvk.,"):
        weights[c] = 0.6 / (k + 3)
    for c in range(0x80, 0xC0):
        weights[c] = 2e-3
    weights[0xC3] = 0.03
    for c in b"\n|*$%&#!jqxzETAOIN0123456789":
        weights[c] = 3e-3
    weights[0] = 4e-3
    lengths = [1e-4 if k < 4 else 0.08 * 0.75 ** (k - 4) for k in range(LENGTH_CODES)]
    return weights + lengths, [2 ** (k / 4) if k < 25 else 0.02 for k in range(DISTANCE_CODES)]


class _Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def symbol(self, only: int) -> None:
        """A code of one symbol."""
        self.write(1, 1)
        self.write(0, 1)
        self.write(1, 1)
        self.write(only, 8)

    def lengths(self, lengths: list[int]) -> None:
        """A normal code by its lengths, runs of which are written as repeats."""
        steps, at = [], 0
        while at < len(lengths):
            n, run = lengths[at], 1
            while at + run < len(lengths) and lengths[at + run] == n:
                run += 1
            at += run
            if not n:
                while run >= 3:
                    part = min(run, 138)
                    steps.append((17, part - 3, 3) if part <= 10 else (18, part - 11, 7))
                    run -= part
            else:
                steps.append((n, 0, 0))
                run -= 1
                while run >= 3:
                    part = min(run, 6)
                    steps.append((16, part - 3, 2))
                    run -= part
            steps += [(n, 0, 0)] * run
        used = sorted({s for s, _, _ in steps})
        each = [sum(s == u for s, _, _ in steps) for u in used]
        own = [0] * 19
        for u, n in zip(used, code_lengths(each, 7) if len(used) > 1 else [1], strict=True):
            own[u] = n
        codes = _canonical(own)
        self.write(0, 1)
        self.write(19 - 4, 4)
        for symbol in LENGTH_CODE_ORDER:
            self.write(own[symbol], 3)
        self.write(0, 1)
        for s, value, n in steps:
            if len(used) > 1:
                self.write(codes[s], own[s])
            self.write(value, n)


def _canonical(lengths: list[int]) -> list[int]:
    """Codes by symbol, bits in the order in which they are read."""
    codes = [0] * len(lengths)
    for (n, code), s in Code(lengths).by_code.items():
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
    return codes


@cache
def _stored() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Lengths and codes of the stored form for samples and lengths, and for distances, and its code group as (value, bits)."""
    weights, far = _stored_weights()
    lengths, far_lengths = code_lengths(weights, _STORED_BITS), code_lengths(far, _STORED_DISTANCE_BITS)
    w = _Writer()
    w.lengths(lengths)
    for only in (0, 0, 255):  # red, blue and alpha: one symbol each
        w.symbol(only)
    w.lengths(far_lengths)
    return *(np.array(x, np.int64) for x in (lengths, _canonical(lengths), far_lengths, _canonical(far_lengths))), (w.value, w.size)


def _opened(height: int) -> _Writer:
    w = _Writer()
    w.write(SIGNATURE, 8)
    w.write(WIDTH - 1, 14)
    w.write(height - 1, 14)
    w.write(0, 4)  # no alpha, version 0
    w.write(1, 1)
    w.write(SUBTRACT_GREEN, 2)
    return w


@cache
def _head(height: int) -> tuple[bytes, int]:
    """The stream of a stored image up to its first pixel, and its bits."""
    w = _opened(height)
    w.write(0, 3)  # no further transform, no colour cache, one group of codes
    w.write(*_stored()[4])
    return w.value.to_bytes(-(-w.size // 8), "little"), w.size


def _palette_stream(tile: bytes) -> bytes:
    """An image of at most sixteen greys by its palette, several samples in a pixel."""
    greys, index = np.unique(np.frombuffer(tile, np.uint8), return_inverse=True)
    packing = 3 if len(greys) <= 2 else 2 if len(greys) <= 4 else 1
    w, eight = _opened(len(tile) // WIDTH), [8] * 256 + [0] * LENGTH_CODES
    flat = _canonical(eight)
    w.write(1, 1)
    w.write(PALETTE, 2)
    w.write(len(greys) - 1, 8)
    w.write(0, 1)  # the palette: no cache; greens, then red, blue, alpha and distance
    w.lengths(eight)
    w.symbol(0)
    w.symbol(0)
    if len(greys) > 1:  # alpha is 255, then does not change
        w.write(1, 1)
        w.write(1, 1)
        w.write(1, 1)
        w.write(0, 8)
        w.write(255, 8)
    else:
        w.symbol(255)
    w.symbol(0)
    for k, step in enumerate(np.diff(greys, prepend=np.uint8(0)).tolist()):
        w.write(flat[step], 8)
        if len(greys) > 1:
            w.write(int(k == 0), 1)
    w.write(0, 3)  # no further transform, no colour cache, one group of codes
    w.lengths(eight)
    for only in (0, 0, 255, 0):
        w.symbol(only)
    each, size = 1 << packing, 8 >> packing
    packed = (index.reshape(-1, each) << (size * np.arange(each))).sum(axis=1)
    for p in packed.tolist():
        w.write(flat[p], 8)
    return w.value.to_bytes(-(-w.size // 8), "little")


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def _references(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, distance) of stretches of images that repeat earlier ones of the same image; they do not overlap.

    Every place looks for the last one with the same next five bytes: one sort. Places side by side with one distance are one
    stretch; where two stretches meet, the earlier one goes to its end.
    """
    n = len(flat)
    where = np.arange(n) + np.repeat(np.arange(len(sizes)) * TILE - starts, sizes)  # the image times 4096, and the place in it
    window = _windows([flat.tobytes()])[:n].view(np.uint64)
    key = (window << np.uint64(24)) | where.astype(np.uint64)
    last = starts + sizes
    near = np.ones(n, bool)
    for k in range(1, MIN_MATCH):
        near[last - k] = False
    key = key[near]
    key.sort()
    same = (key[1:] ^ key[:-1]) < np.uint64(TILE)
    low = (key & np.uint64(0xFFFFFF)).astype(np.int32)
    own, step = low[1:][same], np.diff(low)[same]
    distance = np.zeros(n + 1, np.int32)
    distance[own + (starts - np.arange(len(sizes)) * TILE).astype(np.int32)[own >> 12]] = step
    change = np.flatnonzero(distance[1:] != distance[:-1]) + 1
    begin = np.concatenate([[0], change[:-1]]) if len(change) else np.zeros(0, np.int64)
    # a stretch ends where its image does: no place there has five bytes left, so its distance is 0
    held = distance[begin] > 0
    begin, end, d = begin[held], change[held] + MIN_MATCH - 1, distance[begin[held]]
    begin = np.maximum(begin, np.concatenate([[0], end[:-1]])) if len(begin) else begin
    kept = end - begin >= MIN_MATCH
    return begin[kept], (end - begin)[kept], d[kept]


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, further bits and their value of lengths and distances."""
    least, extra = _prefix_values(LENGTH_CODES + DISTANCE_CODES)
    code = np.searchsorted(least, values, side="right") - 1
    return code, extra[code], values - least[code]


@cache
def _distance_codes() -> np.ndarray:
    """By distance in a stored image: the shortest of its codes."""
    out = np.arange(TILE + 1) + len(near_places())
    for k, (left, up) in reversed(list(enumerate(near_places(), start=1))):
        if 0 < left + up * WIDTH <= TILE:
            out[left + up * WIDTH] = k
    return out


def _stored_streams(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Images of these sizes, end to end, as VP8L streams."""
    lengths, codes, far_lengths, far_codes, _ = _stored()
    starts = np.cumsum(sizes) - sizes
    place, n, distance = _references(flat, sizes, starts)
    covered = np.zeros(len(flat) + 1, np.int8)
    covered[place] += 1
    covered[place + n] -= 1  # one copy may begin where another ends
    single = np.cumsum(covered[:-1], dtype=np.int8) == 0
    head = single.copy()
    head[place] = True
    at = np.flatnonzero(head)  # places of symbols
    is_copy = ~single[at]
    code, more, value = _prefix(n)
    far, far_more, far_value = _prefix(_distance_codes()[distance])
    # a copy is written in two steps, its length and its distance
    item = np.arange(len(at)) + np.cumsum(is_copy) - is_copy
    bits, content = np.zeros(len(at) + len(place), np.int64), np.zeros(len(at) + len(place), np.int64)
    plain = flat[at[~is_copy]]
    bits[item[~is_copy]], content[item[~is_copy]] = lengths[plain], codes[plain]
    own = item[is_copy]
    bits[own], content[own] = lengths[256 + code] + more, codes[256 + code] | value << lengths[256 + code]
    bits[own + 1], content[own + 1] = far_lengths[far] + far_more, far_codes[far] | far_value << far_lengths[far]
    ends = np.cumsum(bits)
    first = item[np.searchsorted(at, starts)]  # every image begins with a symbol
    before = ends[first] - bits[first]
    used = np.diff(np.concatenate([before, ends[-1:]]))
    heads = [_head(int(k) // WIDTH) for k in sizes]
    head_bits = np.array([h[1] for h in heads], np.int64)
    whole = -(-(head_bits + used) // 8)
    base = np.cumsum(whole) - whole
    to = ends - bits + np.repeat(8 * base + head_bits - before, np.diff(np.concatenate([first, [len(bits)]])))
    # in words of 32 bits: what begins in a word goes into it and the next
    word, total = to >> 5, int(whole.sum())
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    joined, word = np.bitwise_or.reduceat(content << (to & 31), firsts), word[firsts]
    out = np.zeros(total // 4 + 3, np.uint32)
    out[word] = joined & 0xFFFFFFFF
    out[word + 1] |= (joined >> 32).astype(np.uint32)
    out = out.view(np.uint8)
    for (h, _), b in zip(heads, base.tolist(), strict=True):
        out[b : b + len(h)] |= np.frombuffer(h, np.uint8)
    stream = out.tobytes()
    found = [stream[b : b + k] for b, k in zip(base.tolist(), whole.tolist(), strict=True)]
    rows = np.sort(flat.reshape(-1, WIDTH)[starts // WIDTH], axis=1)
    for k in np.flatnonzero((np.diff(rows, axis=1) > 0).sum(axis=1) < 16).tolist():  # first rows of at most 16 greys
        tile = flat[starts[k] : starts[k] + sizes[k]].tobytes()
        if len(set(tile)) <= 16:
            found[k] = min(found[k], _palette_stream(tile), key=len)
    return found


def _chunk(kind: bytes, content: bytes) -> bytes:
    return kind + struct.pack("<I", len(content)) + content + b"\0" * (len(content) & 1)


def _file(streams: list[bytes], size: int) -> bytes:
    """A still image, or an animated file with a frame for each stream."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        wide = (WIDTH - 1).to_bytes(3, "little")
        body = _chunk(b"VP8X", b"\x02\0\0\0" + wide + wide) + _chunk(b"ANIM", bytes(6))
        for k, s in enumerate(streams):
            rows = min(TILE, size - k * TILE) // WIDTH
            body += _chunk(b"ANMF", bytes(6) + wide + (rows - 1).to_bytes(3, "little") + b"\x64\0\0\x02" + _chunk(b"VP8L", s))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as one WebP file."""
    sizes = []
    for p in payloads:
        if not p or len(p) % WIDTH:
            raise ValueError("a payload has a positive multiple of 64 bytes")
        full, rest = divmod(len(p), TILE)
        sizes += [TILE] * full + [rest] * (rest > 0)
    sizes, flat, streams = np.array(sizes, np.int64), np.frombuffer(b"".join(payloads), np.uint8), []
    ends, k, done = np.cumsum(sizes), 0, 0
    while k < len(sizes):
        to = max(k + 1, min(k + MOST_STREAMS, int(np.searchsorted(ends, done + WRITE_PIXELS, side="right"))))
        streams += _stored_streams(flat[done : int(ends[to - 1])], sizes[k:to])
        k, done = to, int(ends[to - 1])
    media, k = [], 0
    for p in payloads:
        tiles = -(-len(p) // TILE)
        media.append(_file(streams[k : k + tiles], len(p)))
        k += tiles
    return media


def read_media(media: list[bytes]) -> list[bytes]:
    """The payloads behind files: the samples of all frames, row by row, in order."""
    streams, owner = [], []
    for k, m in enumerate(media):
        own = streams_of(m)
        streams += own
        owner += [k] * len(own)
    parts: list[list[bytes]] = [[] for _ in media]
    for k, image in zip(owner, decode_streams(streams), strict=True):
        parts[k].append(image[:, :, 2].tobytes())
    return [b"".join(p) for p in parts]


def feature_of(pixels: bytes) -> str:
    """Rows, mean, entropy in bits and horizontal contrast of the grey image."""
    a = np.frombuffer(pixels, np.uint8)
    n = np.bincount(a, minlength=256)
    p = n[n > 0] / len(a)
    image = a.reshape(-1, WIDTH).astype(np.int16)
    contrast = int(np.abs(np.diff(image, axis=1)).sum())
    return f"rows={len(image)};mean={int((n * np.arange(256)).sum()) / len(a):.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};contrast={contrast / (len(image) * (WIDTH - 1)):.4f}"


def _texts_to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in words.slices(whole, "text", MOST_PIXELS):
            raw, at = words.text_bytes(batch.column(1))
            raw, at = raw.tobytes(), at.tolist()
            media = encode([payload_of(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
            yield pa.record_batch([batch.column(0), pa.array([b - a for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def to_media(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``media``: the UTF-8 bytes of every text, padded to a positive multiple of 64, as WebP files.

    A null text counts as empty: 64 zero bytes. Null and repeated ids are kept row by row; a text of more than 4096 bytes is one file
    of as many frames as it needs; extra columns play no part; equal texts have equal media. An empty table gives an empty result.
    """
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_texts_to_media, "id long, n_bytes long, media binary")


def _media_to_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in words.slices(whole, "media", MOST_PIXELS // 2):
            pixels = read_media(batch.column(2).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(pixels, pa.binary())], names=["id", "n_bytes", "media", "pixels"])


def from_media(stored: DataFrame) -> DataFrame:
    """``stored`` with ``pixels``: the samples read back from the media, row by row."""
    return stored.select("id", "n_bytes", "media").mapInArrow(_media_to_pixels, "id long, n_bytes long, media binary, pixels binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, pixels in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            rows.append((len(pixels), sha256(pixels).hexdigest(), crc32(pixels[-64:]), len(media), sha256(media).hexdigest(), feature_of(pixels)))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as images, stored in the shared folder, and back, with digests and a feature of what was read."""
    stored = written(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "webp-media")
    return from_media(stored).mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
