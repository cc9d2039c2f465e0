"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space and 0x09 to 0x0D; upper-case ASCII letters count as lower case where asked for.
The hash of bytes ``b_0 .. b_k`` is ``sum(T[b_i] * M^i) mod 2^64`` for a fixed random table ``T`` and an odd ``M``, mixed at
the end. Prefix sums over a block of bytes give the hash of any span in two lookups, as odd ``M`` has an inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
#: True for the six white-space bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of text whose sums are held at once.
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            grown = [np.cumprod(np.full(max(n, _BLOCK + 4096), m, dtype=np.uint64)) * np.uint64(i) for m, i in ((_MULT, _INVERSE), (_INVERSE, _MULT))]
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its row offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes of text each; a longer text is a part by itself."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    begin, rows = 0, batch.num_rows
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, end)`` of every word, in order."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    return np.searchsorted(at, start, side="right") - 1, start, np.flatnonzero(ends) + 1


def hash_many(raw: np.ndarray, start: np.ndarray, end: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], lower: bool = True) -> list[np.ndarray]:
    """64-bit hashes of spans inside words: ``parts`` are (start, end) arrays, one span in each word; word starts ascend."""
    table, i, n = _LOWER if lower else _TABLE, 0, len(start)
    out = [np.empty(n, np.uint64) for _ in parts]
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(start, start[i] + _BLOCK)))
            low, high = int(start[i]), int(end[i:j].max())
            powers, inverse = _powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[raw[low:high]] * powers[: high - low], out=sums[1:])
            for held, (first, last) in zip(out, parts, strict=True):
                s, e = first[i:j] - low, last[i:j] - low
                held[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            i = j
        return [mix(h) for h in out]


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words."""
    return hash_many(raw, start, end, [(start, end)], lower)[0]


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every word of the column, in order."""
    raw, at = text_bytes(column)
    row, start, end = spans(raw, at)
    return row, hash_spans(raw, start, end, lower)


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin among all words, and their number at the end."""
    return np.searchsorted(row, np.arange(rows + 1))


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of word shingles: ``size`` words each; of a row with fewer words, its whole sequence as one."""
    counts = np.diff(bounds)
    rows = np.arange(len(counts))
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
        row = np.repeat(rows, each)
        first = bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        length = np.minimum(counts[row], size)
        out = np.zeros(len(row), np.uint64)
        for k in range(size):
            there = k < length
            out = np.where(there, out * step + h[np.minimum(first + k, max(0, len(h) - 1))], out) if len(h) else out
        return row, mix(out + length.astype(np.uint64))


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats, sorted by row and hash."""
    if not len(h):
        return row, h
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]
