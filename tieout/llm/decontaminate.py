"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item of ``n`` words when some window of ``n`` of its words (fewer at its end) is within
``n // 5`` word edits (insert, delete, replace) of the item. Words are lower-cased and compared by 64-bit hashes.

1. *Windows.* ``k`` edits leave at least ``n - 1 - 2k`` of an item's word pairs in place, so only windows with so many word
   pairs of items of that length can match. This is exact: no window within reach is left out.
2. *Embedding.* A CGK walk reads a sequence with a pointer that moves on or waits by a shared random bit of (step, word);
   what it sees in ``3n`` steps is the embedding. Edit distance ``d`` becomes a Hamming distance that depends on ``d`` alone.
3. *LSH.* Tables of one walk each sample positions of the embedding; a window and an item that agree on a table's sample are a
   candidate. Walks repeat until a pair at the largest distance is missed with a chance below 1 - ``RECALL``.
4. *Pieces.* Drift grows with length, so items of more than ``PIECE_WORDS`` words are embedded in pieces of at most that many: of
   ``n // 5`` edits in all, some piece of ``m`` words has ``m // 5`` or fewer. A piece that is found within so many edits proposes
   the windows that can hold its item around it.
5. *Verification.* Candidates are aligned exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.storage import row_keys, without_rows, written

#: One edit is allowed for so many words of an item.
WORDS_PER_EDIT = 5
#: Recall that the walks and tables were chosen for at the largest distance; tests measure it.
RECALL = 0.99
WALKS, TABLES, SAMPLED = 12, 8, 3
#: Words up to which the walks and tables have that recall; longer items are searched for by pieces.
PIECE_WORDS = 60
#: Text of items that one broadcast index may hold; more items are searched in blocks of that size.
INDEX_BYTES = 16 << 20
_PAD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_COLUMNS = "id long, k1 long, k2 long, item_id long, item_words int, start long, distance int"


def edits_for(n: int) -> int:
    return n // WORDS_PER_EDIT


def _pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(h[:-1] * _STEP + h[1:])


class _Class:
    """The items of one length: their words, and a sorted table of sampled keys for each table of each walk."""

    def __init__(self, n: int, ids: list[int], texts: list[np.ndarray]):
        self.n, self.edits, self.ids = n, edits_for(n), np.array(ids, np.int64)
        self.words = np.concatenate(texts)
        rng = np.random.Generator(np.random.PCG64([n, 20160101]))
        self.bits = rng.integers(0, 1 << 63, (WALKS, 3 * n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # early positions have drifted least; sampling leans to them
        chance = np.maximum(2.0 * n - np.arange(3 * n), 0)  # half of all walks have read everything by step 2n
        self.sampled = np.array([[np.sort(rng.choice(3 * n, SAMPLED, replace=False, p=chance / chance.sum())) for _ in range(TABLES)] for _ in range(WALKS)])
        starts = np.arange(len(ids), dtype=np.int64) * n
        keys = self.keys(self.words, starts, np.full(len(ids), n))
        order = np.argsort(keys, axis=2, kind="stable")
        self.items, self.table = order, np.take_along_axis(keys, order, axis=2)

    def keys(self, h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(walk, table, window) keys of sampled embeddings."""
        out = np.zeros((WALKS, TABLES, len(start)), np.uint64)
        padded = np.concatenate([h, [_PAD]])
        end = len(h)
        with np.errstate(over="ignore"):
            for w in range(WALKS):
                at = np.zeros(len(start), np.int64)
                used = {int(j) for j in self.sampled[w].ravel()}
                for j in range(max(used) + 1):
                    seen = padded[np.where(at < length, start + at, end)]
                    if j in used:
                        for t, position in np.argwhere(self.sampled[w] == j):
                            out[w, t] = out[w, t] * _STEP + seen + np.uint64(position)
                    at += ((seen * self.bits[w, j]) >> np.uint64(63)).astype(np.int64)
        return out

    def candidates(self, h: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree on a table."""
        keys, found = self.keys(h, start, length), []
        for w in range(WALKS):
            for t in range(TABLES):
                low = np.searchsorted(self.table[w, t], keys[w, t], "left")
                high = np.searchsorted(self.table[w, t], keys[w, t], "right")
                many = high - low
                window = np.repeat(np.arange(len(start)), many)
                place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(window))
                found.append(window * len(self.ids) + self.items[w, t][place])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)


class _Long:
    """The items of one length above ``PIECE_WORDS``, and their pieces by length."""

    def __init__(self, n: int, ids: list[int], texts: list[np.ndarray]):
        self.n, self.edits, self.ids = n, edits_for(n), np.array(ids, np.int64)
        self.words = np.concatenate(texts)
        bounds = np.arange(-(-n // PIECE_WORDS) + 1) * n // -(-n // PIECE_WORDS)
        self.pieces = []  # a class of pieces, and the item and the offset of each
        for m in sorted({int(x) for x in np.diff(bounds)}):
            own = [(k, int(at), t[at : at + m]) for k, t in enumerate(texts) for at in bounds[:-1][np.diff(bounds) == m]]
            self.pieces.append((_Class(m, [i for i, _, _ in own], [t for _, _, t in own]), np.array([i for i, _, _ in own]), np.array([at for _, at, _ in own])))

    def candidates(self, h: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs in which a piece lies near its place with its share of the edits; ``start`` ascends."""
        fresh = np.maximum(start, np.concatenate([[0], (start + length)[:-1]]))  # every word of the windows once
        many = np.maximum(start + length - fresh, 0)
        at = np.repeat(fresh - (np.cumsum(many) - many), many) + np.arange(many.sum())
        # words that a piece at a place may read: up to the end of the last window that holds the place
        stop = (start + length)[np.searchsorted(start, at, side="right") - 1]
        found = [np.zeros(0, np.int64)]
        for group, item, offset in self.pieces:
            for begin in range(0, len(at), max(1, (1 << 22) // (group.n * WALKS))):
                a = at[begin : begin + max(1, (1 << 22) // (group.n * WALKS))]
                left = stop[begin : begin + len(a)] - a
                place, piece = group.candidates(h, a, np.minimum(group.n, left))
                for lo in range(0, len(place), max(1, (1 << 21) // group.n)):
                    p, i = place[lo : lo + max(1, (1 << 21) // group.n)], piece[lo : lo + max(1, (1 << 21) // group.n)]
                    reach = group.n + group.edits
                    text = h[np.minimum(a[p][:, None] + np.arange(reach), len(h) - 1)]
                    near = edit_distances(group.words.reshape(-1, group.n)[i], text, np.minimum(reach, left[p]), open_end=True) <= group.edits
                    found.append(np.unique((a[p[near]] - offset[i[near]] + self.n) * len(self.ids) + item[i[near]]))
        begins = np.unique(np.concatenate(found))  # where items would begin if nothing before the piece were edited
        centre, own = begins // len(self.ids) - self.n, begins % len(self.ids)
        first, last = np.searchsorted(start, centre - self.edits, "left"), np.searchsorted(start, centre + self.edits, "right")
        each = last - first
        window = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        pairs = np.unique(window * len(self.ids) + np.repeat(own, each))
        return pairs // len(self.ids), pairs % len(self.ids)


def edit_distances(a: np.ndarray, b: np.ndarray, length: np.ndarray, open_end: bool = False) -> np.ndarray:
    """Row-wise edit distances of ``a`` (pairs x n) and the first ``length`` of ``b`` (pairs x m), or the nearest beginning of them."""
    steps = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.tile(steps, (len(a), 1))
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (b != a[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    if open_end:
        return np.where(steps <= length[:, None], row, a.shape[1] + b.shape[1]).min(axis=1)
    return row[np.arange(len(a)), length]


class Index:
    """What a worker needs to search texts for a bounded block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        row, h = words.words(pa.array([t for _, t in items], pa.string()))
        bounds = words.row_bounds(row, len(items))
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        single: list[tuple[int, int]] = []  # items of one word, found by equality
        numbers: dict = {}  # items are told apart by a number here, as an id may be null
        for k, (item, _) in enumerate(items):
            text = h[bounds[k] : bounds[k + 1]]
            if len(text) == 1:
                single.append((int(text[0]), numbers.setdefault(item, len(numbers))))
            elif len(text):
                groups.setdefault(len(text), []).append((numbers.setdefault(item, len(numbers)), text))
        self.ids = pa.array(list(numbers), pa.int64())
        single.sort()
        self.single, self.single_ids = np.array([w for w, _ in single], np.uint64), np.array([i for _, i in single], np.int64)
        self.classes = [(_Class if n <= PIECE_WORDS else _Long)(n, [i for i, _ in g], [t for _, t in g]) for n, g in sorted(groups.items())]
        pairs, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for c, group in enumerate(self.classes):
            own = np.unique(np.concatenate([_pairs(t) for _, t in groups[group.n]]))
            pairs.append(own)
            owner.append(np.full(len(own), c))
        pairs, owner = np.concatenate(pairs), np.concatenate(owner)
        order = np.lexsort((owner, pairs))
        self.pairs, self.owner = pairs[order], owner[order]
        self.bits = max(16, int(len(self.pairs) * 16).bit_length())
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(self.pairs >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def search(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """``(row, number of the item, n, start, distance)`` of the windows within reach of an item."""
        row, h = words.words(texts)
        bounds = words.row_bounds(row, len(texts))
        if len(self.single):
            low, high = np.searchsorted(self.single, h, "left"), np.searchsorted(self.single, h, "right")
            many = high - low
            at = np.repeat(np.arange(len(h)), many)
            place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(at))
            yield row[at], self.single_ids[place], 1, at - bounds[row[at]], np.zeros(len(at), np.int64)
        if len(h) < 2 or not self.classes:
            return
        pair = _pairs(h)
        maybe = np.flatnonzero(self.there[(pair >> np.uint64(64 - self.bits)).astype(np.int64)] & (row[1:] == row[:-1]))
        low, high = np.searchsorted(self.pairs, pair[maybe], "left"), np.searchsorted(self.pairs, pair[maybe], "right")
        many = high - low
        place = np.repeat(maybe, many)
        owner = self.owner[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(place))] if len(place) else place
        order = np.argsort(owner, kind="stable")
        place, owner = place[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(self.classes) + 1))
        for c, group in enumerate(self.classes):
            hits = place[edges[c] : edges[c + 1]]
            need, n = group.n - 1 - 2 * group.edits, group.n
            if len(hits) < need:
                continue
            first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
            close = (last - first <= n - 2) & (row[first] == row[last])
            first, last = first[close], last[close]
            if not len(first):
                continue
            low = np.maximum(last - (n - 2), bounds[row[first]])
            spread = first - low + 1
            start = np.unique(np.repeat(low - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum()))
            yield from self._match(group, h, row, bounds, start)

    def _match(self, group: _Class | _Long, h, row, bounds, start):
        n = group.n
        block = max(1, (1 << 22) // (n * WALKS))
        for begin in range(0, len(start), block):
            at = start[begin : begin + block]
            length = np.minimum(n, bounds[row[at] + 1] - at)
            window, item = group.candidates(h, at, length)
            for lo in range(0, len(window), max(1, (1 << 21) // n)):
                w, i = window[lo : lo + max(1, (1 << 21) // n)], item[lo : lo + max(1, (1 << 21) // n)]
                left = group.words.reshape(-1, n)[i]
                right = h[np.minimum(at[w][:, None] + np.arange(n), len(h) - 1)]
                distance = edit_distances(left, right, length[w])
                near = distance <= group.edits
                if near.any():
                    r, s, d, i = row[at[w[near]]], at[w[near]] - bounds[row[at[w[near]]]], distance[near], i[near]
                    yield r, group.ids[i], n, s, d


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in words.slices(whole, "text"):
                parts = [(r, i, np.full(len(r), n), s, d) for r, i, n, s, d in index.search(batch.column(3))]
                if not parts:
                    continue
                r, item, n, s, d = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((s, d, item, r))
                r, item, n, s, d = r[order], item[order], n[order], s[order], d[order]
                best = np.ones(len(r), bool)
                best[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1])
                yield pa.record_batch(
                    [*[c.take(pa.array(r[best])) for c in batch.columns[:3]], index.ids.take(pa.array(item[best])), pa.array(n[best].astype(np.int32)), pa.array(s[best].astype(np.int64)), pa.array(d[best].astype(np.int32))],
                    names=["id", "k1", "k2", "item_id", "item_words", "start", "distance"],
                )

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``id``, ``item_id``, ``item_words``, ``start`` (word of the text, from 0) and ``distance`` of the nearest, then first, window for
    every document row and item within reach, with the row's keys ``k1`` and ``k2``.

    Items are a stated query set, searched for in blocks of at most ``index_bytes`` of text: the broadcast never grows with
    either table. Null or empty texts and items match nothing. Null ids are kept as null.
    Repeated rows give repeated results; items that share an id are reported once per document, at the nearest of them. Very
    long texts are searched whole. Extra columns play no part, whatever their names. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_column}`").cast("long").alias("item_id"), F.col(f"`{item_text_column}`").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // index_bytes) or 1
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), *row_keys(id_column, text_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Index(sorted((tuple(r) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))
        found = base.mapInArrow(_searcher(shared), _COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that any item contaminates.

    Each row goes or stays by its own text: rows with a null id too, and rows that share an id with a row that goes. Null and empty
    texts stay. Equal texts go or stay together, so there are no ties. Very long texts are searched whole. Columns may have any name.
    Empty tables give back ``docs``.
    """
    found = contaminations(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    return without_rows(docs, written(found.select("k1", "k2").distinct(), "contaminated"), id_column, text_column)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) within reach."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminations(docs, benchmark).drop("k1", "k2").withColumnRenamed("id", "doc_id")
