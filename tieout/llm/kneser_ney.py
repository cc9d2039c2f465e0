"""An interpolated modified Kneser-Ney model of word pairs: counted by Spark, stored as sorted hash arrays, mapped by workers.

Counting. Workers turn texts into 64-bit word hashes and pack the pairs (previous word, word) of about a million tokens at a
time into sorted, compressed arrays, one for each cell of a square grid: its row follows from the previous word, its column from
the word. Cells are merged after one shuffle. Each merged cell is written to the shared folder as sorted arrays (pair hash, count)
and sends on what it knows of its previous words (how many pairs seen once, twice, more often) and of its words (count, distinct
previous words). A word meets only one row and one column of the grid, so these second counts are small, and no cell holds
all pairs of a frequent word.

Scoring. With ``c`` the count of a pair, ``D(c)`` the discount of counts 1, 2, and 3 or more,

    p(w | u) = (c(u w) - D(c(u w))) / c(u) + g(u) q(w),        q(w) = (n(w) - D'(n(w))) / N' + g' / (V + 1)

where ``n(w)`` is the number of distinct words before ``w``, ``N'`` their sum, ``g`` and ``g'`` what the discounts leave, and the V + 1-th
word stands for all unknown ones. Discounts follow from counts of counts (Chen and Goodman). The context of a text's first word
is a start mark; its last token is an end mark. Workers map the arrays from the shared folder, which must be mounted
on them, and look up sorted batches, so pages are read in order and shared by the processes of a machine.

Words are told apart by 64-bit hashes: among a billion distinct words fewer than 0.03 pairs collide.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.quality import remainder
from tieout.llm.storage import fresh_path, posix_path, written

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 1 << 64))
_STEP = np.uint64(_STEP)
#: Tokens that a worker packs at a time: more where the grid is wide, so that a cell's part of a pack stays worth its head.
PACK_TOKENS, MOST_PACK_TOKENS = 1 << 20, 8 << 20
#: Tokens for each cell of the grid, about; the merge of a cell holds so many pairs at most in one task.
CELL_TOKENS = 4 << 20
#: Tables that a worker keeps mapped; the longest unused go first.
MAPPED = 4096
ADD = 0.1


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Invertible for a known word: ``before`` comes back from the pair and the word."""
    with np.errstate(over="ignore"):
        return before * _STEP + word


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, previous, token)`` of all tokens, end marks included, in order."""
    row, h = words.words(texts)
    rows = len(texts)
    bounds = words.row_bounds(row, rows)
    at = np.arange(len(h)) + row
    token = np.full(len(h) + rows, END, np.uint64)
    token[at] = h
    owner = np.empty(len(token), np.int64)
    owner[at] = row
    ends = bounds[1:] + np.arange(rows)
    owner[ends] = np.arange(rows)
    previous = np.empty_like(token)
    previous[1:] = token[:-1]
    previous[np.concatenate([[0], ends[:-1] + 1]) if rows else []] = START
    return owner, previous, token


def _band(h: np.ndarray, grid: int) -> np.ndarray:
    """The row or column of the grid that a word belongs to."""
    return ((h >> np.uint64(32)) * np.uint64(grid) >> np.uint64(32)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the first is sorted and kept as differences. Bytes of equal rank stand together."""
    first = arrays[0].astype(np.uint64)
    steps = np.diff(first, prepend=np.uint64(0))
    parts = [np.array([len(first), *[a.dtype.itemsize for a in arrays]], np.int64).tobytes()]
    for a in (steps, *arrays[1:]):
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes())
    return zlib.compress(b"".join(parts), 1)


def _unpacked(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8 * (1 + len(kinds)), []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    with np.errstate(over="ignore"):
        out[0] = np.cumsum(out[0].astype(np.uint64), dtype=np.uint64)
    return out


def _merged(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[heads], *[np.add.reduceat(v[order], heads) for v in values]]


def grid_for(tokens: int) -> int:
    """Rows of the square grid whose cells see about ``CELL_TOKENS`` each."""
    return max(1, math.isqrt(max(0, tokens - 1) // CELL_TOKENS) + 1)


def _counter(grid: int):
    """Texts to packed pairs of each cell."""
    pack = min(max(PACK_TOKENS, grid * grid * 256), MOST_PACK_TOKENS)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        pair, word = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, word = pair[order], word[order]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(np.concatenate([heads, [len(pair)]])).astype(np.uint32)
        pair, word = pair[heads], word[heads]
        with np.errstate(over="ignore"):
            before = (pair - word) * _BACK
        cell = _band(before, grid) * grid + _band(word, grid)
        by_cell = np.argsort(cell, kind="stable")
        edges = np.searchsorted(cell[by_cell], np.arange(grid * grid + 1))
        cells, blobs = [], []
        for c in np.flatnonzero(np.diff(edges)):
            own = by_cell[edges[c] : edges[c + 1]]
            names, index = np.unique(word[own], return_inverse=True)
            cells.append(int(c))
            body = _packed(pair[own], index.astype(np.uint32), count[own])
            blobs.append(len(body).to_bytes(8, "little") + body + _packed(names))
        yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(blobs, pa.binary())], names=["cell", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in words.slices(whole, "text"):
                _, previous, token = tokens(batch.column(0))
                held.append((pair_hash(previous, token), token))
                n += len(token)
                if n >= pack:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write under another name first: a task that runs twice, or is lost half way, leaves whole files only."""
    for k, a in enumerate(arrays):
        path = Path(folder) / f"{name}.{k}"
        draft = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
        draft.write_bytes(np.ascontiguousarray(a).tobytes())
        os.replace(draft, path)


def _cell_merger(folder: str, grid: int):
    """All blobs of a cell: write its pairs, send on counts of its previous words and words."""

    def run(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        pairs, names, counts = [], [], []
        for blob in blobs["blob"]:
            size = int.from_bytes(blob[:8], "little")
            pair, index, count = _unpacked(blob[8 : 8 + size], [np.uint64, np.uint32, np.uint32])
            name = _unpacked(blob[8 + size :], [np.uint64])[0]
            pairs.append(pair)
            names.append(name[index])
            counts.append(count.astype(np.uint64))
        pair, name, count = np.concatenate(pairs), np.concatenate(names), np.concatenate(counts)
        order = np.argsort(pair, kind="stable")
        pair, name, count = pair[order], name[order], count[order]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, name, count = pair[heads], name[heads], np.add.reduceat(count, heads)
        _save(folder, f"pairs-{key[0]}", pair, count)
        with np.errstate(over="ignore"):
            before = (pair - name) * _BACK
        one, two = (count == 1).astype(np.uint64), (count == 2).astype(np.uint64)
        first = _merged(before, one, two, np.uint64(1) - one - two)
        second = _merged(name, count, np.ones(len(name), np.uint64))
        seen = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        rows = [(int(key[0]) // grid, 0, _packed(*first), int(key[0]), len(pair), *seen), (int(key[0]) % grid, 1, _packed(*second), None, 0, 0, 0, 0, 0)]
        return pd.DataFrame(rows, columns=["band", "kind", "blob", "cell", "pairs", "n1", "n2", "n3", "n4"]).astype({"cell": "Int64"})

    return run


def _word_merger(folder: str):
    """All counts of a band of words, as previous words and as words: write its table, send its sums."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, sums = [], []
        for kind, blob in zip(rows["kind"], rows["blob"], strict=True):
            k, *v = _unpacked(blob, [np.uint64] * (4 if kind == 0 else 3))
            full = np.zeros((5, len(k)), np.uint64)
            full[0:2] = v if kind else 0
            full[2:5] = 0 if kind else v
            keys.append(k)
            sums.append(full)
        key_, count, before, one, two, more = _merged(np.concatenate(keys), *np.concatenate(sums, axis=1))
        _save(folder, f"words-{key[0]}", key_, count, before.astype(np.uint32), one.astype(np.uint32), two.astype(np.uint32), more.astype(np.uint32))
        seen = [int((before == k).sum()) for k in (1, 2, 3, 4)]
        out = (int(key[0]), len(key_), int(count.sum()), int((count > 0).sum()), int(before.sum()), *seen)
        return pd.DataFrame([out], columns=["band", "rows", "tokens", "words", "befores", "n1", "n2", "n3", "n4"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ of modified Kneser-Ney; where counts of counts are missing, 0.5, 1 and 1.5 of them in bounds."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(found, start=1))


@dataclass
class Model:
    """Where the arrays are, how long each must be, and the sums that scoring needs: a number for each cell and band, about
    ``CELL_TOKENS`` tokens, and nothing else that grows with the corpus."""

    folder: str
    grid: int
    texts: int
    tokens: int
    words: int
    befores: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float
    cell_rows: np.ndarray
    band_rows: np.ndarray

    def table(self, kind: str, at: int, kinds: list) -> list[np.ndarray]:
        """The arrays of a cell (``pairs``) or band (``words``); raises where a file is missing or has another length."""
        rows, name = int((self.cell_rows if kind == "pairs" else self.band_rows)[at]), f"{kind}-{at}"
        if not rows:
            return [np.zeros(0, k) for k in kinds]
        key = (self.folder, name)
        if key not in _MAPPED:
            paths = [Path(self.folder) / f"{name}.{k}" for k in range(len(kinds))]
            for path, k in zip(paths, kinds, strict=True):
                if not path.exists() or path.stat().st_size != rows * np.dtype(k).itemsize:
                    raise FileNotFoundError(f"the model's file {path} is missing here or is not whole: the shared folder must be mounted on every worker")
            while len(_MAPPED) >= MAPPED:
                _MAPPED.pop(next(iter(_MAPPED)))
            _MAPPED[key] = [np.memmap(p, k, "r") for p, k in zip(paths, kinds, strict=True)]
        else:
            _MAPPED[key] = _MAPPED.pop(key)
        return _MAPPED[key]

    def look_up(self, kind: str, at: int, kinds: list, keys: np.ndarray) -> np.ndarray:
        """(values x keys), 0 for what is not there; keys are looked up in ascending order."""
        table = self.table(kind, at, kinds)
        out = np.zeros((len(kinds) - 1, len(keys)))
        if len(table[0]) and len(keys):
            place = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
            there = table[0][place] == keys
            for k, column in enumerate(table[1:]):
                out[k] = np.where(there, column[place], 0)
        return out

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        """(count, befores, once, twice, more) of sorted distinct words."""
        out, band = np.zeros((5, len(h))), _band(h, self.grid)
        for b in np.unique(band):
            own = np.flatnonzero(band == b)
            out[:, own] = self.look_up("words", int(b), [np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32], h[own])
        return out

    def pair_counts(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair, cell = pair_hash(before, word), _band(before, self.grid) * self.grid + _band(word, self.grid)
        order = np.lexsort((pair, cell))
        edges = np.searchsorted(cell[order], np.arange(self.grid**2 + 1))
        out = np.zeros(len(pair))
        for c in np.flatnonzero(np.diff(edges)):
            own = order[edges[c] : edges[c + 1]]
            out[own] = self.look_up("pairs", int(c), [np.uint64, np.uint64], pair[own])[0]
        return out

    def log10(self, previous: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of every token."""
        names, index = np.unique(np.concatenate([previous, token]), return_inverse=True)
        facts = self.word_counts(names)
        facts[0, names == START] = self.texts
        u, w = index[: len(previous)], index[len(previous) :]
        d, e = np.array([0.0, *self.pair_discounts]), np.array([0.0, *self.word_discounts])
        count, before = facts[0][w], facts[1]
        lower = np.full(len(names), 1 / (self.words + 1))
        if self.befores:
            lower = np.maximum(before - e[np.minimum(before, 3).astype(int)], 0) / self.befores + self.word_left / (self.words + 1)
        p, context = lower[w], facts[0][u]
        known = context > 0
        pairs = np.zeros(len(token))
        pairs[known] = self.pair_counts(previous[known], token[known])
        left = d[1] * facts[2] + d[2] * facts[3] + d[3] * facts[4]
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = np.maximum(pairs - d[np.minimum(pairs, 3).astype(int)], 0) / context + left[u] / context * p
        return np.log10(np.where(known, mixed, p)), count


_MAPPED: dict = {}


def train(docs: DataFrame, *, text_column: str = "text", grid: int | None = None) -> Model:
    """A model of the texts of ``docs``; null texts count as empty ones, of which the end mark alone is learnt.

    ``grid`` squared is the number of cells; by default it follows from the number of tokens, so that a cell fits a task at any size.
    """
    spark = docs.sparkSession
    folder = posix_path(fresh_path(spark, "kneser-ney"))
    os.makedirs(folder)
    texts = docs.select(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    # words are about as many as separators; this only sizes the grid
    rows, breaks = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") - F.octet_length(F.translate("text", " \n", ""))), F.lit(0))).first()
    grid = grid or grid_for(rows + breaks)
    packed = texts.mapInArrow(_counter(grid), "cell int, blob binary")
    merged = packed.groupBy("cell").applyInPandas(_cell_merger(folder, grid), "band int, kind int, blob binary, cell long, pairs long, n1 long, n2 long, n3 long, n4 long")
    cells = written(merged, "kneser-ney-cells")
    pair_seen = cells.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    cell_rows, band_rows = np.zeros(grid * grid, np.int64), np.zeros(grid, np.int64)
    for cell, n in cells.filter("kind = 0").select("cell", "pairs").collect():
        cell_rows[cell] = n
    bands = cells.select("band", "kind", "blob").groupBy("band").applyInPandas(_word_merger(folder), "band long, rows long, tokens long, words long, befores long, n1 long, n2 long, n3 long, n4 long").collect()
    for r in bands:
        band_rows[r["band"]] = r["rows"]
    total = [sum(r[k] for r in bands) for k in range(2, 9)]
    word_discounts = discounts(*total[3:])
    # what the discounts take from the words: their number at 1, 2, and 3 or more distinct previous words
    more = total[1] - total[3] - total[4]
    taken = word_discounts[0] * total[3] + word_discounts[1] * total[4] + word_discounts[2] * more
    left = taken / total[2] if total[2] else 1.0
    return Model(folder, grid, rows, total[0], total[1], total[2], discounts(*pair_seen), word_discounts, left, cell_rows, band_rows)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in words.slices(whole, "text", 4 << 20):
                rows = batch.num_rows
                row, previous, token = tokens(batch.column(1))
                p, count = model.log10(previous, token)
                base = np.log10((count + ADD) / (model.tokens + ADD * (model.words + 1)))
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array(np.bincount(row, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(row, count > 0, rows).astype(np.int64)),
                        pa.array(np.bincount(row, base, rows)),
                        pa.array(np.bincount(row, p, rows)),
                    ],
                    names=["id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def scores(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` (log10 probabilities of the text) and ``perplexity`` of each row.

    Null and empty texts have one token, the end mark. Null and repeated ids are kept as they are. Very long texts are read
    whole. Extra columns play no part. A model of no texts gives every word the same chance, 1.
    """
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    found = base.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "id long, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(remainder("doc_id", 10) != 0))
    return scores(docs, model).select(F.col("id").alias("doc_id"), (remainder("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
