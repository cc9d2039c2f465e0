"""Quality scores from a generalised additive model with pairwise interactions.

Each feature of a text is binned; a score is the sigmoid of an intercept, one lookup per feature and one lookup per chosen pair of
features. Tables are learnt by cyclic boosting: round after round, each feature in turn gets a shallow tree fitted to the gradient
histogram of its bins and its leaves are added, shrunk, to the feature's table. Pairs are then ranked by how much of the remaining
gradient their joint bins explain and boosted in the same way with trees that split one axis and then the other.

Learning takes a bounded sample of labelled rows (``MAX_ROWS``, those with the smallest hash of the id) on the driver; features
and scores of all rows are computed where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.storage import row_keys, without_rows, written

#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 4.0
#: A document is predicted to be good from this score on.
CUT = 0.3
FEATURES = (
    "log_words", "log_bytes", "word_length", "distinct_words", "top_word", "longest_run", "repeat_next", "distinct_pairs", "upper", "symbols", "digits",
    "bangs", "bars", "symbol_tail", "line_length", "distinct_lines", "stops", "commas", "short_words", "long_words", "one_letter", "title_words",
)
_SCHEMA = "id long, k1 long, k2 long, features array<float>"
_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_SYMBOL[[c for c in range(33, 127) if not (_LETTER[c] or _DIGIT[c]) and chr(c) not in ".,'-"]] = True


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)


def features_of(texts: pa.Array) -> np.ndarray:
    """(rows x features) of whole texts; all zero for a text without words."""
    rows = len(texts)
    raw, at = words.text_bytes(texts)
    row, start, end = words.spans(raw, at)
    bounds = words.row_bounds(row, rows)
    count = np.diff(bounds).astype(np.float64)
    n, size = np.maximum(count, 1), np.maximum(np.diff(at), 1).astype(np.float64)
    out = np.zeros((rows, len(FEATURES)))
    if not len(row):
        return out
    h = words.hash_spans(raw, start, end)
    length = end - start
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    length_chars = chars[end] - chars[start]
    wr, wh = row, h
    order = np.lexsort((wh, wr))
    r, s = wr[order], wh[order]
    new = np.ones(len(s), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    heads = np.flatnonzero(new)
    group = np.diff(np.concatenate([heads, [len(s)]]))
    top = np.zeros(rows)
    np.maximum.at(top, r[heads], group)
    distinct = np.bincount(r[heads], minlength=rows)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    breaks = np.flatnonzero(~same)
    run_length = np.diff(np.concatenate([breaks, [len(h)]]))
    longest = np.zeros(rows)
    np.maximum.at(longest, row[breaks], run_length)
    with np.errstate(over="ignore"):
        pair = words.mix(h[:-1] * np.uint64(0xD1342543DE82EF95) + h[1:])
    inside = row[1:] == row[:-1]
    pr, _ = words.distinct(row[:-1][inside], pair[inside])
    lines = raw == 10
    n_lines = _per_row(lines, at) + 1
    # a line's hash: the sum of its words' hashes by place, so that equal lines agree
    line_of = np.cumsum(np.concatenate([[0], lines[:-1]]))[start]
    lead = np.ones(len(h), bool)
    lead[1:] = (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])
    leads = np.flatnonzero(lead)
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.repeat(leads, np.diff(np.concatenate([leads, [len(h)]])))
        line_hash = np.add.reduceat(words.mix(h + place.astype(np.uint64)), leads)
    full_lines = np.bincount(row[leads], minlength=rows)
    lr, _ = words.distinct(row[leads], line_hash)
    letters = np.maximum(_per_row(_LETTER[raw], at), 1)
    upper = _per_row(_UPPER[raw], at)
    tail = _SYMBOL[raw[end - 1]] & (length > 1)
    shares = {
        "log_words": np.log1p(count), "log_bytes": np.log1p(np.diff(at)), "word_length": np.bincount(row, length_chars, rows) / n, "distinct_words": distinct / n, "top_word": top / n,
        "longest_run": np.log1p(longest), "repeat_next": np.bincount(row, same, rows) / n, "distinct_pairs": np.bincount(pr, minlength=rows) / n, "upper": upper / letters,
        "symbols": _per_row(_SYMBOL[raw], at) / size, "digits": _per_row(_DIGIT[raw], at) / size, "bangs": _per_row(raw == 33, at) / n, "bars": _per_row(raw == 124, at) / n,
        "symbol_tail": np.bincount(row, tail, rows) / n, "line_length": np.log1p(count / n_lines), "distinct_lines": np.bincount(lr, minlength=rows) / np.maximum(full_lines, 1),
        "stops": _per_row(raw == 46, at) / n, "commas": _per_row(raw == 44, at) / n, "short_words": np.bincount(row, length_chars <= 3, rows) / n, "long_words": np.bincount(row, length_chars >= 12, rows) / n,
        "one_letter": np.bincount(row, length_chars == 1, rows) / n, "title_words": np.bincount(row, _UPPER[raw[start]], rows) / n,
    }
    for k, name in enumerate(FEATURES):
        out[:, k] = shares[name]
    out[count == 0] = 0
    return out


@dataclass
class Model:
    """Bin edges, the intercept, a table per feature and a table per chosen pair."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins).astype(np.float32)) if len(values) else np.zeros(0, np.float32)


def _best_cut(g: np.ndarray, w: np.ndarray) -> tuple[int, float]:
    """Where to cut a histogram in two, and what it gains."""
    left_g, left_w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
    if not len(left_g):
        return 0, 0.0
    total_g, total_w = g.sum(), w.sum()
    gain = left_g**2 / (left_w + RIDGE) + (total_g - left_g) ** 2 / (total_w - left_w + RIDGE) - total_g**2 / (total_w + RIDGE)
    best = int(np.argmax(gain))
    return best + 1, float(gain[best])


def _leaves(g: np.ndarray, w: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin of a tree over one histogram."""
    cut, gain = _best_cut(g, w) if depth else (0, 0.0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (w.sum() + RIDGE))
    return np.concatenate([_leaves(g[:cut], w[:cut], depth - 1), _leaves(g[cut:], w[cut:], depth - 1)])


def _pair_leaves(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Leaves of the better tree of two: cut one axis, then each side on the other."""
    found = []
    for turned in (False, True):
        a, b = (g.T, w.T) if turned else (g, w)
        cut, _ = _best_cut(a.sum(axis=1), b.sum(axis=1))
        out, gain = np.zeros_like(a), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            pg, pw = a[part].sum(axis=0), b[part].sum(axis=0)
            leaf = _leaves(pg, pw, 1)
            out[part] = leaf
            gain += float((leaf * pg).sum())
        found.append((gain, out.T if turned else out))
    return max(found, key=lambda x: x[0])[1]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Deterministic; no rows give score 0.5 everywhere, one class a constant near it."""
    x = x.astype(np.float32)
    k = x.shape[1]
    edges, coarse = [_edges(x[:, j], BINS) for j in range(k)], [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y):
        return Model(edges, 0.0, tables, [], coarse, [])
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(k)]
    low = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(k)]
    total = np.full(len(y), intercept)
    for _ in range(ROUNDS):
        for j in range(k):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _leaves(np.bincount(bins[j], y - p, len(tables[j])), np.bincount(bins[j], p * (1 - p), len(tables[j])))
            tables[j] += step
            total += step[bins[j]]
    p = 1 / (1 + np.exp(-total))
    ranked = []
    for i in range(k):
        for j in range(i + 1, k):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell = low[i] * shape[1] + low[j]
            g, w = (np.bincount(cell, v, shape[0] * shape[1]) for v in (y - p, p * (1 - p)))
            ranked.append((float((g**2 / (w + RIDGE)).sum()), i, j))
    pairs = sorted((i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS])
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(pairs, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            cell = low[i] * table.shape[1] + low[j]
            g, w = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
            step = RATE * _pair_leaves(g, w)
            table += step
            total += step.ravel()[cell]
    return Model(edges, intercept, tables, pairs, coarse, pair_tables)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in words.slices(whole, "text"):
            x = features_of(batch.column(3)).astype(np.float32)
            yield pa.record_batch([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))], names=["id", "k1", "k2", "features"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(FEATURES))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], pa.array(shared.value.scores(_matrix(batch.column(3))))], names=["id", "k1", "k2", "score"])

    return run


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def quality_scores(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, fold: int = 5, held_out: int = 0, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """``id`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``docs``, with the row's keys ``k1`` and ``k2``.

    Labels are learnt from rows whose id has another remainder than ``held_out``, at most ``max_rows`` of them, those with the
    smallest hash of the id. Inputs of a score are computed from the text alone. Null and empty texts have all features 0 and
    get a score like any other. Null ids and labels other than 0 and 1 are not learnt from. Repeated ids are scored row by row. Very long
    texts are read whole. Other columns play no part. Without labels all scores are 0.5; an empty table gives an empty one.
    """
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), *row_keys(id_column, text_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    features = written(base.mapInArrow(_featurise, _SCHEMA), "quality-features")
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    known = known.filter(remainder("id", fold) != held_out)
    sample = features.join(known, "id").orderBy(F.xxhash64("id"), "id", "y", "k1", "k2").limit(max_rows).select("features", "y").toArrow()
    x = np.concatenate([_matrix(c) for c in sample.column(0).chunks]) if sample.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    model = fit(x, np.asarray(sample.column(1), dtype=np.float64))
    return features.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "id long, k1 long, k2 long, score double")


def good_documents(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that score below ``cut``.

    Each row goes or stays by its own text: rows with a null id too, and rows that share an id with a row that goes. Null and empty
    texts go where their score is low. Equal texts have equal scores, so there are no ties to break, and repeated rows go or
    stay together. Very long texts are read whole. Columns may have any name. An empty table gives an empty result; without
    labels all rows score 0.5 and stay.
    """
    low = quality_scores(docs, labels, id_column=id_column, text_column=text_column, **options).filter(F.col("score") < cut).select("k1", "k2").distinct()
    return without_rows(docs, written(low, "quality-low"), id_column, text_column)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_scores(docs, labels)
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
