"""Toxic spans and documents by a linear-chain conditional random field over two states.

Token labels. A feature (a word, or a prefix or suffix of one) that occurs in at least ``MIN_DOCS`` toxic labelled documents and
whose smoothed share of toxic ones is ``MIN_SHARE`` or more marks its tokens in toxic documents: these are the labelled tokens.

Field. The score of a sequence adds the weights of each toxic token's hashed features, a bias, and weights of neighbouring
states. Training maximises the conditional likelihood of the labelled tokens by L-BFGS; expectations come from forward-backward.

Forward-backward runs over all tokens of a batch at once: a token is a 2 x 2 matrix (at a text's beginning one of rank 1, which
forgets what was before), and messages are prefix products of such matrices, taken in blocks by doubling levels. Its cost
does not depend on how long the longest text is.

Documents. The marginals of the toxic state give the largest one, their expected number, and that per word; a logistic model on
these, fitted to the labelled documents, is the score of a document. Spans are the runs of tokens with a marginal of 0.5 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.quality import remainder

#: Labelled documents that are learnt from at most, and bytes of their texts. Token labels, field and document model see them all.
MAX_DOCS, MAX_BYTES = 12_000, 32 << 20
#: Text whose messages are in memory at once while the field is fitted, and stretches of it that are worked on side by side.
FIT_PART, FIT_THREADS = 1 << 20, 4
MIN_DOCS, MIN_SHARE = 4, 0.8
PREFIXES, SUFFIXES = (3, 4, 5, 6, 8), (4, 6)
BITS = 18
RIDGE, STEPS = 1.0, 20
CUT = 0.3
_BLOCK = 64
_TRIM = np.zeros(256, bool)
_TRIM[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def token_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, end, slots)`` of every word: hashed whole word, prefixes and suffixes, without punctuation around it."""
    raw, at = words.text_bytes(texts)
    row, start, end = words.spans(raw, at)
    first, last = start.copy(), end.copy()
    for _ in range(4):
        open_ = (first < last - 1) & _TRIM[raw[first]] if len(first) else np.zeros(0, bool)
        first = first + open_
        shut = (last - 1 > first) & _TRIM[raw[last - 1]] if len(first) else np.zeros(0, bool)
        last = last - shut
    parts = [(first, last)] + [(first, np.minimum(first + k, last)) for k in PREFIXES] + [(np.maximum(last - k, first), last) for k in SUFFIXES]
    hashes = words.hash_many(raw, start, end, parts)
    slots = np.empty((len(row), len(parts)), np.int32)
    with np.errstate(over="ignore"):
        for k, h in enumerate(hashes):
            slots[:, k] = (words.mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int32)
    # a part as long as the word says nothing that the word does not
    length = last - first
    for k, size in enumerate((*PREFIXES, *SUFFIXES), start=1):
        slots[length <= size, k] = slots[length <= size, 0]
    return row, start, end, slots


def _prefix_messages(step: np.ndarray) -> np.ndarray:
    """Row vectors ``v_t`` with ``v_t`` proportional to ``v_(t-1) step_t``; ``step_0`` has equal rows."""
    n = len(step)
    if n <= _BLOCK:
        out, v = np.empty((n, 2)), np.array([0.5, 0.5])
        for t in range(n):
            v = v @ step[t]
            v = v / v.sum()
            out[t] = v
        return out
    blocks = -(-n // _BLOCK)
    # (entry, place in its block, block): the loop reads and writes stretches that lie side by side
    padded = np.ascontiguousarray(np.concatenate([step, np.tile(np.eye(2), (blocks * _BLOCK - n, 1, 1))]).reshape(blocks, _BLOCK, 4).transpose(2, 1, 0))
    inside = np.empty_like(padded)
    a, b, c, d = padded[:, 0]
    for t in range(_BLOCK):
        if t:
            e, f, g, h = padded[:, t]
            a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
        inside[0, t], inside[1, t], inside[2, t], inside[3, t] = a, b, c, d
    carried = _prefix_messages(inside[:, -1].T.reshape(blocks, 2, 2))
    before = np.concatenate([[[0.5, 0.5]], carried[:-1]]).T
    x = before[0] * inside[0] + before[1] * inside[2]
    y = before[0] * inside[1] + before[1] * inside[3]
    total = x + y
    return np.stack([(x / total).T, (y / total).T], axis=2).reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, row: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of state 1 at every token, and of each pair of states between a token and the next of its text.

    ``emission``: log weight of state 1 over state 0; ``change``: 2 x 2 log weights of neighbouring states; ``row``: ascending.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    e = np.exp(np.clip(emission, -20, 20))
    moves = np.exp(np.clip(change, -20, 20))
    begins = np.concatenate([[True], row[1:] != row[:-1]])
    ends = np.concatenate([begins[1:], [True]])
    forward = np.empty((n, 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            forward[:, i, j] = np.where(begins, 1.0, moves[i, j]) * (e if j else 1.0)
    alpha = _prefix_messages(forward)
    # b_t(i) = sum_j moves(i, j) e_(t+1)(j) b_(t+1)(j), as row vectors from the end: b_t = b_(t+1) diag(e_(t+1)) moves^T
    backward = np.empty((n, 2, 2))
    nxt = np.concatenate([e[1:], [1.0]])
    for i in (0, 1):
        for j in (0, 1):
            backward[:, j, i] = np.where(ends, 1.0, moves[i, j] * (nxt if j else 1.0))
    beta = _prefix_messages(backward[::-1])[::-1]
    toxic = alpha[:, 1] * beta[:, 1]
    chance = toxic / (alpha[:, 0] * beta[:, 0] + toxic)
    inner = np.flatnonzero(~begins[1:])
    before, after = alpha[inner], beta[inner + 1]
    after[:, 1] *= e[inner + 1]
    pair = np.empty((len(inner), 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pair[:, i, j] = before[:, i] * moves[i, j] * after[:, j]
    pair /= (pair[:, 0, 0] + pair[:, 0, 1] + pair[:, 1, 0] + pair[:, 1, 1])[:, None, None]
    return chance, pair


@dataclass
class Field:
    """Weights of hashed features, bias, neighbour weights, and the document model with its scaling."""

    weights: np.ndarray
    bias: float
    change: np.ndarray
    document: np.ndarray

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        out = np.full(len(slots), self.bias)
        for k in range(slots.shape[1]):
            out += self.weights[slots[:, k]]
        return out

    def document_scores(self, chance: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        z = document_features(chance, row, rows) @ self.document
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_features(chance: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows x 4): 1, the largest marginal, the log of the expected number and of that per hundred words."""
    largest = np.zeros(rows)
    np.maximum.at(largest, row, chance)
    expected = np.bincount(row, chance, rows)
    count = np.maximum(np.bincount(row, minlength=rows), 1)
    return np.stack([np.ones(rows), largest, np.log1p(expected), np.log1p(100 * expected / count)], axis=1)


def marked_features(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """(slots x features) of those that mark toxic tokens, from (row, slots, labels of rows) of the labelled documents."""
    width, bad, total = 1 << BITS, None, None
    for row, slots, toxic in parts:
        if bad is None:
            bad, total = (np.zeros((slots.shape[1], width)) for _ in range(2))
        for k in range(slots.shape[1]):
            pair = np.unique(row.astype(np.int64) * width + slots[:, k])
            doc, slot = pair // width, pair % width
            bad[k] += np.bincount(slot, toxic[doc], width)
            total[k] += np.bincount(slot, minlength=width)
    if bad is None:
        return np.zeros((0, width), bool)
    return (bad >= MIN_DOCS) & ((bad + 0.1) / (total + 0.5) >= MIN_SHARE)


def _minimise(value_and_slope, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with step halving."""
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, kept = slope.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(slope).sum()) ** 0.5)
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        step = 1.0
        for _ in range(12):
            new = x - step * q
            new_value, new_slope = value_and_slope(new)
            if new_value <= value - 1e-4 * step * (slope @ q):
                break
            step /= 2
        else:
            return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-10:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def _parts(column: pa.Array, toxic: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, slots, labels) of stretches of the texts."""
    batch, begin = pa.record_batch([column], names=["text"]), 0
    for part in words.slices(batch, "text", most):
        row, _, _, slots = token_features(part.column(0))
        yield begin, row, slots, toxic[begin : begin + part.num_rows]
        begin += part.num_rows


def fit(column: pa.Array, toxic: np.ndarray) -> Field:
    """Deterministic; without toxic tokens every score is the share of toxic documents."""
    rows = len(column)
    prior = (toxic.sum() + 0.5) / (len(toxic) + 1)
    field = Field(np.zeros(1 << BITS), -20.0, np.zeros((2, 2)), np.array([np.log(prior / (1 - prior)), 0, 0, 0]))
    marked = marked_features((row, slots, own) for _, row, slots, own in _parts(column, toxic))
    if not marked.any():
        return field
    _fit_field(field, column, toxic, marked)
    shown = np.zeros((rows, len(field.document)))
    for begin, row, slots, own in _parts(column, toxic):
        chance, _ = marginals(field.emissions(slots), row, field.change)
        shown[begin : begin + len(own)] = document_features(chance, row, len(own))
    field.document = _logistic(shown, toxic)
    return field


def _fit_field(field: Field, column: pa.Array, toxic: np.ndarray, marked: np.ndarray) -> None:
    """Set the field's weights to those most likely for the token labels of all texts, read part by part."""

    def labelled() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, row, slots, own in _parts(column, toxic, FIT_PART):
            label = np.zeros(len(row), bool)
            for k in range(slots.shape[1]):
                label |= marked[k][slots[:, k]]
            yield row, slots, label & (own[row] > 0)

    # only features of labelled tokens can gain weight; the rest stay 0
    there = np.zeros(1 << BITS, bool)
    for _, slots, label in labelled():
        there[slots[label]] = True
    used = np.flatnonzero(there)
    n = len(used)
    if not n:
        return
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(n)
    parts, truth = [], np.zeros(n + 4)
    for row, slots, label in labelled():
        local = place[slots]
        token, feature = np.nonzero(local >= 0)
        slot, inner = local[token, feature], row[1:] == row[:-1]
        parts.append((row.astype(np.int32), label, token.astype(np.int32), slot))
        truth[:n] += np.bincount(slot, label[token], n)
        truth[n] += label.sum()
        truth[n + 1 :] += np.bincount((label[:-1] * 2 + label[1:])[inner], minlength=4)[1:]

    def unpacked(x: np.ndarray) -> np.ndarray:
        change = np.zeros((2, 2))
        change[0, 1], change[1, 0], change[1, 1] = x[-3:]
        return change

    def value_and_slope(x: np.ndarray):
        def expected(part):
            row, label, token, slot = part
            chance, pair = marginals(x[n] + np.bincount(token, x[slot], len(row)), row, unpacked(x))
            mean = np.concatenate([np.bincount(slot, chance[token], n), [chance.sum()], pair.sum(axis=0).ravel()[1:]])
            return _log_likelihood(label, chance, pair, row[1:] == row[:-1]), mean

        value, mean = 0.0, np.zeros(n + 4)
        for v, m in pool.map(expected, parts):  # in the order of the parts, so that sums do not depend on threads
            value, mean = value + v, mean + m
        return -value + RIDGE / 2 * (x @ x), mean - truth + RIDGE * x

    x = np.zeros(n + 4)
    x[n] = -4.0
    with ThreadPoolExecutor(FIT_THREADS) as pool:
        x = _minimise(value_and_slope, x, STEPS)
    field.weights[used], field.bias, field.change = x[:n], float(x[n]), unpacked(x)


def _log_likelihood(label: np.ndarray, chance: np.ndarray, pair: np.ndarray, inner: np.ndarray) -> float:
    """log p(labels) by the chain rule: a chain's joint is the product of pair marginals over inner node marginals."""
    tiny = 1e-300
    node = np.log(np.maximum(np.where(label, chance, 1 - chance), tiny))
    pairs = np.log(np.maximum(pair[np.arange(len(pair)), label[:-1][inner].astype(int), label[1:][inner].astype(int)], tiny))
    # every token's node marginal once for each pair that it takes part in beyond the first
    times = np.ones(len(label))
    times[:-1] -= inner
    times[1:] -= inner
    return float(pairs.sum() + (times * node).sum())


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for whole in batches:
            for batch in words.slices(whole, "text"):
                texts, rows = batch.column(1), batch.num_rows
                row, start, end, slots = token_features(texts)
                chance, _ = marginals(field.emissions(slots), row, field.change)
                scores = field.document_scores(chance, row, rows)
                hit = np.flatnonzero(chance >= 0.5)
                opens = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]) if len(hit) else np.zeros(0, bool)
                heads = hit[opens]
                tails = hit[np.concatenate([opens[1:], [True]])] if len(hit) else hit
                raw, at = words.text_bytes(texts)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                owner = row[heads]
                base = points[at[owner]]
                spans = np.stack([points[start[heads]] - base, points[end[tails]] - base], axis=1).astype(np.int32) if len(heads) else np.zeros((0, 2), np.int32)
                offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["start", "end"])
                yield pa.record_batch([batch.column(0), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "score", "spans"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, fold: int = 4, held_out: int = 2, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Field:
    """A field fitted on labelled rows outside the held-out fold: at most ``max_docs`` of them, those with the smallest hash of
    the id, and of these in that order all whose texts fit what is left of ``max_bytes``; one that does not is passed over. Null
    ids, texts and labels are left out.
    """
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    some = known.filter(remainder("id", fold) != held_out).orderBy(F.xxhash64("id"), "id", "y").limit(max_docs)
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("text is not null")
    # the sample has a fixed bound, so its ids may be broadcast, and its texts come from one filtered scan
    sizes = texts.join(F.broadcast(some.distinct()), "id").groupBy("id", "y").agg(F.sum(F.octet_length("text")).alias("size"))
    fits, left = set(), max_bytes
    for _, i, y, size in sorted(tuple(r) for r in sizes.select(F.xxhash64("id"), "id", "y", "size").collect()):
        if size <= left:
            fits.add((i, y))
            left -= size
    wanted = docs.sparkSession.createDataFrame(sorted(fits), "id long, y int")
    rows = texts.join(F.broadcast(wanted), "id").select("id", "y", "text").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").cast(pa.large_string()).combine_chunks(), np.asarray(rows.column("y"), dtype=np.float64))


def toxicity(docs: DataFrame, field: Field, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``score`` (0 to 1, higher: label 1 likelier) and ``spans`` (code points, end exclusive) of every row.

    Null and empty texts have no spans and the score of a text without toxic words. Null and repeated ids are scored row by
    row. Very long texts are read whole. Other columns play no part; an empty table gives an empty result.
    """
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(field)), "id long, score double, spans array<struct<start: int, end: int>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its offending offsets."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, train(docs, labels))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), offsets.alias("offsets"))
