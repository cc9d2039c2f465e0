"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Candidates are spans of four kinds (email, ip, card, phone): those of the strict patterns, and looser ones (written-out
emails, IPv6 addresses, cards in other groupings, phones without a country code). Labelers look at a candidate and vote for, against or not
at all: the pattern, the checks of its kind, gazetteers (domains, network ranges, issuer digits, calling codes) and the
words before it. How often each pattern of votes occurs is counted over all documents; a two-class model of independent labelers
is fitted to the counts by expectation-maximisation, so no labels are needed. Its posteriors train a logistic classifier
on votes and shape, which decides on the looser candidates. Strict spans always stay; a loose match that fails the check of its
kind, or stands inside a longer word, is no candidate, as a strict one that fails is none.

One pass reads the texts; everything after works on the few candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.storage import written

KINDS = ("email", "ip", "card", "phone")
#: A looser candidate is taken from this probability on.
CUT = 0.9
#: Distinct patterns of votes that are fitted at most; there are 3^7 * 4 * 5 in all, so none is ever left out.
LABELERS = ("strict", "check", "gazetteer", "near_words", "far_words", "bounds", "shape")
CHECK, BOUNDS = LABELERS.index("check"), LABELERS.index("bounds")
CONTEXT_NEAR, CONTEXT_FAR = 24, 80

# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu ch at nl be ca us au jp example test".split())
CONTEXT = {
    "email": frozenset("mail email e-mail contact write inbox correo courriel address reach send".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address addr client login from node adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment paid karte carte tarjeta".split()),
    "phone": frozenset("call phone tel telephone mobile cell fax whatsapp sms dial ring telefon móvil".split()),
}
AGAINST = frozenset("version isbn issn order invoice serial build release figure section chapter page doi commit sha hash ticket".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails from each of its places if it fails from its first, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63})+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_ANY = re.compile(r"[0-9@]|[\[(]at[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Strict emails, left to right. Every @ is tried with the run of name characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        if found := _DOMAIN.match(text, at):
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield begin, found.end()
                done = found.end()
        at = text.find("@", max(at + 1, done))


def strict_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """``(kind, start, end, passes)`` of the strict patterns; only those that pass their checks are spans."""
    for begin, end in emails(text):
        yield "email", begin, end, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), _octets(m.group())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            yield "card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


def _votes(text: str, kind: str, begin: int, end: int, strict: bool, passes: bool) -> tuple[int, ...]:
    """One of -1, 0, 1 for each of ``LABELERS``."""
    span = text[begin:end]
    digits = _digits(span)
    if kind == "email":
        tail = re.split(r"[.\])]", span)[-1].strip().lower()
        check, gazetteer = 1 if tail.isalpha() else -1, 1 if tail in DOMAINS else 0
        shape = 1 if 6 <= len(span) <= 64 else -1
    elif kind == "ip":
        check = 1 if ":" in span or _octets(span) else -1
        gazetteer = -1 if ":" not in span and span.split(".")[0] in ("0", "1", "2", "255") else 1
        shape = 1 if ":" in span or all(len(p) <= 3 for p in span.split(".")) else -1
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
        shape = 1 if len(digits) in (15, 16) else 0
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if strict and digits[0] != "0" else 0 if digits[0] in "23456789" else -1
        shape = 1 if re.search(r"[ ().-]", span) and len(set(digits)) > 2 else 0
    near, far = (frozenset(w.lower() for w in _WORDS.findall(text, max(0, begin - n), begin)) for n in (CONTEXT_NEAR, CONTEXT_FAR))
    context = [1 if CONTEXT[kind] & w else -1 if AGAINST & w else 0 for w in (near, far)]
    beside = text[begin - 1 : begin] + text[end : end + 1] if begin else text[end : end + 1]
    bounds = -1 if any(c.isalnum() or c in "_/" for c in beside) else 1
    return (1 if strict and passes else -1 if strict else 0, check, gazetteer, *context, bounds, shape)


def _free(spans: list[tuple[int, int]], held: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``held``; both ascend, ``spans`` are apart, those of ``held`` may overlap: one sweep."""
    out, at, reach = [], 0, 0
    for begin, end in spans:
        while at < len(held) and held[at][0] < end:
            reach = max(reach, held[at][1])
            at += 1
        if reach <= begin:
            out.append((begin, end))
    return out


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str]]:
    """``(kind, start, end, strict span, votes)``; code points, ends exclusive. Loose ones do not overlap strict spans.

    Time is that of the patterns, linear in the text, and of sorting the strict spans.
    """
    if not text or not _ANY.search(text):
        return []
    out = [(k, b, e, passes, _votes(text, k, b, e, True, passes)) for k, b, e, passes in strict_matches(text)]
    held = sorted((b, e) for _, b, e, passes, _ in out if passes)
    for kind, pattern in _LOOSE.items():
        if kind == "email" and "at" not in text:
            continue
        for begin, end in _free([m.span() for m in pattern.finditer(text)], held):
            votes = _votes(text, kind, begin, end, False, False)
            if votes[CHECK] == votes[BOUNDS] == 1:
                out.append((kind, begin, end, False, votes))
    return [(k, b, e, passes, "".join("-0+"[v + 1] for v in votes)) for k, b, e, passes, votes in out]


_FOUND = "id long, found array<struct<kind: string, start: int, end: int, strict: boolean, votes: string>>"
_STRUCT = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in words.slices(whole, "text"):
            found = [[dict(zip(("kind", "start", "end", "strict", "votes"), c, strict=True)) for c in candidates(t)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(_STRUCT))], names=["id", "found"])


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes: the prior, P(vote | class) and each pattern's posterior.

    ``votes``: (patterns x labelers) of -1, 0, 1. Classes start from the majority of votes, which also tells them apart.
    """
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = np.clip(0.5 + 0.45 * np.tanh(votes.sum(axis=1)), 0.02, 0.98)
    prior, table = 0.5, np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        # one vote for, one against and one abstention of a smoothing count in each class
        table = np.einsum("cp,plv->clv", weight, seen) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->pc", seen, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -30, 30)))
        if np.abs(new - posterior).max(initial=0) < 1e-6:
            posterior = new
            break
        posterior = new
    return prior, table, posterior


@dataclass
class Classifier:
    """Weights of a logistic model on kind, votes for and votes against."""

    weights: np.ndarray

    def chance(self, kinds: list[str], votes: list[str]) -> np.ndarray:
        z = features(kinds, votes) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(kinds: list[str], votes: list[str]) -> np.ndarray:
    out = np.zeros((len(kinds), len(KINDS) + 2 * len(LABELERS)))
    for k, (kind, own) in enumerate(zip(kinds, votes, strict=True)):
        out[k, KINDS.index(kind)] = 1
        for j, v in enumerate(own):
            if v != "0":
                out[k, len(KINDS) + 2 * j + (v == "-")] = 1
    return out


def fit(patterns: list[tuple[str, str, int]]) -> Classifier:
    """From (kind, votes, count): reliabilities by kind, then the classifier on their posteriors. Deterministic."""
    patterns = sorted(patterns)
    x = features([k for k, _, _ in patterns], [v for _, v, _ in patterns])
    counts = np.array([n for _, _, n in patterns], float)
    target = np.zeros(len(patterns))
    for kind in KINDS:
        own = [k for k, p in enumerate(patterns) if p[0] == kind]
        if own:
            votes = np.array([["-0+".index(c) - 1 for c in patterns[k][1]] for k in own])
            target[own] = reliabilities(votes, counts[own])[2]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (counts * (target - p)) - w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return Classifier(w)


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, with commas between."""
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _decide(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                strict = [(c["kind"], c["start"], c["end"]) for c in found if c["strict"]]
                loose = [c for c in found if not c["strict"] and c["votes"][0] == "0"]
                taken = list(strict)
                if loose:
                    chance = model.chance([c["kind"] for c in loose], [c["votes"] for c in loose])
                    taken += [(c["kind"], c["start"], c["end"]) for c, p in zip(loose, chance, strict=True) if p >= CUT]
                rows.append((*[sum(s[0] == k for s in strict) for k in KINDS], sha256(joined(strict).encode()).hexdigest(), joined(taken)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, strict spans by kind (``n_email``, ``n_ip``, ``n_card``, ``n_phone``), the digest of the strict spans
    and all ``spans`` as text.

    Null and empty texts have no spans. Null and repeated ids are kept row by row. Very long texts are read whole, in time
    proportional to their length. Extra columns play no part; an empty table gives an empty result.
    """
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    found = written(base.mapInArrow(_find, _FOUND), "pii-candidates")
    patterns = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    model = fit([(r["kind"], r["votes"], r["n"]) for r in patterns.collect()])  # at most 4 * 3^7 rows, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return found.mapInArrow(_decide(shared), out)


def masked(text: str, spans: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans, what is left of the later."""
    out, done = [], 0
    for kind, begin, end in sorted(((k, int(b), int(e)) for k, b, e in (s.split(":") for s in spans.split(",") if s)), key=lambda s: s[1:]):
        if end <= done:
            continue
        out += [text[done : max(done, begin)], f"<{kind}>"]
        done = end
    return "".join([*out, text[done:]])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
