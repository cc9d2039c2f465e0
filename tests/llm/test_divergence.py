"""Source divergence against plain code, whatever the batches and parts: absent sources, ties, nulls, hot terms, very large counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import divergence

WORDS = ["alpha", "Beta", "GAMMA", "délta", "Éta", "日本", "zeta", "iota", "kappa", "lambda"] + [f"w{chr(97 + k)}{chr(97 + k // 3)}" for k in range(20)]


def plain(rows, least=10, first=10):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in df[lang].items() if n >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            best = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:first]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", best)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def texts(n, seed):
    draw, rows = random.Random(seed), []
    for _ in range(n):
        lang = draw.choice(["en", "de", None])
        source = draw.choice(["s1", "s2", "s3", None, "é", "Z"]) if lang != "de" else draw.choice(["s1", "only de"])
        pool = WORDS[: 12 if source == "s1" else 30]
        rows.append((draw.choice([" ", "\n", "-3-"]).join(draw.choice(pool) for _ in range(draw.randrange(40))), lang, source))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(t, la, s, "x", 1) for t, la, s in rows], "text string, lang string, source string, term string, n int").withColumn("a.b", F.col("n")).repartition(4)
    return sorted(map(tuple, divergence.divergence(df, **options).collect()))


@pytest.mark.parametrize("held", [250_000, 7])
def test_groups_terms_and_ties(spark, held):
    rows = texts(200, 5) + [(None, "fr", "a"), ("", "fr", "b"), ("1 2 3", "fr", None), ("word", "it", "alone"), (None, "en", "empty"), ("solo " * 50_000, "en", "s2"), ("alpha beta", "en", "s1"), ("alpha beta", "en", "s1")]
    assert found(spark, rows, held=held) == plain(rows)


def test_frequent_terms_are_dealt_by_part(spark, monkeypatch):
    """A word of every document, in parts small enough that its rows go to many places first, and steps that cut runs of terms."""
    monkeypatch.setattr(divergence, "FREQUENT", 2)
    monkeypatch.setattr(divergence, "STEP", 20)
    rows = [(f"the {w} of {WORDS[k % 30]}", "en", f"s{k % 5}") for k, w in enumerate(WORDS * 12)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, rows, held=12) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_empty_table(spark):
    assert found(spark, []) == []


def test_shares_of_counts_beyond_64_bits():
    counts, total = np.array([0, 10**12, 5 * 10**12]), 6 * 10**12
    assert divergence._share(counts, total, 3).tolist() == [1 + 10**9 * (c + 2) // (total + 6) for c in counts.tolist()]


def test_terms_by_bytes_are_those_by_characters():
    text = "Aä-b_c日本語9x ÀBİc\x7fq{r}[s]`t@u  v"
    assert [t.decode() for t in divergence.terms(text.encode())] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
