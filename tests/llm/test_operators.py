"""Operators on the small tables against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tieout.llm import decontaminate, kneser_ney, mixing, neardup, pii, quality, sharding, tokenstore, toxicity, webp
from tieout.llm.components import components, extended
from tieout.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def split(text):
    return (text or "").encode().lower().split()


def crc(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_language_model(spark, docs):
    tokens = {i: [*split(d["text"]), None] for i, d in docs.items()}
    uni, bi = Counter(), Counter()
    for i, w in tokens.items():
        if crc(i, 10):
            uni.update(w)
            bi.update(zip(["<s>", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)

    def discount(counts):
        c = [sum(x == k for x in counts) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        return (0, 1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2])

    d, before = discount(bi.values()), Counter(w for _, w in bi)
    e, total = discount(before.values()), sum(before.values())
    context, left = Counter(), Counter()
    for (u, _), c in bi.items():
        context[u] += c
        left[u] += d[min(c, 3)]
    rest = sum(e[min(c, 3)] for c in before.values()) / total

    def p(u, w):
        q = (before[w] - e[min(before[w], 3)] if w in before else 0) / total + rest / (v + 1)
        return (max(bi[u, w] - d[min(bi[u, w], 3)], 0) + left[u] * q) / context[u] if context[u] else q

    assert abs(sum(p("<s>", w) for w in uni) + rest / (v + 1) * left["<s>"] / context["<s>"] - 1) < 1e-9
    rows = QUERIES["op1_kneser_ney"](spark, DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(uni[x] > 0 for x in w), n, crc(r["doc_id"], 10) == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w)))


@pytest.mark.parametrize("lost", ["pairs-0.0", "pairs-3.1", "words-1.0", "words-0.3"])
def test_a_model_that_lost_a_file_raises(spark, lost):
    from pathlib import Path

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 50}" for j in range(40))) for k in range(30)], "doc_id long, text string")
    model = kneser_ney.train(docs, grid=2)
    whole = {r["id"]: r["score"] for r in kneser_ney.scores(docs, model).collect()}
    one = {r["id"]: r["score"] for r in kneser_ney.scores(docs, kneser_ney.train(docs)).collect()}
    assert whole == pytest.approx(one)  # whatever the grid
    again = kneser_ney.train(docs, grid=2)
    path = Path(again.folder) / lost
    path.write_bytes(path.read_bytes()[:-8])
    with pytest.raises(Exception, match="not whole"):
        kneser_ney.scores(docs, again).collect()
    path.unlink()
    with pytest.raises(Exception, match="missing"):
        kneser_ney.scores(docs, again).collect()


def test_the_grid_follows_the_corpus():
    assert [kneser_ney.grid_for(n) for n in (0, 1, kneser_ney.CELL_TOKENS, kneser_ney.CELL_TOKENS + 1, 100 * kneser_ney.CELL_TOKENS)] == [1, 1, 1, 2, 10]


@pytest.mark.parametrize("name,label,by,out,least", [("op2_quality", "quality", 5, 0, 0.95), ("op10_toxicity", "toxic", 4, 2, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, by, out, least):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], by) == out) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= least * len(held)


def test_field_messages_against_enumeration():
    rng = np.random.default_rng(3)
    emission, row, change = rng.normal(size=150), np.repeat([0, 1, 2], [3, 140, 7]), rng.normal(size=(2, 2))
    chance, pair = toxicity.marginals(emission, row, change)
    for r in (0, 2):
        own = np.flatnonzero(row == r)
        weights = defaultdict(float)
        for states in np.ndindex(*[2] * len(own)):
            weights[states] = math.exp(sum(emission[t] * s for t, s in zip(own, states)) + sum(change[a, b] for a, b in zip(states, states[1:])))
        z = sum(weights.values())
        assert np.allclose(chance[own], [sum(w for s, w in weights.items() if s[k]) / z for k in range(len(own))])
    assert pair.shape == (147, 2, 2) and np.allclose(pair.sum(axis=(1, 2)), 1)


def test_field_learns_from_the_whole_sample(spark):
    """A labelled text of 4 MB with the smallest id neither ends its label's part of the field's texts nor the sample."""
    large = next(i for i in range(-9, 0) if crc(i, 4) != 2)
    for y, options in ((1, {}), (0, {}), (1, {"max_bytes": 1 << 20})):
        rows = [(large, "plain word here " * 250_000, y)] + [(i, f"plain word {'vile' if i % 2 else 'kind'} here and there", i % 2) for i in range(80)]
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        field = toxicity.train(docs, labels, **options)
        assert field.weights.any()
        scores = {r["id"]: r["score"] for r in toxicity.toxicity(docs.filter("doc_id >= 0"), field).collect()}
        assert min(scores[i] for i in range(1, 80, 2)) > max(scores[i] for i in range(0, 80, 2))


def test_personal_data(spark, docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    def plain(text):
        return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if fits(k, m.group())]

    for r in QUERIES["op3_personal_data"](spark, DIR).collect():
        want = plain(docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest() and set(pii.joined(want).split(",")) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
    rng = np.random.default_rng(1)
    for _ in range(2000):
        text = "".join(rng.choice(list("ab.@1-2+ ()9"), size=rng.integers(0, 40)))
        assert [(k, b, e) for k, b, e, ok in pii.strict_matches(text) if ok] == plain(text), text
    assert luhn_card_in_loose_grouping()


def test_personal_data_in_linear_time():
    import time

    text, seconds = "call 555-123-4567 or a.b@c.de now, ", []
    for n in (4000, 16000):
        began = time.process_time()
        found = pii.candidates(text * n)
        seconds.append(time.process_time() - began)
        assert len(found) == 2 * n
    assert seconds[1] < 8 * seconds[0] + 0.5


def test_loose_spans_stand_clear_of_strict_ones():
    rng = np.random.default_rng(9)
    for _ in range(300):
        held = sorted((int(b), int(b + n)) for b, n in zip(rng.integers(0, 60, 8), rng.integers(1, 9, rng.integers(0, 8))))
        ends = sorted(int(x) for x in rng.choice(70, 2 * rng.integers(0, 9), replace=False))
        spans = list(zip(ends[::2], ends[1::2]))
        assert pii._free(spans, held) == [s for s in spans if not any(b < s[1] and s[0] < e for b, e in held)]


def test_reliabilities_against_plain_steps():
    """Expectation-maximisation by loops over rows, and labelers of known reliability found again."""
    rng = np.random.default_rng(12)
    right = (0.95, 0.8, 0.7, 0.55)
    truth = rng.random(20000) < 0.4
    rows = Counter()
    for t in truth:
        rows[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < p) == t else -1) for p in right)] += 1
    votes, counts = np.array(list(rows)), np.array(list(rows.values()), float)
    prior, table, posterior = pii.reliabilities(votes, counts)
    own = [min(max(0.5 + 0.45 * math.tanh(sum(v)), 0.02), 0.98) for v in rows]
    for _ in range(200):
        share = (sum(p * c for p, c in zip(own, rows.values())) + 1) / (sum(rows.values()) + 2)
        chance = [[{v: (sum((p if k else 1 - p) * c for p, (w, c) in zip(own, rows.items()) if w[j] == v) + 1) for v in (-1, 0, 1)} for j in range(4)] for k in (0, 1)]
        for k in (0, 1):
            for j in range(4):
                whole = sum(chance[k][j].values())
                chance[k][j] = {v: x / whole for v, x in chance[k][j].items()}
        new = []
        for w in rows:
            a, b = (1 - share) * math.prod(chance[0][j][v] for j, v in enumerate(w)), share * math.prod(chance[1][j][v] for j, v in enumerate(w))
            new.append(b / (a + b))
        done = max(abs(x - y) for x, y in zip(new, own)) < 1e-6
        own = new
        if done:
            break
    assert prior == pytest.approx(share) and posterior == pytest.approx(np.array(own), abs=1e-6)
    assert abs(prior - 0.4) < 0.05
    for j, p in enumerate(right):
        assert abs(table[1, j, 2] / (table[1, j, 2] + table[1, j, 0]) - p) < 0.06


def test_span_classifier(spark):
    """The classifier follows the posteriors, and decides which loose spans are added."""
    patterns = [("phone", "0++++++", 50), ("phone", "0++--++", 40), ("phone", "--+00-0", 30), ("card", "+++00++", 20)]
    model = pii.fit(patterns)
    assert pii.fit(patterns[::-1]).weights.tolist() == model.weights.tolist()
    x, target = pii.features([p[0] for p in patterns], [p[1] for p in patterns]), np.zeros(4)
    for kind in ("phone", "card"):
        own = [k for k, p in enumerate(sorted(patterns)) if p[0] == kind]
        target[own] = pii.reliabilities(np.array([["-0+".index(c) - 1 for c in sorted(patterns)[k][1]] for k in own]), np.array([sorted(patterns)[k][2] for k in own], float))[2]
    x, counts = pii.features([p[0] for p in sorted(patterns)], [p[1] for p in sorted(patterns)]), np.array([p[2] for p in sorted(patterns)])
    p = 1 / (1 + np.exp(-(x @ model.weights)))
    assert np.allclose(x.T @ (counts * (target - p)), model.weights, atol=1e-5)  # the slope of the penalised likelihood is 0
    rows = [(k, ["please call 555-123-4567 today, or mail a.b@c.de", "tel (555) 123-4567 ring", "order 555 123 4567 and +1 555", "+49 30 1234567 fax", "build 1.2.3.400", None][k % 6]) for k in range(120)]
    seen = Counter((c[0], c[4]) for _, text in rows for c in pii.candidates(text))
    own, added = pii.fit([(k, v, n) for (k, v), n in seen.items()]), 0
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = pii.candidates(rows[r["doc_id"]][1])
        want = [c[:3] for c in found if c[3] or (c[4][0] == "0" and own.chance([c[0]], [c[4]])[0] >= pii.CUT)]
        assert r["spans"] == pii.joined(want)
        added += len(want) - sum(c[3] for c in found)
    assert added > 0 and not pii.candidates("x555-123-4567y") and not pii.candidates("4111/1111/1111/1112")
    assert pii.masked("please call 555-123-4567 today", "phone:12:24") == "please call <phone> today"


def luhn_card_in_loose_grouping():
    found = pii.candidates("my visa card is 4111/1111/1111/1111 ok")
    return [(c[0], c[3]) for c in found] == [("card", False)]


def test_mixing(spark, docs):
    rows = QUERIES["op4_mixing"](spark, DIR).collect()
    size = Counter()
    for d in docs.values():
        size[d["source"]] += len((d["text"] or "").encode().split())
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    targets = mixing.targets_of(dict(size), weights)
    taken = Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len((d["text"] or "").encode().split()) and r["source_size"] == size[d["source"]] and r["target"] == pytest.approx(float(targets[d["source"]])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= mixing.BLOCK_TOKENS for s in size)
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op4_mixing"](spark, DIR).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_targets_reshare_what_is_above():
    assert mixing.targets_of({"a": 1, "b": 100}, {"a": 5, "b": 2}) == {"a": 3, "b": 98}
    assert mixing.targets_of({"a": 0}, {"a": 5}) == {"a": 0} and mixing.targets_of({}, {}) == {}


def test_schedule_is_even(spark):
    rows = mixing.schedule(spark, [("a", 2560), ("b", 1024), ("c", 512)]).orderBy("slot").collect()
    seen = Counter()
    for k, r in enumerate(rows, start=1):
        assert r["rank"] == seen[r["__mx_src"]]
        seen[r["__mx_src"]] += 1
        if k <= 4096:
            assert all(abs(seen[s] - k * w / 8) <= 1 + math.log2(k + 1) for s, w in (("a", 5), ("b", 2), ("c", 1)))
    assert seen == {"a": 2560, "b": 1024, "c": 512}


def test_points_against_the_sequence():
    points = [int(f"{i:0{mixing.BITS}b}"[::-1], 2) for i in range(3000)]
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, (first, end) = int(rng.integers(0, 1000)), sorted(int(x) for x in rng.integers(0, 1 << mixing.BITS, 2))
        end += 1
        assert mixing.points_below(n, first) == sum(p < first for p in points[:n])
        inside = [i for i in range(n, 3000) if first <= points[i] < end]
        assert mixing.next_points(n, first, end, 5)[: len(inside)] == inside[:5]
    assert mixing.points_below(7, 1 << mixing.BITS) == 7 and mixing.next_points(9, 0, 1 << mixing.BITS, 3) == [9, 10, 11]


@pytest.mark.parametrize("due", [[("big", 5000), ("one", 1), ("two", 2), ("none", 0)], [(f"s{k:05}", 1 + k % 3) for k in range(5000)]])
def test_every_source_gets_its_due(spark, due):
    rows = mixing.schedule(spark, due).collect()
    ranks = defaultdict(list)
    for r in rows:
        ranks[r["__mx_src"]].append(r["rank"])
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in due if n}
    assert len({r["slot"] for r in rows}) == len(rows)


def test_a_mix_of_many_sources(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id, ' x y z') as text", "concat('s', id % 2000) as source")
    pieces, documents = mixing.mixture(docs, block_tokens=4)
    taken = {r["__mx_src"]: r["w"] for r in pieces.groupBy("__mx_src").agg({"words": "sum"}).withColumnRenamed("sum(words)", "w").collect()}
    for r in documents.select("__mx_src", "target").distinct().collect():
        assert abs(taken.get(r["__mx_src"], 0) - r["target"]) <= 4


def test_token_store(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = tokenstore.write_store(spark.read.parquet(f"{DIR}/documents.parquet"))
    got, whole, start = {r["doc_id"]: r for r in tokenstore.read_store(spark, path).collect()}, {r["doc_id"]: r["ids"] for r in tokenstore.restore(spark, path).collect()}, 0
    for i in sorted(docs):
        ids = [*t.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and whole[i] == ids
        start += len(ids)
    names = [r["name"] for r in spark.read.parquet(f"{path}/objects").filter("kind = 0").collect()]
    assert len(names) == len(set(names))


@pytest.mark.parametrize("kind", ["chunk", "recipe", "manifest", "file and manifest", "top"])
def test_a_store_that_lost_a_row_raises(spark, kind):
    docs = spark.createDataFrame([(k, f"text {k % 7} of a store " * (k % 5 + 1)) for k in range(40)] + [(99, None)], "doc_id long, text string")
    path = tokenstore.write_store(docs)
    assert tokenstore.read_store(spark, path).count() == 41

    def less(name, condition):
        df = spark.read.parquet(f"{path}/{name}")
        rows, schema = [r for r in df.collect() if not condition(r)], df.schema
        assert len(rows) < df.count()
        writer = spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite")
        (writer.partitionBy("kind") if name == "objects" else writer).parquet(f"{path}/{name}")

    if kind == "chunk":
        name = spark.read.parquet(f"{path}/objects").filter("kind = 0").first()["name"]
        less("objects", lambda r: r["kind"] == 0 and r["name"] == name)
    else:
        part = spark.read.parquet(f"{path}/manifest").agg({"part": "min"}).first()[0]
        if kind == "recipe":
            less("recipes", lambda r: r["id"] == 5)
        if "file" in kind:
            less("recipes", lambda r: r["part"] == part)
        if "manifest" in kind:
            less("manifest", lambda r: r["part"] == part)
        if kind == "top":
            less("top", lambda r: True)
    with pytest.raises(Exception, match="chunk|manifest|top"):
        tokenstore.read_store(spark, path).collect()
    if kind in ("chunk", "manifest"):
        with pytest.raises(Exception, match="chunk|manifest|top"):
            tokenstore.restore(spark, path).collect()


@pytest.mark.parametrize("text", ["", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "don't we'll", "<|endoftext|> x", "é × ü", "日本 語", "a\tb", "a\x1cb", "... ,a.b,c. 1,2.", "x" * 5000, "a. b, c"])
def test_encoder_is_the_tokenizer(text):
    own = tokenstore.encoder(tokenstore.TOKENIZER)
    ids, at = own.encode(pa.array([text, text]), 0)
    want = [*own.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert ids.tolist() == want * 2 and at.tolist() == [0, len(want), 2 * len(want)]


def test_near_duplicates(spark, docs):
    sets = {}
    for i, d in docs.items():
        w = split(d["text"])
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in QUERIES["op7_near_duplicates"](spark, DIR).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_a_large_group_of_edits(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for at in rng.choice(150, size=rng.integers(0, 9), replace=False):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    root = list(range(250))
    for a in range(250):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert [found[i] for i in range(250)] == root


def test_hot_groups_against_brute_force(spark, monkeypatch):
    """Six of ten documents in one bucket of edits that the threshold splits, three of ten without words, copies: blocks of two members."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 2)
    rng = np.random.default_rng(6)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(120):
        w = list(base)
        for at in rng.choice(60, size=rng.integers(0, 5), replace=False):
            w[at] = f"x{i % 40}_{at}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, ["", None, " "][i % 3]) for i in range(60)] + [(300 + i, rows[5][1]) for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} if (t or "").split() else set() for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == root


def test_posterior_bound():
    for n in (32, 64, 128):
        m = neardup.least_matches(n, 75, 1e-6)
        tail = lambda m: sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-6 > tail(m - 1)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 600)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if a in root and b in root and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == root
    groups = components(spark.createDataFrame(edges[:200], "a long, b long"))
    assert {r["node"]: r["component"] for r in extended(groups, spark.createDataFrame(edges[200:], "a long, b long").filter("a <> b")).collect()} == root
    assert components(df.limit(0)).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        new = [i]
        for j, y in enumerate(b, start=1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination_recall(spark):
    """Items planted with as many edits as are allowed, and fewer, against every window of every text."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of"] * 60
    items = [[str(w) for w in rng.choice(vocabulary, size=n)] for n in (3, 6, 11, 20, 32, 47)]
    texts, wanted = [], {}
    for i in range(120):
        words = [str(w) for w in rng.choice(vocabulary, size=rng.integers(0, 90))]
        k = int(rng.integers(0, len(items)))
        own = list(items[k])
        for _ in range(int(rng.integers(0, len(own) // 5 + 1))):
            at = int(rng.integers(0, len(own)))
            own[at : at + 1] = [["Q"], [], ["Q", own[at]]][int(rng.integers(0, 3))]
        at = int(rng.integers(0, len(words) + 1))
        texts.append(words[:at] + own + words[at:] if i % 4 else words)
    for i, t in enumerate(texts):
        low = [w.lower() for w in t]
        for k, item in enumerate(items):
            best = min(((_distance(item, low[s : s + len(item)]), s) for s in range(len(low))), default=(99, 0))
            if best[0] <= len(item) // 5:
                wanted[i, k] = best[0]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    for limit in (1 << 20, 200):  # one block of items, and several
        found = {(r["id"], r["item_id"]): r["distance"] for r in decontaminate.contaminations(docs, bench, index_bytes=limit).collect()}
        assert set(found) <= set(wanted) and all(found[x] >= wanted[x] for x in found)
        assert len(found) >= decontaminate.RECALL * len(wanted)


def test_items_of_one_and_two_words(spark):
    docs = spark.createDataFrame([(0, "an Answer here"), (1, "an answers"), (2, "no"), (3, "here an answer"), (None, "forty two"), (5, "forty")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "answer"), (1, "forty two"), (2, "an answer"), (3, "No"), (3, "no")], "item_id long, text string")
    found = {(r["id"], r["item_id"], r["item_words"], r["start"], r["distance"]) for r in decontaminate.contaminations(docs, bench).collect()}
    assert found == {(0, 0, 1, 1, 0), (3, 0, 1, 2, 0), (None, 1, 2, 0, 0), (0, 2, 2, 0, 0), (3, 2, 2, 1, 0), (2, 3, 1, 0, 0)}


@pytest.mark.parametrize("n", [200, 400, 800])
def test_recall_of_long_items(n):
    """As many edits as are allowed: replacements, deletions at a text's end, insertions (a window of n words loses as many)."""
    rng, k, cases = np.random.default_rng(n), n // 5, []
    for i in range(24):
        item, kind = [f"w{i}x{j}" for j in range(n)], i % 3
        own = [[w] for w in item]
        for at in rng.choice(n - 1, size=k // 2 if kind == 2 else k, replace=False):
            own[at] = [["Q"], [], [own[at][0], "Q"]][kind]
        cases.append((item, ["before"] * 30 + [w for p in own for w in p] + ([] if kind == 1 else ["after"] * 30)))
    index = decontaminate.Index([(i, " ".join(item)) for i, (item, _) in enumerate(cases)])
    found = {}
    for r, item, words, start, distance in index.search(pa.array([" ".join(t) for _, t in cases])):
        for x in zip(r.tolist(), item.tolist(), distance.tolist()):
            found[x[:2]] = min(x[2], found.get(x[:2], n))
    assert all(a == b and d <= k for (a, b), d in found.items())
    assert len(found) >= decontaminate.RECALL * len(cases)


def test_sharding(spark, docs):
    rows = QUERIES["op8_sharding"](spark, DIR).collect()
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 8, zlib.crc32(text), "rows", None)
    _whole_shards([(r["shard"], r["slot"]) for r in rows], 24)
    own = sharding.interleave(spark.read.parquet(f"{DIR}/documents.parquet"), 6, range_rows=7).collect()
    _whole_shards([(r["shard"], r["slot"]) for r in own], 6)
    share = Counter(d["source"] for d in docs.values())
    for shard in range(6):
        here = Counter(r["source"] for r in own if r["shard"] == shard)
        assert all(abs(here[s] - n / 6) <= 2 for s, n in share.items())
    # by brute force: ranks by key within the source, then the order of fractional ranks
    rest = {r["doc_id"]: r["rest"] for r in spark.read.parquet(f"{DIR}/documents.parquet").selectExpr("doc_id", "xxhash64(text, lang, n_chars) rest").collect()}
    key = lambda d: hashlib.md5(f"17:{d['doc_id']}:{rest[d['doc_id']]}".encode()).hexdigest()
    ranks = {}
    for s in share:
        for k, d in enumerate(sorted((d for d in docs.values() if d["source"] == s), key=key), start=1):
            ranks[d["doc_id"]] = ((2 * k - 1) / (2 * share[s]), f"={s}", k)
    order = sorted(ranks, key=ranks.get)
    place = {i: p for p, i in enumerate(order)}
    first = {s: min(p for i, p in place.items() if p * 6 // len(order) == s) for s in range(6)}
    assert all((r["shard"], r["slot"]) == (place[r["doc_id"]] * 6 // len(order), place[r["doc_id"]] - first[r["shard"]]) for r in own)


def _whole_shards(pairs, shards):
    slots = defaultdict(list)
    for shard, slot in pairs:
        slots[shard].append(slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_media(spark, docs):
    for r in QUERIES["op9_webp"](spark, DIR).collect():
        text = (docs[r["doc_id"]]["text"] or "").encode()
        payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = webp.encode([payload])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]
        count = Counter(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in count.values())
        contrast = sum(abs(a - b) for row in rows for a, b in zip(row, row[1:])) / (63 * len(rows))
        assert r["feature"] == f"rows={len(rows)};mean={sum(payload) / len(payload):.4f};entropy={abs(entropy):.4f};contrast={contrast:.4f}"


def test_stored_images():
    rng = np.random.default_rng(3)
    payloads = [webp.payload_of(x) for x in (b"", b"a", b"\0" * 200, b"ab" * 3000, bytes(range(256)) * 30, rng.bytes(9000), ("the quiet river " * 40 + "\n" + "naïve 日本 ").encode() * 20, bytes(rng.integers(97, 101, 700, dtype=np.uint8)))]
    payloads += [webp.payload_of(bytes(rng.choice(list(b"abc def\n"), size=n).astype(np.uint8))) for n in rng.integers(1, 20000, 30)]
    media = webp.encode(payloads)
    assert webp.read_media(media) == payloads and webp.encode(payloads[::-1])[::-1] == media  # whatever stands beside them
    for p, m in zip(payloads, media):
        assert struct.unpack_from("<I", m, 4)[0] == len(m) - 8
        frames = webp.streams_of(m)
        images = [webp.decode_streams([s])[0] for s in frames]
        assert all((i[:, :, 1] == i[:, :, 2]).all() and (i[:, :, 3] == i[:, :, 2]).all() and (i[:, :, 0] == 255).all() and i.shape[1] == 64 for i in images)
        assert len(frames) == -(-len(p) // webp.TILE) and (len(frames) == 1) == (m[12:16] == b"VP8L")
    kinds = [{step[0] for s in webp.streams_of(m) for step in webp._layout(s).steps} for m in media]
    assert kinds[0] == kinds[1] == {webp.SUBTRACT_GREEN, webp.PALETTE} and webp.SUBTRACT_GREEN in set.intersection(*kinds)
    assert len(media[3]) < 300 and len(media[6]) < len(payloads[6]) / 4  # repeats are references


def test_damaged_media_raise():
    media = webp.encode([webp.payload_of(b"some words of a text that are stored " * 30)])[0]
    for broken in (media[:-40], b"RIFF" + media[4:8] + b"WAVE" + media[12:], media[:20]):
        with pytest.raises(ValueError):
            webp.read_media([broken])
    changed = bytearray(media)
    changed[20] = 0
    with pytest.raises(ValueError):
        webp.decode(bytes(changed))


def test_references_against_plain_search():
    rng = np.random.default_rng(5)
    sizes = np.array([64, 512, 64 * 64, 128])
    flat = rng.integers(97, 100, sizes.sum(), dtype=np.uint8)
    place, n, d = webp._references(flat, sizes, np.cumsum(sizes) - sizes)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    assert len(place) and (np.diff(place) >= n[:-1]).all() and (n >= webp.MIN_MATCH).all()
    for p, k, far in zip(place.tolist(), n.tolist(), d.tolist()):
        image = np.searchsorted(edges, p, side="right") - 1
        assert edges[image] <= p - far and p + k <= edges[image + 1] and all(flat[p + i] == flat[p - far + i] for i in range(k))


def test_quality_features_of_odd_texts():
    x = quality.features_of(pa.array(["", None, "  \n", "a", "A!! b|c"]))
    assert x.shape == (5, len(quality.FEATURES)) and not x[:3].any() and np.isfinite(x).all()
    assert kneser_ney.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
