from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
from tieout.llm import decontaminate, mixing, neardup, quality
from tieout.llm.storage import written

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, written(stage(spark, kept, DIR), f"test-{name}")
        if name != "sharding":
            assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in before.collect()}
        out = Counter(r["doc_id"] for r in kept.collect())
        assert set(out) <= ids
        if name == "quality":
            low = {r["id"] for r in quality.quality_scores(before, spark.read.parquet(f"{DIR}/labels.parquet")).collect() if r["score"] < quality.CUT}
            assert set(out) == ids - low
        elif name == "near_duplicates":
            assert set(out) == {r["doc_id"] for r in neardup.near_duplicates(before).collect() if r["kept"]}
        elif name == "decontamination":
            assert set(out) == ids - {r["id"] for r in decontaminate.contaminations(before, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
        elif name == "mixing":
            pieces, _ = mixing.mixture(before)
            words = Counter()
            sizes = {}
            for r in pieces.collect():
                words[r["id"], r["epoch"]] += r["words"]
                sizes[r["id"]] = r["size"]
            want = Counter(i for (i, _), w in words.items() if 2 * w >= sizes[i])
            assert out == want
        else:
            shards = Counter(r["shard"] for r in kept.collect())
            assert out == Counter(r["doc_id"] for r in before.collect()) and max(shards.values()) - min(shards.values() if len(shards) == 24 else [0]) <= 1
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, DIR).count() == kept.count()


ALPHABET = "abcdefghijklmnoprstuvw"


def _texts():
    """Rows (id, text, source, why) and benchmark items; every case is planted, nothing is taken from the operators."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices(ALPHABET, k=rng.randint(3, 9))) for _ in range(900)]
    sentence = lambda n: rng.choices(vocabulary, k=n)
    items = [sentence(20) for _ in range(6)]
    rows, n = [], iter(range(10_000))
    add = lambda words, why, source, i=-1: rows.append((next(n) if i == -1 else i, words if words is None or isinstance(words, str) else " ".join(words), source, why))

    def changed(words, many):
        out, step = list(words), len(words) // many
        for k in range(many):
            out[k * step + step // 2] = "changed" + rng.choice(vocabulary)
        return out

    for k in range(160):
        source = ["a", "a", "a", "b", "c", None][k % 6]
        text = sentence(rng.randint(40, 90))
        add(text, "good", source)
        add(" ".join(rng.choices(["!!!", "$$$", "|||", "1", "22", "###", "A!"], k=rng.randint(20, 80))), "bad", source)
        if k % 10 == 0:
            add(text, "copy", "b")
            add(changed(text, 1), "near", source)
            add(changed(text, 8), "far", source)
    for k, item in enumerate(items):
        for edits in (0, 3, 4, 8):
            add(sentence(25) + (changed(item, edits) if edits else item) + sentence(25), f"edits {edits}", "abc"[k % 3])
    whole = sentence(60)
    for i, text, source in ((None, whole, "a"), (None, whole, "a"), (None, sentence(50), "b"), (0, sentence(44), "b"), (None, sentence(20) + items[0] + sentence(9), "a")):
        add(text, "good", source, i)
    for text in (None, "", " \n\t", None, ""):
        add(text, "none", "a")
    rng.shuffle(rows)
    return rows, items


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _one_of_each(rows):
    """Indexes of the rows that stay: all pairs compared, the smallest id of each component, all rows without words."""
    sets, root = [_shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[top(k) if sets[k] else (k,)].append(k)
    return [min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1] or "")) for g in groups.values()]


def _within(item, text):
    """Whether some stretch of the text is at most a fifth of the item's words away from it, by edits of words."""
    words, row = (text or "").lower().split(), list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        last, row = row, [0]
        for j, x in enumerate(item, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (w != x)))
        best = min(best, row[-1])
    return best <= len(item) // 5


def _targets(sizes):
    """Shares 5, 2, 1 by order of sources, at most three times a source's size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full, open_, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set(order), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 3 * sizes[s]
            left -= full[s]
            open_.discard(s)


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, items = _texts()
    DOCS = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s, _ in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(why != "bad"), 0) for i, _, _, why in rows if i is not None and why != "none"], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # rows that share id, text and source are alike; ``seen`` counts rows
    plain = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    bad = {r[1] for r in rows if r[3] == "bad"}
    before = plain(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), f"brute-{name}")
        seen = plain(docs)
        got = Counter(seen)
        if name == "quality":
            worded = [r for r in before if (r[1] or "").split() and r[1] not in bad]
            assert Counter(r for r in seen if (r[1] or "").split()) == Counter(worded)
            assert sum(got[r] for r in got if not (r[1] or "").split()) in (0, 5)
        elif name == "near_duplicates":
            assert got == Counter(before[k] for k in _one_of_each(before)) and len(seen) < len(before)
        elif name == "decontamination":
            want = Counter(r for r in before if not any(_within(x, r[1]) for x in items))
            assert got == want and len(seen) == len(before) - 19
        elif name == "mixing":
            size = lambda r: len((r[1] or "").split())
            sums = Counter()
            for r in before:
                sums[r[2]] += size(r)
            assert set(got) <= set(before) and not any(size(r) == 0 for r in got)
            for source, target in _targets(sums).items():
                own, times = [r for r in before if r[2] == source and size(r)], target / sums[source]
                assert abs(sum(size(r) * got[r] for r in own) - target) <= 64 + max(map(size, own))
                assert {got[r] for r in own} <= {math.floor(times), math.ceil(times), round(times)}
        else:
            assert got == Counter(before)
            placed = [(r["shard"], r["slot"], r["source"]) for r in docs.collect()]
            for shard, many in Counter(p[0] for p in placed).items():
                assert sorted(p[1] for p in placed if p[0] == shard) == list(range(many)) and many in (len(placed) // 24, -(-len(placed) // 24))
            for source, many in Counter(p[2] for p in placed).items():
                assert all(abs(sum(p[0] == k and p[2] == source for p in placed) - many / 24) < 2 for k in range(24))
        before = seen
    assert Counter(plain(corpus_pipeline.run(spark, str(tmp_path)))) == Counter(before)
