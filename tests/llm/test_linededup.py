"""Line dedup against plain code: shared lines, ties, nulls, repeated rows and ids, clashing names, both ways of joining."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tieout.llm import linededup

COMMON = [f"This line number {k} is held by many documents, whatever they say" for k in range(6)]


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, shortest=40, documents=5):
    """doc_id and text to (n_lines, n_dropped, kept text), one row each."""
    own, held = [(i, (t or "").split("\n")) for i, t in rows], defaultdict(set)
    for i, lines in own:
        for line in lines:
            if len(key(line)) >= shortest:
                held[key(line)].add(i)
    top = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, lines in own:
        kept = [x for x in lines if key(x) not in top or i is not None and i == top[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(n, seed):
    draw, rows = random.Random(seed), []
    for i in range(n):
        text = [f"own line {i} {k} with enough letters to be counted as long" for k in range(draw.randrange(4))]
        text += [draw.choice(["", "  ", "\t"]) + (c.upper() if draw.random() < 0.3 else c) + draw.choice(["", " \r", "\x0b"]) for c in COMMON if draw.random() < 0.4]
        text += ["short one"] * draw.randrange(3) + [COMMON[0]] * draw.randrange(3)
        draw.shuffle(text)
        rows.append((i, "\n".join(text)))
    return rows


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, hash string, id long").withColumn("keep", F.col("hash")).withColumn("a.b", F.col("hash")).repartition(5)
    kept = linededup.with_bitmaps(docs, linededup.written(linededup.keep_bitmaps(docs), "bitmaps"))
    got = kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(linededup.kept_text(F.col("doc.text"), F.col("keep")), 256))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_that_many_hold(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    rows = rows_of(80, 3)
    rows += [(900, None), (901, ""), (902, "\n"), (903, COMMON[1] + "\n" + "é" * 39 + "\n" + "É" * 40), (3, COMMON[2] + "\nanother text with the id of a third row, long enough"), rows[5], rows[5]]
    rows += [(None, COMMON[3] + "\nx"), (None, COMMON[3]), (5000, "\n".join(COMMON * 2000))]
    got = found(spark, rows)
    assert got == plain(rows)
    assert sum(x[2] for x in got) > 50


def test_case_beyond_ascii_and_exact_length(spark):
    line = "ÄÖÜ is not folded, but letters A to Z are"[:40]
    rows = [(i, line if i % 2 else line.upper()) for i in range(6)] + [(10 + i, line.lower()) for i in range(4)] + [(20 + i, line[:39]) for i in range(9)]
    assert found(spark, rows) == plain(rows)


def test_no_rows_and_no_long_lines(spark):
    assert found(spark, []) == []
    assert found(spark, [(i, "a\nb") for i in range(9)]) == plain([(i, "a\nb") for i in range(9)])


def test_the_hot_line_is_dealt_to_many_ranges(spark):
    """One line in every document: its runs lie in more than one range."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(COMMON[0] + "\n"), F.lit("own line of a document, long enough "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be one task
    try:
        held = linededup._held(docs, 40, "doc_id", "text").withColumn("task", F.spark_partition_id())
        spread = held.groupBy("hash").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n")).orderBy(F.desc("n")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread["n"] == 4000 and spread["tasks"] >= 2
    bitmaps = linededup.keep_bitmaps(docs)
    assert bitmaps.count() == 3999 and bitmaps.filter("id = 3999").count() == 0
