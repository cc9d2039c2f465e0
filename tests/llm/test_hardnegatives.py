"""Hard negatives against all pairs in plain code: several blocks and runs of dimensions, ties, nulls, odd values, repeated rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import hardnegatives

DDL = "vec_id long, embedding array<double>, label int"


def plain(rows, low=30, high=90, positives=5, negatives=10, every=100):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(256.0 * x) for x in v])
        best[i] = min(best.get(i, one), one)
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            fits = [i for i in order if best[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(n, dimensions, seed, labels=4, spread=0.5):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 0.1) for _ in range(dimensions)] for _ in range(labels)]
    base = [draw.gauss(0.3, 0.1) for _ in range(dimensions)]
    rows = []
    for i in range(n):
        label = 0 if draw.random() < 0.4 else draw.randrange(labels)
        rows.append((i, [b + m + draw.gauss(0, 0.1) for b, m in zip(base, middle[label])], label))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, DDL).withColumn("id", F.lit("x")).withColumn("rb", F.lit(1)).withColumn("v", F.lit(None).cast("string")).withColumn("a.b", F.lit(2)).repartition(3)
    return sorted(map(tuple, hardnegatives.hard_negatives(df, **options).collect()))


@pytest.mark.parametrize("dimensions", [5, 64, 150])
def test_blocks_and_runs_of_dimensions(spark, dimensions):
    rows = vectors(900, dimensions, dimensions)
    got = found(spark, rows, block=(100, 3))
    assert got == plain(rows) and len(got) > 50


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.25, float(i % 3)], i % 2) for i in range(250)]
    rows += [(300, None, 1), (400, [0.5, None, 1.0], 1), (500, [0.5, float("nan"), 1.0], 1), (600, [0.5, float("inf"), 1.0], 0), (700, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(100, [0.5, 0.25, 2.0], 0)] * 3 + [(100, [0.25, 0.25, 9.0], 1), (800, [1.0], 0), (801, [], 1), (900, [], 7), (1000, [-1.0, -1.0, -1.0], 0), (-100, [0.5, 0.5, 0.5], 5), (-101, [0.5, 0.5, 0.25], 5)]
    got = found(spark, rows, block=(40, 2))
    assert got == plain(rows) and got


def test_windows_hold_their_edges(spark):
    """Scores of exactly 30 and 90 hundredths are inside, one less or more is outside; a positive of zero takes zeros only."""
    one = 1 / 256
    rows = [(0, [one, 0.0], 1), (1, [100 * one, 0.0], 1)] + [(10 + k, [k * one, 0.0], 2) for k in (29, 30, 31, 89, 90, 91)]
    rows += [(100, [0.0, one], 3), (101, [one, 0.0], 3), (102, [0.0, -5 * one], 4)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert {n for a, p, _, n, _, _ in got if (a, p) == (0, 1)} == {40, 41, 99, 100} | {n for a, p, _, n, _, _ in plain(rows) if (a, p) == (0, 1)}


def test_large_components_and_what_would_not_fit(spark):
    rows = [(i, [float(2**18 + i % 7), -float(i)], i % 3) for i in range(205)]
    assert found(spark, rows) == plain(rows)
    with pytest.raises(OverflowError):
        found(spark, [(0, [1e9], 1), (1, [1e9], 1)])
    wide = np.array([[2**30 + 1, 3], [5, -7]], np.int64)
    assert (hardnegatives._product(wide, wide) == np.array([[(2**30 + 1) ** 2 + 9, 5 * (2**30 + 1) - 21], [5 * (2**30 + 1) - 21, 74]])).all()


def test_nothing_to_compare(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == [] and found(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []
