"""Queries on tables whose work goes beyond the limits of any policy: no refusal, and all that their SQL finds."""

from __future__ import annotations

import duckdb
import pytest

from tieout.plans import catalogue

#: 600 orders of one account, day and amount: over 100 000 pairs of texts alike; and one that the ledger has in another account
ALIKE = """select (2 + 4*i)::bigint o_orderkey, 1::bigint o_custkey, 'O' o_orderstatus, 1234.5::double o_totalprice, timestamp '1996-05-01' o_orderdate, '1-URGENT' o_orderpriority from range(600) r(i)
 union all select 92, 1, 'O', 99.5, timestamp '1996-05-01', '1-URGENT'"""
#: 40 orders of one account and day that match nothing: over a million combinations each way, some of which sum up; and one on its own
SUMS = """select (14 + 28*i)::bigint o_orderkey, 1::bigint o_custkey, 'O' o_orderstatus, (i+1)::double o_totalprice, timestamp '1996-05-01' o_orderdate, '1-URGENT' o_orderpriority from range(40) r(i)
 union all select 34, 1, 'O', 7.5, timestamp '1997-05-01', '1-URGENT'"""


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """A folder with ``orders`` of some SQL, and DuckDB over it."""
    def make(sql: str):
        d, c = tmp_path_factory.mktemp("orders"), duckdb.connect()
        c.sql(f"copy ({sql}) to '{d}/orders.parquet'")
        c.sql(f"create view orders as select * from '{d}/orders.parquet'")
        return str(d), c

    return make


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("" if r[k] is None else str(r[k]) for k in order) for r in rows)


def _check(spark, folder: str, duck, name: str) -> int:
    df, want = catalogue.QUERIES[name](spark, folder), duck.sql(catalogue.ORACLE_SQL[name])
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(want.columns) and found == _rows(want.columns, want.fetchall())
    return len(found)


@pytest.fixture(scope="module")
def alike(made):
    folder, duck = made(ALIKE)
    assert duck.sql(f"select count(*) from ({catalogue.ORACLE_SQL['fuzzy_candidates']})").fetchall()[0][0] > catalogue.POLICY.maximum_fuzzy_candidate_pairs
    return folder, duck


@pytest.mark.parametrize("name", ["ambiguous_fuzzy", "match_fuzzy", "fuzzy_candidates", "split_merge_budget", "cross_partition_ids", "mutations"])
def test_more_pairs_than_a_policy_allows(spark, alike, name):
    assert _check(spark, *alike, name) > 0


@pytest.fixture(scope="module")
def sums(made):
    folder, duck = made(SUMS)
    assert duck.sql(catalogue.ORACLE_SQL["split_merge_budget"]).fetchall()[0][0] > catalogue.POLICY.maximum_split_merge_evaluations
    return folder, duck


@pytest.mark.parametrize("name", ["split_merge", "exception_keys", "reconcile_summary", "comparison_rows", "exceptions_summary", "missing_rows", "report_rows", "result_state", "unexpected_rows"])
def test_more_combinations_than_a_policy_allows(spark, sums, name):
    assert _check(spark, *sums, name) > 0


@pytest.mark.parametrize("size", [2, 3, 4, 5, 6])
def test_halves_make_every_combination(spark, size):
    """Sums of up to ``size``, also of equal amounts, zeros and negative ones."""
    import itertools
    from datetime import date

    from tieout.operators.matching import split_merge

    amounts = [1, 1, 2, 3, 0, -1, -2, -4, 0, 5, 2]
    left = [("s1", 7), ("s2", -5), ("s3", 14), ("s4", 0)]
    right = [(f"c{k:02d}", a) for k, a in enumerate(amounts)]
    want = set()
    for singles, components, flip in ((left, right, False), (right, left, True)):
        for s, whole in singles:
            near = [c for c in components if whole and (c[1] > 0) == (whole > 0)]
            for k in range(2, size + 1):
                made = [sorted(x[0] for x in c) for c in itertools.combinations(near, k) if sum(x[1] for x in c) == whole]
                want |= {(tuple(m), (s,)) if flip else ((s,), tuple(m)) for m in made}
    tables = [spark.createDataFrame([(n, "A", "USD", date(2026, 1, 5), a) for n, a in side], "locator string, account string, currency string, booking_date date, amount long") for side in (left, right)]
    found = [(tuple(r[0]), tuple(r[1])) for r in split_merge(*tables, 3, size).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_equal_rows_are_one_class(spark):
    """50 000 equal rows a side make one pair of classes; they tie with each other, and what matches beside them still does."""
    from pyspark.sql import functions as F

    from tieout.model import MatchingPolicy
    from tieout.plans.reconcile import Tiers

    def side(p: str):
        n = F.col("id")
        equal = spark.range(50_000).select(F.concat(F.lit(p), n.cast("string")).alias("locator"), F.lit("same text of all").alias("description"), F.lit(500).cast("long").alias("amount"))
        own = spark.range(20).select(F.concat(F.lit(p + "x"), n.cast("string")).alias("locator"), F.concat(F.lit("own text no "), n.cast("string"), F.lit("" if p == "l" else "!")).alias("description"), (900 + n).alias("amount"))
        none = F.lit(None).cast("string")
        return equal.unionByName(own).select("locator", F.lit("A").alias("account"), F.lit("USD").alias("currency"), F.lit("1996-05-01").cast("date").alias("booking_date"), "amount", none.alias("strong_id"), none.alias("reference"), "description", none.alias("payee"), none.alias("memo"))

    tiers = Tiers(side("l"), side("r"), MatchingPolicy(), limited=False)
    assert tiers.class_pairs.count() == 21 and tiers.class_pairs.agg(F.sum(F.col("n_l") * F.col("n_r"))).first()[0] == 50_000**2 + 20
    assert sorted(r["left_locator"] for r in tiers.fuzzy.collect()) == sorted(f"lx{k}" for k in range(20))
    ties = tiers.ranks.filter("left_rank = 1 and left_ties > 1").collect()
    assert [(r["left_ties"], r["right_ties"]) for r in ties] == [(50_000, 50_000)]
