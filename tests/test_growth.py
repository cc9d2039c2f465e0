"""Steps whose work must grow no faster than their tables: what they write, shuffle and tell, beside the results that a plain way gives."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tieout.functions import columns as C
from tieout.model import IntegrityFailure, MatchingPolicy
from tieout.operators import checks, matching
from tieout.plans import reconcile

SIDE = "locator string, account string, currency string, booking_date date, value_date date, amount long, strong_id string, reference string, description string, payee string, memo string, transaction_code string, cleared_status string, category string"


def side(spark, rows):
    """Rows of (locator, day, amount, strong id, reference, description)."""
    made = [(n, "A", "USD", date(2026, 1, 1) + timedelta(d), None, a, s, r, t, None, None, None, None, None) for n, d, a, s, r, t in rows]
    return spark.createDataFrame(made, SIDE)



@pytest.fixture()
def written(monkeypatch):
    """The tables that a step writes, by name."""
    found, plain = [], reconcile.cut

    def noted(df, name):
        out = plain(df, name)
        found.append((name, out))
        return out

    monkeypatch.setattr(reconcile, "cut", noted)
    return found


def test_a_trim_of_all_white_space(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{chr(c)}a{chr(c)} b{chr(c)}",) for c in points] + [("",), (" 　\n",), (None,)], "t string")
    plain = F.nullif(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""), F.lit(""))
    assert not df.filter(~C.cleaned(F.col("t")).eqNullSafe(plain)).collect()


def test_texts_are_told_once(spark):
    left, right = (side(spark, [(f"{p}{k}", k, 5, None, None, t) for k, t in enumerate(["Order no 1", "  ", "Crème 2"])]) for p in "lr")
    tiers = reconcile.Tiers(left, right, MatchingPolicy())
    told = tiers.texts[0]
    assert sorted((r["locator"], r["text"]) for r in told.collect()) == [("l0", "order no 1"), ("l1", None), ("l2", "creme 2")]
    for df in (matching.text_classes(told), tiers.members[0]):
        assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_no_tier_could_take_are_not_written_by_it(spark, written):
    rows = lambda p: [(f"{p}s{k}", 0, 1, f"T{k}", None, "x") for k in range(3)] + [(f"{p}r{k}", 0, k, " ", f"R{k}", "x") for k in range(3)] + [(f"{p}n{k}", 0, k, None, "", f"text {k}") for k in range(9)]
    tiers = reconcile.Tiers(side(spark, [*rows("l"), ("lx", 0, 7, "own", None, "x")]), side(spark, rows("r")), MatchingPolicy())
    assert [df.count() for df in tiers.rest2] == [10, 9]
    counts = {name: df.count() for name, df in written}
    assert (counts["rest1-left"], counts["rest1-right"], counts["rest2-left"], counts["rest2-right"]) == (1, 0, 0, 0)


def test_pairs_near_in_time_whatever_their_bucket(spark):
    days = list(range(0, 70, 1))
    left, right = (side(spark, [(f"{p}{d:02d}", d, 5, None, None, "same text") for d in days]).withColumn("text", F.col("description")) for p in "lr")
    found = {(r["left_locator"], r["right_locator"]) for r in matching.fuzzy_candidates(left, right, 3, 850).collect()}
    assert found == {(f"l{a:02d}", f"r{b:02d}") for a in days for b in days if abs(a - b) <= 3}


@pytest.mark.parametrize("walk", [0, 40, 10_000])
def test_breaks_of_short_and_long_partitions(spark, walk):
    rng, rows, want = random.Random(5), [], set()
    for account, n in (("A", 12), ("B", 60), ("C", 1), ("D", 30)):
        total, held, since = 100, None, []
        for k in range(n):
            amount = rng.randrange(-50, 50)
            total += amount
            shown = None if rng.random() < 0.6 or account == "D" else total + rng.choice([0, 0, 3])
            rows.append((f"{account}{k:03d}", account, "USD", date(2026, 1, 1 + k // 4), k, amount, shown))
            since.append(f"{account}{k:03d}")
            if shown is not None:
                if shown != total:
                    want.add((since[-1], total, shown, tuple([held or f"O{account}", *since])))
                total, held, since = shown, since[-1], []
    df = spark.createDataFrame(rows, "locator string, account string, currency string, booking_date date, source_ordinal long, amount long, running_balance long").repartition(3)
    balances = spark.createDataFrame([("opening", a, "USD", date(2026, 1, 1), 100, f"O{a}") for a in "ABCD"], "kind string, account string, currency string, date date, amount long, locator string")
    found = [(r["locator"], r["expected"], r["found"], tuple(r["locators"])) for r in checks.running_balance_breaks(df, balances, walk=walk).collect()]
    assert want and len(found) == len(set(found)) and set(found) == want


def test_short_partitions_shuffle_their_rows_once(spark):
    rows = spark.range(1000).selectExpr("'l'||id locator", "'A'||(id%50) account", "'C'||(id%2) currency", "date'2026-01-01' booking_date", "id source_ordinal", "id amount", "id running_balance")
    balances = spark.createDataFrame([], "kind string, account string, currency string, date date, amount long, locator string")
    plan = checks.running_balance_breaks(rows, balances)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_repeated_rows_and_no_others(spark):
    rows = [("a", 0, 1, "T", None, "x"), ("b", 3, 9, " T", "r", "y"), ("c", 0, 1, None, "r", "x"), ("d", 0, 1, " ", "r ", "x"), ("e", 0, 1, None, None, "x"), ("f", 0, 1, None, "x", None), ("g", 1, 1, None, "r", "x")]
    found = [(r["n"], r["locators"]) for r in checks.duplicates(side(spark, rows)).collect()]
    assert sorted(found) == [(2, ["a", "b"]), (2, ["c", "d"])]


@pytest.mark.parametrize("pairs", [[("l0", "r0", "strongID"), ("l0", "r1", "strongID")], [("l0", "r0", "strongID"), ("l1", "r0", "strongID")], [("l0", "gone", "strongID")], [("l0", "r1", "fuzzy")]])
def test_matches_that_do_not_hold_are_refused(spark, pairs):
    tiers = reconcile.Tiers(*(side(spark, [(f"{p}{k}", 0, k, None, None, "x") for k in range(2)]) for p in "lr"), MatchingPolicy())
    tiers.__dict__["matches"] = spark.createDataFrame(pairs, "left_locator string, right_locator string, kind string")
    with pytest.raises(IntegrityFailure):
        tiers.checked  # noqa: B018


def test_a_run_makes_each_tier_once(spark, written, tmp_path):
    from test_whole_jobs import SUMS

    import duckdb

    from tieout.plans import catalogue

    duckdb.connect().sql(f"copy ({SUMS}) to '{tmp_path}/orders.parquet'")
    assert catalogue.QUERIES["exceptions_summary"](spark, str(tmp_path)).count() > 0
    names = [name for name, _ in written]
    assert "classes-left" in names and len(names) == len(set(names))


def test_digests_of_keys_travel_as_bytes(spark):
    from tieout.operators import sealing

    df = spark.createDataFrame([(k % 5, f"t{k}") for k in range(12)], "k long, t string")
    keyed = sealing._keyed(df, ["k"], 2)
    assert dict(keyed.dtypes)["row"] == "binary"
    assert sealing.verify_tables(df, df.repartition(3), ["k"]).count() == 0
    changed = df.withColumn("t", F.when(F.col("t") == "t3", "x").otherwise(F.col("t"))).filter("k <> 4")
    assert sorted((r["key"], r["change"]) for r in sealing.verify_tables(df, changed, ["k"], bucket=1).collect()) == [('{"k":3}', "changed"), ('{"k":4}', "removed")]


def test_exports_are_compared_without_a_join_of_orders_with_themselves(spark, monkeypatch):
    from tieout.operators import sealing
    from tieout.plans import catalogue

    seen = []
    monkeypatch.setattr(sealing, "verify_tables", lambda left, right, keys, **more: seen.extend([left, right]) or left)
    catalogue.QUERIES["verify_tables"](spark, "/root/testdata/sf0.001")
    assert seen and not any("Join" in df._jdf.queryExecution().executedPlan().toString() for df in seen)
