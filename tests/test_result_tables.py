"""What a result's readers shuffle and write: nothing sorted twice, no column written that only orders, nothing run again for a decision."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tieout.model import IntegrityFailure, Period
from tieout.operators.numbering import numbered
from tieout.plans import catalogue, derive, reconcile

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def job(spark):
    sources = [reconcile.Source(role, catalogue._rows(spark, DIR, rows).filter("account like 'C1%'"), derive.spark_view(spark, DIR, balances).filter("account like 'C1%'")) for role, rows, balances in (("bank", "bank_rb", "balances"), ("ledger", "ledger", "other_balances"))]
    return reconcile.Job("bankVsLedger", Period(derive.START, derive.END), sources, catalogue.POLICY, limited=False)


@pytest.fixture(scope="module")
def result(job):
    return reconcile.run(job)


def test_readers_in_no_order_are_not_sorted_for(result):
    loose = result.unordered()
    for name in ("matches", "exceptions", "totals"):
        plan = getattr(loose, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan and "Join" not in plan
        assert sorted(map(str, getattr(loose, name).collect())) == sorted(map(str, getattr(result, name).collect()))


def test_every_named_row_has_its_fingerprint_once(result):
    rows = result.exceptions.select("left_locators", "right_locators", "source_fingerprints").collect()
    for r in rows:
        named = [f"L:{x}" for x in r["left_locators"]] + [f"R:{x}" for x in r["right_locators"]]
        prints = [p.rpartition(":") for p in r["source_fingerprints"]]
        assert [p[0] for p in prints] == sorted(x for x in named if x[2] in "BL") and all(len(p[2]) == 64 and p[2] == p[2].lower() for p in prints)
    assert len(rows) > 100


def test_what_only_orders_is_not_written(spark):
    df = spark.range(50).select(F.col("id"), (-F.col("id")).alias("by"), F.lit("long text").alias("more"))
    got = numbered(df, "by", "more", keep=("id",))
    assert got.columns == ["id", "seq"] and {(r["id"], r["seq"]) for r in got.collect()} == {(k, 49 - k) for k in range(50)}


def test_decisions_conclude_without_a_run(spark, job, result, monkeypatch):
    monkeypatch.setattr(reconcile, "_validated", None)
    keys = reconcile.with_keys(result.exceptions)
    told = lambda ok: keys.select("exception_key", F.lit("seen").alias("explanation"), F.lit(ok).alias("approved"))
    assert {reconcile.concluded(replace(job, decisions=d), result) for d in (None, told(True), told(False))} == {result.state}
    with pytest.raises(IntegrityFailure):
        reconcile.concluded(replace(job, decisions=told(True).unionByName(told(True))), result)
