"""The engine on small fixtures whose outcome is stated."""

from __future__ import annotations

import itertools
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql.types import StructType

from tieout.model import BALANCES, TRANSACTIONS, IntegrityFailure, InvalidConfiguration, MatchingPolicy, Period, PeriodViolation, ResourceLimit, RoleMismatch
from tieout.plans.reconcile import Job, Source, run, with_keys

PERIOD = Period(date(2026, 1, 1), date(2026, 1, 31))


def day(n: int) -> date:
    return date(2026, 1, n)


def source(spark, role: str, rows: list[dict], balances: list[tuple] = (), **more) -> Source:
    schema = StructType.fromDDL(TRANSACTIONS)
    base = {"source_id": f"source-{role}", "account": "A", "currency": "USD", "original_values": {}, "derived_fields": []}
    full = [base | {"source_ordinal": k} | r | {"amount": Decimal(r["amount"])} for k, r in enumerate(rows)]
    data = [tuple(r.get(n) for n in schema.names) for r in full]
    return Source(role, spark.createDataFrame(data, schema), spark.createDataFrame([(k, "A", "USD", d, Decimal(a), f"bal:{k}") for k, d, a in balances], BALANCES), **more)


def pair(spark, left: list[dict], right: list[dict], **options):
    return run(Job("bankVsLedger", PERIOD, [source(spark, "bank", left), source(spark, "ledger", right)], **options))


def kinds(result) -> list[str]:
    return [r["kind"] for r in result.exceptions.collect()]


def row(locator: str, n: int, amount, **more) -> dict:
    return {"locator": locator, "booking_date": day(n), "amount": amount, **more}


def test_fuzzy_match_one_day_apart(spark):
    result = pair(spark, [row("L1", 2, 10, description="ACME Invoice 123")], [row("R1", 3, 10, description="acme invoice 123")])
    assert [r["kind"] for r in result.matches.collect()] == ["fuzzy"]
    assert "dateChanged" in kinds(result)


def test_fuzzy_tie_is_never_resolved(spark):
    same = {"description": "Same text"}
    result = pair(spark, [row("L1", 2, 10, **same)], [row("R1", 2, 10, **same), row("R2", 2, 10, **same)])
    assert result.matches.count() == 0 and "ambiguousCandidate" in kinds(result) and result.state == "cannotConclude"


def test_split_is_a_candidate_and_its_rows_are_not_missing(spark):
    result = pair(spark, [row("L1", 2, 100, description="Batch")], [row("R1", 2, 60, description="one"), row("R2", 2, 40, description="two")])
    assert kinds(result) == ["possibleSplitOrMerge"]


@pytest.mark.parametrize("left,right", [([row("L1", 1, 1, strong_id="ABC")], [row("R1", 1, 1, strong_id="abc")])])
def test_strong_ids_have_case(spark, left, right):
    result = pair(spark, left, right)
    assert result.matches.count() == 0 and result.state == "differenceFound"


def test_keys_do_not_run_together(spark):
    result = pair(spark, [row("L1", 1, 1, account="A|USD", strong_id="X")], [row("R1", 1, 1, account="A", strong_id="USD|X")])
    assert result.matches.count() == 0 and result.state == "differenceFound"


def test_balances_alone_prove(spark):
    job = Job("singleStatement", PERIOD, [source(spark, "statement", [], [("opening", day(1), 100), ("closing", day(31), 100)])])
    result = run(job)
    assert result.state == "reconciled" and kinds(result) == []


def test_no_balances_is_inconclusive(spark):
    assert run(Job("singleStatement", PERIOD, [source(spark, "statement", [])])).state == "cannotConclude"


def test_running_balance_breaks_once_and_anchors_again(spark):
    rows = [row("a", 1, 10, running_balance=Decimal(110)), row("b", 1, 5), row("c", 1, 2, running_balance=Decimal(999)), row("d", 2, 1, running_balance=Decimal(1000))]
    result = run(Job("singleStatement", PERIOD, [source(spark, "statement", rows, [("opening", day(1), 100), ("closing", day(31), 118)])]))
    found = [r for r in result.exceptions.collect() if r["kind"] == "runningBalanceBreak"]
    assert len(found) == 1 and found[0]["left_locators"] == ["a", "b", "c"] and result.state == "differenceFound"


def test_two_openings_mean_none(spark):
    rows = [row("a", 1, 10, running_balance=Decimal(500))]
    balances = [("opening", day(1), 100), ("closing", day(31), 110)]
    s = source(spark, "statement", rows, balances)
    s.balances = s.balances.unionByName(spark.createDataFrame([("opening", "A", "USD", day(1), Decimal(1), "other")], BALANCES))
    assert kinds(run(Job("singleStatement", PERIOD, [s]))) == ["periodGapOrOverlap"]


def test_explained_differences_need_closing_arithmetic(spark):
    left, right = [row("L1", 2, 10, strong_id="T", cleared_status="a")], [row("R1", 2, 10, strong_id="T", cleared_status="b")]
    keys = [r["exception_key"] for r in with_keys(pair(spark, left, right).exceptions).collect()]
    decisions = spark.createDataFrame([(k, "checked", True) for k in keys], "exception_key string, explanation string, approved boolean")
    assert pair(spark, left, right, decisions=decisions).state == "reconciledWithExplanations"
    blank = spark.createDataFrame([(k, " ", True) for k in keys], "exception_key string, explanation string, approved boolean")
    assert pair(spark, left, right, decisions=blank).state == "differenceFound"


def test_approvals_do_not_close_a_broken_balance(spark):
    rows = [row("a", 1, 10, running_balance=Decimal(999), strong_id="T")]
    def job(decisions=None):
        left = source(spark, "bank", rows, [("opening", day(1), 100), ("closing", day(31), 110)])
        right = source(spark, "ledger", [row("b", 1, 10, strong_id="T")], [("opening", day(1), 100), ("closing", day(31), 110)])
        return run(Job("bankVsLedger", PERIOD, [left, right], decisions=decisions))

    first = job()
    keys = [r["exception_key"] for r in with_keys(first.exceptions).collect()]
    assert kinds(first) == ["runningBalanceBreak"] and first.exceptions.first()["detail"] == "A|USD: expected 110, found 999"
    assert job(spark.createDataFrame([(k, "seen", True) for k in keys], "exception_key string, explanation string, approved boolean")).state == "differenceFound"


def test_details_tell_lengths_and_amounts(spark):
    result = pair(spark, [row("L1", 2, "10.50", strong_id="Té", reference="r")], [row("R1", 2, 10, strong_id="Té", reference="r"), row("R2", 3, 10, strong_id="Té", reference="r")])
    told = {r["kind"]: r["detail"] for r in result.exceptions.collect()}
    assert told["ambiguousCandidate"] == "Strong identifier has multiple candidates: A|USD strong-id[3]" and told["duplicateInRight"] == "Repeated identity: A|USD strong-id[3]"
    changed = pair(spark, [row("L1", 2, "10.50", strong_id="T")], [row("R1", 2, 10, strong_id="T")]).exceptions.collect()
    assert [(r["kind"], r["detail"]) for r in changed] == [("amountChanged", "10.5 \u2192 10")]


def test_refusals(spark):
    with pytest.raises(RoleMismatch):
        run(Job("singleStatement", PERIOD, [source(spark, "bank", []), source(spark, "ledger", [])]))
    with pytest.raises(IntegrityFailure):
        pair(spark, [row("L1", 1, 1), row("L1", 1, 1)], [])
    with pytest.raises(PeriodViolation):
        pair(spark, [{**row("L1", 1, 1), "booking_date": date(2026, 2, 1)}], [])
    with pytest.raises(InvalidConfiguration):
        MatchingPolicy(maximum_date_distance_days=32)
    same = {"description": "Same text"}
    with pytest.raises(ResourceLimit):
        pair(spark, [row("L1", 2, 10, **same), row("L2", 2, 10, **same)], [row("R1", 2, 10, **same), row("R2", 2, 10, **same)], policy=MatchingPolicy(maximum_fuzzy_candidate_pairs=3))


def test_splits_against_brute_force_and_order(spark):
    rng = random.Random(5)
    from tieout.operators.matching import split_merge, split_merge_evaluations

    def side(p: str, n: int):
        return [(f"{p}{k}", "A", "USD", day(rng.randint(1, 6)), rng.choice([-5, -3, -2, 0, 1, 2, 3, 4, 6, 9])) for k in range(n)]

    left, right = side("l", 7), side("r", 9)
    expected, work = set(), 0
    for singles, components, flip in ((left, right, False), (right, left, True)):
        for s in singles:
            if not s[4]:
                continue
            near = [c for c in components if (c[4] > 0) == (s[4] > 0) and abs((c[3] - s[3]).days) <= 3]
            for size in (2, 3, 4):
                for combo in itertools.combinations(near, size):
                    work += 1
                    if sum(c[4] for c in combo) == s[4]:
                        many = ",".join(sorted(c[0] for c in combo))
                        expected.add((many, s[0]) if flip else (s[0], many))
    ddl = "locator string, account string, currency string, booking_date date, amount long"
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)
    found = {(",".join(r[0]), ",".join(r[1])) for r in split_merge(a.repartition(3), b, 3, 4).collect()}
    assert found == expected
    assert split_merge_evaluations(a, b, 3, 4).first()[0] == work


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(8)
    from pyspark.sql import functions as F

    from tieout.functions.columns import similarity_permille
    from tieout.operators.matching import fuzzy_candidates

    def side(p: str):
        return [(f"{p}{k}", "A", "USD", day(rng.randint(1, 12)), rng.choice([5, 7]), rng.choice([None, "x", "y"]), rng.choice([None, "order 1", "order 12", "ordre 1", "other"])) for k in range(25)]

    left, right = side("l"), side("r")
    ddl = "locator string, account string, currency string, booking_date date, amount long, strong_id string, text string"
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)
    got = {(r[0], r[1], r[2], r[3]) for r in fuzzy_candidates(a, b, 3, 700).collect()}
    texts = spark.createDataFrame([(x, y) for x in {r[6] for r in left} - {None} for y in {r[6] for r in right} - {None}], "x string, y string")
    like = {(r[0], r[1]): r[2] for r in texts.select("x", "y", similarity_permille(F.col("x"), F.col("y"))).collect()}
    want = {(p[0], q[0], like[p[6], q[6]], abs((p[3] - q[3]).days)) for p in left for q in right if p[4] == q[4] and abs((p[3] - q[3]).days) <= 3 and (p[5] is None or q[5] is None or p[5] == q[5]) and p[6] and q[6] and like[p[6], q[6]] >= 700}
    assert got == want


def test_manual_match_must_still_hold(spark):
    from tieout.functions.columns import fingerprint
    from tieout.plans.reconcile import ROW

    left, right = [row("L1", 2, 10)], [row("R1", 9, 10)]
    prints = [s.transactions.select(fingerprint({n: s.transactions[n] for n in ROW})).first()[0] for s in (source(spark, "bank", left), source(spark, "ledger", right))]
    ddl = "left_locator string, right_locator string, left_fingerprint string, right_fingerprint string"
    good = spark.createDataFrame([("L1", "R1", *prints)], ddl)
    assert [r["kind"] for r in pair(spark, left, right, manual_matches=good).matches.collect()] == ["manual"]
    with pytest.raises(IntegrityFailure):
        pair(spark, left, right, manual_matches=spark.createDataFrame([("L1", "R1", prints[0], "old")], ddl))
