"""What is refused before anything is matched, and imports that need a choice."""

from __future__ import annotations

import io
import zipfile
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from test_engine import PERIOD, day, pair, row, source
from test_sources import _xlsx

from tieout.model import BALANCES, DECISIONS, ArithmeticOverflow, EngineError, IntegrityFailure, InvalidConfiguration, MalformedInput, Period, PeriodViolation, ResourceLimit
from tieout.operators import sums
from tieout.plans.reconcile import Job, Source, run, with_keys
from tieout.sources import bai2, delimited, mt940, qif, router, xlsx
from tieout.sources.records import Limits, Profile, Statement
from tieout.sources.router import Replay

LEFT = [row("L1", 2, 10, strong_id="T", cleared_status="x")]
RIGHT = [row("R1", 2, 10, strong_id="T", cleared_status="y")]


@pytest.mark.parametrize("second", [True, False])
def test_two_decisions_on_one_exception(spark, second):
    key = with_keys(pair(spark, LEFT, RIGHT).exceptions).first()["exception_key"]
    decided = lambda *d: spark.createDataFrame([(key, "seen", x) for x in d], DECISIONS)
    assert pair(spark, LEFT, RIGHT, decisions=decided(True)).state == "reconciledWithExplanations"
    with pytest.raises(IntegrityFailure):
        pair(spark, LEFT, RIGHT, decisions=decided(True, second))
    with pytest.raises(IntegrityFailure):
        pair(spark, LEFT, RIGHT, decisions=spark.createDataFrame([(None, "seen", True)], DECISIONS))


def test_rows_come_from_the_files_of_their_side(spark):
    mixed = [row("L1", 1, 1), row("L2", 1, 2, source_id="source-other")]
    with pytest.raises(IntegrityFailure):
        pair(spark, mixed, [])
    known = replace(source(spark, "bank", mixed), source_ids=("source-bank", "source-other"))
    run(Job("bankVsLedger", PERIOD, [known, source(spark, "ledger", [])]))
    for ids in (("source-bank",), ()):
        with pytest.raises(IntegrityFailure):
            run(Job("bankVsLedger", PERIOD, [replace(known, source_ids=ids), source(spark, "ledger", [])]))


def test_a_side_read_for_another_period(spark):
    with pytest.raises(PeriodViolation):
        run(Job("bankVsLedger", PERIOD, [replace(source(spark, "bank", []), period=Period(day(1), day(30))), source(spark, "ledger", [])]))


@pytest.mark.parametrize("changed, error", [({"account": " "}, IntegrityFailure), ({"locator": ""}, IntegrityFailure), ({"date": date(2025, 12, 31)}, PeriodViolation), ({"date": None}, PeriodViolation), ({}, None)])
def test_balances_are_looked_at(spark, changed, error):
    one = {"kind": "opening", "account": "A", "currency": "USD", "date": day(1), "amount": Decimal(0), "locator": "b"} | changed
    s = replace(source(spark, "statement", []), balances=spark.createDataFrame([tuple(one.values())], BALANCES))
    if error is None:
        run(Job("singleStatement", PERIOD, [s]))
    else:
        with pytest.raises(error):
            run(Job("singleStatement", PERIOD, [s]))


def _fold(amounts):
    """The fold as a loop over whole numbers and scales."""
    scaled = lambda x: (int(x.scaleb(6)), 6) if x else (0, 0)

    def least(x):
        n, s = scaled(x)
        while s and n % 10 == 0:
            n, s = n // 10, s - 1
        return n, s

    total = Decimal(0)
    for x in amounts:
        t = max(least(total)[1], least(x)[1])
        if any(not -(2**63) <= int(v.scaleb(t)) <= 2**63 - 1 for v in (total, x, total + x)):
            return None
        total += x
    return total


NINE = "9000000000000000000"


@pytest.mark.parametrize(
    "amounts",
    [[NINE] * 3, [NINE, "-" + NINE, NINE], [NINE, "223372036854775807"], [NINE, "223372036854775808"], ["-" + NINE, "-223372036854775808"], ["-" + NINE, "-223372036854775809"], ["900000000000000000", "0.5", "0.5"], ["1000000000000000000", "0.5"], ["9000000000000", "0.000001", "1"], ["9300000000000", "1", "0.000001"], ["0.1"] * 9],
)
def test_sums_refuse_what_64_bits_cannot_hold(spark, amounts):
    rows = [row(f"L{k}", 1 + k, x) for k, x in enumerate(amounts)]
    refused = _fold([Decimal(x) for x in amounts]) is None
    df = source(spark, "bank", rows).transactions
    assert [sums.overflowing(df, chunk=c).count() for c in (1, 2, 65536)] == [int(refused)] * 3
    assert sums.checked_sums(df, chunk=2).first()["overflows"] is refused
    if refused:
        with pytest.raises(ArithmeticOverflow):
            pair(spark, rows, [])


def test_differences_and_equations_are_sums_too(spark):
    with pytest.raises(ArithmeticOverflow):
        pair(spark, [row("L1", 1, NINE)], [row("R1", 1, "-" + NINE)])
    s = source(spark, "statement", [row("S1", 5, NINE)], [("opening", day(1), NINE), ("closing", day(31), "0")])
    with pytest.raises(ArithmeticOverflow):
        run(Job("singleStatement", PERIOD, [s]))


def test_empty_cells_take_no_default():
    with_column = b"date,amount,account,currency\n2026-01-02,1,,EUR\n"
    with pytest.raises(MalformedInput):
        router.parse(with_column, "a.csv", PERIOD)
    r = router.parse(b"date,amount\n2026-01-02,1\n", "a.csv", PERIOD, Replay(profile=Profile(currency="NOK"))).transactions[0]
    assert (r["account"], r["currency"], r["derived_fields"]) == ("Primary", "NOK", ["account", "currency"])
    assert router.plan_import(with_column, "a.csv").mapping.default_account is None
    with pytest.raises(InvalidConfiguration):
        router.plan_import(b"when,how much\n2026-01-02,1\n", "a.csv")


def test_profiles_are_bound_to_a_format():
    saved = Replay(format="csv", mapping=delimited.Mapping(1, 0, default_account="Mill", default_currency="NOK"), delimiter=",")
    assert router.plan_import(b"x,y\n1,2026-01-02\n", "a.csv", saved).mapping.account is None
    with pytest.raises(InvalidConfiguration):
        router.plan_import(b"x\ty\n", "a.tsv", saved)
    with pytest.raises(EngineError):
        router.plan_import(b"x", "a.unknown")


def _workbook(sheets=1, columns=8):
    letters, values = "ABCDEFGH", ["2026-01-04", "7.25", "Dock", "NOK", "id-9", "ref-9", "timber", "107.25"]
    cells = lambda v, n: "".join(f'<c r="{c}{n}" t="str"><v>{x}</v></c>' for c, x in zip(letters[:columns], v, strict=False))
    sheet = f'<worksheet><sheetData><row r="1">{cells(list(letters), 1)}</row><row r="2">{cells(values, 2)}</row></sheetData></worksheet>'
    names = [f"Sheet {k}" for k in range(sheets)]
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="x"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(sheets)) + "</Relationships>",
        **{f"xl/worksheets/sheet{k}.xml": sheet for k in range(sheets)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_worksheets_have_eight_columns_and_are_chosen():
    r = router.parse(_workbook(), "a.xlsx", PERIOD).transactions[0]
    assert (r["account"], r["currency"], r["strong_id"], r["reference"], r["description"], r["running_balance"]) == ("Dock", "NOK", "id-9", "ref-9", "timber", Decimal("107.25"))
    with pytest.raises(InvalidConfiguration, match="Sheet 0, Sheet 1"):
        router.parse(_workbook(2), "a.xlsx", PERIOD)
    assert router.parse(_workbook(2), "a.xlsx", PERIOD, Replay(worksheet="Sheet 1")).transactions[0]["locator"] == "sheet:Sheet 1!row:2"
    with pytest.raises(MalformedInput):
        router.parse(_workbook(columns=4), "a.xlsx", PERIOD)
    assert router.plan_import(_workbook(2), "a.xlsx", worksheet="Sheet 1", currency="CHF").mapping.default_currency == "CHF"


@pytest.mark.parametrize("at, value", [(4, b"\1\0"), (6, b"\1\0"), (8, b"\7\0"), (10, b"\xff\xff"), (12, b"\xff\xff\xff\xff"), (16, b"\xff\xff\xff\xff")])
def test_archives_of_several_disks_or_64_bits(at, value):
    whole = _xlsx('<c r="A2" s="1"><v>46036</v></c>')
    end = whole.rfind(b"PK\5\6")
    assert xlsx.worksheet_names(whole)
    with pytest.raises(EngineError):
        xlsx.worksheet_names(whole[: end + at] + value + whole[end + at + len(value) :])


def test_every_format_has_limits():
    few, short = Limits(records=1), Limits(scalars=20)
    ledger = b"!Type:Bank\nD1/2/2026\nT1\n^\nD1/3/2026\nT2\n^\n"
    profile = Profile(account="A", currency="USD")
    assert len(qif.parse(ledger, PERIOD, profile).transactions) == 2
    for limits in (few, short):
        with pytest.raises(ResourceLimit):
            qif.parse(ledger, PERIOD, profile, limits=limits)
    for parse in (mt940.parse, bai2.parse):
        with pytest.raises(ResourceLimit):
            parse(b"x" * 30, PERIOD, limits=short)
    s = Statement("source-x", PERIOD, limits=Limits(records=2, field_bytes=10))
    for n in range(2):
        s.add(locator=f"l{n}", booking_date=day(1), memo="x" * 10)
    with pytest.raises(ResourceLimit):
        s.add(locator="l3", booking_date=day(1))
    with pytest.raises(ResourceLimit):
        Statement("source-x", PERIOD, limits=Limits(field_bytes=10)).add(locator="l", booking_date=day(1), memo="é" * 6)


def test_a_source_names_its_statement(spark):
    assert Source("bank", *router.frames(spark, Statement("source-x", PERIOD))).source_ids is None
