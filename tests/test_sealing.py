"""Canonical rows, seals, comparison of tables, ordered reports: against plain code, under any partitioning."""

from __future__ import annotations

import hashlib
import json
import random
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_engine import pair, row

from tieout import report
from tieout.evidence import File, canonical, differences, lock, result_seal, result_value, stored_result, verify
from tieout.functions.canonical import canonical_row
from tieout.model import DECISIONS, IntegrityFailure, InvalidConfiguration, Period
from tieout.operators import sealing
from tieout.operators.numbering import numbered
from tieout.plans.reconcile import run, with_keys

TEXTS = ["", "plain", 'q"u\\o\te', "\x00\x01\x1f\x7f", "é 日本\U0001f600", "\r\n\b\f/", None]


def test_canonical_columns_are_the_plain_encoders(spark):
    draw = random.Random(1)
    amounts = [Decimal(x) for x in ("0", "-0.000001", "12.50", "100", "9223372036854775807", "-9223372036854.775807", "0.1", "-10")] + [None]
    rows = [
        (n, draw.choice(TEXTS), draw.choice(amounts), draw.choice([date(2026, 1, 2), date(1, 1, 1), None]), draw.choice([True, False, None]), draw.choice([None, [], [draw.choice(TEXTS), None]]), draw.choice([None, {}, {x or "": draw.choice(TEXTS) for x in TEXTS[:4]}]), draw.choice([None, (draw.choice(TEXTS), draw.choice(amounts))]))
        for n in range(80)
    ]
    df = spark.createDataFrame(rows, "n long, text string, amount decimal(25,6), day date, yes boolean, list array<string>, map map<string,string>, nested struct<b string, A decimal(25,6)>")
    got = {r["n"]: r["c"] for r in df.select("n", canonical_row(df).alias("c")).collect()}
    names = df.columns
    for r in rows:
        value = dict(zip(names, r, strict=True))
        value["nested"] = value["nested"] and dict(zip(("b", "A"), value["nested"], strict=True))
        assert got[r[0]] == canonical(value)
        json.loads(got[r[0]])
    with pytest.raises(InvalidConfiguration):
        canonical_row(spark.createDataFrame([(1.5,)], "x double"))


@pytest.mark.parametrize("rows, parts", [(0, 3), (1, 1), (500, 1), (500, 7)])
def test_numbers_without_holes(spark, rows, parts):
    df = spark.range(rows).select((F.col("id") * 7919 % 1009).alias("a"), F.col("id").alias("b")).repartition(parts)
    got = numbered(df, "a", "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["seq"])] == sorted((i * 7919 % 1009, i) for i in range(rows))
    assert sorted(r["seq"] for r in got) == list(range(rows))


def _plain_seal(rows: list[dict], key, fanout: int) -> tuple[int, str]:
    level = [hashlib.sha256(canonical(r).encode()).hexdigest() for r in sorted(rows, key=key)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + fanout]).encode()).hexdigest() for k in range(0, len(level), fanout)]
    return len(rows), level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("rows", [0, 1, 4, 5, 64, 300])
def test_seals_follow_from_the_rows_alone(spark, rows):
    data = [{"k": f"k{n % 97:03d}", "v": n // 97, "amount": Decimal(n) / 4} for n in range(rows)]
    df = spark.createDataFrame([tuple(r.values()) for r in data], "k string, v long, amount decimal(25,6)")
    wanted = _plain_seal(data, lambda r: (r["k"], r["v"]), 4)
    assert {sealing.seal(df.repartition(p), "k", "v", fanout=4) for p in (1, 6)} == {wanted}
    if rows > 4:
        changed = df.withColumn("v", F.when(F.col("k") == "k003", F.col("v") + 1).otherwise(F.col("v")))
        assert sealing.seal(changed, "k", "v", fanout=4)[1] != wanted[1]


def test_tables_are_compared_by_key(spark):
    draw = random.Random(4)
    old = [(f"k{n}", n % 5, draw.choice(TEXTS)) for n in range(400)] + [(None, 1, "x"), ("many", 1, "a"), ("many", 1, "a"), ("many", 2, "b"), ("same", 1, "a"), ("same", 1, "a")]
    new = [(k, g, t if draw.random() > 0.03 else "other") for k, g, t in old if draw.random() > 0.03] + [("fresh", 0, None), ("many", 1, "a"), (None, 2, "y")]
    draw.shuffle(new)
    held = [{}, {}]
    for side, rows in zip(held, (old, new), strict=True):
        for k, g, t in rows:
            side.setdefault((k, g), []).append(str(t) + str(t is None))
    want = {(canonical({"k": k[0], "g": k[1]}), "added" if k not in held[0] else "removed" if k not in held[1] else "changed") for k in held[0] | held[1] if sorted(held[0].get(k, [])) != sorted(held[1].get(k, []))}
    left, right = (spark.createDataFrame(r, "k string, g int, t string") for r in (old, new))
    for bucket in (1, 10, 1000):
        got = sealing.verify_tables(left, right.select("t", "g", "k"), ["k", "g"], bucket=bucket).collect()
        assert {(r["key"], r["change"]) for r in got} == want and len(got) == len(want)
    assert sealing.verify_tables(left, left.repartition(5), ["k", "g"]).count() == 0
    assert sealing.verify_tables(left.limit(0), left.limit(0), ["k", "g"]).count() == 0
    assert {r["change"] for r in sealing.verify_tables(left, left.limit(0), ["k", "g"]).collect()} == {"removed"}


FILES = [
    File("bank", "bank.csv", b"date,amount,account,currency,id,description\n2026-01-02,12.50,A,USD,t1,Rope\n2026-01-03,-3,A,USD,t2,Tar\n2026-01-05,8,A,USD,,Sail\n"),
    File("ledger", "ledger.csv", b"date,amount,account,currency,id,description\n2026-01-02,12.5,A,USD,t1,Rope\n2026-01-04,-3,A,USD,t2,Tar\n"),
]
PERIOD = Period(date(2026, 1, 1), date(2026, 1, 31))


def test_a_lock_with_tables_holds_no_rows(spark, tmp_path):
    kept = str(tmp_path / "kept")
    evidence = lock(spark, "bankVsLedger", PERIOD, FILES, "2026-02-01T00:00:00Z", tables=kept)
    parts = evidence["manifest"]["result"]["parts"]
    assert {k: v["rows"] for k, v in parts.items()} == {"matches": 2, "exceptions": 2, "totals": 1} and "matches" not in evidence["manifest"]["result"]
    verify(spark, evidence, FILES, tables=kept)
    plain = lock(spark, "bankVsLedger", PERIOD, FILES, "2026-02-01T00:00:00Z")
    verify(spark, plain, tables=kept)
    rows = plain["manifest"]["result"]
    assert rows["totals"][0]["left"] == {"canonical": "17.5", "mantissa": 175, "scale": 1}
    stored = stored_result(spark, rows["state"], kept)
    assert result_value(stored) == rows and result_seal(stored)["parts"] == parts
    other = str(tmp_path / "other")
    for name in ("exceptions", "totals"):
        spark.read.parquet(f"{kept}/{name}").write.parquet(f"{other}/{name}")
    spark.read.parquet(f"{kept}/matches").withColumn("kind", F.lit("manual")).write.parquet(f"{other}/matches")
    with pytest.raises(IntegrityFailure, match="matches .*changed"):
        verify(spark, evidence, tables=other)
    assert {(r["part"], r["change"]) for r in differences(stored, stored_result(spark, "", other)).collect()} == {("matches", "changed")}


def test_reports_of_tables_read_in_order(spark, tmp_path):
    left = [row(f"L{n:02d}", 1 + n % 28, n, strong_id=f"T{n}", description=f'text "{n}"') for n in range(30)]
    right = [row(f"R{n:02d}", 1 + n % 28, n, strong_id=f"T{n}", description=f'text "{n}"', cleared_status="x" if n % 3 else None) for n in range(25)]
    result = pair(spark, left, right)
    keyed = with_keys(result.exceptions)
    decided = keyed.filter("kind = 'statusOrCategoryChanged'").select("exception_key", F.lit("seen").alias("explanation"), F.col("left_locators")[0].endswith("1").alias("approved"))
    lines = report.report_table(spark, result, 'The "Mill"', {"job": "j", "mode": "bankVsLedger"}, [{"role": "bank", "filename": "b.csv", "details": "x"}], decided)
    got = sorted(lines.collect())
    assert [r["seq"] for r in got] == list(range(len(got)))
    sections = [r["section"] for r in got]
    assert list(dict.fromkeys(sections)) == list(report._SECTIONS) and sections.count("match") == 25 and sections.count("decision") == decided.count() > 5
    assert got[0]["line"] == ",".join(f'"{c}"' for c in report.CELLS) and '"The ""Mill"""' in got[1]["line"]
    value, q = result_value(result), report.quoted
    plain = [",".join(q(x) for x in ("match", m["kind"], "", "", m["left_locator"], m["right_locator"], "", "")) for m in value["matches"]]
    plain += [",".join(q(x) for x in ("exception", e["kind"], "", "", " | ".join(e["left_locators"]), " | ".join(e["right_locators"]), "", e["detail"])) for e in value["exceptions"]]
    assert [r["line"] for r in got if r["section"] in ("match", "exception")] == plain
    report.write_report(lines, str(tmp_path / "report"))
    text = b"".join(f.read_bytes() for f in sorted(Path(tmp_path / "report").glob("part-*")))
    assert text.decode() == "".join(r["line"] + "\r\n" for r in got)
    with_decision = report.explained(result.exceptions, decided)
    assert with_decision.filter("explanation is not null").count() == decided.count() and with_decision.count() == result.exceptions.count()


def test_kinds_do_not_need_fingerprints(spark):
    from tieout.plans.reconcile import Job

    from test_engine import source

    job = Job("bankVsLedger", PERIOD, [source(spark, "bank", [row("L1", 1, 5, strong_id="T"), row("L2", 2, 7)]), source(spark, "ledger", [row("R1", 2, 5, strong_id="T")])])
    whole, slim = run(job), run(job, bound=False)
    kinds = lambda r: sorted((x["kind"], x["left_locators"], x["detail"]) for x in r.exceptions.collect())
    assert kinds(whole) == kinds(slim) and whole.state == slim.state and "source_fingerprints" not in slim.exceptions.columns
    decided = spark.createDataFrame([("none", "x", True)], DECISIONS)
    from dataclasses import replace

    assert "source_fingerprints" in run(replace(job, decisions=decided), bound=False).exceptions.columns
