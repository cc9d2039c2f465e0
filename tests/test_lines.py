"""Line formats as Spark jobs against the parsers of whole files and against loops, for chunks of any width."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tieout.model import EngineError, ResourceLimit
from tieout.operators.carry import along
from tieout.sources import lines as L
from tieout.sources import mt940
from tieout.sources.bai2 import _summaries
from tieout.sources.bai2 import records as plain_records
from tieout.sources.delimited import tokenize
from tieout.sources.records import Limits


def table(spark, texts: dict[str, str]):
    rows = [(f, n, line) for f, t in texts.items() for n, line in enumerate(t.split("\n")[: -1 if t.endswith("\n") else None])]
    return spark.createDataFrame(rows, "file string, line long, text string").repartition(5)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_sums_and_last_values_along(spark, chunk):
    draw = random.Random(chunk)
    rows = [(f, n * 7, draw.choice([None, 1, 2]), draw.choice([None, None, "x", "y"])) for f in ("a", "b") for n in range(40)]
    got = {(r["f"], r["at"]): (r["sum"], r["seen"]) for r in along(spark.createDataFrame(rows, "f string, at long, v int, t string").repartition(4), ["f"], "at", sums={"sum": F.coalesce("v", F.lit(0))}, last={"seen": F.col("t")}, chunk=chunk).collect()}
    state = defaultdict(lambda: (0, None))
    for f, at, v, t in rows:
        state[f] = (state[f][0] + (v or 0), t or state[f][1])
        assert got[f, at] == state[f]


def _random_csv(draw) -> str:
    cell = lambda: draw.choice(["", "a", "é x", '""', '"q""r"', '"two\nlines"', '"a\r\nb,c"', '"\r"', "1.5"])
    return "".join(",".join(cell() for _ in range(draw.randrange(1, 4))) + draw.choice(["\n", "\n", "\r\n", "\r", "\n\n"]) for _ in range(draw.randrange(1, 25)))


@pytest.mark.parametrize("seed", range(4))
def test_delimited_text_over_many_tasks(spark, seed):
    draw = random.Random(seed)
    texts = {f"f{n}": _random_csv(draw) for n in range(6)}
    for chunk in (2, 1 << 16):
        got = sorted(L.delimited_records(table(spark, texts), chunk=chunk).collect(), key=lambda r: (r["file"], r["line"], r["part"]))
        assert [(r["file"], r["first"], r["cells"]) for r in got] == [(f, first, cells) for f in sorted(texts) for first, cells in tokenize(texts[f] if texts[f].endswith("\n") else texts[f] + "\n", ",")]


def test_files_are_read_where_they_are_split(spark, tmp_path):
    draw = random.Random(9)
    texts = {}
    for n in range(3):
        texts[f"f{n}.csv"] = "".join(f'{k},"{draw.choice(["x", "y" * 50])}\n{k}",{draw.randrange(99)}\n' for k in range(300))
        (tmp_path / f"f{n}.csv").write_text(texts[f"f{n}.csv"], newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = L.read_lines(spark, str(tmp_path))
        got = sorted(L.delimited_records(lines, chunk=64).collect(), key=lambda r: (r["file"], r["line"], r["part"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["file"].rpartition("/")[2], r["first"], r["cells"]) for r in got] == [(f, first, cells) for f in sorted(texts) for first, cells in tokenize(texts[f], ",")]


@pytest.mark.parametrize("text", ['a,b"c\nd,e\n', 'a,"b"c\n', 'a,b\n"never closed\nmore\n'])
def test_faults_are_refused(spark, text):
    with pytest.raises(EngineError):
        list(tokenize(text, ","))
    with pytest.raises(Exception, match="MalformedInput"):
        L.delimited_records(table(spark, {"f": "x,y\n" * 5 + text})).collect()
    with pytest.raises(ResourceLimit):
        L.delimited_records(table(spark, {"f": '"' + "x\n" * 100}), limits=Limits(columns=1, field_bytes=20))


def test_statements_are_the_parsers(spark):
    text = "{1:F01}\n:20:A\n:25:acc\n:28C:1\n:60F:C260101EUR1,\n:61:2601020102C5,NTRFref//id\nsecond line\n:86:note\nmore\n\n:61:2601030103D5,NTRFx\n:62F:C260131EUR1,\n-}\n:20:B\n:25:acc\n:60F:C260101EUR1,\n:86:of nothing\n:60M:C260101EUR1,\n:62F:C260131EUR1,\n-\n"
    for chunk in (1, 4, 1000):
        fields = L.tagged_fields(table(spark, {"a": text, "b": "stray\n" + text}), chunk=chunk)
        got = [(r["tag"], r["value"]) for r in sorted(fields.filter("file = 'a'").collect(), key=lambda r: r["field"])]
        assert got == mt940.tagged(text)
        segments = {(r["file"], r["segment"]): (r["account"], r["entries"], r["noted"], r["problems"]) for r in L.statement_segments(fields).collect()}
        assert segments == {("b", 0): (None, 0, 0, ["before"]), **{(f, 1): ("acc", 2, 1, []) for f in "ab"}, **{(f, 2): ("acc", 0, 0, ["28C", "60"]) for f in "ab"}}


BAI = "01,S,R,260101,0,1,80,,2/\n02,R,O,1,260102,,USD,2/\n03,K1,,015,250,,,100,5,,D,2,0,5,1,7,190,3,,S,1,2,3,191,4,,V,260101,1/\n16,195,250,Z,x\n88,and more/\n16,890,1,/\n49,513,5/\n98,513,1,7/\n99,513,1,9/\n"


def test_nested_records_are_the_parsers(spark):
    for chunk in (1, 5, 1000):
        records = L.nested_records(table(spark, {"a": BAI}), chunk=chunk)
        got = sorted(records.collect(), key=lambda r: r["record"])
        assert [(r["fields"], r["physical"]) for r in got] == plain_records(BAI) and not any(r["problem"] for r in got)
    three = records.filter("kind = '03'").select(L.summary_amounts(F.col("fields"), F.lit("USD")).alias("s"))
    assert [(x["code"], x["amount"]) for x in three.first()["s"]] == _summaries(plain_records(BAI)[2][0], "USD")
    totals = {r["level"]: r for r in L.control_totals(records).collect()}
    assert {k: (int(r["total"] * 100), r["physical"], r["children"], r["agree"]) for k, r in totals.items()} == {"account": (513, 5, None, True), "group": (513, 7, 1, True), "file": (513, 9, 1, True)}


@pytest.mark.parametrize("old, new, wrong", [("49,513,5", "49,512,5", {"account"}), ("49,513,5", "49,513,4", {"account"}), ("98,513,1,7", "98,514,1,7", {"group"}), ("98,513,1,7", "98,513,2,7", {"group"}), ("99,513,1,9", "99,513,1,8", {"file"}), ("99,513,1,9", "99,513,,9", {"file"}), ("16,890,1,", "16,890,2,", {"account", "group", "file"})])
def test_a_wrong_trailer_is_found(spark, old, new, wrong):
    found = L.control_totals(L.nested_records(table(spark, {"a": BAI.replace(old, new), "b": BAI}))).filter("not agree").collect()
    assert {r["level"] for r in found if r["file"] == "a"} == wrong and all(r["file"] == "a" for r in found)


@pytest.mark.parametrize("text, problems", [("88,x\n" + BAI, {"continuation"}), (BAI.replace("49,513,5/", "49,513,5/\n88,no/"), {"continuation"}), (BAI + "16,195,1,/\n", {"place"}), (BAI.replace("02,R", "16,195,1,\n02,R"), {"place"}), (BAI.replace("16,890,1,", "17,890,1,"), {"kind"})])
def test_records_at_a_wrong_place(spark, text, problems):
    assert {r["problem"] for r in L.nested_records(table(spark, {"a": text}), chunk=3).collect()} - {None} == problems


def _states(text: str, account=None):
    """A loop over the lines of one file."""
    out, section, held, record, stray = [], None, None, 0, False
    for n, line in enumerate(text.split("\n")[:-1]):
        if not line.strip():
            stray |= bool(held)
        elif line[0] == "!":
            stray |= bool(held)
            name = line[1:].strip().lower()
            if not name.startswith("option:"):
                section = "ACCOUNT" if name == "account" else name[5:].strip().upper() if name.startswith("type:") else "OTHER"
        elif line[0] == "^":
            out.append((record, held, section, stray, True))
            record, held, stray = record + 1, None, False
        else:
            held = held or {"began": n}
            held.setdefault(line[0], []).append(line[1:].strip() or None)
    if held:
        out.append((record, held, section, stray, False))
    rows = []
    for record, held, section, stray, ended in out:
        get = lambda c: ((held or {}).get(c) or [None])  # noqa: B023, E731
        if section == "ACCOUNT":
            account = get("N")[0] or account
        money = section in L.SECTIONS
        once = all(len((held or {}).get(c, [])) == 1 for c in "DT")
        problem = "investment" if section == "INVST" else "inside" if stray else "open" if not ended else "fields" if money and not once else "account" if money and not account else None
        rows.append((record, held and held["began"], section, account, *((get(c)[0] if money else None) for c in "DTN"), problem))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_record_states_are_a_loops(spark, seed):
    draw = random.Random(seed)
    pool = ["!Type:Bank", "!Type:Cat", "!Account", "!Option:X", "!type: ccard", "D1/2/26", "T5", "Nacc", "N", "Pz", "^", "^", "^", "", " ", "D1\r", "T7", "!Type:Invst" if seed == 3 else "^"]
    texts = {f"f{n}": "".join(draw.choice(pool) + "\n" for _ in range(60)) for n in range(5)}
    for chunk, account in ((4, None), (1 << 16, "given")):
        got = sorted(tuple(r) for r in L.record_states(table(spark, texts), account, chunk=chunk).collect())
        assert got == [(f, *r) for f in sorted(texts) for r in _states(texts[f], account)] or [(a, b) for a, b in zip(got, [(f, *r) for f in sorted(texts) for r in _states(texts[f], account)]) if a != b][:3] == []


def test_what_reads_nested_records_reads_no_line_again(spark):
    records = L.nested_records(table(spark, {"a": BAI}), chunk=3)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "ExistingRDD" not in plan and "collect_list" not in plan


def test_segments_shuffle_no_text_twice(spark):
    fields = L.tagged_fields(table(spark, {"a": ":20:A\n:25:acc\n:61:x\n:86:note\n"}), chunk=3)
    plan = L.statement_segments(fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "collect_list" not in plan and "regexp_extract" not in plan


def test_records_have_chunks_of_their_own(spark, monkeypatch):
    widths = []
    monkeypatch.setattr(L, "along", lambda *args, chunk, **named: widths.append(chunk) or along(*args, chunk=chunk, **named))
    assert L.record_states(table(spark, {"a": "!Account\nNx\n^\n!Type:Bank\nD1\nT2\n^\n"}), chunk=1 << 40).filter("account = 'x'").count() == 2
    assert widths == [1 << 40, L.CHUNK]
