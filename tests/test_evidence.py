from __future__ import annotations

import copy
import csv
import io
import json
from dataclasses import replace

import pytest

from tieout import application, evidence, report, sample
from tieout.model import EntitlementRequired, IntegrityFailure, InvalidConfiguration, LockedMutation, MatchingPolicy, NotFound, StaleRevision
from tieout.sources import batch
from tieout.sources.router import read_source
from tieout.store import FileAnchors, Store, _head, anchor_summary

AT = "2026-02-01T00:00:00Z"


@pytest.fixture(scope="module")
def locked(spark):
    files = sample.files()
    files[1] = replace(files[1], data=files[1].data + b"2026-01-28,-7.00,Harbour,CHF,k10,x,Only here,1242.85\n")
    decisions = [{"exception_key": "b" * 64, "explanation": "later, \"maybe\"", "approved": False}, {"exception_key": "a" * 64, "explanation": "seen", "approved": True}]
    return evidence.lock(spark, "bankVsLedger", sample.PERIOD, files, AT, MatchingPolicy(maximum_date_distance_days=2), decisions=decisions, job="j1")


def variant(locked, job):
    """The same job by another id."""
    m = locked["manifest"]
    return evidence.sealed(m["job"] | {"id": job}, m["result"], AT, evidence.check(locked))


def test_sample_is_reconciled_and_verifies(spark):
    made = evidence.lock(spark, "bankVsLedger", sample.PERIOD, sample.files(), AT)
    assert made["manifest"]["result"]["state"] == "reconciled" and len(made["manifest"]["result"]["matches"]) == 3
    evidence.verify(spark, made, sample.files())
    for other in ([replace(f, filename="other.csv") for f in sample.files()], [replace(f, data=f.data + b" ") for f in sample.files()]):
        with pytest.raises(IntegrityFailure):
            evidence.verify(spark, made, other)
    with pytest.raises(IntegrityFailure):
        evidence.lock(spark, "bankVsLedger", sample.PERIOD, sample.files(), "today")
    with pytest.raises(IntegrityFailure):
        evidence.lock(spark, "bankVsLedger", sample.PERIOD, sample.files(), AT, expected=made["manifest"]["result"] | {"state": "differenceFound"})


def test_evidence_stands_alone(spark, locked):
    read = json.loads(evidence.canonical(locked))
    evidence.verify(spark, read)
    job = read["manifest"]["job"]
    assert job["policy"]["maximum_date_distance_days"] == 2 and [d["approved"] for d in job["decisions"]] == [True, False]
    assert job["sources"][0]["replay"]["format"] == "csv" and job["sources"][0]["replay"]["mapping"]["strong_id"] == 4
    result = read["manifest"]["result"]
    forged = evidence.sealed(job, result | {"state": "reconciled"}, AT, evidence.check(read))
    evidence.check(forged)
    with pytest.raises(IntegrityFailure):
        evidence.verify(spark, forged)


def test_any_change_of_evidence_is_seen(locked):
    def changed(f):
        e = copy.deepcopy(locked)
        f(e)
        with pytest.raises((IntegrityFailure, ValueError)):
            evidence.check(e)

    changed(lambda e: e.update(id="evidence-0"))
    changed(lambda e: e.update(job_sha256="0"))
    changed(lambda e: e.update(result_sha256="0"))
    changed(lambda e: e["manifest"]["job"]["policy"].update(fuzzy=False))
    changed(lambda e: e["manifest"].update(locked_at="2026-02-30T00:00:00Z"))
    changed(lambda e: e["manifest"]["job"]["decisions"].pop())
    changed(lambda e: e["blobs"].popitem())
    changed(lambda e: e["blobs"].update({"0" * 64: "AA=="}))
    changed(lambda e: e["blobs"].update({k: "AA==" for k in e["blobs"]}))


def test_reports(locked):
    record = {"state": "locked", "content": locked}
    made = report.pack(record, " Harbour Ltd ", {locked["manifest"]["job"]["sources"][0]["source_id"]: AT})
    lines = list(csv.DictReader(io.StringIO(made["csv"])))
    of = lambda s: [x for x in lines if x["section"] == s]
    assert [x["section"] for x in lines] == sorted((x["section"] for x in lines), key="summary metadata source total match exception decision".split().index)
    assert of("summary")[0]["details"] == "Harbour Ltd" and len(of("match")) == 3 and [x["type"] for x in of("decision")] == ["approved", "unresolved"]
    assert of("decision")[1]["details"].endswith('later, "maybe"') and "unexpectedLedgerItem" in [x["type"] for x in of("exception")]
    assert of("source")[0]["details"].endswith(f"date[0] amount[1]; account[2] currency[3]; dateOrder ymd decimal . | {AT}") and of("source")[1]["details"].endswith("not recorded")
    assert of("total")[0]["left"] != of("total")[0]["right"] and made["csv"].endswith("\r\n")
    assert made["pdf"].startswith(b"%PDF") and json.loads(made["json"]) == locked["manifest"] and made["base"] == "reconciliation-2026-01-31-j1"
    assert b"(Brand" in report.pack(record, "x", header="Brand", tier="accountant")["pdf"]
    for bad, error in ((({"state": "draft"}, "x"), InvalidConfiguration), ((record, " "), InvalidConfiguration), ((record, "x", None, "Brand", "pro"), EntitlementRequired)):
        with pytest.raises(error):
            report.pack(*bad)


def test_store(spark, tmp_path, locked):
    s = Store(str(tmp_path / "a"))
    job = locked["manifest"]["job"]
    assert s.save("j1", {"x": 1}, 0) == 1
    with pytest.raises(IntegrityFailure):
        s.commit_lock(spark, "j1", locked, 1)
    assert s.save("j1", job, 1) == 2
    with pytest.raises(StaleRevision):
        s.save("j1", {}, 1)
    assert s.commit_lock(spark, "j1", locked, 2) == 3 and s.real_locks() == 1
    with pytest.raises(LockedMutation):
        s.save("j1", {}, 3)
    for name in ("j2", "j3"):
        s.save(name, job | {"id": name}, 0)
    s.save("j4", job | {"id": "j4"}, 0, sample=True)
    s.commit_lock(spark, "j2", variant(locked, "j2"), 1)
    with pytest.raises(EntitlementRequired):
        s.commit_lock(spark, "j3", variant(locked, "j3"), 1)
    s.commit_lock(spark, "j4", variant(locked, "j4"), 1)
    assert s.real_locks() == 2 and Store(str(tmp_path / "a"), "pro").commit_lock(spark, "j3", variant(locked, "j3"), 1) == 2
    with pytest.raises(NotFound):
        s.load("../j1")
    text = s.backup()
    other = Store(str(tmp_path / "b"))
    other.restore(text)
    assert other.load("j1") == s.load("j1") and len(other.jobs()) == 4 and other.real_locks() == 3
    with pytest.raises(IntegrityFailure):
        Store(str(tmp_path / "c")).restore(text.replace("draft", "drift"))
    (tmp_path / "a/jobs/j1.3.json").unlink()
    with pytest.raises(IntegrityFailure):
        s.load("j1")
    for path in (tmp_path / "a/jobs").glob("j2.*"):
        path.unlink()
    with pytest.raises(IntegrityFailure):
        s.save("j2", {}, 0)


def test_the_anchor_guards_the_store(tmp_path):
    anchors = FileAnchors(tmp_path / "elsewhere")
    s = Store(str(tmp_path / "s"), anchors=anchors)
    s.save("j", {"x": 1}, 0)
    data = anchors.load(s.identifier)
    heads = json.loads(data)["heads"]
    assert json.loads(data)["summary"] == anchor_summary(heads)
    with pytest.raises(IntegrityFailure):
        anchors.compare_and_swap(s.identifier, b"old", b"new")
    anchors.compare_and_swap(s.identifier, data, data.replace(b'"real_locks":0', b'"real_locks":1'))
    with pytest.raises(IntegrityFailure):
        s.load("j")
    (tmp_path / "elsewhere" / s.identifier).unlink()
    with pytest.raises(IntegrityFailure):
        s.load("j")


def test_a_write_before_its_anchor_is_recovered(tmp_path):
    s = Store(str(tmp_path / "s"))
    s.save("j", {"x": 1}, 0)
    value = s.load("j") | {"revision": 2, "previous": evidence.digest(s.load("j")), "content": {"x": 2}}
    s._swap(s._anchor()["heads"], {"job": "j", "head": _head(value)})
    assert s.load("j")["revision"] == 1 and s._anchor()["pending"] is None
    s._swap(s._anchor()["heads"], {"job": "j", "head": _head(value)})
    s._put(s._path("j", 2), value)
    assert s.load("j")["revision"] == 2


def test_batch_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in sample.files():
        (tmp_path / "in" / f.filename).write_bytes(f.data)
    (tmp_path / "in/link_bank.csv").symlink_to(tmp_path / "in/sample_bank.csv")
    names, folder = ["sample_bank.csv", "sample_ledger.csv"], str(tmp_path / "in")
    s = Store(str(tmp_path / "s"), "accountant")
    assert application.import_batch(spark, s, "b1", folder, "bankVsLedger", names, sample.PERIOD)["state"] == "reconciled"
    assert s.load("b1")["state"] == "draft" and [x["role"] for x in s.load("b1")["content"]["sources"]] == ["bank", "ledger"]
    for bad, error in ((names[:1], IntegrityFailure), (["../x_bank.csv", names[1]], IntegrityFailure), (["link_bank.csv", names[1]], InvalidConfiguration), ([*names, names[0]], IntegrityFailure)):
        with pytest.raises(error):
            application.import_batch(spark, s, "b2", folder, "bankVsLedger", bad, sample.PERIOD)
    with pytest.raises(EntitlementRequired):
        application.import_batch(spark, Store(str(tmp_path / "s")), "b2", folder, "bankVsLedger", names, sample.PERIOD)
    listed = batch.in_natural_order(spark.createDataFrame([(n,) for n in ("a10.csv", "A2.csv", "b.csv", "a1.csv", "a002.csv")], "f string"), "f")
    assert [r["f"] for r in listed.collect()] == ["a1.csv", "A2.csv", "a002.csv", "a10.csv", "b.csv"]
    assert batch.role_of("x_Old.csv") == "olderExport" and batch.role_of("bank.csv") is None


def test_one_source_a_role():
    files = sample.files()
    new = replace(files[0], data=b"new")
    assert [f.data for f in evidence.with_source(files, new)] == [b"new", files[1].data]


def test_files_become_a_side(spark, tmp_path):
    bank, ledger = sample.files()
    (tmp_path / "one.csv").write_bytes(bank.data)
    one = read_source(spark, "bank", str(tmp_path), sample.PERIOD)
    assert one.completeness == "complete" and sorted(r["locator"] for r in one.transactions.collect()) == ["line:2", "line:3", "line:4"]
    (tmp_path / "two.csv").write_bytes(ledger.data)
    two = read_source(spark, "bank", str(tmp_path), sample.PERIOD)
    assert two.transactions.count() == 6 and two.transactions.filter("locator like 'two.csv#line:%'").count() == 3 and two.balances.count() == 0
    (tmp_path / "none").mkdir()
    none = read_source(spark, "bank", str(tmp_path / "none"), sample.PERIOD)
    assert none.completeness == "incomplete" and none.transactions.count() == 0
