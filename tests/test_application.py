from __future__ import annotations

import json

import pytest

from tieout import application as A
from tieout.model import IntegrityFailure

JOB = "00000000-0000-4000-8000-000000000001"


def test_state(tmp_path):
    path = str(tmp_path / "x/state.json")
    state = A.load(path)
    state["entity_of_job"][JOB] = state["selected"]
    A.save(path, state)
    assert A.load(path) == state and A.restored(A.backup(state)) == state
    old = {k: state[k] for k in ("entities", "selected")} | {"schema": 2}
    (tmp_path / "old.json").write_text(json.dumps(old))
    assert A.load(str(tmp_path / "old.json"))["currency"] == "USD"
    for bad in ({"selected": "x"}, {"entities": []}, {"entity_of_job": {JOB: "nobody"}}, {"currency": "US"}, {"schema": 4}, {"entities": [{"id": state["selected"], "name": " "}]}):
        with pytest.raises(IntegrityFailure):
            A.validate(state | bad)
    with pytest.raises(IntegrityFailure):
        A.restored(A.backup(state).replace("My entity", "Your entity"))


def test_tables(spark):
    entities = spark.createDataFrame([("a", "A"), ("a", " "), ("b", "B")], "id string, name string")
    jobs = spark.createDataFrame([("1", "a", "draft", None), ("2", "z", "locked", "cannotConclude"), ("3", "b", "locked", "reconciled")], "job string, entity string, state string, result_state string")
    assert {r["check"]: r["violations"] for r in A.violations(entities, jobs).collect()} == {"ids_unique": 1, "names_not_blank": 1, "jobs_have_entities": 1}
    assert {r["job"]: r["entity_name"] for r in A.entity_names(jobs, entities.filter("name <> ' '")).collect()} == {"1": "A", "2": "Unassigned", "3": "B"}
    assert sorted(r["job"] for r in A.review_queue(jobs).collect()) == ["1", "2"]
    decisions = spark.createDataFrame([("k", "old", True), ("l", "x", True)], "exception_key string, explanation string, approved boolean")
    assert sorted(tuple(r) for r in A.with_decision(decisions, spark.createDataFrame([("k", "new", False)], decisions.schema)).collect()) == [("k", "new", False), ("l", "x", True)]
    asked = [("free", "lock", 1), ("free", "lock", 2), ("pro", "lock", 9), ("pro", "entity", 1), ("accountant", "entity", 1), ("free", "profile", 1), ("pro", "brand", 0), ("accountant", "brand", 0)]
    assert list(spark.range(1).select(*[A.permits(t, w, n).alias(str(k)) for k, (t, w, n) in enumerate(asked)]).first()) == [True, False, True, False, True, False, False, True]


def test_history_finds_every_fault(spark):
    """A chain of revisions with each fault planted, against a loop over the revisions."""
    import hashlib

    from tieout.evidence import canonical
    from tieout.operators.revisions import history_problems

    text = lambda n: {"body": f'text "{n}"', "size": n}
    sha = lambda n: hashlib.sha256(canonical(text(n)).encode()).hexdigest()
    rows = [("a", 1, None, "draft", 1), ("a", 2, sha(1), "draft", 2), ("a", 3, sha(2), "locked", 3), ("b", 1, None, "locked", 4), ("b", 2, sha(4), "draft", 5), ("c", 1, None, "draft", 6), ("c", 3, sha(6), "draft", 7)]
    rows += [("d", 1, "x", "draft", 8), ("d", 2, "x", "draft", 9), ("e", 1, None, "draft", 10), ("e", 2, sha(11), "draft", 12), ("e", 2, sha(10), "draft", 13), ("e", 3, sha(12), "draft", 14), ("f", 0, None, "draft", 15), ("g", 2, None, "draft", 16), (None, 1, None, "draft", 17)]
    df = spark.createDataFrame([(j, r, p, s, text(n)["body"], n) for j, r, p, s, n in rows], "job string, revision long, previous string, state string, body string, size long")
    got = sorted(map(tuple, history_problems(df, "job", "revision", "previous", "state", ["body", "size"]).collect()), key=str)
    assert got == sorted([("b", 2, "afterLock"), ("c", 3, "gap"), ("d", 1, "hash"), ("d", 2, "hash"), ("e", 2, "hash"), ("e", 2, "repeated"), ("e", 2, "repeated"), ("f", 0, "gap"), ("g", 2, "gap"), (None, 1, "gap")], key=str)
    assert history_problems(df.limit(0), "job", "revision", "previous", "state", ["body", "size"]).count() == 0
