"""Append-only revisions of jobs in a folder, with an anchor outside it that tells when any of it was taken away."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
from contextlib import contextmanager
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession

from tieout.evidence import canonical, digest, verify
from tieout.model import EntitlementRequired, IntegrityFailure, LockedMutation, NotFound, ResourceLimit, StaleRevision

FREE_LOCKS, BACKUP_BYTES, MAX_JOBS, MAX_REVISIONS = 2, 256 << 20, 10_000, 10_000
TIERS = ("free", "pro", "accountant")


class Anchors(Protocol):
    """Where a store keeps what it must not lose: a few bytes by name, changed only from what the caller has seen."""

    def load(self, identifier: str) -> bytes | None: ...

    def compare_and_swap(self, identifier: str, expected: bytes | None, replacement: bytes) -> None: ...


class FileAnchors:
    """Anchors as files of one folder, which should be out of reach of whoever can change the store's."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def load(self, identifier: str) -> bytes | None:
        path = self.folder / identifier
        return path.read_bytes() if path.exists() else None

    def compare_and_swap(self, identifier: str, expected: bytes | None, replacement: bytes) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / f"{identifier}.lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            if self.load(identifier) != expected:
                raise IntegrityFailure("the anchor was changed by another")
            draft = self.folder / f"{identifier}.draft"
            draft.write_bytes(replacement)
            os.replace(draft, self.folder / identifier)


def anchor_summary(heads: dict[str, dict]) -> dict:
    """Digests of all heads and of the receipts of locks, and the number of locks that are no samples."""
    locked = [h for h in heads.values() if h["state"] == "locked"]
    return {"heads_sha256": digest(heads), "receipts_sha256": digest(sorted(h["receipt"] for h in locked)), "real_locks": sum(not h["sample"] for h in locked)}


def _head(value: dict) -> dict:
    return {"revision": value["revision"], "hash": digest(value), "state": value["state"], "sample": value["sample"], "receipt": value["receipt"]}


def _chained(job: str, revisions: list[dict]) -> list[dict]:
    """The revisions, if each names the one before it and only the last is locked."""
    previous, before = None, None
    for n, value in enumerate(revisions, start=1):
        if value["job"] != job or value["revision"] != n or value["previous"] != previous or before == "locked":
            raise IntegrityFailure(f"revision {n} of {job}")
        previous, before = digest(value), value["state"]
    return revisions


class Store:
    """One folder; every change happens under a file lock, is announced in the anchor, written whole, then taken into the anchor."""

    def __init__(self, folder: str, tier: str = "free", anchors: Anchors | None = None):
        self.folder, self.tier = Path(folder).resolve(), tier
        self.anchors = anchors or FileAnchors(self.folder.with_name(self.folder.name + ".anchors"))
        self.identifier = hashlib.sha256(str(self.folder).encode()).hexdigest()
        (self.folder / "jobs").mkdir(parents=True, exist_ok=True)

    @contextmanager
    def _held(self):
        with open(self.folder / ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            self._recover()
            yield

    @staticmethod
    def _put(path: Path, value) -> None:
        draft = path.with_suffix(".draft")
        draft.write_text(canonical(value))
        os.replace(draft, path)

    def _anchor(self) -> dict:
        data = self.anchors.load(self.identifier)
        if data is None:
            if any((self.folder / "jobs").glob("*.json")):
                raise IntegrityFailure("the anchor is gone")
            return {"heads": {}, "pending": None, "summary": anchor_summary({})}
        anchor = json.loads(data)
        if anchor["summary"] != anchor_summary(anchor["heads"]):
            raise IntegrityFailure("the anchor does not sum up")
        return anchor

    def _swap(self, heads: dict, pending: dict | None) -> None:
        seen = self.anchors.load(self.identifier)
        after = {"heads": heads, "pending": pending, "summary": anchor_summary(heads)}
        self.anchors.compare_and_swap(self.identifier, seen, canonical(after).encode())

    def _recover(self) -> None:
        """A change that was announced and written, but not yet taken into the anchor, is taken in now; unwritten ones are dropped."""
        anchor = self._anchor()
        if pending := anchor["pending"]:
            path, heads = self._path(pending["job"], pending["head"]["revision"]), anchor["heads"]
            if path.exists() and _head(json.loads(path.read_text())) == pending["head"]:
                heads = heads | {pending["job"]: pending["head"]}
            self._swap(heads, None)

    def _path(self, job: str, revision: int) -> Path:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", job):
            raise NotFound(f"no job can be called {job!r}")
        return self.folder / "jobs" / f"{job}.{revision}.json"

    def history(self, job: str) -> list[dict]:
        """All revisions, after the chain has been checked against itself and the anchor."""
        out = []
        while (path := self._path(job, len(out) + 1)).exists():
            out.append(json.loads(path.read_text()))
        _chained(job, out)
        head = self._anchor()["heads"].get(job)
        if head != (_head(out[-1]) if out else None):
            raise IntegrityFailure(f"{job} is not what the anchor says")
        if not out:
            raise NotFound(job)
        return out

    def load(self, job: str) -> dict:
        with self._held():
            return self.history(job)[-1]

    def jobs(self) -> list[dict]:
        with self._held():
            return [self.history(j)[-1] for j in sorted(self._anchor()["heads"])]

    def _append(self, job: str, content: dict, expected_revision: int, state: str, sample: bool | None, receipt: str | None) -> int:
        anchor = self._anchor()
        heads = anchor["heads"]
        held = self.history(job) if job in heads or self._path(job, 1).exists() else []
        if held and held[-1]["state"] == "locked":
            raise LockedMutation(job)
        if len(held) != expected_revision:
            raise StaleRevision(job)
        if len(held) >= MAX_REVISIONS or (not held and len(heads) >= MAX_JOBS):
            raise ResourceLimit("jobs or revisions")
        real = held[-1]["sample"] if held else bool(sample)
        if receipt is not None:
            if not held or held[-1]["content"] != content["manifest"]["job"] or content["manifest"]["job"]["id"] != job:
                raise IntegrityFailure("the evidence is not about this draft")
            if receipt in (h["receipt"] for h in heads.values()):
                raise IntegrityFailure("this evidence is locked already")
            if not real and self.tier == "free" and anchor["summary"]["real_locks"] >= FREE_LOCKS:
                raise EntitlementRequired("pro")
        value = {"job": job, "revision": len(held) + 1, "previous": digest(held[-1]) if held else None, "state": state, "sample": real, "receipt": receipt, "content": content}
        value = json.loads(canonical(value))
        self._swap(heads, {"job": job, "head": _head(value)})
        self._put(self._path(job, value["revision"]), value)
        self._swap(heads | {job: _head(value)}, None)
        return value["revision"]

    def save(self, job: str, content: dict, expected_revision: int, *, sample: bool = False) -> int:
        """Appends a draft; ``expected_revision`` is the one it was made from, 0 for a new job. A sample stays one."""
        with self._held():
            return self._append(job, content, expected_revision, "draft", sample, None)

    def real_locks(self) -> int:
        with self._held():
            return self._anchor()["summary"]["real_locks"]

    def commit_lock(self, spark: SparkSession, job: str, evidence: dict, expected_revision: int) -> int:
        """The last revision of a job, whose draft is the job that the evidence states (:func:`tieout.evidence.job_value`). The evidence
        is run again from its bytes before. Its receipt is used once; the free tier has two locks that are not samples."""
        verify(spark, evidence)
        with self._held():
            return self._append(job, evidence, expected_revision, "locked", None, f"lock-{evidence['sha256'][:32]}")

    def backup(self) -> str:
        with self._held():
            jobs = {j: self.history(j) for j in sorted(self._anchor()["heads"])}
        text = canonical({"jobs": jobs, "sha256": digest(jobs)})
        if len(text.encode()) > BACKUP_BYTES:
            raise ResourceLimit("the backup's size")
        return text

    def restore(self, text: str) -> None:
        """Into an empty store only; every chain is checked before a byte is written."""
        if len(text.encode()) > BACKUP_BYTES:
            raise ResourceLimit("the backup's size")
        value = json.loads(text)
        if digest(value["jobs"]) != value["sha256"]:
            raise IntegrityFailure("the backup was changed")
        if len(value["jobs"]) > MAX_JOBS or any(not 0 < len(r) <= MAX_REVISIONS for r in value["jobs"].values()):
            raise ResourceLimit("jobs or revisions")
        with self._held():
            if self._anchor()["heads"]:
                raise IntegrityFailure("the store is not empty")
            paths = [(self._path(j, r["revision"]), r) for j, revisions in value["jobs"].items() for r in _chained(j, revisions)]
            for path, r in paths:
                self._put(path, r)
            self._swap({j: _head(r[-1]) for j, r in value["jobs"].items()}, None)
