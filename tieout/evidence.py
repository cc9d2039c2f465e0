"""Evidence: canonical JSON, digests, and locks that hold the source bytes and all that is needed to run them again."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import asdict, dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.model import DECISIONS, MANUAL_MATCHES, IntegrityFailure, MatchingPolicy, Period, ResourceLimit
from tieout.operators.sealing import seal, verify_tables
from tieout.plans.reconcile import Job, Result, Source, run
from tieout.sources.delimited import Mapping
from tieout.sources.records import Profile
from tieout.sources.router import Replay, frames, parse, planned

SCHEMA, ENGINE = 2, "3"
#: Rows of a result that a manifest holds itself; larger results are sealed as tables.
MANIFEST_ROWS = 100_000

_TIMESTAMP = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z")


def is_whole_second(text: str) -> bool:
    """A real second in UTC, as text of twenty bytes."""
    try:
        return bool(_TIMESTAMP.fullmatch(text)) and bool(datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ"))
    except ValueError:
        return False


def canonical(value) -> str:
    """JSON with sorted keys, explicit nulls, no spaces and no escapes that are not needed; an amount says its mantissa, scale and text.

    ``functions.canonical`` makes the same text of a row as a column.
    """
    def plain(x):
        if isinstance(x, Decimal):
            text = format(x, "f")
            text = text.rstrip("0").rstrip(".") if "." in text else text
            return {"canonical": text, "mantissa": int(text.replace(".", "")), "scale": len(text.partition(".")[2])}
        if isinstance(x, date):
            return x.isoformat()
        raise TypeError(type(x))

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=plain)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class File:
    """The bytes of one source and how to read them."""

    role: str
    filename: str
    data: bytes
    replay: Replay = Replay()


def with_source(files: list[File], new: File) -> list[File]:
    """One source a role: the last import stands. In the order of the roles' names."""
    return sorted([*(f for f in files if f.role != new.role), new], key=lambda f: f.role)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _plain(value):
    """The value as its canonical JSON reads back."""
    return json.loads(canonical(value))


def job_value(mode: str, period: Period, files: list[File], policy: MatchingPolicy | None = None, decisions=(), manual_matches=(), job: str = "job") -> dict:
    """All that a run depends on, as plain JSON: what is inferred from the bytes (format, columns, sheet) is stated."""
    sources = [
        {"role": f.role, "filename": f.filename, "source_id": f"source-{_sha(f.data)}", "sha256": _sha(f.data), "bytes": len(f.data), "replay": asdict(planned(f.data, f.filename, f.replay))}
        for f in sorted(files, key=lambda f: (f.role, f.filename))
    ]
    by_key, by_pair = sorted(decisions, key=lambda d: (d["exception_key"], d["explanation"], d["approved"])), sorted(manual_matches, key=lambda m: (m["left_locator"], m["right_locator"]))
    return _plain({"id": job, "mode": mode, "period": [period.start, period.end], "policy": asdict(policy or MatchingPolicy()), "sources": sources, "decisions": by_key, "manual_matches": by_pair})


def _replay_of(value: dict) -> Replay:
    mapping = Mapping(**value["mapping"]) if value["mapping"] else None
    balances = tuple(b | {"date": date.fromisoformat(b["date"]), "amount": Decimal(b["amount"]["canonical"])} for b in value["balances"])
    return Replay(**value | {"mapping": mapping, "profile": Profile(**value["profile"]), "balances": balances})


def job_of(spark: SparkSession, value: dict, blobs: dict[str, bytes]) -> Job:
    """The job that ``value`` states, its sources parsed from their bytes."""
    period, sources = Period(*(date.fromisoformat(x) for x in value["period"])), []
    for s in value["sources"]:
        parsed = parse(blobs[s["sha256"]], s["filename"], period, _replay_of(s["replay"]))
        sources.append(Source(s["role"], *frames(spark, parsed), parsed.completeness, source_ids=(s["source_id"],), period=period))

    def table(rows: list[dict], ddl: str):
        names = [c.split()[0] for c in ddl.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl) if rows else None

    return Job(value["mode"], period, sources, MatchingPolicy(**value["policy"]), table(value["manual_matches"], MANUAL_MATCHES), table(value["decisions"], DECISIONS))


#: The parts of a result and the columns that order their rows; lists count as their texts, joined.
ORDERS = {"matches": ("left_locator", "right_locator", "kind"), "exceptions": ("kind", "left_locators", "right_locators", "source_fingerprints", "detail"), "totals": ("account", "currency", "kind")}


def _order(part: str) -> list[Column]:
    return [F.array_join(c, "") if c in ("left_locators", "right_locators", "source_fingerprints") else F.col(c) for c in ORDERS[part]]


def result_value(result: Result) -> dict:
    """The rows of a result, for a manifest. One that is too large to be held by a manifest is refused: see :func:`sealed_tables`."""
    def rows(df: DataFrame) -> list[dict]:
        found = df.limit(MANIFEST_ROWS + 1).collect()
        if len(found) > MANIFEST_ROWS:
            raise ResourceLimit(f"more than {MANIFEST_ROWS} rows: lock with a folder for tables")
        return [r.asDict(recursive=True) for r in found]

    return _plain({"state": result.state, "matches": rows(result.matches), "exceptions": rows(result.exceptions), "totals": rows(result.totals)})


def result_seal(result: Result) -> dict:
    """State, and the number of rows and the root of the digest tree of each part; nothing of a part but these goes to the driver."""
    found = result.unordered()
    seals = {name: seal(getattr(found, name), *_order(name)) for name in ORDERS}
    return {"state": result.state, "parts": {name: {"rows": n, "sha256": root} for name, (n, root) in seals.items()}}


def sealed_tables(result: Result, folder: str) -> dict:
    """The result as tables under ``folder``, each in its order, and its seal."""
    for name in ORDERS:
        getattr(result, name).write.mode("errorifexists").parquet(f"{folder}/{name}")
    return result_seal(stored_result(result.totals.sparkSession, result.state, folder))


def stored_result(spark: SparkSession, state: str, folder: str) -> Result:
    return Result(state, *(spark.read.parquet(f"{folder}/{name}") for name in ("matches", "exceptions", "totals")))


#: What names a row of each part, where two results are compared.
KEYS = {"matches": ["left_locator", "right_locator"], "exceptions": ["kind", "left_locators", "right_locators"], "totals": ["account", "currency"]}


def differences(left: Result, right: Result) -> DataFrame:
    """``part``, ``key`` and ``change`` of every row in which two results differ, ``right`` being the new one."""
    return reduce(DataFrame.unionByName, [verify_tables(getattr(left, n), getattr(right, n), k).select(F.lit(n).alias("part"), "key", "change") for n, k in KEYS.items()])


def sealed(job: dict, result: dict, locked_at: str, blobs: dict[str, bytes]) -> dict:
    """Manifest, its digests and the bytes it speaks of, each once. Does not run anything: see :func:`lock`."""
    manifest = {"schema": SCHEMA, "engine": ENGINE, "locked_at": locked_at, "job": job, "result": result}
    sha = digest(manifest)
    kept = {k: base64.b64encode(v).decode() for k, v in blobs.items()}
    return {"id": f"evidence-{sha[:24]}", "manifest": manifest, "sha256": sha, "job_sha256": digest(job), "result_sha256": digest(result), "blobs": kept}


def lock(spark: SparkSession, mode: str, period: Period, files: list[File], locked_at: str, policy: MatchingPolicy | None = None, *, decisions=(), manual_matches=(), job: str = "job", expected: dict | None = None, tables: str | None = None) -> dict:
    """Evidence of a job: policy, decisions, manual matches, how files are read, their bytes, and the result, which is run from these
    bytes. ``expected`` is the result that a user saw; another one refuses the lock. With ``tables`` the result is written there, whatever
    its size, and the manifest holds its seal."""
    if not is_whole_second(locked_at):
        raise IntegrityFailure("a lock needs a whole second in UTC")
    value, blobs = job_value(mode, period, files, policy, decisions, manual_matches, job), {_sha(f.data): f.data for f in files}
    found = run(job_of(spark, value, blobs))
    result = sealed_tables(found, tables) if tables else result_value(found)
    if expected is not None and _plain(expected) != result:
        raise IntegrityFailure("the result is not reproducible")
    return sealed(value, result, locked_at, blobs)


def check(evidence: dict) -> dict[str, bytes]:
    """Raises unless the evidence agrees with itself; its source bytes by digest. Runs nothing."""
    m = evidence["manifest"]
    sums = {"sha256": digest(m), "job_sha256": digest(m["job"]), "result_sha256": digest(m["result"])}
    if m["schema"] != SCHEMA or m["engine"] != ENGINE or not is_whole_second(m["locked_at"]):
        raise IntegrityFailure("evidence of another schema or engine")
    if any(evidence[k] != v for k, v in sums.items()) or evidence["id"] != f"evidence-{sums['sha256'][:24]}":
        raise IntegrityFailure("the manifest was changed")
    blobs = {k: base64.b64decode(v, validate=True) for k, v in evidence["blobs"].items()}
    stated = {s["sha256"]: s["bytes"] for s in m["job"]["sources"]}
    if {k: len(v) for k, v in blobs.items()} != stated or any(_sha(v) != k for k, v in blobs.items()):
        raise IntegrityFailure("the retained bytes are not those of the manifest")
    return blobs


def verify(spark: SparkSession, evidence: dict, files: list[File] | None = None, tables: str | None = None) -> None:
    """Raises unless the evidence is whole and its own bytes give its result again; with ``files``, also unless it is about them; with
    ``tables``, also unless the tables there are those that it seals, naming the first row that is not."""
    blobs, value = check(evidence), evidence["manifest"]["job"]
    if files is not None:
        told = sorted((s["role"], s["filename"], s["sha256"]) for s in value["sources"])
        if told != sorted((f.role, f.filename, _sha(f.data)) for f in files):
            raise IntegrityFailure("the evidence is about other files")
    told, again = evidence["manifest"]["result"], run(job_of(spark, value, blobs))
    if (result_seal(again) if "parts" in told else result_value(again)) != told:
        raise IntegrityFailure("the sources do not give this result")
    if tables is not None:
        kept = stored_result(spark, told["state"], tables)
        if result_seal(kept) != (told if "parts" in told else result_seal(again)):
            at = differences(again, kept).first()
            raise IntegrityFailure(f"the tables are not those that were sealed: {at['part']} {at['key']} {at['change']}" if at else "the tables are not those that were sealed")
