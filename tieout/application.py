"""What an application keeps between runs: entities, profiles, watched folders and which job belongs to whom; and what tiers allow.

The state is one JSON document with a digest for backups. Its integrity check is relational (unique ids, foreign keys), so states
of many users can be checked as tables too (:func:`violations`).
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.evidence import File, canonical, digest, job_of, job_value, result_value
from tieout.functions.columns import cleaned
from tieout.model import MODES, EntitlementRequired, IntegrityFailure, InvalidCurrency, Period
from tieout.plans.reconcile import run
from tieout.sources.batch import role_of, safe_path
from tieout.sources.records import currency_of
from tieout.store import FREE_LOCKS, TIERS, Store

SCHEMA = 3
_DEFAULTS = {"profiles": [], "folders": [], "imported_at": {}, "entity_of_job": {}, "date_order": "ymd", "currency": "USD"}


def initial() -> dict:
    entity = str(uuid.uuid4())
    return {"schema": SCHEMA, "entities": [{"id": entity, "name": "My entity"}], "selected": entity} | {k: v.copy() if hasattr(v, "copy") else v for k, v in _DEFAULTS.items()}


def migrated(state: dict) -> dict:
    """Schema 2 lacks what was added since; anything else but 3 is refused."""
    if state.get("schema") not in (2, SCHEMA):
        raise IntegrityFailure(f"schema {state.get('schema')}")
    return _DEFAULTS | state | {"schema": SCHEMA}


def _is_id(text: str) -> bool:
    try:
        return str(uuid.UUID(text)) == text
    except ValueError:
        return False


def validate(state: dict) -> dict:
    entities = [e["id"] for e in state["entities"]]
    named = [*state["entities"], *state["profiles"], *state["folders"]]
    lists = (entities, [p["id"] for p in state["profiles"]], [f["id"] for f in state["folders"]])
    whole = (
        state["schema"] == SCHEMA
        and entities
        and all(len(set(x)) == len(x) for x in lists)
        and state["selected"] in entities
        and all(_is_id(j) and e in entities for j, e in state["entity_of_job"].items())
        and all(x["name"].strip() for x in named)
        and all(f.get("path") for f in state["folders"])
    )
    if not whole:
        raise IntegrityFailure("the application's state")
    try:
        currency_of(state["currency"])
    except InvalidCurrency as e:
        raise IntegrityFailure("the preferred currency") from e
    return state


def load(path: str) -> dict:
    file = Path(path)
    if not file.exists():
        return initial()
    if file.is_symlink() or not file.is_file():
        raise IntegrityFailure("the state is no regular file")
    return validate(migrated(json.loads(file.read_text())))


def save(path: str, state: dict) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    draft = file.with_suffix(".draft")
    draft.write_text(canonical(validate(state)))
    os.replace(draft, file)


def backup(state: dict) -> str:
    return canonical({"state": validate(state), "sha256": digest(state)})


def restored(text: str) -> dict:
    value = json.loads(text)
    if digest(value["state"]) != value["sha256"]:
        raise IntegrityFailure("the backup was changed")
    return validate(migrated(value["state"]))


def violations(entities: DataFrame, jobs: DataFrame) -> DataFrame:
    """``check`` and ``violations`` over tables of entities (``id``, ``name``) and jobs (``job``, ``entity``)."""
    facts = entities.agg((F.count("*") - F.count_distinct("id")).alias("ids_unique"), F.count_if(cleaned(F.col("name")).isNull()).alias("names_not_blank"))
    owned = jobs.join(entities.select(F.col("id").alias("entity")), "entity", "left_anti").agg(F.count("*").alias("jobs_have_entities"))
    wide = facts.crossJoin(owned)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in wide.columns])).alias("x")).select("x.*")


def entity_names(jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """Jobs with the name of their entity, ``Unassigned`` where there is none."""
    names = entities.select(F.col("id").alias("entity"), F.col("name").alias("entity_name"))
    return jobs.join(names, "entity", "left").withColumn("entity_name", F.coalesce("entity_name", F.lit("Unassigned")))


def review_queue(jobs: DataFrame) -> DataFrame:
    """Drafts, and results that need a look."""
    return jobs.filter((F.col("state") == "draft") | F.col("result_state").isin("differenceFound", "cannotConclude"))


def locked_records(jobs: DataFrame) -> DataFrame:
    return jobs.filter("state = 'locked'")


def with_decision(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """The last decision on an exception stands."""
    return decisions.join(new.select("exception_key"), "exception_key", "left_anti").unionByName(new)


def _rank(tier: Column | str) -> Column:
    ranks = F.create_map(*[x for k, t in enumerate(TIERS) for x in (F.lit(t), F.lit(k))])
    return F.element_at(ranks, F.lit(tier) if isinstance(tier, str) else tier)


def permits(tier: Column | str, what: str, existing: Column | int = 0) -> Column:
    """Whether a tier may lock, add an entity or a profile, or put its brand on a report, given how many there are."""
    n, rank = existing if isinstance(existing, Column) else F.lit(existing), _rank(tier)
    return {"lock": (rank >= 1) | (n < FREE_LOCKS), "entity": (rank == 2) | (n < 1), "profile": (rank >= 1) | (n < 1), "brand": rank == 2}[what]


def import_batch(spark: SparkSession, store: Store, job: str, folder: str, mode: str, filenames: list[str], period: Period) -> dict:
    """A pair or statement of a batch folder (:func:`tieout.sources.batch.paired`) run and stored as a draft; its result. Needs the
    tier ``accountant`` and exactly the roles of the mode."""
    if store.tier != "accountant":
        raise EntitlementRequired("accountant")
    files = [File(role_of(n) or "", n, safe_path(folder, n).read_bytes()) for n in filenames]
    if sorted(f.role for f in files) != sorted(MODES.get(mode, ())):
        raise IntegrityFailure("the files are not those that the mode needs")
    value = job_value(mode, period, files, job=job)
    result = result_value(run(job_of(spark, value, {s["sha256"]: f.data for s, f in zip(value["sources"], sorted(files, key=lambda f: (f.role, f.filename)), strict=True)})))
    store.save(job, value, 0)
    return result
