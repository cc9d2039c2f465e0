"""Append-only revision chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.canonical import canonical_row


def broken_revisions(df: DataFrame, job: str, order: list[str], revision: str, previous_hash: str | None = None, own_hash: str | None = None, state: str | None = None) -> DataFrame:
    """Rows where a chain does not hold, with ``problem``: ``gap`` (not counted from 1 without holes), ``hash`` (the predecessor's
    hash is another) or ``afterLock`` (something follows a locked revision)."""
    w = Window.partitionBy(job).orderBy(*order)
    problem = F.when(F.row_number().over(w) != F.col(revision), "gap")
    if previous_hash and own_hash:
        problem = problem.when(~F.col(previous_hash).eqNullSafe(F.lag(own_hash).over(w)), "hash")
    if state:
        problem = problem.when(F.lag(state).over(w) == "locked", "afterLock")
    return df.withColumn("problem", problem).filter("problem is not null")


def current_heads(df: DataFrame, job: str, revision: str) -> DataFrame:
    """The last revision of each job, without a window: one row per job and task goes through the shuffle."""
    others = [c for c in df.columns if c != job]
    return df.groupBy(job).agg(F.max_by(F.struct(*others), revision).alias("head")).select(job, "head.*")


def content_digest(df: DataFrame, content: list[str]) -> Column:
    """SHA-256 of the canonical JSON of these columns."""
    return F.sha2(canonical_row(df.select(*content)), 256)


def history_problems(df: DataFrame, job: str, revision: str, previous: str, state: str, content: list[str]) -> DataFrame:
    """``job``, ``revision`` and ``problem`` of all that is wrong in chains of revisions; a revision may have several problems.

    ``gap``: the revision before is not there, or the number is below 1. ``repeated``: the number is not the only one of its job. ``hash``: the
    stated predecessor is not the digest of the content that the revision before has, which is computed anew here (the first states none).
    ``afterLock``: the revision before is locked. A revision finds the one before by its number, in one equi-join: no task walks a job.
    """
    at = df.select(F.col(job).alias("job"), F.col(revision).alias("revision"), F.col(previous).alias("previous"), F.col(state).alias("state"), content_digest(df, content).alias("own"))
    # one row for each number, also where it is repeated
    held = at.groupBy("job", "revision").agg(F.count("*").alias("n"), F.min("own").alias("own"), F.max("own").alias("other"), F.bool_or(F.col("state") == "locked").alias("locked"))
    before = held.select("job", (F.col("revision") + 1).alias("revision"), F.col("own").alias("b_own"), F.col("other").alias("b_other"), F.col("locked").alias("b_locked"))
    met = at.join(held.select("job", "revision", "n"), ["job", "revision"], "left").join(before, ["job", "revision"], "left")
    first, there = F.col("revision") == 1, F.col("b_own").isNotNull()
    fits = F.col("previous").eqNullSafe(F.col("b_own")) | F.col("previous").eqNullSafe(F.col("b_other"))
    problems = {
        "gap": (~first & ~there) | (F.col("revision") < 1) | F.col("revision").isNull() | F.col("job").isNull(), "repeated": F.col("n") > 1,
        "hash": (first & F.col("previous").isNotNull()) | (~first & there & ~fits), "afterLock": there & F.col("b_locked"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in problems.items()]))
    return met.select("job", "revision", F.explode(found).alias("problem"))
