"""The shared folder: where stages cut their lineage so that a lost executor costs one task, not a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.session import cut as written
from tieout.session import shared_dir

__all__ = ["fresh_path", "posix_path", "row_keys", "without_rows", "written"]

#: So many keys of rows may be broadcast (16 bytes each); beyond, rows are shuffled to them.
BROADCAST_ROWS = 1_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def posix_path(path: str) -> str:
    """The mounted path behind ``file:`` URIs, for files that workers map into memory."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on the workers, not {path}")
    return path


def row_keys(id_column: str, text_column: str) -> list:
    """Two hashes, ``k1`` and ``k2``, of a row's id and text, never null. What follows from id and text alone (a score, a match, a
    group) is one decision for all rows with these keys; rows that share only an id, or have none, are told apart."""
    i, t = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    return [F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i.isNull(), F.coalesce(i, F.lit(7))).alias("k2")]


def without_rows(docs: DataFrame, keys: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` without the rows whose :func:`row_keys` are among ``keys``; few keys are broadcast, after they were counted."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = keys.select("k1", "k2").alias("gone")
    k1, k2 = row_keys(id_column, text_column)
    # expressions in the condition: no column is added whose name could be taken
    return docs.join(F.broadcast(keys) if few else keys, (k1 == F.col("gone.k1")) & (k2 == F.col("gone.k2")), "left_anti")
