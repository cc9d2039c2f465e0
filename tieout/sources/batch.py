"""Batch folders: files are paired by base name and the role in their suffix, listed in natural order and read safely."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.model import IntegrityFailure, InvalidConfiguration, ResourceLimit

ROLES = {"bank": "bank", "ledger": "ledger", "old": "olderExport", "older": "olderExport", "new": "newerExport", "newer": "newerExport", "statement": "statement"}
MAX_FILES, MAX_BYTES = 1_000, 512 << 20


def paired(files: DataFrame) -> DataFrame:
    """``base``, ``mode`` and sorted ``files`` of each base name; anything but an exact pair or one statement is ``unassigned``."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    suffix = F.lower(F.regexp_extract(stem, r"_([A-Za-z]+)$", 1))
    role = F.try_element_at(known, suffix)
    base = F.when(role.isNull(), stem).otherwise(F.regexp_replace(stem, r"_[A-Za-z]+$", ""))
    roles = F.array_join(F.array_sort(F.collect_list(F.coalesce("role", F.lit("none")))), ",")
    grouped = files.select("filename", base.alias("base"), role.alias("role")).groupBy("base").agg(roles.alias("roles"), F.array_sort(F.collect_list("filename")).alias("files"))
    mode = F.when(F.col("roles") == "bank,ledger", "bankVsLedger").when(F.col("roles") == "newerExport,olderExport", "exportVsExport").when(F.col("roles") == "statement", "singleStatement").otherwise("unassigned")
    return grouped.select("base", mode.alias("mode"), "files")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The pairing of a folder's files, within the limits on their number and size; contents are not read."""
    listed = spark.read.format("binaryFile").load(folder).select("path", "length")
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if count > MAX_FILES or size > MAX_BYTES:
        raise ResourceLimit(f"{count} files of {size} bytes")
    return paired(listed.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")))


def in_natural_order(names: DataFrame, column: str) -> DataFrame:
    """``a2`` before ``a10``: runs of digits compare as numbers of up to 20 digits, letters without case; ties by the name itself."""
    padded = F.regexp_replace(F.regexp_replace(F.lower(column), r"([0-9]+)", "0" * 20 + "$1"), r"0*([0-9]{20})(?![0-9])", "$1")
    return names.orderBy(padded, column)


def safe_path(folder: str, filename: str) -> Path:
    """A regular file directly in ``folder``; names that lead elsewhere and links are refused."""
    if not filename or filename in (".", "..") or re.search(r"[/\\\0]", filename):
        raise IntegrityFailure("an unsafe file name")
    path = Path(folder).resolve() / filename
    if path.is_symlink() or not path.is_file():
        raise InvalidConfiguration(f"{filename} is no regular file")
    return path


def role_of(filename: str) -> str | None:
    found = re.fullmatch(r".+_([A-Za-z]+)", filename.rpartition(".")[0] or filename)
    return ROLES.get(found[1].lower()) if found else None
