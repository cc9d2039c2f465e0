"""From files to the canonical tables: ``binaryFile`` rows go through the parser of their format where they are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from tieout.model import BALANCES, TRANSACTIONS, InvalidConfiguration, Period, UnsupportedFormat
from tieout.plans.reconcile import Source
from tieout.session import cut, ship_package
from tieout.sources import bai2, camt, delimited, mt940, ofx, qif, xlsx
from tieout.sources.detect import detect
from tieout.sources.records import Limits, Profile, Statement

PARSER_VERSION = 1


@dataclass(frozen=True)
class Replay:
    """All that is needed to parse the same bytes to the same rows again."""

    format: str | None = None
    mapping: delimited.Mapping | None = None
    delimiter: str | None = None
    worksheet: str | None = None
    profile: Profile = Profile()
    balances: tuple = ()
    parser_version: int = PARSER_VERSION


#: Columns of a worksheet without a saved mapping: date, amount, account, currency, strong id, reference, description, balance.
WORKSHEET = delimited.Mapping(date=0, amount=1, account=2, currency=3, strong_id=4, reference=5, description=6, balance=7)


def planned(data: bytes, filename: str, replay: Replay = Replay(), limits: Limits = Limits(), *, account: str = "Primary", currency: str = "USD") -> Replay:
    """The replay with all that is inferred from the file stated: format, delimiter and columns, worksheet, defaults. Of several worksheets
    one must be chosen."""
    kind = replay.format or detect(data, filename)
    if kind in ("csv", "tsv"):
        defaults = {"account": account, "currency": replay.profile.currency or currency}
        delimiter, mapping = (replay.delimiter or ("\t" if kind == "tsv" else ","), replay.mapping) if replay.mapping else delimited.infer_mapping(data, tab=kind == "tsv", **defaults)
        return replace(replay, format=kind, delimiter=delimiter, mapping=mapping)
    if kind == "xlsx":
        sheet = replay.worksheet
        if sheet is None:
            names = xlsx.worksheet_names(data, limits)
            if len(names) != 1:
                raise InvalidConfiguration(f"choose one worksheet: {', '.join(names)}")
            sheet = names[0]
        columns = replay.mapping or replace(WORKSHEET, default_account=account, default_currency=replay.profile.currency or currency)
        return replace(replay, format=kind, worksheet=sheet, mapping=columns)
    return replace(replay, format=kind)


def plan_import(data: bytes, filename: str, saved: Replay | None = None, *, worksheet: str | None = None, account: str = "Primary", currency: str = "USD", date_order: str = "ymd", limits: Limits = Limits()) -> Replay:
    """How a new file is to be read. A saved profile must be one of the file's format; without one, structured formats fall back to ``account``,
    ``currency`` and ``date_order``, tables to the columns that their header names, worksheets to eight columns in order."""
    found = detect(data, filename)
    if found is None:
        raise UnsupportedFormat(filename)
    if saved is not None and saved.format not in (None, found):
        raise InvalidConfiguration(f"the saved profile is for {saved.format}, the file is {found}")
    replay = saved or Replay(profile=Profile(date_order=date_order, account=account, currency=currency))
    made = planned(data, filename, replace(replay, format=found, worksheet=worksheet or replay.worksheet), limits, account=account, currency=currency)
    if saved is None and made.mapping is not None:
        made = replace(made, mapping=replace(made.mapping, date_order=date_order))
    return made


def parse(data: bytes, filename: str, period: Period, replay: Replay = Replay(), limits: Limits = Limits()) -> Statement:
    replay = planned(data, filename, replay, limits)
    if replay.parser_version != PARSER_VERSION:
        raise UnsupportedFormat(f"parser version {replay.parser_version}")
    kind, rest = replay.format, {"balances": replay.balances, "limits": limits}
    if kind in ("csv", "tsv"):
        return delimited.parse(data, period, replay.mapping, delimiter=replay.delimiter, **rest)
    if kind == "xlsx":
        return xlsx.parse(data, period, replay.mapping, replay.worksheet, **rest)
    if kind in ("ofx", "qfx", "qbo"):
        return ofx.parse(data, period, replay.profile, **rest)
    if kind in ("qif", "qmtf"):
        return qif.parse(data, period, replay.profile, **rest)
    if kind in ("camt053", "camt054"):
        return camt.parse(data, period, replay.profile, **rest)
    if kind == "mt940":
        return mt940.parse(data, period, **rest)
    if kind == "bai2":
        return bai2.parse(data, period, **rest)
    raise UnsupportedFormat(filename)


def frames(spark: SparkSession, statement: Statement) -> tuple[DataFrame, DataFrame]:
    """A statement's rows and balances as tables of the canonical schemas."""
    out = []
    for rows, ddl in ((statement.transactions, TRANSACTIONS), (statement.balances, BALANCES)):
        schema = StructType.fromDDL(ddl)
        out.append(spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema))
    return out[0], out[1]


def read_files(spark: SparkSession, path: str, period: Period, replay: Replay = Replay()) -> DataFrame:
    """Canonical transactions of all files under ``path``, one file a row group; a file that is refused fails the job."""
    schema = StructType.fromDDL(TRANSACTIONS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(data, name.rpartition("/")[2], period, replay).transactions
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: list(r[n].items()) if n == "original_values" else r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return files.mapInArrow(run, schema)


def read_source(spark: SparkSession, role: str, path: str, period: Period, replay: Replay = Replay()) -> Source:
    """All files under ``path`` as one side of a job: rows, balances and completeness, each file parsed once and written as a table.

    With several files, locators carry the file's name (``name#locator``), so they stay unique; rows are numbered within their file.
    No file or no row gives an empty side that is ``incomplete``; names under ``path`` that occur twice are refused by the engine's own check.
    """
    rows, held = StructType.fromDDL(TRANSACTIONS), StructType.fromDDL(BALANCES)
    schema = StructType().add("file", "string").add("source_id", "string").add("completeness", "string").add("warnings", ArrayType(StringType())).add("rows", ArrayType(rows)).add("held", ArrayType(held))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = at.rpartition("/")[2]
                s = parse(data, name, period, replay)
                made = [{n: list(r[n].items()) if n == "original_values" else r.get(n) for n in rows.names} for r in s.transactions]
                one = {"file": name, "source_id": s.source_id, "completeness": s.completeness, "warnings": s.warnings, "rows": made, "held": [{n: b.get(n) for n in held.names} for b in s.balances]}
                yield pa.RecordBatch.from_pylist([one], schema=arrow)

    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parsed = cut(files.mapInArrow(run, schema), f"files-{role}")
    n, complete = parsed.agg(F.count("*"), F.count_if(F.col("completeness") == "complete")).first()
    # one short text a file that was listed on the driver anyway
    ids = tuple(r[0] for r in parsed.select("source_id").distinct().collect())
    own = lambda df: df.withColumn("locator", F.concat_ws("#", "file", "locator")).drop("file") if n > 1 else df.drop("file")
    return Source(role, own(parsed.select("file", F.inline("rows"))), own(parsed.select("file", F.inline("held"))), "complete" if n and n == complete else "incomplete", source_ids=ids, period=period)
