"""Records of line formats from tables of lines: one file may be spread over many tasks.

Lines have ``file``, ``line`` (a whole number in the order of the file, unique in it) and ``text``. What a parser of one file carries from line to
line (whether a quote is open, the statement, group, account or section that it is in) is carried here by ``operators.carry``, so
that records come out with their state and nothing is read in order by one task. Where a parser refuses a file, the tables name what is
wrong (``problem``), and the caller refuses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.functions import columns as C
from tieout.model import ResourceLimit
from tieout.operators.carry import CHUNK, along, carried
from tieout.operators.numbering import numbered
from tieout.session import cut, ship_package
from tieout.sources.delimited import tokenize
from tieout.sources.records import Limits


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files under ``path``, split where Spark likes: only LF ends a line, so CR stays where it was."""
    raw = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").alias("text"))
    # within a split lines come in order; splits are told apart by where they begin
    placed = cut(raw.withColumn("at", F.monotonically_increasing_id()), "lines")
    return numbered(placed, "file_path", "file_block_start", "at", name="line").select(F.col("file_path").alias("file"), "line", "text")


# ---- delimited text ----

_RECORD = "file string, line long, first long, part int, cells array<string>"
_RECORD_TYPES = pa.schema([("file", pa.string()), ("line", pa.int64()), ("first", pa.int64()), ("part", pa.int32()), ("cells", pa.list_(pa.string()))])


def _tokenized(delimiter: str, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, line, first, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for part, (at, cells) in enumerate(tokenize(text, delimiter, limits)):
                    rows.append({"file": file, "line": line, "first": first + at - 1, "part": part, "cells": cells})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_TYPES)

    return run


def delimited_records(lines: DataFrame, delimiter: str = ",", *, limits: Limits = Limits(), chunk: int = CHUNK) -> DataFrame:
    """``file``, ``first`` (the physical line, from 1, on which a record begins) and ``cells`` of every record, with ``line`` and ``part`` to order them.

    Whether a line begins inside quotes is the parity of all quotes before it in its file: a doubled quote counts twice, so in well-formed
    text this is the state of a tokenizer that has read everything before. Lines that one quote holds together become one text, which the
    strict tokenizer reads. The first fault of a file lies in a text that begins where a record does, so that it raises there as
    it would in order. LF, CRLF and CR end records; blank records are kept. A quote that holds more than a record may have raises ``ResourceLimit``.
    """
    text, quote = F.coalesce("text", F.lit("")), F.lit('"')
    quotes = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    body = F.regexp_replace(text, "\r$", "")
    ends = F.lit(1) + F.length(body) - F.length(F.replace(body, F.lit("\r"), F.lit("")))
    marked = along(lines.select("file", "line", text.alias("text")), ["file"], "line", sums={"open": quotes, "ends": ends}, chunk=chunk)
    closed = (F.col("open") % 2 == 0).cast("int")
    own = marked.select("file", "line", "text", (F.col("ends") - ends + 1).alias("first"), closed.alias("closed"))
    held = along(own, ["file"], "line", sums={"done": F.col("closed")}, chunk=chunk).withColumn("record", F.col("done") - F.col("closed"))
    held = cut(held.select("file", "record", "line", "first", "text"), "records")
    largest = limits.columns * (limits.field_bytes + 3)
    size = held.groupBy("file", "record").agg(F.sum(F.octet_length("text") + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    if size > largest:
        raise ResourceLimit(f"one record has {size} bytes")
    joined = held.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("line", "first", "text"))).alias("l"))
    whole = joined.select("file", F.col("l")[0]["line"].alias("line"), F.col("l")[0]["first"].alias("first"), F.concat(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))
    ship_package(lines.sparkSession)
    return whole.mapInArrow(_tokenized(delimiter, limits), _RECORD)


# ---- statements of tagged fields ----

TAGS = {"20": ("20",), "25": ("25",), "28C": ("28C",), "60": ("60F", "60M"), "62": ("62F", "62M")}


def tagged_fields(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """``file``, ``segment`` (from 1; 0 is before the first ``:20:``), ``field`` (its number in the file), ``tag`` and ``value``: a tag's text with the lines that continue it.

    Blank lines, dashes and envelope blocks are skipped. Text before the first tag has a null tag and field 0.
    """
    text = F.regexp_replace("text", "\r$", "")
    kept = lines.select("file", "line", text.alias("text")).filter(~F.trim("text").isin("", "-", "-}") & ~F.col("text").startswith("{"))
    shape = "^:([0-9]{2}[A-Z]?):(.*)"
    tag = F.nullif(F.regexp_extract("text", shape, 1), F.lit(""))
    at = along(kept.withColumn("tag", tag), ["file"], "line", sums={"field": F.col("tag").isNotNull(), "segment": F.coalesce(F.col("tag") == "20", F.lit(False))}, chunk=chunk)
    own = F.when(F.col("tag").isNotNull(), F.regexp_extract("text", shape, 2)).otherwise(F.col("text"))
    parts = at.select("file", "segment", "field", "line", "tag", own.alias("own"))
    grouped = parts.groupBy("file", "segment", "field").agg(F.max("tag").alias("tag"), F.array_sort(F.collect_list(F.struct("line", "own"))).alias("l"))
    return grouped.select("file", "segment", "field", "tag", F.array_join(F.transform("l", lambda x: x["own"]), "\n").alias("value"))


def statement_segments(fields: DataFrame) -> DataFrame:
    """Per segment of :func:`tagged_fields`: the ``account``, ``entries``, ``noted`` (entries with their own ``:86:`` directly behind) and ``problems``, the tags
    of which there is not exactly one; what stands before the first segment is a problem of its own."""
    many = {name: F.count_if(F.col("tag").isin(*tags)) for name, tags in TAGS.items()}
    # only the account is read as a text: the others go no further than here
    told = cut(fields.select("file", "segment", "field", "tag", F.when(F.col("tag") == "25", C.cleaned(F.col("value"))).alias("account")), "fields")
    counted = told.groupBy("file", "segment").agg(F.max("account").alias("account"), F.count_if(F.col("tag") == "61").alias("entries"), *[n.alias(f"n{name}") for name, n in many.items()])
    # a note belongs to an entry where its field is the next one: fields are joined by number, there is no order to walk
    entries, notes = told.filter("tag = '61'").select("file", "segment", "field"), told.filter("tag = '86'").select("file", (F.col("field") - 1).alias("field"))
    noted = entries.join(notes, ["file", "field"], "left_semi").groupBy("file", "segment").agg(F.count("*").alias("noted"))
    counted = counted.join(noted, ["file", "segment"], "left").withColumn("noted", F.coalesce("noted", F.lit(0)))
    wrong = F.array_compact(F.array(*[F.when(F.col(f"n{name}") != 1, F.lit(name)) for name in TAGS]))
    return counted.select("file", "segment", "account", "entries", "noted", F.when(F.col("segment") == 0, F.array(F.lit("before"))).otherwise(wrong).alias("problems"))


# ---- nested records with control totals ----

#: How many levels are open before a record of each kind.
DEPTH = {"01": 0, "02": 1, "03": 2, "16": 3, "49": 3, "98": 2, "99": 1}


def nested_records(lines: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """``file``, ``record`` (from 1), ``kind``, ``fields``, ``physical`` lines, the numbers of the ``grp`` and ``account`` that it lies in, its ``currency`` and ``problem``.

    88 continues the record before. Problems: ``continuation`` (of nothing, or of what cannot be continued), ``place`` (a record at a
    level where it cannot be, or behind the file's trailer) and ``kind`` (unknown).
    """
    text = F.trim(F.regexp_replace("text", "\r$", ""))
    more = F.col("text").startswith("88,")
    own = F.when(more, F.expr("substring(text, 4)")).otherwise(F.col("text"))
    kept = cut(lines.select("file", "line", text.alias("text")).filter("text <> ''").select("file", "line", more.alias("more"), F.regexp_replace(own, "/$", "").alias("own")), "lines")
    # a chunk begins where a record does: lines that continue one over its edge go to the chunk of that record, so whole records and
    # what is counted along them come out of one shuffle of the lines
    chunked = kept.withColumn("__chunk", F.expr(f"line div {chunk}"))
    begins = chunked.groupBy("file", "__chunk").agg(F.min("line").alias("least"), F.min(F.when(~F.col("more"), F.col("line"))).alias("begin"))
    before = Window.partitionBy("file").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = begins.withColumn("earlier", F.last(F.when(F.col("begin").isNotNull(), F.col("__chunk")), ignorenulls=True).over(before)).filter("begin is null or least < begin").drop("least")
    at_edge = F.col("edge") & (F.col("begin").isNull() | (F.col("line") < F.col("begin")))
    held = chunked.join(F.broadcast(edges.withColumn("edge", F.lit(True))), ["file", "__chunk"], "left").withColumn("__chunk", F.when(at_edge, F.coalesce("earlier", F.lit(-1 << 62))).otherwise(F.col("__chunk")))
    inside = Window.partitionBy("file", "__chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counted = held.select("file", "__chunk", "line", "more", "own", F.sum((~F.col("more")).cast("long")).over(inside).alias("nth"))
    joined = counted.groupBy("file", "__chunk", "nth").agg(F.array_sort(F.collect_list(F.struct("line", "own"))).alias("l"), F.count("*").alias("physical"), F.max("more").alias("continued"))
    fields = F.split(F.array_join(F.transform("l", lambda x: x["own"]), ","), ",")
    records = joined.select("file", "__chunk", "nth", "physical", "continued", fields.alias("fields")).withColumn("kind", F.when(F.col("nth") > 0, F.col("fields")[0]))
    kind = F.col("kind")
    step = F.when(kind.isin("01", "02", "03"), 1).when(kind.isin("49", "98", "99"), -1).otherwise(0)
    field = lambda n: F.nullif(F.trim(F.get("fields", F.lit(n))), F.lit(""))
    placed = carried(
        records, ["file"], "nth", sums={"record": F.col("nth") > 0, "grp": kind == "02", "account": kind == "03", "level": step, "files": kind == "01"},
        last={"group_currency": F.when(kind == "02", F.coalesce(field(6), F.lit("USD"))), "own_currency": F.when(kind == "03", F.coalesce(field(2), F.lit("-"))).when(kind == "02", F.lit("-"))},
    )
    expected = reduce(lambda rest, k: F.when(kind == k, DEPTH[k]).otherwise(rest), DEPTH, F.lit(None).cast("int"))
    before = F.col("level") - step
    problem = (
        F.when((F.col("record") == 0) | (F.col("continued") & kind.isin("01", "02", "49", "98", "99")), "continuation").when(expected.isNull(), "kind").when((before != expected) | (F.col("files") != 1), "place")
    )
    currency = F.when(F.col("own_currency") == "-", F.col("group_currency")).otherwise(F.coalesce("own_currency", "group_currency"))
    return placed.select("file", "record", "kind", "fields", "physical", "grp", "account", F.upper(currency).alias("currency"), problem.alias("problem"))


def summary_amounts(fields: Column, currency: Column) -> Column:
    """``code`` and ``amount`` of the repeated groups of an account record: a group has a code, an amount, a count and a funds type, behind which the type
    may have fields of its own (S three, V two, D a number and twice as many)."""
    at = lambda k: F.get(fields, k)

    def after(k: Column) -> Column:
        kind = F.upper(at(k))
        return F.when(kind == "S", k + 4).when(kind == "V", k + 3).when(kind == "D", k + 2 + 2 * F.coalesce(at(k + 1).try_cast("int"), F.lit(0))).otherwise(k + 1)

    none = F.array().cast("array<struct<code:string,amount:decimal(25,6)>>")
    code, amount = (lambda k: F.trim(at(k))), (lambda k: C.implied_amount(F.trim(at(k + 1)), currency))
    item = lambda k: F.array(F.struct(code(k).alias("code"), amount(k).alias("amount")))
    there = lambda k: (code(k) != "") & (F.trim(at(k + 1)) != "")
    step = lambda s, k: F.when(s["next"] == k, F.struct(after(k + 3).cast("int").alias("next"), F.when(there(k), F.concat(s["held"], item(k))).otherwise(s["held"]).alias("held"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(3), F.greatest(F.size(fields) - 1, F.lit(3))), F.struct(F.lit(3).alias("next"), none.alias("held")), step, lambda s: s["held"])


def control_totals(records: DataFrame) -> DataFrame:
    """Each account, group and file of :func:`nested_records`: its ``total``, ``physical`` records and ``children``, what its trailer states, and whether they ``agree``.

    An account's total is of its amounts and summaries, whatever their codes; a group's is of its accounts, a file's of its groups. ``children`` are
    not stated for accounts. Sums and counts are partial before they are shuffled, one row for each account of a task.
    """
    kind, at = F.col("kind"), lambda k: F.trim(F.get("fields", F.lit(k)))
    own = F.when(kind == "16", C.implied_amount(at(2), F.col("currency"))).when(kind == "03", F.aggregate(summary_amounts(F.col("fields"), F.col("currency")), F.lit(0).cast("decimal(31,6)"), lambda s, x: (s + x["amount"]).cast("decimal(31,6)")))
    amounts = records.select("file", "kind", "grp", "account", "physical", "currency", own.cast("decimal(31,6)").alias("amount"), *[at(k).alias(f"f{k}") for k in (1, 2, 3)])
    inner = amounts.filter(kind.isin("03", "16", "49"))
    trailer = lambda k, n: F.max(F.when(F.col("kind") == k, F.col(f"f{n}")))
    money = lambda c: C.implied_amount(F.col(c), F.col("currency"))
    accounts = inner.groupBy("file", "grp", "account").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"), F.sum("physical").alias("physical"), trailer("49", 1).alias("t"), trailer("49", 2).alias("r"), F.max("currency").alias("currency"))
    accounts = cut(accounts.withColumn("children", F.lit(None).cast("long")).withColumn("c", F.lit(None).cast("string")), "accounts")

    def above(below: DataFrame, keys: list[str], opens: str, closes: str) -> DataFrame:
        sums = below.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("physical").alias("inside"), F.count("*").alias("children"), F.max("currency").alias("currency"))
        edges = amounts.filter(kind.isin(opens, closes)).groupBy(*keys).agg(F.sum("physical").alias("edges"), trailer(closes, 1).alias("t"), trailer(closes, 3).alias("r"), trailer(closes, 2).alias("c"), F.max(F.when(F.col("kind") == opens, F.col("currency"))).alias("edge_currency"))
        both = edges.join(sums, keys, "left")
        return both.select(*keys, F.coalesce("total", F.lit(0)).alias("total"), (F.col("edges") + F.coalesce("inside", F.lit(0))).alias("physical"), "t", "r", F.coalesce("currency", "edge_currency").alias("currency"), F.coalesce("children", F.lit(0)).alias("children"), "c")

    groups = cut(above(accounts, ["file", "grp"], "02", "98"), "groups")
    files = above(groups, ["file"], "01", "99")
    none = F.lit(None).cast("long")
    levels = [accounts.withColumn("level", F.lit("account")), groups.withColumn("level", F.lit("group")).withColumn("account", none), files.withColumn("level", F.lit("file")).withColumn("grp", none).withColumn("account", none)]
    every = reduce(DataFrame.unionByName, levels)
    stated = every.select("level", "file", "grp", "account", F.col("total").cast("decimal(31,6)").alias("total"), "physical", "children", money("t").alias("stated_total"), F.col("r").try_cast("long").alias("stated_physical"), F.col("c").try_cast("long").alias("stated_children"))
    same = F.col("total").eqNullSafe(F.col("stated_total")) & F.col("physical").eqNullSafe(F.col("stated_physical")) & F.col("children").eqNullSafe(F.col("stated_children"))
    return stated.withColumn("agree", same)


# ---- records between marks ----

SECTIONS = ("BANK", "CASH", "CCARD", "OTHA", "OTHL")


def record_states(lines: DataFrame, account: str | None = None, *, chunk: int = CHUNK) -> DataFrame:
    """``file``, ``record`` (from 0), ``began`` (its first line), ``section``, the ``account`` carried to it, its first ``day``, ``amount`` and ``number``, and ``problem``.

    A record ends with ``^``. A section holds until the next one, an account until a record of an account section names another; options say
    nothing. Problems: ``inside`` (a blank line or a mark within a record), ``open`` (it does not end), ``investment``, ``fields`` (not one
    date and one amount in a section of money) and ``account`` (none there). Records of other sections are listed without fields of their own.
    """
    text = F.regexp_replace("text", "\r$", "")
    base = lines.select("file", "line", text.alias("text"))
    first, name = F.substring("text", 1, 1), F.lower(F.trim(F.expr("substring(text, 2)")))
    kind = F.when(F.trim("text") == "", "blank").when(first == "!", "mark").when(first == "^", "end").otherwise("field")
    marked = base.withColumn("kind", kind)
    told = F.when(name == "account", "ACCOUNT").when(name.startswith("type:"), F.upper(F.trim(F.expr("substring(text, 7)")))).otherwise("OTHER")
    section = F.when((F.col("kind") == "mark") & ~name.startswith("option:"), told)
    at = along(marked, ["file"], "line", sums={"done": F.col("kind") == "end"}, last={"section": section}, chunk=chunk)
    at = at.withColumn("record", F.col("done") - (F.col("kind") == "end").cast("int"))
    code, value = F.substring("text", 1, 1), C.cleaned(F.expr("substring(text, 2)"))
    is_field = F.col("kind") == "field"
    of = lambda c: F.min_by(F.when(is_field & (code == c), value), F.when(is_field & (code == c), F.col("line")))
    many = lambda c: F.count_if(is_field & (code == c))
    began, stray = F.min(F.when(is_field, F.col("line"))), F.max(F.when(F.col("kind").isin("blank", "mark"), F.col("line")))
    records = at.groupBy("file", "record").agg(
        began.alias("began"), stray.alias("stray"), F.max_by("section", "line").alias("section"), F.count_if(F.col("kind") == "end").alias("ends"), of("D").alias("day"), of("T").alias("amount"), of("N").alias("number"), many("D").alias("days"), many("T").alias("amounts"),
    )
    records = records.filter("began is not null or ends > 0")
    held = along(records, ["file"], "record", last={"account": F.when(F.col("section") == "ACCOUNT", F.col("number"))}, chunk=min(chunk, CHUNK)).withColumn("account", F.coalesce("account", F.lit(account).cast("string")))
    money = F.col("section").isin(*SECTIONS)
    problem = (
        F.when(F.col("section") == "INVST", "investment").when(F.col("began").isNotNull() & (F.col("stray") > F.col("began")), "inside").when(F.col("ends") == 0, "open")
        .when(money & ((F.col("days") != 1) | (F.col("amounts") != 1)), "fields").when(money & F.col("account").isNull(), "account")
    )
    only = lambda c: F.when(money, F.col(c)).alias(c)
    return held.select("file", "record", "began", "section", "account", only("day"), only("amount"), only("number"), problem.alias("problem"))
