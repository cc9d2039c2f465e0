"""Sums that refuse what 64 bits cannot hold.

An amount is a 64-bit whole number and a scale of up to six digits. A sum is a fold in the order of the source; each addition brings both
sides to the larger scale, and a sum, or a side so rescaled, that leaves 64 bits refuses the whole. Spark's decimals are wider, so nothing
overflows here: prefixes are computed exactly and looked at.

A fold over many rows is put together from chunks of ordinals: each gives its (sum, least prefix, greatest prefix), these compose in order,
and a row's prefix is its chunk's offset plus the prefix inside. No task sorts more than a chunk's rows or a row for each chunk.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

PARTITION = ("account", "currency")
LEAST, GREATEST, SCALES = -(2**63), 2**63 - 1, 6
#: Ordinals of one chunk; they are unique in a source, so a chunk has no more rows.
CHUNK = 1 << 16


def _decimal(value: int, scale: int) -> str:
    return f"cast('{Decimal(value).scaleb(-scale)}' as decimal(25,6))"


def scale_of(c: str) -> str:
    """SQL of the digits behind the point that an amount, a decimal with six, needs."""
    return f"length(trim(trailing '0' from substring_index(cast({c} as string), '.', -1)))"


def fits(c: str, scale: str) -> str:
    """SQL of whether an amount at ``scale`` is a 64-bit whole number."""
    bounds = lambda value: f"element_at(array({', '.join(_decimal(value, k) for k in range(SCALES + 1))}), {scale} + 1)"
    return f"{c} between {bounds(LEAST)} and {bounds(GREATEST)}"


def added(a: str, b: str, total: str) -> Column:
    """Whether ``a + b = total`` (expressions) is an addition that 64 bits allow."""
    scale = f"greatest({scale_of(a)}, {scale_of(b)})"
    return F.expr(" and ".join(f"({fits(x, scale)})" for x in (a, b, total)))


def _prefixes(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Chunks with their summaries and offsets, and rows with the prefix inside their chunk."""
    exact = rows.select(*PARTITION, "source_ordinal", F.col("amount").cast("decimal(31,6)").alias("amount"), F.expr(f"source_ordinal div {chunk}").alias("chunk"))
    inside = Window.partitionBy(*PARTITION, "chunk").orderBy("source_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    inner = exact.withColumn("inner", F.sum("amount").over(inside).cast("decimal(38,6)"))
    chunks = inner.groupBy(*PARTITION, "chunk").agg(F.sum("amount").cast("decimal(38,6)").alias("total"), F.min("inner").alias("least"), F.max("inner").alias("greatest"))
    before = Window.partitionBy(*PARTITION).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("off", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("decimal(38,6)")), inner


def checked_sums(rows: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Per partition: ``total``, the ``least`` and ``greatest`` prefix of the fold in source order, and whether the fold ``overflows``.

    ``rows``: ``account``, ``currency``, ``source_ordinal``, ``amount`` (whole numbers, or decimals of up to six digits behind the point).
    """
    chunks, inner = _prefixes(rows, chunk)
    whole = chunks.groupBy(*PARTITION).agg(F.sum("total").cast("decimal(38,6)").alias("total"), F.min(F.col("off") + F.col("least")).cast("decimal(38,6)").alias("least"), F.max(F.col("off") + F.col("greatest")).cast("decimal(38,6)").alias("greatest"))
    moved = inner.join(chunks.select(*PARTITION, "chunk", "off"), [*PARTITION, "chunk"]).selectExpr(*PARTITION, "amount", "cast(off + inner as decimal(38,6)) now")
    steps = moved.selectExpr(*PARTITION, "amount", "now", "cast(now - amount as decimal(38,6)) before").select(*PARTITION, (~added("before", "amount", "now")).alias("over"))
    return whole.join(steps.groupBy(*PARTITION).agg(F.bool_or("over").alias("overflows")), list(PARTITION))


def overflowing(rows: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The partitions whose fold overflows. Only those whose amounts could do so in any order and at any scale are looked at row by row;
    in all others the sum of the magnitudes says that none can."""
    kind = rows.schema["amount"].dataType
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    mass = rows.groupBy(*PARTITION).agg(F.sum(F.abs(F.col("amount").cast("decimal(31,6)"))).alias("mass")).filter(f"mass > {_decimal(GREATEST, scale)}")
    if not mass.limit(1).count():
        return rows.select(*PARTITION).limit(0)
    could = rows.alias("r").join(mass.alias("m"), reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in PARTITION]), "left_semi")
    return checked_sums(could, chunk=chunk).filter("overflows")


def unfit(totals: DataFrame) -> DataFrame:
    """Totals (``left``, ``right``, ``difference``) that 64 bits cannot hold."""
    exact = totals.select("*", *[F.col(c).cast("decimal(38,6)").alias(f"{c}_") for c in ("left", "right", "difference")])
    return exact.filter(~added("left_", "right_", "difference_")).drop("left_", "right_", "difference_")
