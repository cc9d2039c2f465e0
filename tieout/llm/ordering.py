"""Seeded orders and running sums over them without a window that spans a source or the table."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of md5 read as a number: 13 digits are 52 bits, exact in a double.
_HEX = 13
#: Rows that one range of an order holds about, at least and at most; a window sorts so many at once.
RANGE_ROWS = (1_000, 20_000)


def shuffle_key(column: str, seed: int, *more: Column) -> Column:
    """A uniform text key of a value; null has a key too. ``more``: what else tells rows apart that share the value, so that
    neither a null nor a repeated one holds many rows together."""
    rest = [F.lit(":"), F.xxhash64(*more).cast("string")] if more else []
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null")), *rest))


def key_range(key: Column, ranges: int) -> Column:
    """The range, 0 to ``ranges - 1``, of a key of :func:`shuffle_key`; ranges ascend with the key."""
    number = F.conv(F.substring(key, 1, _HEX), 16, 10).cast("double")
    return F.floor(number / F.lit(float(16**_HEX)) * ranges).cast("int")


def ranges_for(rows: int | None, range_rows: int | None = None) -> int:
    """Ranges of about ``range_rows`` rows; by default their number and their size grow alike until a size that a task sorts well."""
    rows = int(rows or 0)
    return max(1, -(-rows // (range_rows or min(max(isqrt(rows), RANGE_ROWS[0]), RANGE_ROWS[1]))))


def spare(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it in any case of letters."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def before(df: DataFrame, keys: list[str], bucket: str, amount: Column, out: str, total: str) -> DataFrame:
    """Per bucket, within ``keys``: the sum of ``amount`` before it (``out``) and in it (``total``)."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(amount).alias(total))
    order = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, total, F.coalesce(F.sum(total).over(order), F.lit(0)).cast("long").alias(out))


def stratum(source_column: str) -> Column:
    """The source as a text that is never null: nulls are a stratum of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_column}`").cast("string")), F.lit(""))
