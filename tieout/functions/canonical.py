"""Canonical JSON as a column: keys sorted, nulls written, no spaces, only needed escapes; an amount says its mantissa, scale and text.

The encoder follows the schema and is made of expressions, so a row's text comes from generated code wherever the row lies. It is byte-equal to
``tieout.evidence.canonical`` over the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, IntegralType, MapType, StringType, StructType

from tieout.functions.columns import amount_text
from tieout.model import InvalidConfiguration

_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
#: A backslash first, as the others bring their own.
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), *((chr(k), _SHORT.get(k, f"\\u{k:04x}")) for k in range(32))]


def text(c: Column) -> Column:
    """A JSON string; the escapes run only for texts that need one."""
    escaped = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES, c)
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(c), F.lit('"'))


def amount(c: Column) -> Column:
    """An exact decimal as an object of its canonical text, its mantissa without trailing zeros, and its scale."""
    shown = amount_text(c)
    scale = F.length(F.regexp_extract(shown, r"\.(.*)$", 1))
    mantissa = F.regexp_replace(F.replace(shown, F.lit("."), F.lit("")), r"^(-?)0+(?=[0-9])", "$1")
    return F.concat(F.lit('{"canonical":"'), shown, F.lit('","mantissa":'), mantissa, F.lit(',"scale":'), scale.cast("string"), F.lit("}"))


def encoded(c: Column, kind: DataType) -> Column:
    """The JSON text of a value of this type, never null."""
    if isinstance(kind, StructType):
        return F.when(c.isNull(), "null").otherwise(_object([(f.name, encoded(c.getField(f.name), f.dataType)) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        body = F.array_join(F.transform(c, lambda x: encoded(x, kind.elementType)), ",")
        return _whole(c, F.concat(F.lit("["), body, F.lit("]")))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entry = lambda k: F.concat(text(k), F.lit(":"), encoded(F.element_at(c, k), kind.valueType))
        return _whole(c, F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), entry), ","), F.lit("}")))
    if isinstance(kind, StringType):
        return _whole(c, text(c))
    if isinstance(kind, DecimalType):
        return _whole(c, amount(c))
    if isinstance(kind, DateType):
        return _whole(c, F.concat(F.lit('"'), c.cast("string"), F.lit('"')))
    if isinstance(kind, IntegralType | BooleanType):
        return _whole(c, c.cast("string"))
    raise InvalidConfiguration(f"{kind.simpleString()} has no canonical text")


def _whole(c: Column, made: Column) -> Column:
    return F.when(c.isNull(), "null").otherwise(made)


def _object(fields: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(f'{"," if k else ""}"{name}":'), value) for k, (name, value) in enumerate(sorted(fields, key=lambda f: f[0]))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def canonical_row(df: DataFrame) -> Column:
    """The canonical text of each row of ``df``."""
    return _object([(f.name, encoded(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields])
