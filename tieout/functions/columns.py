"""Column expressions: exact amounts, strict dates, clean and comparable text, digests. Everything stays inside generated code
but the folding of text beyond ASCII, which is a pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tieout.model import AMOUNT

ZERO_DECIMAL = tuple("BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX UYI VND VUV XAF XOF XPF".split())
THREE_DECIMAL = tuple("BHD IQD JOD KWD LYD OMR TND".split())


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


#: All that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def cleaned(c: Column) -> Column:
    """Without Unicode white space around it; empty becomes null. A trim, as it is made for several texts of every row: a pattern costs many times that."""
    return F.nullif(F.btrim(c, F.lit(WHITE)), F.lit(""))


def amount(c: Column, decimal: str = ".", grouping: str | None = None) -> Column:
    """The exact amount of a text, or null where it is not one: an optional sign, digits with an optional decimal separator, at most
    six decimals, groups of exactly three, at most 19 digits in all, at most 64 bytes, no exponent, no white space."""
    point = _literal(decimal)
    whole = rf"[0-9]{{1,3}}(?:{_literal(grouping)}[0-9]{{3}})+|[0-9]*" if grouping else "[0-9]*"
    shape = c.rlike(rf"\A[+-]?(?:{whole})(?:{point}[0-9]{{0,6}})?\z") & (F.octet_length(c) <= 64)
    plain = F.replace(c, F.lit(grouping), F.lit("")) if grouping else c
    plain = F.replace(plain, F.lit(decimal), F.lit(".")) if decimal != "." else plain
    digits = F.length(F.regexp_replace(plain, "[^0-9]", ""))
    unsigned = F.regexp_replace(F.regexp_replace(plain, r"^\+", ""), r"^(-?)\.", "$10.")
    value = F.regexp_replace(unsigned, r"\.$", "").try_cast(AMOUNT)
    # the mantissa without the fraction's trailing zeros must fit a signed 64-bit number
    mantissa = F.regexp_replace(F.regexp_replace(amount_text(value), r"[.-]", ""), "^$", "0").try_cast("decimal(25,0)")
    return F.when(shape & (digits >= 1) & (digits <= 19) & (mantissa <= F.lit(2**63 - 1)), value)


def amount_text(c: Column) -> Column:
    """Plain decimal without exponent or trailing zeros, of sums too, which are wider than amounts."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", "")


def iso_date(c: Column) -> Column:
    """Exactly ten bytes, year-month-day, a real day; else null."""
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c.try_cast("date"))


def _from_parts(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def delimited_date(c: Column, order: str = "ymd") -> Column:
    """Ten bytes, separated by - or /, padded with zeros, in the declared order."""
    place = {"ymd": r"\A([0-9]{4})([-/])([0-9]{2})\2([0-9]{2})\z", "dmy": r"\A([0-9]{2})([-/])([0-9]{2})\2([0-9]{4})\z", "mdy": r"\A([0-9]{2})([-/])([0-9]{2})\2([0-9]{4})\z"}[order]
    a, b, d = (F.regexp_extract(c, place, k) for k in (1, 3, 4))
    year, month, day = {"ymd": (a, b, d), "dmy": (d, b, a), "mdy": (d, a, b)}[order]
    return F.when(c.rlike(place), _from_parts(year, month, day))


def pivoted_year(two_digits: Column) -> Column:
    """70 to 99 are the 1900s, 00 to 69 the 2000s."""
    n = two_digits.cast("int")
    return n + F.when(n >= 70, 1900).otherwise(2000)


def compact_date(c: Column) -> Column:
    """Six digits, year-month-day."""
    shape = r"\A([0-9]{2})([0-9]{2})([0-9]{2})\z"
    y, m, d = (F.regexp_extract(c, shape, k) for k in (1, 2, 3))
    return F.when(c.rlike(shape), _from_parts(pivoted_year(F.nullif(y, F.lit(""))).cast("string"), m, d))


def ofx_date(c: Column) -> Column:
    """The first eight digits; what follows is a time."""
    return F.when(c.rlike("^[0-9]{8}"), _from_parts(F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)))


def lenient_date(c: Column, order: str) -> Column:
    """An ISO date at the beginning wins; else three parts between / - . or an apostrophe in the declared order."""
    text = F.replace(F.trim(c), F.lit("'"), F.lit("/"))
    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    parts = F.filter(F.split(text, r"[/.\-]"), lambda p: p != "")
    a, b, d = (F.get(parts, k) for k in (0, 1, 2))
    year, month, day = {"ymd": (a, b, d), "dmy": (d, b, a), "mdy": (d, a, b)}[order]
    full = F.when(F.length(year) == 2, pivoted_year(F.when(year.rlike("^[0-9]{2}$"), year)).cast("string")).when(F.length(year) == 4, year)
    fits = (F.size(parts) == 3) & year.rlike("^[0-9]+$") & month.rlike("^[0-9]{1,2}$") & day.rlike("^[0-9]{1,2}$")
    return F.when(text.rlike(iso), F.substring(text, 1, 10).try_cast("date")).when(fits, _from_parts(full, month, day))


def excel_date(serial: Column, date1904: bool = False) -> Column:
    """Whole days of a serial number; in the 1900 system day 60 never was, and later ones are one too high."""
    n = F.floor(serial).cast("int")
    if date1904:
        return F.when(n >= 0, F.date_add(F.lit("1904-01-01").cast("date"), n))
    return F.when((n >= 1) & (n != 60), F.date_add(F.lit("1899-12-31").cast("date"), n - (n > 60).cast("int")))


def minor_units(currency: Column) -> Column:
    return F.when(currency.isin(*ZERO_DECIMAL), 0).when(currency.isin(*THREE_DECIMAL), 3).otherwise(2)


def implied_amount(c: Column, currency: Column) -> Column:
    """An integer text in minor units."""
    n = F.when(c.rlike(r"\A[+-]?[0-9]{1,18}\z"), c.try_cast("decimal(19,0)"))
    return F.when(minor_units(currency) == 0, n).when(minor_units(currency) == 3, n / F.lit(1000).cast("decimal(4,0)")).otherwise(n / F.lit(100).cast("decimal(3,0)")).cast(AMOUNT)


def signed(value: Column, indicator: Column, reversed_: Column) -> Column:
    """Debits are negative; a reversal turns the sign again; another indicator gives null."""
    sign = F.when(indicator == "CRDT", 1).when(indicator == "DBIT", -1)
    return value * sign * F.when(reversed_, -1).otherwise(1)


def currency(c: Column) -> Column:
    return F.when(F.upper(c).rlike(r"\A[A-Z]{3}\z"), F.upper(c))


def date_distance(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None or x.isascii():
            return x
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)))

    return s.map(one, na_action="ignore")


def comparison_text(reference: Column, description: Column, payee: Column, memo: Column, most: int, ascii_only: bool = False) -> Column:
    """The four texts, cleaned, in one: case, diacritics and width folded, other than letters and digits one space. Null where there is
    none, or where it is longer than ``most`` before folding: such a row has no fuzzy match, it is not cut."""
    joined = F.concat_ws(" ", cleaned(reference), cleaned(description), cleaned(payee), cleaned(memo))
    kept = F.when((F.length(joined) > 0) & (F.length(joined) <= most), joined)
    folded = F.lower(kept) if ascii_only else _fold(F.lower(kept))
    return F.nullif(F.trim(F.regexp_replace(folded, "[^a-z0-9]+" if ascii_only else r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(""))


def similarity_permille(a: Column, b: Column) -> Column:
    """Thousandths, floored; equal texts have 1000."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1000)).otherwise(F.floor((longest - F.levenshtein(a, b)) * 1000 / longest)).cast("long")


def field(c: Column) -> Column:
    """Length in bytes, a colon, the text; null reads as ``<nil>``."""
    text = F.coalesce(c.cast("string"), F.lit("<nil>"))
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def fingerprint(cols: dict[str, Column]) -> Column:
    """SHA-256 over the nineteen fields of a transaction, each with its length, so that no two rows read alike."""
    original = F.array_join(F.transform(F.array_sort(F.map_keys(cols["original_values"])), lambda k: F.concat(field(k), field(F.element_at(cols["original_values"], k)))), "")
    derived = F.array_join(F.array_sort(cols["derived_fields"]), "\u001f")
    plain = ("source_id", "locator", "source_ordinal", "account", "currency", "booking_date", "value_date")
    texts = ("strong_id", "reference", "payee", "description", "memo", "transaction_code", "cleared_status", "category")
    parts = [field(cols[n]) for n in plain] + [field(amount_text(cols[n])) for n in ("amount", "running_balance")] + [field(cols[n]) for n in texts]
    parts += [field(F.coalesce(original, F.lit(""))), field(F.coalesce(derived, F.lit("")))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def exception_key(kind: Column, left: Column, right: Column, fingerprints: Column, detail: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, F.array_join(left, ","), F.array_join(right, ","), F.array_join(fingerprints, ","), detail), 256)


def display_name(c: Column) -> Column:
    """``amountChanged`` as ``Amount Changed``."""
    return F.initcap(F.regexp_replace(c, "([A-Z])", " $1"))


def normalized_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", "")


def whole_second(c: Column) -> Column:
    """Whether a text is a real whole second in UTC, like 2026-01-31T23:59:59Z."""
    shape = c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return F.coalesce(shape & F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull(), F.lit(False))
