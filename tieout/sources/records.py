"""What parsers share: limits, exact values from text, rows of the canonical schema."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from tieout.functions.columns import THREE_DECIMAL, ZERO_DECIMAL
from tieout.model import InvalidAmount, InvalidConfiguration, InvalidCurrency, InvalidDate, MalformedInput, Period, PeriodViolation, ResourceLimit


@dataclass(frozen=True)
class Limits:
    """A file beyond any of these is refused whole."""

    bytes: int = 64 << 20
    records: int = 500_000
    columns: int = 256
    field_bytes: int = 16_384
    scalars: int = 10_000_000
    archive_entries: int = 1_024
    expanded_bytes: int = 128 << 20
    xml_nodes: int = 2_000_000
    xml_depth: int = 128

    def check_size(self, data: bytes) -> None:
        if len(data) > self.bytes:
            raise ResourceLimit(f"{len(data)} bytes")


@dataclass(frozen=True)
class Profile:
    """How to read formats that do not say everything themselves."""

    date_order: str = "mdy"
    decimal: str = "."
    grouping: str | None = ","
    account: str | None = None
    currency: str | None = None

    def __post_init__(self):
        if len(self.decimal) != 1 or (self.grouping is not None and (len(self.grouping) != 1 or self.grouping == self.decimal)):
            raise InvalidConfiguration("separators are single, different characters")


@dataclass
class Statement:
    """A parsed file: rows and balances as dicts of the canonical columns."""

    source_id: str
    period: Period
    transactions: list[dict] = field(default_factory=list)
    balances: list[dict] = field(default_factory=list)
    completeness: str = "complete"
    warnings: list[str] = field(default_factory=list)
    limits: Limits = Limits()

    def add(self, **values) -> None:
        if len(self.transactions) >= self.limits.records:
            raise ResourceLimit(f"more than {self.limits.records} records")
        for name, value in values.items():
            if isinstance(value, str) and len(value.encode()) > self.limits.field_bytes:
                raise ResourceLimit(f"{name} of {values['locator'][:80]}")
        if not self.period.start <= values["booking_date"] <= self.period.end:
            raise PeriodViolation(f"{values['locator']} is booked on {values['booking_date']}")
        row = {"source_id": self.source_id, "source_ordinal": len(self.transactions), "original_values": {}, "derived_fields": []}
        self.transactions.append(row | values)

    def balance(self, kind: str, account: str, currency: str, on: date, amount: Decimal, locator: str) -> None:
        self.balances.append({"kind": kind, "account": account, "currency": currency, "date": on, "amount": amount, "locator": locator})


def source_id(data: bytes) -> str:
    return "source-" + hashlib.sha256(data).hexdigest()


def clean(text: str | None) -> str | None:
    return (text or "").strip() or None


def amount_of(text: str, decimal: str = ".", grouping: str | None = None) -> Decimal:
    """As ``functions.columns.amount``, but raising."""
    d = re.escape(decimal)
    whole = rf"(?:[0-9]{{1,3}}(?:{re.escape(grouping)}[0-9]{{3}})+|[0-9]*)" if grouping else "[0-9]*"
    if len(text.encode()) > 64 or not re.fullmatch(rf"[+-]?{whole}(?:{d}[0-9]{{0,6}})?", text):
        raise InvalidAmount(text)
    plain = (text.replace(grouping, "") if grouping else text).replace(decimal, ".")
    digits = re.sub("[^0-9]", "", plain)
    if not 1 <= len(digits) <= 19:
        raise InvalidAmount(text)
    value = Decimal(plain + "0" if plain.endswith(".") else plain)
    if abs(int(value.normalize().scaleb(-value.normalize().as_tuple().exponent))) > 2**63 - 1:
        raise InvalidAmount(text)
    return value


def implied_amount(text: str, currency: str) -> Decimal:
    if not re.fullmatch(r"[+-]?[0-9]{1,18}", text):
        raise InvalidAmount(text)
    return Decimal(int(text)).scaleb(0 if currency in ZERO_DECIMAL else -3 if currency in THREE_DECIMAL else -2)


def currency_of(text: str | None) -> str:
    code = (text or "").upper()
    if not re.fullmatch("[A-Z]{3}", code):
        raise InvalidCurrency(str(text))
    return code


def _date(y: str, m: str, d: str, text: str) -> date:
    try:
        return date(int(y), int(m), int(d))
    except ValueError as e:
        raise InvalidDate(text) from e


def iso_date(text: str) -> date:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise InvalidDate(text)
    return _date(*text.split("-"), text)


def delimited_date(text: str, order: str) -> date:
    """Ten bytes, zeros kept, one kind of separator."""
    separator = "-" if "-" in text else "/"
    parts = text.split(separator)
    sizes = [4, 2, 2] if order == "ymd" else [2, 2, 4]
    if not text.isascii() or len(parts) != 3 or [len(p) for p in parts] != sizes or not all(p.isdigit() for p in parts):
        raise InvalidDate(text)
    found = dict(zip(order, parts, strict=True))
    return _date(found["y"], found["m"], found["d"], text)


def lenient_date(text: str, order: str) -> date:
    """ISO wins whatever the order; else three parts with short years pivoted at 70."""
    text = text.strip().replace("'", "/")
    if re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return iso_date(text[:10])
    parts = [p.strip() for p in re.split(r"[/.\-]", text) if p.strip()]
    if len(parts) != 3 or not all(p.isascii() and p.isdigit() for p in parts):
        raise InvalidDate(text)
    found = dict(zip(order, parts, strict=True))
    if len(found["y"]) not in (2, 4) or len(found["m"]) > 2 or len(found["d"]) > 2:
        raise InvalidDate(text)
    year = found["y"] if len(found["y"]) == 4 else str(short_year(found["y"]))
    return _date(year, found["m"], found["d"], text)


def short_year(two: str) -> int:
    return int(two) + (1900 if int(two) >= 70 else 2000)


def compact_date(text: str) -> date:
    if not re.fullmatch("[0-9]{6}", text):
        raise InvalidDate(text)
    return _date(str(short_year(text[:2])), text[2:4], text[4:], text)


def bounded(text: str, limits: Limits) -> str:
    """The text, unless it has more characters than a file may have."""
    if len(text) > limits.scalars:
        raise ResourceLimit(f"{len(text)} characters")
    return text


def decoded(data: bytes, what: str, limits: Limits = Limits()) -> str:
    try:
        return bounded(data.decode("utf-8"), limits)
    except UnicodeDecodeError as e:
        raise MalformedInput(f"{what} is not UTF-8") from e
