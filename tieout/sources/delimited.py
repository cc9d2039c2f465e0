"""CSV and TSV with a declared mapping of columns. One bad row refuses the file."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from tieout.model import InvalidConfiguration, MalformedInput, Period, ResourceLimit
from tieout.sources.records import Limits, Statement, amount_of, clean, currency_of, decoded, delimited_date, source_id

# Headers that name a field, after lower-casing and dropping all but letters, marks and digits.
ALIASES = {
    "date": "date transactiondate bookingdate posteddate datum buchungsdatum fecha fechacontable data".split(),
    "amount": "amount transactionamount montant betrag importe valor valore".split(),
    "account": "account accountid accountnumber compte konto cuenta conta".split(),
    "currency": "currency currencycode devise wahrung moneda moeda".split(),
    "strong_id": "id transactionid fitid uniqueid identifiant belegnummer".split(),
    "reference": "reference ref checknumber endtoendid referenz referencia".split(),
    "description": "description memo payee narrative libelle beschreibung descripcion descricao".split(),
    "balance": "balance runningbalance solde saldo kontostand".split(),
}


@dataclass(frozen=True)
class Mapping:
    """Column numbers from 0; ``account`` and ``currency`` may be left to defaults."""

    date: int
    amount: int
    account: int | None = None
    currency: int | None = None
    value_date: int | None = None
    balance: int | None = None
    strong_id: int | None = None
    reference: int | None = None
    payee: int | None = None
    description: int | None = None
    memo: int | None = None
    default_account: str | None = None
    default_currency: str | None = None
    date_order: str = "ymd"
    decimal: str = "."
    grouping: str | None = None
    header: bool = True

    def __post_init__(self):
        used = [v for v in self.__dict__.values() if isinstance(v, int) and not isinstance(v, bool)]
        if len(set(used)) != len(used) or min(used) < 0:
            raise InvalidConfiguration("each column is mapped once")


def tokenize(text: str, delimiter: str, limits: Limits = Limits()) -> Iterator[tuple[int, list[str]]]:
    """``(first line, cells)`` of every record. LF, CRLF and CR end records; a doubled quote inside quotes is one quote."""
    if len(text) > limits.scalars:
        raise ResourceLimit(f"{len(text)} characters")
    cell, cells, line, first, state, at, n = [], [], 1, 1, "start", 0, len(text)

    def close() -> None:
        value = "".join(cell)
        if len(value.encode()) > limits.field_bytes or len(cells) >= limits.columns:
            raise ResourceLimit(f"line {line}")
        cells.append(value)
        cell.clear()

    while at < n:
        c = text[at]
        at += 1
        newline = c in "\r\n"
        if c == "\r" and text[at : at + 1] == "\n":
            at += 1
            ended = "\r\n"
        else:
            ended = c
        if state == "quoted":
            if c == '"':
                if text[at : at + 1] == '"':
                    cell.append('"')
                    at += 1
                else:
                    state = "closed"
            else:
                cell.append(ended if newline else c)
                line += newline
        elif newline:
            close()
            yield first, cells
            cells, state = [], "start"
            line += 1
            first = line
        elif c == delimiter:
            close()
            state = "start"
        elif c == '"':
            if state != "start":
                raise MalformedInput(f"a quote inside a cell in line {line}")
            state = "quoted"
        elif state == "closed":
            raise MalformedInput(f"text behind a closing quote in line {line}")
        else:
            cell.append(c)
            state = "plain"
    if state == "quoted":
        raise MalformedInput(f"a quote that does not close, from line {first}")
    if cells or cell or state != "start":
        close()
        yield first, cells


def parse(data: bytes, period: Period, mapping: Mapping, *, delimiter: str = ",", balances: tuple = (), limits: Limits = Limits()) -> Statement:
    """The rows of a file. Blank lines are skipped before widths are compared and take no ordinal; the first row is the header,
    if there is one, and says how wide all rows are."""
    limits.check_size(data)
    out = Statement(source_id(data), period, limits=limits)
    rows = [(line, cells) for line, cells in tokenize(decoded(data, "the file"), delimiter, limits) if any(c.strip() for c in cells)]
    if not rows:
        raise MalformedInput("no rows")
    width, body = len(rows[0][1]), rows[mapping.header :]
    if len(body) > limits.records:
        raise ResourceLimit(f"{len(body)} records")
    for line, cells in body:
        if len(cells) != width:
            raise MalformedInput(f"line {line} has {len(cells)} cells, not {width}")

        def at(k: int | None) -> str | None:
            if k is None:
                return None
            if k >= width:
                raise InvalidConfiguration(f"no column {k}")
            return clean(cells[k])  # noqa: B023

        derived, values = [], {}
        for name, default in (("account", mapping.default_account), ("currency", mapping.default_currency)):
            found = at(getattr(mapping, name))
            if found is None:
                if default is None:
                    raise MalformedInput(f"line {line} has no {name}")
                found = default
                derived.append(name)
            values[name] = found
        money = lambda text: amount_of(text, mapping.decimal, mapping.grouping)
        value_date, balance = at(mapping.value_date), at(mapping.balance)
        out.add(
            locator=f"line:{line}", account=values["account"], currency=currency_of(values["currency"]), booking_date=delimited_date(at(mapping.date) or "", mapping.date_order), amount=money(at(mapping.amount) or ""),
            value_date=delimited_date(value_date, mapping.date_order) if value_date else None, running_balance=money(balance) if balance else None,
            **{n: at(getattr(mapping, n)) for n in ("strong_id", "reference", "payee", "description", "memo")},
            original_values={f"column:{k}": c for k, c in enumerate(cells)}, derived_fields=derived,
        )
    out.balances = list(balances)
    return out


def normalized(header: str) -> str:
    return re.sub(r"[^\w]|_", "", header.strip().lower())


def infer_mapping(data: bytes, *, tab: bool = False, account: str = "Primary", currency: str = "USD") -> tuple[str, Mapping]:
    """Delimiter and mapping from the first record; a file without a date or amount column is refused. A default account or currency stands
    in for a column that the file does not have, never for an empty cell of one that it has."""
    head = decoded(data, "the file").split("\n", 1)[0]
    bare = re.sub(r'"(?:[^"]|"")*"', "", head)
    counts = Counter({d: bare.count(d) for d in ",;\t|"})
    delimiter = "\t" if tab else max(",;\t|", key=lambda d: counts[d])
    names = [normalized(c) for c in next(iter(tokenize(head.rstrip("\r"), delimiter)))[1]]
    found = {f: next((k for k, n in enumerate(names) if n in a), None) for f, a in ALIASES.items()}
    if found["date"] is None or found["amount"] is None:
        raise InvalidConfiguration("date and amount columns were not recognised; state a mapping")
    absent = lambda name, default: default if found[name] is None else None
    return delimiter, Mapping(**found, default_account=absent("account", account), default_currency=absent("currency", currency))
