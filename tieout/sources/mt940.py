"""SWIFT MT940 statements."""

from __future__ import annotations

import re

from tieout.model import MalformedInput, Period
from tieout.sources.records import Limits, Statement, amount_of, clean, compact_date, currency_of, decoded, source_id

_TAG = re.compile(r":([0-9]{2}[A-Z]?):(.*)")
_ENTRY = re.compile(r"([0-9]{6})([0-9]{4})?(RC|RD|C|D)([A-Z])?([0-9]*,[0-9]*)([NFS][A-Z0-9]{3})(.*)", re.S)
_BALANCE = re.compile(r"([CD])([0-9]{6})([A-Z]{3})([0-9]*,[0-9]*)")


def tagged(text: str) -> list[tuple[str, str]]:
    """Tags with their lines; lines without a tag belong to the tag before."""
    out: list[list[str]] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.strip() in ("", "-", "-}") or line.startswith("{"):
            continue
        if m := _TAG.match(line):
            out.append([m[1], m[2]])
        elif out:
            out[-1][1] += "\n" + line
        else:
            raise MalformedInput("text before the first tag")
    return [(t, v) for t, v in out]


def _one(segment: list[tuple[str, str]], *tags: str) -> str:
    found = [v for t, v in segment if t in tags]
    if len(found) != 1:
        raise MalformedInput(f"{len(found)} fields of :{'/'.join(tags)}:")
    return found[0]


def _balance(text: str):
    m = _BALANCE.fullmatch(text.strip())
    if not m:
        raise MalformedInput(f"balance {text}")
    value = amount_of(m[4], ",")
    return compact_date(m[2]), currency_of(m[3]), -value if m[1] == "D" else value


def parse(data: bytes, period: Period, *, balances: tuple = (), limits: Limits = Limits()) -> Statement:
    """The booking date is the value date; text before ``//`` is the reference, after it the strong id."""
    limits.check_size(data)
    out, segments = Statement(source_id(data), period, limits=limits), []
    for tag, value in tagged(decoded(data, "the statement", limits)):
        if tag == "20":
            segments.append([])
        elif not segments:
            raise MalformedInput(f":{tag}: before :20:")
        segments[-1].append((tag, value))
    if not segments:
        raise MalformedInput("no statement")
    for s, segment in enumerate(segments):
        account = clean(_one(segment, "25")) or ""
        _one(segment, "20"), _one(segment, "28C")
        opened, currency, opening = _balance(_one(segment, "60F", "60M"))
        closed, closing_currency, closing = _balance(_one(segment, "62F", "62M"))
        if currency != closing_currency or not account:
            raise MalformedInput("a statement in two currencies or without an account")
        out.balance("opening", account, currency, opened, opening, f"statement:{s}:opening")
        out.balance("closing", account, currency, closed, closing, f"statement:{s}:closing")
        for k, (tag, value) in enumerate(segment):
            if tag != "61":
                continue
            m = _ENTRY.fullmatch(value)
            if not m:
                raise MalformedInput(f"entry {value}")
            own = amount_of(m[5], ",")
            reference, _, bank = m[7].split("\n")[0].partition("//")
            note = segment[k + 1][1] if k + 1 < len(segment) and segment[k + 1][0] == "86" else None
            day = compact_date(m[1])
            out.add(locator=f"statement:{s}:entry:{k}", account=account, currency=currency, booking_date=day, value_date=day, amount=own if m[3] in ("C", "RD") else -own, transaction_code=m[6], reference=clean(reference), strong_id=clean(bank), description=clean(note))
    out.balances += list(balances)
    return out
