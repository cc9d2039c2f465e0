"""QIF: a state machine over lines, with section and account carried along."""

from __future__ import annotations

from tieout.model import InvalidConfiguration, MalformedInput, Period
from tieout.sources.records import Limits, Profile, Statement, amount_of, bounded, clean, currency_of, lenient_date, source_id

SECTIONS = ("BANK", "CASH", "CCARD", "OTHA", "OTHL")


def parse(data: bytes, period: Period, profile: Profile, *, balances: tuple = (), limits: Limits = Limits()) -> Statement:
    """Rows of the money sections; other sections are skipped, investments refused. A record ends with ``^`` and not before."""
    limits.check_size(data)
    if profile.currency is None:
        raise InvalidConfiguration("QIF needs a currency")
    out, account, section, record, began = Statement(source_id(data), period, limits=limits), profile.account, None, {}, 0
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
        out.warnings.append("read as Windows-1252")
    bounded(text, limits)
    for number, line in enumerate(text.removeprefix("﻿").replace("\r\n", "\n").split("\n"), start=1):
        if not line.strip():
            if record:
                raise MalformedInput(f"a blank line inside the record of line {began}")
            continue
        if line.startswith("!"):
            if record:
                raise MalformedInput(f"a section inside the record of line {began}")
            name = line[1:].strip()
            if name.lower().startswith("option:"):
                continue
            section = "ACCOUNT" if name.lower() == "account" else name.partition(":")[2].upper() if name.lower().startswith("type:") else "OTHER"
            if section == "INVST":
                raise MalformedInput("investment accounts")
            continue
        if line[0] != "^":
            began = began if record else number
            record.setdefault(line[0], []).append(line[1:])
            continue
        if section == "ACCOUNT":
            account = clean((record.get("N") or [""])[0]) or account
        elif section in SECTIONS:
            if len(record.get("D", [])) != 1 or len(record.get("T", [])) != 1:
                raise MalformedInput(f"the record of line {began} needs one date and one amount")
            if not account:
                raise InvalidConfiguration("QIF needs an account")
            get = lambda k: clean((record.get(k) or [""])[0])  # noqa: B023, E731
            out.add(locator=f"line:{began}", account=account, currency=currency_of(profile.currency), booking_date=lenient_date(record["D"][0], profile.date_order), amount=amount_of(record["T"][0].strip(), profile.decimal, profile.grouping), strong_id=get("N"), reference=get("N"), payee=get("P"), memo=get("M"), description=get("M") or get("P"), cleared_status=get("C"), category=get("L"))
        record = {}
    if record:
        raise MalformedInput(f"the record of line {began} does not end")
    out.balances = list(balances)
    return out
