"""ISO 20022 CAMT.053 statements and CAMT.054 notifications, versions 02 to 08."""

from __future__ import annotations

import re

from tieout.model import MalformedInput, Period
from tieout.sources import xmltree as X
from tieout.sources.records import Limits, Profile, Statement, amount_of, iso_date, source_id

REFERENCES = ("EndToEndId", "InstrId", "TxId", "MsgId", "PmtInfId", "ChqNb")


def signed(value, indicator: str | None, reversed_: bool):
    if indicator not in ("CRDT", "DBIT"):
        raise MalformedInput(f"indicator {indicator}")
    return -value if (indicator == "DBIT") != reversed_ else value


def _day(e):
    found = X.text(X.at(e, "Dt")) or X.text(X.at(e, "DtTm"))
    return iso_date(found[:10]) if found else None


def parse(data: bytes, period: Period, profile: Profile = Profile(), *, balances: tuple = (), limits: Limits = Limits()) -> Statement:
    limits.check_size(data)
    root, out = X.parse(data, limits), Statement(source_id(data), period, limits=limits)
    m = re.match(r"\{urn:iso:std:iso:20022:tech:xsd:camt\.05([34])\.001\.0([2-8])\}", root.tag)
    if not m:
        raise MalformedInput("no CAMT document of a known version")
    notification = m[1] == "4"
    statements = X.descendants(root, "Ntfctn" if notification else "Stmt")
    if not statements:
        raise MalformedInput("no statement")
    for s, statement in enumerate(statements):
        identity = X.at(statement, "Acct", "Id")
        account = X.text(X.at(identity, "IBAN")) or X.text(X.at(identity, "Othr", "Id")) or profile.account
        if not account:
            raise MalformedInput("no account")
        for b in X.children(statement, "Bal"):
            code = X.text(X.at(b, "Tp", "CdOrPrtry", "Cd"))
            if code in ("OPBD", "CLBD"):
                money = X.only(b, "Amt")
                value = signed(amount_of(X.text(money) or ""), X.text(X.only(b, "CdtDbtInd")), False)
                out.balance("opening" if code == "OPBD" else "closing", account, money.get("Ccy", ""), _day(X.at(b, "Dt")), value, f"statement:{s}:{code}")
        for k, entry in enumerate(X.children(statement, "Ntry")):
            money, booked = X.only(entry, "Amt"), _day(X.at(entry, "BookgDt")) or _day(X.at(entry, "ValDt"))
            if booked is None:
                raise MalformedInput("an entry without a date")
            value = signed(amount_of(X.text(money) or ""), X.text(X.only(entry, "CdtDbtInd")), X.text(X.at(entry, "RvslInd")) == "true")
            references = [t for n in REFERENCES for t in (X.text(e) for e in X.descendants(entry, n)) if t]
            remittance = " ".join(t for t in (X.text(e) for e in X.descendants(entry, "Ustrd")) if t) or None
            note = " ".join(t for t in (X.text(X.at(entry, "AddtlNtryInf")), remittance) if t) or None
            out.add(locator=f"statement:{s}:entry:{k}", account=account, currency=money.get("Ccy", ""), booking_date=booked, value_date=_day(X.at(entry, "ValDt")), amount=value, strong_id=X.text(X.at(entry, "AcctSvcrRef")) or X.text(X.at(entry, "NtryRef")), reference=" | ".join(references) or None, memo=remittance, description=note, transaction_code=X.text(X.at(entry, "BkTxCd", "Prtry", "Cd")))
    out.completeness = "notificationOnly" if notification else "complete"
    out.balances += list(balances)
    return out
