"""OFX, QFX and QBO: XML, or SGML whose leaves do not close."""

from __future__ import annotations

import html
import re
from xml.etree.ElementTree import Element, SubElement

from tieout.model import InvalidDate, MalformedInput, Period, ResourceLimit
from tieout.sources import xmltree as X
from tieout.sources.records import Limits, Profile, Statement, amount_of, currency_of, iso_date, source_id

# Tags that hold others; every other tag is a leaf.
CONTAINERS = frozenset(
    "OFX SIGNONMSGSRSV1 SONRS STATUS BANKMSGSRSV1 STMTTRNRS STMTRS BANKACCTFROM BANKTRANLIST STMTTRN LEDGERBAL AVAILBAL CREDITCARDMSGSRSV1 CCSTMTTRNRS CCSTMTRS CCACCTFROM CCBANKTRANLIST".split()
)
_ENTITY = re.compile(r"&([^;&\s]*);?")


def _unescaped(text: str) -> str:
    def one(m):
        if re.fullmatch(r"amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+", m[1]):
            return html.unescape(f"&{m[1]};")
        raise MalformedInput(f"entity {m[0]}")

    return _ENTITY.sub(one, text)


def sgml(text: str, limits: Limits = Limits()) -> Element:
    """Tags of the known containers nest; every other tag is a leaf with the text behind it."""
    root, stack, nodes = None, [], 0
    for close, name, value in re.findall(r"<(/?)([A-Za-z0-9.]+)>([^<]*)", text):
        name, nodes = name.upper(), nodes + (not close)
        if nodes > limits.xml_nodes or len(stack) > limits.xml_depth or len(value.strip().encode()) > limits.field_bytes:
            raise ResourceLimit("tags, depth or a field of the document")
        if close:
            if name in CONTAINERS:
                if not stack or stack[-1].tag != name:
                    raise MalformedInput(f"</{name}> at a wrong place")
                stack.pop()
        elif name in CONTAINERS:
            element = SubElement(stack[-1], name) if stack else Element(name)
            root = element if root is None else root
            stack.append(element)
        else:
            if not stack:
                raise MalformedInput(f"<{name}> outside the document")
            SubElement(stack[-1], name).text = _unescaped(value.strip())
    if root is None or stack:
        raise MalformedInput("the document does not close")
    return root


def ofx_date(text: str | None):
    if not text or not re.match("[0-9]{8}", text):
        raise InvalidDate(str(text))
    return iso_date(f"{text[:4]}-{text[4:6]}-{text[6:8]}")


def _optional(e: Element, name: str) -> str | None:
    found = [t for t in (X.text(c) for c in X.children(e, name)) if t]
    return found[0] if len(found) == 1 else None


def _required(e: Element, name: str, fallback: str | None = None) -> str:
    found = [t for t in (X.text(c) for c in X.descendants(e, name)) if t]
    if len(found) == 1:
        return found[0]
    if fallback:
        return fallback
    raise MalformedInput(f"{len(found)} values of {name}")


def parse(data: bytes, period: Period, profile: Profile = Profile(), *, balances: tuple = (), limits: Limits = Limits()) -> Statement:
    """Bank and card statements. Only a closing balance is in the format; a range short of the period is incomplete."""
    limits.check_size(data)
    out = Statement(source_id(data), period, limits=limits)
    begin = re.search(rb"<OFX", data, re.I)
    if not begin:
        raise MalformedInput("no OFX")
    head = data[: begin.start()]
    if b"<?xml" in head:
        root = X.parse(data[begin.start() :], limits)
    else:
        kind = "utf-8" if re.search(rb"ENCODING:\s*(UTF-8|UNICODE)", head) else "cp1252" if b"CHARSET:1252" in head else "ascii"
        try:
            root = sgml(data[begin.start() :].decode(kind), limits)
        except UnicodeDecodeError as e:
            raise MalformedInput("text in another character set than declared") from e
    statements = X.descendants(root, "STMTRS") + X.descendants(root, "CCSTMTRS")
    if not statements:
        raise MalformedInput("no statement")
    for s, statement in enumerate(statements):
        account, currency = _required(statement, "ACCTID", profile.account), currency_of(_required(statement, "CURDEF", profile.currency))
        for k, t in enumerate(X.descendants(statement, "STMTTRN")):
            out.add(locator=f"statement:{s}:transaction:{k}", account=account, currency=currency, booking_date=ofx_date(_required(t, "DTPOSTED")), amount=amount_of(_required(t, "TRNAMT")), strong_id=_optional(t, "FITID"), reference=_optional(t, "REFNUM") or _optional(t, "CHECKNUM"), payee=_optional(t, "NAME"), description=_optional(t, "MEMO"), memo=_optional(t, "MEMO"), transaction_code=_optional(t, "TRNTYPE"))
        if (ledger := X.at(statement, "LEDGERBAL")) is not None:
            out.balance("closing", account, currency, ofx_date(_required(ledger, "DTASOF")), amount_of(_required(ledger, "BALAMT")), f"statement:{s}:ledger")
        listed = next((x for x in (X.at(statement, t) for t in ("BANKTRANLIST", "CCBANKTRANLIST")) if x is not None), None)
        if listed is not None and (ofx_date(_required(listed, "DTSTART")) > period.start or ofx_date(_required(listed, "DTEND")) < period.end):
            out.completeness = "incomplete"
            out.warnings.append("the listed range does not span the period")
    out.balances += list(balances)
    return out
