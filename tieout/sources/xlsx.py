"""XLSX worksheets with a declared mapping of columns."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from datetime import date, timedelta

from tieout.model import InvalidDate, MalformedInput, Period, ResourceLimit
from tieout.sources import xmltree as X
from tieout.sources.delimited import Mapping
from tieout.sources.records import Limits, Statement, amount_of, clean, currency_of, lenient_date, source_id

_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


class Archive:
    """A ZIP within limits: no encryption, links, parent paths, repeated names, extreme ratios or wrong checksums."""

    def __init__(self, data: bytes, limits: Limits = Limits()):
        end = data.rfind(b"PK\5\6")
        # this disk, the directory's disk, entries here and in all; 0xFFFF and 0xFFFFFFFF point to a 64-bit record
        if end >= 0 and len(data) >= end + 22:
            disk, first, here, total, size, offset = struct.unpack("<HHHHII", data[end + 4 : end + 20])
            if disk or first or here != total or 0xFFFF in (here, total) or 0xFFFFFFFF in (size, offset) or data[max(0, end - 20) : end].startswith(b"PK\6\7"):
                raise MalformedInput("an archive of several disks or of 64 bits")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise MalformedInput("no ZIP archive") from e
        names = [i.filename for i in self.zip.infolist()]
        if len(names) > limits.archive_entries or sum(i.file_size for i in self.zip.infolist()) > limits.expanded_bytes:
            raise ResourceLimit("archive entries or size")
        for i in self.zip.infolist():
            linked = (i.external_attr >> 16) & 0o170000 == 0o120000
            if i.flag_bits & 1 or linked or ".." in i.filename.split("/") or i.filename.startswith("/") or i.file_size > 100 * max(1, i.compress_size):
                raise MalformedInput(f"archive entry {i.filename}")
        if len(set(names)) != len(names):
            raise MalformedInput("repeated archive entries")

    def read(self, name: str) -> bytes:
        try:
            return self.zip.read(name)
        except KeyError as e:
            raise MalformedInput(f"no {name}") from e
        except zipfile.BadZipFile as e:
            raise MalformedInput(f"checksum of {name}") from e


def column_index(reference: str) -> int:
    letters = re.match("[A-Za-z]+", reference)
    if not letters:
        raise MalformedInput(f"cell {reference}")
    n = 0
    for c in letters[0].upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def excel_date(serial: str, date1904: bool = False) -> date:
    """Whole days; the 1900 system has a day 60 that never was."""
    try:
        n = int(float(serial))
    except ValueError as e:
        raise InvalidDate(serial) from e
    if date1904:
        return date(1904, 1, 1) + timedelta(n)
    if n < 1 or n == 60:
        raise InvalidDate(serial)
    return date(1899, 12, 31) + timedelta(n - (n > 60))


def _sheets(archive: Archive, limits: Limits) -> tuple[dict[str, str], bool]:
    """Paths by worksheet name, in order, and whether days count from 1904."""
    book, links = X.parse(archive.read("xl/workbook.xml"), limits), X.parse(archive.read("xl/_rels/workbook.xml.rels"), limits)
    targets = {}
    for r in X.children(links, "Relationship"):
        if r.get("TargetMode") == "External" or r.get("Id") in targets or ".." in r.get("Target", "").split("/"):
            raise MalformedInput("a relationship out of the workbook")
        targets[r.get("Id")] = r.get("Target", "")
    out = {}
    for s in X.descendants(book, "sheet"):
        key = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
        if key not in targets:
            raise MalformedInput(f"no part of worksheet {s.get('name')}")
        target = targets[key]
        out[s.get("name", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    properties = X.at(book, "workbookPr")
    return out, properties is not None and properties.get("date1904") in ("1", "true")


def worksheet_names(data: bytes, limits: Limits = Limits()) -> list[str]:
    return list(_sheets(Archive(data, limits), limits)[0])


def _date_styles(archive: Archive, limits: Limits) -> set[int]:
    if "xl/styles.xml" not in archive.zip.namelist():
        return set()
    root = X.parse(archive.read("xl/styles.xml"), limits)
    own = {}
    for f in X.descendants(root, "numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "").lower())
        own[int(f.get("numFmtId", "0"))] = "y" in bare or "d" in bare
    formats = X.at(root, "cellXfs")
    ids = [int(x.get("numFmtId", "0")) for x in X.children(formats, "xf")] if formats is not None else []
    return {k for k, n in enumerate(ids) if own.get(n, n in _DATE_FORMATS)}


def parse(data: bytes, period: Period, mapping: Mapping, worksheet: str, *, balances: tuple = (), limits: Limits = Limits()) -> Statement:
    """Rows of the named worksheet below its first; every mapped cell must be there, plain, and not a formula."""
    limits.check_size(data)
    archive, out = Archive(data, limits), Statement(source_id(data), period, limits=limits)
    paths, date1904 = _sheets(archive, limits)
    if worksheet not in paths:
        raise MalformedInput(f"no worksheet {worksheet}")
    shared = []
    if "xl/sharedStrings.xml" in archive.zip.namelist():
        shared = ["".join(t.text or "" for t in X.descendants(si, "t")) for si in X.children(X.parse(archive.read("xl/sharedStrings.xml"), limits), "si")]
    styles, seen = _date_styles(archive, limits), set()
    rows = X.descendants(X.parse(archive.read(paths[worksheet]), limits), "row")
    if len(rows) > limits.records + 1:
        raise ResourceLimit("records")
    for place, row in enumerate(rows):
        number = int(row.get("r") or place + 1)
        if number in seen:
            raise MalformedInput(f"row {number} twice")
        seen.add(number)
        cells: dict[int, tuple[str, bool, bool]] = {}
        for c in X.children(row, "c"):
            k, kind, value = column_index(c.get("r", "")), c.get("t", "n"), X.text(X.at(c, "v")) or ""
            if k in cells or kind == "e":
                raise MalformedInput(f"cell {c.get('r')}")
            if kind == "s":
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in X.descendants(c, "t"))
            cells[k] = (value, kind == "n", kind == "n" and int(c.get("s", "0")) in styles) if X.at(c, "f") is None else ("=", False, False)
        if not place or not any(v.strip() for v, _, _ in cells.values()):
            continue

        def get(k: int | None, must: bool = True) -> str | None:
            if k is None:
                return None
            if k not in cells or cells[k][0] == "=":  # noqa: B023
                raise MalformedInput(f"row {number} has no plain cell {k}")  # noqa: B023
            return clean(cells[k][0])  # noqa: B023

        def day(k: int) -> date:
            text = get(k) or ""  # noqa: B023
            if cells[k][1]:  # noqa: B023
                if not cells[k][2]:  # noqa: B023
                    raise InvalidDate(text)
                return excel_date(text, date1904)
            return lenient_date(text, mapping.date_order)

        derived = [n for n in ("account", "currency") if not get(getattr(mapping, n))]
        account, currency = get(mapping.account) or mapping.default_account, get(mapping.currency) or mapping.default_currency
        if not account or not currency:
            raise MalformedInput(f"row {number} has no account or currency")
        balance = get(mapping.balance)
        money = lambda t: amount_of(t, mapping.decimal, mapping.grouping)
        out.add(locator=f"sheet:{worksheet}!row:{number}", account=account, currency=currency_of(currency), booking_date=day(mapping.date), amount=money(get(mapping.amount) or ""), value_date=day(mapping.value_date) if mapping.value_date is not None else None, running_balance=money(balance) if balance else None, **{n: get(getattr(mapping, n)) for n in ("strong_id", "reference", "payee", "description", "memo")}, original_values={f"column:{k}": v for k, (v, _, _) in cells.items()}, derived_fields=derived)
    out.balances = list(balances)
    return out
