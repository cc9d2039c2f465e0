"""Format detection by name, then by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that must select the same formats.
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "tab": "tsv", "xlsx": "xlsx", "ofx": "ofx", "qfx": "qfx", "qbo": "qbo", "qif": "qif", "qmtf": "qmtf",
    "mt940": "mt940", "sta": "mt940", "swift": "mt940", "bai": "bai2", "bai2": "bai2",
}


#: Bytes that are looked at, and what tells XML messages apart; notifications first.
XML_SNIFF, SNIFF = 128 << 10, 8 << 10
MESSAGES = {"camt054": (b"camt.054.", b"bktocstmrdbtcdtntfctn"), "camt053": (b"camt.053.", b"bktocstmrstmt")}


def format_by_name(filename: Column) -> Column:
    """By extension, whatever its case; null where only the content can tell."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1)))


def detect(data: bytes, filename: str) -> str | None:
    """Extension first; XML is sniffed for CAMT.054 then .053; unknown names for OFX, MT940 and BAI2."""
    extension = filename.rpartition(".")[2].lower()
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    if extension == "xml":
        head = data[:XML_SNIFF].lower()
        return next((kind for kind, marks in MESSAGES.items() if any(m in head for m in marks)), None)
    head = data[:SNIFF].upper()
    if b"OFXHEADER:" in head or b"<OFX" in head:
        return "ofx"
    if b":20:" in head and b":25:" in head:
        return "mt940"
    return "bai2" if head.startswith(b"01,") else None
