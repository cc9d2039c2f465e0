"""A balanced pair of bank and ledger files."""

from __future__ import annotations

from datetime import date

from tieout.evidence import File
from tieout.model import Period

PERIOD = Period(date(2026, 1, 1), date(2026, 1, 31))
_HEAD = "date,amount,account,currency,id,reference,description,balance\n"
_ROWS = (
    "2026-01-03,-48.20,Harbour,CHF,k7,rope-19,Mooring rope,951.80\n", "2026-01-14,310.05,Harbour,CHF,k8,berth-4,Berth let to Nadir,1261.85\n",
    "2026-01-27,-12.00,Harbour,CHF,k9,tide-2,Tide tables,1249.85\n",
)


def files() -> list[File]:
    return [File("bank", "sample_bank.csv", (_HEAD + "".join(_ROWS)).encode()), File("ledger", "sample_ledger.csv", (_HEAD + "\n".join(_ROWS)).encode())]
