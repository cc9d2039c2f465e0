"""Schemas, policies and errors."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

AMOUNT = "decimal(25,6)"
TRANSACTIONS = (
    "source_id string, locator string, source_ordinal bigint, account string, currency string, booking_date date, value_date date, "
    f"amount {AMOUNT}, running_balance {AMOUNT}, strong_id string, reference string, payee string, description string, memo string, "
    "transaction_code string, cleared_status string, category string, original_values map<string,string>, derived_fields array<string>"
)
BALANCES = f"kind string, account string, currency string, date date, amount {AMOUNT}, locator string"
MATCHES = "left_locator string, right_locator string, kind string"
EXCEPTIONS = "kind string, left_locators array<string>, right_locators array<string>, source_fingerprints array<string>, detail string"
MANUAL_MATCHES = "left_locator string, right_locator string, left_fingerprint string, right_fingerprint string"
DECISIONS = "exception_key string, explanation string, approved boolean"

MODES = {"bankVsLedger": ("bank", "ledger"), "exportVsExport": ("olderExport", "newerExport"), "singleStatement": ("statement",)}
INCONCLUSIVE_KINDS = ("invalidRow", "periodGapOrOverlap", "ambiguousCandidate")


class EngineError(Exception):
    """Any reason to refuse the whole operation."""


class InvalidAmount(EngineError): ...


class ArithmeticOverflow(EngineError): ...


class InvalidDate(EngineError): ...


class InvalidCurrency(EngineError): ...


class InvalidConfiguration(EngineError): ...


class MalformedInput(EngineError): ...


class ResourceLimit(EngineError): ...


class UnsupportedFormat(EngineError): ...


class RoleMismatch(EngineError): ...


class PeriodViolation(EngineError): ...


class StaleRevision(EngineError): ...


class LockedMutation(EngineError): ...


class IntegrityFailure(EngineError): ...


class NotFound(EngineError): ...


class EntitlementRequired(EngineError): ...


@dataclass(frozen=True)
class Period:
    """Inclusive on both ends."""

    start: date
    end: date

    def __post_init__(self):
        if self.start > self.end:
            raise InvalidDate(f"{self.start} is after {self.end}")


@dataclass(frozen=True)
class MatchingPolicy:
    """What the matching tiers may do, and how much work they may cause."""

    fuzzy: bool = True
    maximum_date_distance_days: int = 3
    minimum_similarity_permille: int = 850
    maximum_fuzzy_candidate_pairs: int = 20_000
    maximum_text_scalars: int = 256
    split_merge: bool = True
    maximum_split_merge_group_size: int = 4
    maximum_split_merge_evaluations: int = 50_000

    def __post_init__(self):
        bounds = {
            "maximum_date_distance_days": (0, 31), "minimum_similarity_permille": (0, 1000), "maximum_fuzzy_candidate_pairs": (1, 100_000), "maximum_text_scalars": (1, 512),
            "maximum_split_merge_group_size": (2, 6), "maximum_split_merge_evaluations": (1, 1_000_000),
        }
        for name, (low, high) in bounds.items():
            if not low <= getattr(self, name) <= high:
                raise InvalidConfiguration(f"{name} must be from {low} to {high}")
