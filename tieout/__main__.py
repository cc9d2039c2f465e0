"""``python -m tieout verify-fixtures``: run the sample, lock it, verify the lock."""

from __future__ import annotations

import sys

from tieout import evidence, sample
from tieout.session import local_session


def main(args: list[str]) -> int:
    if args != ["verify-fixtures"]:
        print(__doc__)
        return 2
    spark = local_session(cores="2", partitions=2)
    locked = evidence.lock(spark, "bankVsLedger", sample.PERIOD, sample.files(), "2026-02-01T00:00:00Z")
    evidence.verify(spark, locked, sample.files())
    result = locked["manifest"]["result"]
    print(f"{result['state']}: {len(result['matches'])} matches, {len(result['exceptions'])} exceptions, evidence {locked['sha256']}")
    return 0 if result["state"] == "reconciled" else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
