"""Two exports of all rows: what differs, and what follows once it is explained, with and without approval."""

from __future__ import annotations

import duckdb
import pytest

from test_whole_jobs import ALIKE
from tieout.plans import catalogue

#: key, status, amount; all of one account and day
PLAIN = [(29, "'O'", 1), (58, "'O'", 2.5), (87, "null", 7), (116, "'F'", 40), (145, "'X'", 90), (5, "'O'", 200), (6, "'O'", 500)]
#: the bank repeats the rows of the first four; two of one are the amount of another
REPEATED = [(101, "'O'", 10), (202, "'O'", 20), (303, "'O'", 1000.5), (404, "'F'", 7000)]
STATES = {
    # a row with a strong id, one with a reference and two with neither; the fifth had the status before
    "plain": (PLAIN, (4, "differenceFound", "reconciledWithExplanations", "differenceFound")),
    # 4 repeated on each side, 2 keys and 16 rows that tie, 4 splits and merges, and on each side 4 rows that no split has
    "repeated": (REPEATED, (38, *["cannotConclude"] * 3)),
    "same": (PLAIN[5:], (0, "reconciled", "reconciled", "reconciled")),
}


def _sql(rows) -> str:
    return " union all ".join(f"select {k}::bigint o_orderkey, 3::bigint o_custkey, {status}::varchar o_orderstatus, {amount}::double o_totalprice, timestamp '1996-05-01' o_orderdate, '1-URGENT' o_orderpriority" for k, status, amount in rows)


def _both(spark, d, sql: str) -> tuple:
    """What the query finds, after it was seen that its SQL finds the same."""
    c = duckdb.connect()
    c.sql(f"copy ({sql}) to '{d}/orders.parquet'")
    c.sql(f"create view orders as select * from '{d}/orders.parquet'")
    df, want = catalogue.QUERIES["explained_state"](spark, str(d)), c.sql(catalogue.ORACLE_SQL["explained_state"])
    found = [tuple(r) for r in df.collect()]
    assert df.columns == want.columns and found == want.fetchall()
    return found[0]


@pytest.mark.parametrize("name", STATES)
def test_all_rows_take_part(spark, tmp_path, name):
    rows, want = STATES[name]
    assert _both(spark, tmp_path, _sql(rows)) == want


def test_more_pairs_than_a_policy_allows(spark, tmp_path):
    changes, *states = _both(spark, tmp_path, ALIKE)
    assert changes > 600 // 29 and states == ["cannotConclude"] * 3
