"""Bank and ledger views over the driver's order table, with planted differences; the same SQL text runs in both engines.

``k`` is the order key. Ledger rows are missing, moved by days, changed in amount, text or status, split in two, added, or booked to
another account, by remainders of ``k``. Money is in cents.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

START, END = date(1995, 1, 1), date(2001, 12, 31)

#: CTEs in order; ``{div}`` is integer division.
VIEWS = {
    "o": """select o_orderkey k, 'C'||o_custkey account, case o_custkey%3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end currency,
 cast(o_orderdate as date) booking_date, cast(round(o_totalprice*100) as bigint) amount, o_orderpriority p, o_orderstatus st from orders""",
    "bank": """select 'B'||lpad(cast(k as string),9,'0') locator, k*2 source_ordinal, account, currency, booking_date, amount,
 case when k%4=0 then 'T'||k end strong_id, case when k%4=1 then 'R'||k end reference, 'order '||p||' no '||k description, st cleared_status from o
 union all
 select 'B'||lpad(cast(k as string),9,'0')||'D', k*2+1, account, currency, booking_date, amount,
 case when k%4=0 then 'T'||k end, case when k%4=1 then 'R'||k end, 'order '||p||' no '||k, st from o where k%101=0""",
    "ledger": """select 'L'||lpad(cast(k as string),9,'0') locator, k*4 source_ordinal, case when k%4=0 and k%23=0 then account||'X' else account end account, currency,
 booking_date + cast(case when k%4=2 then 1 when k%4=0 and k%13=0 then 2 else 0 end as integer) booking_date,
 amount + case when k%4=0 and k%19=0 then 100 else 0 end amount,
 case when k%4=0 then 'T'||k end strong_id, case when k%4=1 then 'R'||k end reference,
 case when k%4=2 and k%7=0 then 'adjustment '||k when k%5=0 then 'ordr '||p||' no '||k else 'order '||p||' no '||k end description, case when k%29=0 then 'X' else st end cleared_status
 from o where k%17<>0 and not (k%4=3 and k%3=0)
 union all select 'L'||lpad(cast(k as string),9,'0')||'S1', k*4+1, account, currency, booking_date, amount {div} 2, null, null, 'part one', st from o where k%4=3 and k%3=0 and k%17<>0
 union all select 'L'||lpad(cast(k as string),9,'0')||'S2', k*4+2, account, currency, booking_date, amount - amount {div} 2, null, null, 'part two', st from o where k%4=3 and k%3=0 and k%17<>0
 union all select 'L'||lpad(cast(k as string),9,'0')||'N', k*4+3, account, currency, booking_date, amount+777, null, null, 'new item '||k, st from o where k%37=0
 union all select 'L'||lpad(cast(k as string),9,'0')||'D', k*4+1, account, currency, booking_date+1, amount, null, null, 'order '||p||' no '||k, st from o where k%4=2 and k%103=0 and k%17<>0 and k%5<>0 and k%7<>0""",
    "bank_rb": """select *, case when source_ordinal%6<>0 then cast(100000 + sum(amount) over (partition by account, currency order by booking_date, source_ordinal, locator rows unbounded preceding)
 + case when source_ordinal%82=0 then 1 else 0 end as bigint) end running_balance from bank""",
    "part_b": "select account, currency, cast(substr(account,2) as integer) ck, cast(sum(amount) as bigint) act from bank group by account, currency",
    "balances": """select 'opening' kind, account, currency, date '1995-01-01' date, cast(100000 as bigint) amount, 'O'||account||currency locator from part_b where ck%77<>0
 union all select 'opening', account, currency, date '1995-01-01', cast(100000 as bigint), 'O2'||account||currency from part_b where ck%91=0
 union all select 'closing', account, currency, date '2001-12-31' - cast(case when ck%63=0 then 1 else 0 end as integer), cast(100000+act+case when ck%50=0 then 1 else 0 end as bigint), 'Z'||account||currency from part_b""",
    "other_balances": """select kind, account, currency, case when cast(substr(account,2) as integer)%41=0 then date '1995-01-02' else date end date,
 cast(amount + case when cast(substr(account,2) as integer)%33=0 then 7 else 0 end as bigint) amount, locator from balances where cast(substr(account,2) as integer)%29<>0""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the table in ``sf_dir``."""
    ctes = [f"{n} as ({q})" for n, q in VIEWS.items()]
    upto = ctes[: list(VIEWS).index(name) + 1]
    text = ", ".join(upto).replace("{div}", "div").replace("from orders)", "from {orders})")
    return spark.sql(f"with {text} select * from {name}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def duck_ctes(*more: tuple[str, str], views: dict[str, str] = VIEWS) -> str:
    """The views and further ones, each made once however often it is read."""
    ctes = [f"{n} as materialized ({q})" for n, q in [*views.items(), *more]]
    return "with " + ",\n".join(ctes).replace("{div}", "//") + "\n"
