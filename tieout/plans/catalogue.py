"""Registered reconciliation queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.functions import columns as C
from tieout.model import BALANCES, MatchingPolicy, Period
from tieout.operators import checks, matching, sums
from tieout.plans import derive, line_queries, reconcile

DAYS, PERMILLE, TEXT, GROUP = 3, 850, 256, 4
Query = Callable[[SparkSession, str], DataFrame]


def _joined(c: str) -> Column:
    return F.array_join(c, ",")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as canonical rows; amounts are cents."""
    df, nothing = derive.spark_view(spark, sf_dir, name), F.lit(None).cast("string")
    made = {
        "source_id": F.lit(f"source-{name}"), "value_date": F.lit(None).cast("date"), "running_balance": F.col("running_balance") if "running_balance" in df.columns else F.lit(None).cast("bigint"),
        "original_values": F.create_map().cast("map<string,string>"), "derived_fields": F.array().cast("array<string>"), **{n: nothing for n in ("payee", "memo", "transaction_code", "category")},
    }
    return df.select(*[made.get(c, F.col(c)).alias(c) for c in reconcile.ROW])


POLICY = MatchingPolicy(maximum_fuzzy_candidate_pairs=100_000, maximum_split_merge_evaluations=1_000_000)


def _tiers(spark: SparkSession, sf_dir: str) -> reconcile.Tiers:
    """The tiers over whole tables of any size: their SQL knows no limits on work, so these do not refuse either."""
    return reconcile.Tiers(_rows(spark, sf_dir, "bank_rb"), _rows(spark, sf_dir, "ledger"), POLICY, limited=False)


def _result(spark: SparkSession, sf_dir: str, bound: bool = True) -> reconcile.Result:
    """Mode A over the views: validation, both sides' proofs, all tiers, whatever work they are, fingerprints (if ``bound``) and the conclusion."""
    sources = [reconcile.Source(role, _rows(spark, sf_dir, rows), derive.spark_view(spark, sf_dir, balances)) for role, rows, balances in (("bank", "bank_rb", "balances"), ("ledger", "ledger", "other_balances"))]
    return reconcile.run(reconcile.Job("bankVsLedger", Period(derive.START, derive.END), sources, POLICY, limited=False), bound=bound).unordered()


# ---- the same tiers in DuckDB ----

_CASCADE = [
    ("l0", "select *, trim(regexp_replace(lower(concat_ws(' ', reference, description)), '[^a-z0-9]+', ' ', 'g')) txt from bank_rb"),
    ("r0", "select *, trim(regexp_replace(lower(concat_ws(' ', reference, description)), '[^a-z0-9]+', ' ', 'g')) txt from ledger"),
    ("sk", """select account, currency, strong_id, count(*) filter (s='l') n_l, count(*) filter (s='r') n_r, min(locator) filter (s='l') l, min(locator) filter (s='r') r
 from (select 'l' s, * from l0 union all by name select 'r' s, * from r0) where strong_id is not null group by all having n_l>0 and n_r>0"""),
    ("strong", "select l, r from sk where n_l=1 and n_r=1"),
    ("l1", "select * from l0 where locator not in (select l from strong)"),
    ("r1", "select * from r0 where locator not in (select r from strong)"),
    ("ck", """select account, currency, booking_date, amount, reference, count(*) filter (s='l') n_l, count(*) filter (s='r') n_r, min(locator) filter (s='l') l, min(locator) filter (s='r') r
 from (select 'l' s, * from l1 union all by name select 'r' s, * from r1) where reference is not null group by all having n_l>0 and n_r>0"""),
    ("composite", "select l, r from ck where n_l=1 and n_r=1"),
    ("l2", "select * from l1 where locator not in (select l from composite)"),
    ("r2", "select * from r1 where locator not in (select r from composite)"),
    ("fc", f"""select * from (select a.locator l, b.locator r, abs(date_diff('day', a.booking_date, b.booking_date)) as days,
 case when a.txt=b.txt then 1000 else (greatest(length(a.txt),length(b.txt))-levenshtein(a.txt,b.txt))*1000//greatest(length(a.txt),length(b.txt)) end permille
 from l2 a join r2 b on a.account=b.account and a.currency=b.currency and a.amount=b.amount
 where abs(date_diff('day', a.booking_date, b.booking_date))<={DAYS} and (a.strong_id is null or b.strong_id is null or a.strong_id=b.strong_id)) where permille>={PERMILLE}"""),
    ("fr", """select *, rank() over (partition by l order by permille desc, days) lr, count(*) over (partition by l, permille, days) lt,
 rank() over (partition by r order by permille desc, days) rr, count(*) over (partition by r, permille, days) rt from fc"""),
    ("fuzzy", "select l, r from fr where lr=1 and lt=1 and rr=1 and rt=1"),
    ("l3", "select * from l2 where locator not in (select l from fuzzy)"),
    ("r3", "select * from r2 where locator not in (select r from fuzzy)"),
    ("matches", "select l, r, 'strongID' kind from strong union all select l, r, 'exactComposite' from composite union all select l, r, 'fuzzy' from fuzzy"),
    ("el", f"""select 'l' side, s.locator s, s.amount whole, c.locator c, c.amount a from l3 s join r3 c on s.account=c.account and s.currency=c.currency and (s.amount>0)=(c.amount>0)
 and abs(date_diff('day', s.booking_date, c.booking_date))<={DAYS} where s.amount<>0
 union all select 'r', s.locator, s.amount, c.locator, c.amount from r3 s join l3 c on s.account=c.account and s.currency=c.currency and (s.amount>0)=(c.amount>0)
 and abs(date_diff('day', s.booking_date, c.booking_date))<={DAYS} where s.amount<>0"""),
    ("e2", "select x.side, x.s, x.whole, [x.c, y.c] p, y.c last, x.a+y.a t from el x join el y on x.side=y.side and x.s=y.s and y.c>x.c"),
    ("e3", "select x.side, x.s, x.whole, list_append(x.p, y.c) p, y.c last, x.t+y.a t from e2 x join el y on x.side=y.side and x.s=y.s and y.c>x.last"),
    ("e4", "select x.side, x.s, x.whole, list_append(x.p, y.c) p, y.c last, x.t+y.a t from e3 x join el y on x.side=y.side and x.s=y.s and y.c>x.last"),
    ("splits", """select distinct case when side='l' then s else array_to_string(list_sort(p), ',') end left_locators, case when side='l' then array_to_string(list_sort(p), ',') else s end right_locators, account, currency, whole
 from (select side, s, p, whole from e2 where t=whole union all select side, s, p, whole from e3 where t=whole union all select side, s, p, whole from e4 where t=whole) x
 join (select locator, account, currency from l3 union all select locator, account, currency from r3) o on o.locator=x.s"""),
    ("split_l", "select distinct unnest(string_split(left_locators, ',')) x from splits"),
    ("split_r", "select distinct unnest(string_split(right_locators, ',')) x from splits"),
    ("miss", "select * from l3 where locator not in (select x from split_l)"),
    ("unexp", "select * from r3 where locator not in (select x from split_r)"),
    ("mut", """select m.l, m.r, unnest(list_filter([case when a.amount<>b.amount then {'kind': 'amountChanged', 'detail': a.amount||' → '||b.amount} end,
 case when a.booking_date<>b.booking_date then {'kind': 'dateChanged', 'detail': 'Booking or value date changed'} end,
 case when a.strong_id is distinct from b.strong_id or a.reference is distinct from b.reference or a.description is distinct from b.description then {'kind': 'descriptionOrReferenceChanged', 'detail': 'Strong ID, reference, description, memo, payee or transaction code changed'} end,
 case when a.cleared_status is distinct from b.cleared_status then {'kind': 'statusOrCategoryChanged', 'detail': 'Cleared status or category changed'} end], lambda x: x is not null)) what
 from matches m join l0 a on a.locator=m.l join r0 b on b.locator=m.r"""),
    ("dup", """select side, account, currency, count(*) n, string_agg(locator, ',' order by locator) locators, 'Repeated identity: '||account||'|'||currency||min(case when strong_id is not null then ' strong-id['||strlen(strong_id)||']'
 else ' '||booking_date||' '||amount||' reference['||coalesce(strlen(reference),0)||'] description['||coalesce(strlen(description),0)||']' end) detail from (select 'l' side, * from l0 union all by name select 'r' side, * from r0)
 group by side, account, currency, strong_id, case when strong_id is null then booking_date end, case when strong_id is null then amount end, case when strong_id is null then reference end,
 case when strong_id is null then description end having count(*)>1"""),
    ("xp", """select a.strong_id, a.locs left_locators, b.locs right_locators from
 (select strong_id, string_agg(locator, ',' order by locator) locs, list(distinct account||'|'||currency) ps from l3 where strong_id is not null group by 1) a join
 (select strong_id, string_agg(locator, ',' order by locator) locs, list(distinct account||'|'||currency) ps from r3 where strong_id is not null group by 1) b using (strong_id) where not list_has_any(a.ps, b.ps)"""),
    ("op", "select account, currency, min(amount) opening from balances where kind='opening' group by all having count(*)=1"),
    ("pp", """select coalesce(a.account, b.account) account, coalesce(a.currency, b.currency) currency, coalesce(activity, 0) activity, coalesce(no, 0) no, coalesce(nc, 0) nc, o, c, od, cd
 from (select account, currency, sum(amount) activity from bank group by all) a full join (select account, currency, count(*) filter (kind='opening') no, count(*) filter (kind='closing') nc,
 min(amount) filter (kind='opening') o, min(amount) filter (kind='closing') c, min(date) filter (kind='opening') od, min(date) filter (kind='closing') cd from balances group by all) b
 on a.account=b.account and a.currency=b.currency"""),
    ("rpp", """select coalesce(a.account, b.account) account, coalesce(a.currency, b.currency) currency, coalesce(activity, 0) activity, coalesce(no, 0) no, coalesce(nc, 0) nc, o, c, od, cd, ol, cl, side
 from (select 'l' side, account, currency, sum(amount) activity from bank group by all union all select 'r', account, currency, sum(amount) from ledger group by all) a
 full join (select side, account, currency, count(*) filter (kind='opening') no, count(*) filter (kind='closing') nc, min(amount) filter (kind='opening') o, min(amount) filter (kind='closing') c,
 min(date) filter (kind='opening') od, min(date) filter (kind='closing') cd, min(locator) filter (kind='opening') ol, min(locator) filter (kind='closing') cl
 from (select 'l' side, * from balances union all select 'r', * from other_balances) group by all) b using (side, account, currency)"""),
    ("arith", """select side, account||'|'||currency part, case when no<>1 or nc<>1 then 'count' when od<>date '1995-01-01' or cd<>date '2001-12-31' then 'dates' when o+activity<>c then 'sum' end reason, o, c, activity, ol, cl from rpp"""),
    ("walk", """select w.*, op.opening, ob.locator opening_locator from (select *, last_value(case when running_balance is not null then running_balance end ignore nulls) over b prev_rb,
 last_value(case when running_balance is not null then cum end ignore nulls) over b prev_cum, last_value(case when running_balance is not null then locator end ignore nulls) over b prev_locator, count(running_balance) over b isl
 from (select *, sum(amount) over (partition by account, currency order by booking_date, source_ordinal, locator rows unbounded preceding) cum from bank_rb)
 window b as (partition by account, currency order by booking_date, source_ordinal, locator rows between unbounded preceding and 1 preceding)) w
 left join op using (account, currency) left join (select account, currency, min(locator) locator from balances where kind='opening' group by all) ob using (account, currency)"""),
    ("breaks", """select account, currency, isl, coalesce(prev_rb, opening)+cum-coalesce(prev_cum, 0) expected, running_balance found, coalesce(prev_locator, opening_locator) anchor from walk
 where running_balance is not null and coalesce(prev_rb, opening)+cum-coalesce(prev_cum, 0)<>running_balance"""),
    ("bcmp", """select part, kind, coalesce(ln,0)>1 or coalesce(rn,0)>1 several, ll, rl from (select coalesce(a.account,b.account)||'|'||coalesce(a.currency,b.currency) part, coalesce(a.kind,b.kind) kind, a.n ln, b.n rn, a.amount la, b.amount ra, a.d ld, b.d rd, a.l ll, b.l rl from
 (select account, currency, kind, count(*) n, min(amount) amount, min(date) d, list(locator order by locator) l from balances group by all) a full join (select account, currency, kind, count(*) n, min(amount) amount, min(date) d, list(locator order by locator) l from other_balances group by all) b
 on a.account=b.account and a.currency=b.currency and a.kind=b.kind) where coalesce(ln,0)>1 or coalesce(rn,0)>1 or la is distinct from ra or ld is distinct from rd"""),
    ("sa", """select account, currency, strong_id, list(locator order by locator) filter (s='l') ls, list(locator order by locator) filter (s='r') rs from (select 'l' s, locator, account, currency, strong_id from l0
 union all select 'r', locator, account, currency, strong_id from r0) x join (select account, currency, strong_id from sk where n_l>1 or n_r>1) k using (account, currency, strong_id) group by all"""),
    ("ca", """select account, currency, booking_date, amount, reference, list(locator order by locator) filter (s='l') ls, list(locator order by locator) filter (s='r') rs from
 (select 'l' s, locator, account, currency, booking_date, amount, reference from l1 union all select 'r', locator, account, currency, booking_date, amount, reference from r1) x
 join (select account, currency, booking_date, amount, reference from ck where n_l>1 or n_r>1) k using (account, currency, booking_date, amount, reference) group by all"""),
    ("ex", """select case side when 'l' then 'duplicateInLeft' else 'duplicateInRight' end kind, case side when 'l' then string_split(locators, ',') else [] end ls, case side when 'r' then string_split(locators, ',') else [] end rs, detail from dup
 union all select 'runningBalanceBreak', list_sort(list_append(list(w.locator), b.anchor)), [], b.account||'|'||b.currency||': expected '||b.expected||', found '||b.found from breaks b join walk w using (account, currency, isl) group by b.account, b.currency, b.isl, b.anchor, b.expected, b.found
 union all select case reason when 'sum' then 'balanceDifference' else 'periodGapOrOverlap' end, case when reason<>'count' and side='l' then list_sort([ol, cl]) else [] end, case when reason<>'count' and side='r' then list_sort([ol, cl]) else [] end,
 part||case reason when 'count' then ': expected exactly one opening and one closing balance' when 'dates' then ': balance dates do not bound the selected period' else ': opening '||o||' + activity '||activity||' = '||(o+activity)||', not '||c end from arith where reason is not null
 union all select case when several then 'periodGapOrOverlap' else 'balanceDifference' end, case when several then [] else coalesce(ll, []) end, case when several then [] else coalesce(rl, []) end, case when several then 'Multiple balance markers for ' else 'Balance amount or date differs for ' end||part||' '||kind from bcmp
 union all select 'ambiguousCandidate', ls, rs, 'Strong identifier has multiple candidates: '||account||'|'||currency||' strong-id['||strlen(strong_id)||']' from sa
 union all select 'ambiguousCandidate', ls, rs, 'Composite identity has multiple candidates: '||account||'|'||currency||' '||booking_date||' '||amount||' reference['||strlen(reference)||']' from ca
 union all select 'ambiguousCandidate', [l], list(r order by r), 'Fuzzy candidates tie at '||min(permille)||'/1000 similarity and '||min(days)||' day distance' from fr where lr=1 and lt>1 group by l
 union all select 'ambiguousCandidate', list(l order by l), [r], 'Fuzzy candidates tie at '||min(permille)||'/1000 similarity and '||min(days)||' day distance' from fr where rr=1 and rt>1 group by r
 union all select what.kind, [l], [r], what.detail from mut
 union all select 'possibleSplitOrMerge', string_split(left_locators, ','), string_split(right_locators, ','), 'Possible split/merge in '||account||'|'||currency||': exact combined amount '||whole from splits
 union all select 'currencyOrAccountMismatch', string_split(left_locators, ','), string_split(right_locators, ','), 'Strong identifier appears only in different account/currency partitions: '||strong_id from xp
 union all select 'missingFromLedger', [locator], [], 'No deterministic counterpart' from miss union all select 'unexpectedLedgerItem', [], [locator], 'No deterministic counterpart' from unexp"""),
    ("prints", "select 'L' side, locator, sha256(%s) fp from (select *, 'source-bank_rb' source_id from bank_rb) union all select 'R', locator, sha256(%s) from (select *, null running_balance, 'source-ledger' source_id from ledger)"),
    ("exid", "select md5(kind||'|'||array_to_string(ls, ',')||'|'||array_to_string(rs, ',')||'|'||detail) id, kind, ls, rs, detail from ex"),
    ("named", "select id, 'L' side, unnest(ls) locator from exid union select id, 'R', unnest(rs) from exid"),
    ("exfp", "select id, string_agg(side||':'||locator||':'||fp, ',' order by side||':'||locator||':'||fp) fps from named join prints using (side, locator) group by id"),
    ("exk", """select kind, array_to_string(ls, ',') left_locators, array_to_string(rs, ',') right_locators, ls, rs, detail, sha256(kind||'|'||array_to_string(ls, ',')||'|'||array_to_string(rs, ',')||'|'||coalesce(fps, '')||'|'||detail) exception_key from exid left join exfp using (id)"""),
]


_FIELD = "strlen(coalesce(cast({0} as varchar),'<nil>'))||':'||coalesce(cast({0} as varchar),'<nil>')"
_ROW_PARTS = ["source_id", "locator", "source_ordinal", "account", "currency", "booking_date", "null", "amount", "running_balance", "strong_id", "reference", "null", "description", "null", "null", "cleared_status", "null", "''", "''"]
_ROW_PRINT = " || '|' || ".join(_FIELD.format(p) for p in _ROW_PARTS)
_CASCADE = [(n, q % (_ROW_PRINT, _ROW_PRINT) if n == "prints" else q) for n, q in _CASCADE]


def _sql(select: str) -> str:
    return derive.duck_ctes(*_CASCADE) + select


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, cascade: bool = True):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _sql(sql) if cascade else sql
        return f

    return add


@_register("partition_totals", """select coalesce(a.account,b.account) account, coalesce(a.currency,b.currency) currency, cast(coalesce(l,0) as bigint) left_total, cast(coalesce(r,0) as bigint) right_total,
 cast(coalesce(l,0)-coalesce(r,0) as bigint) difference from (select account, currency, sum(amount) l from bank group by all) a full join (select account, currency, sum(amount) r from ledger group by all) b
 on a.account=b.account and a.currency=b.currency""")
def partition_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = checks.partition_totals(*(derive.spark_view(spark, sf_dir, n) for n in ("bank", "ledger")))
    return totals.select("account", "currency", F.col("left").alias("left_total"), F.col("right").alias("right_total"), "difference")


@_register("duplicates_left", "select account, currency, n, locators from dup where side='l'")
def duplicates_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(_rows(spark, sf_dir, "bank")).select("account", "currency", "n", _joined("locators").alias("locators"))


def _pairs(tier: str) -> Query:
    return lambda spark, sf_dir: getattr(_tiers(spark, sf_dir), tier).select("left_locator", "right_locator")


for _name, _tier in (("match_strong", "strong"), ("match_composite", "composite"), ("match_fuzzy", "fuzzy")):
    _register(_name, f"select l left_locator, r right_locator from {_tier}")(_pairs(_tier))


@_register("ambiguous_strong", "select account, currency, strong_id, array_to_string(ls, ',') left_locators, array_to_string(rs, ',') right_locators from sa")
def ambiguous_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).ambiguous("strong").select("account", "currency", "strong_id", _joined("left_locators").alias("left_locators"), _joined("right_locators").alias("right_locators"))


@_register("ambiguous_composite", """select account, currency, booking_date, amount, reference, n_l, n_r, l left_locator, r right_locator from ck where n_l>1 or n_r>1""")
def ambiguous_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).composite_groups.filter("n_l > 1 or n_r > 1")


@_register("fuzzy_candidates", "select l left_locator, r right_locator, cast(permille as bigint) permille, days from fc")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).candidates


@_register("ambiguous_fuzzy", """select 'left' side, l locator, string_agg(r, ',' order by r) candidates from fr where lr=1 and lt>1 group by l union all select 'right', r, string_agg(l, ',' order by l) from fr where rr=1 and rt>1 group by r""")
def ambiguous_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tiers(spark, sf_dir)
    return matching.fuzzy_ties(c.ranks, *c.members).select("side", "locator", _joined("candidates").alias("candidates"))


@_register("mutations", "select l left_locator, r right_locator, what.kind kind, what.detail detail from mut")
def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tiers(spark, sf_dir)
    return matching.mutations(c.matches, c.left, c.right)


@_register("split_merge", "select left_locators, right_locators, account, currency, cast(whole as bigint) whole from splits")
def split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).splits.select(_joined("left_locators").alias("left_locators"), _joined("right_locators").alias("right_locators"), "account", "currency", "whole")


@_register("split_merge_budget", """select cast(coalesce(sum(n*(n-1)/2 + case when n>=3 then n*(n-1)*(n-2)/6 else 0 end + case when n>=4 then n*(n-1)*(n-2)*(n-3)/24 else 0 end),0) as bigint) evaluations
 from (select side, s, count(*) n from el group by all having count(*)>=2)""")
def split_merge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tiers(spark, sf_dir)
    return matching.split_merge_evaluations(*c.rest3, DAYS, GROUP)


@_register("cross_partition_ids", "select strong_id, left_locators, right_locators from xp")
def cross_partition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tiers(spark, sf_dir)
    return matching.cross_partition(*c.rest3).select("strong_id", _joined("left_locators").alias("left_locators"), _joined("right_locators").alias("right_locators"))


@_register("missing_rows", "select locator, account, currency, amount from miss")
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).unpaired("left").select("locator", "account", "currency", "amount")


@_register("unexpected_rows", "select locator, account, currency, amount from unexp")
def unexpected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).unpaired("right").select("locator", "account", "currency", "amount")


@_register("running_balance_breaks", """select account, currency, locator, cast(expected as bigint) expected, running_balance as found from (
 select w.*, coalesce(w.prev_rb, op.opening) + w.cum - coalesce(w.prev_cum, 0) expected from (
 select *, last_value(case when running_balance is not null then running_balance end ignore nulls) over b prev_rb, last_value(case when running_balance is not null then cum end ignore nulls) over b prev_cum from
 (select *, sum(amount) over (partition by account, currency order by booking_date, source_ordinal, locator rows unbounded preceding) cum from bank_rb)
 window b as (partition by account, currency order by booking_date, source_ordinal, locator rows between unbounded preceding and 1 preceding)) w
 left join op on op.account=w.account and op.currency=w.currency) where running_balance is not null and expected<>running_balance""")
def running_balance_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, balances = (derive.spark_view(spark, sf_dir, n) for n in ("bank_rb", "balances"))
    return checks.running_balance_breaks(rows, balances).select("account", "currency", "locator", "expected", "found")


@_register("statement_arithmetic", """select account, currency, case when reason='sum' then 'balanceDifference' else 'periodGapOrOverlap' end kind, reason from (
 select *, case when no<>1 or nc<>1 then 'count' when od<>date '1995-01-01' or cd<>date '2001-12-31' then 'dates' when o+activity<>c then 'sum' end reason from pp) where reason is not null""")
def statement_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, balances = (derive.spark_view(spark, sf_dir, n) for n in ("bank", "balances"))
    return checks.statement_arithmetic(rows, balances, derive.START, derive.END).select("account", "currency", "kind", "reason")


@_register("statement_totals", """select account, currency, cast(case when no=1 then o else 0 end + activity as bigint) left_total, cast(case when nc=1 then c else 0 end as bigint) right_total,
 cast(case when no=1 then o else 0 end + activity - case when nc=1 then c else 0 end as bigint) difference from pp""")
def statement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, balances = (derive.spark_view(spark, sf_dir, n) for n in ("bank", "balances"))
    return checks.statement_totals(rows, balances).select("account", "currency", F.col("left").alias("left_total"), F.col("right").alias("right_total"), "difference")


@_register("balance_comparison", """select account, currency, kind, case when coalesce(ln,0)>1 or coalesce(rn,0)>1 then 'periodGapOrOverlap' else 'balanceDifference' end outcome from (
 select coalesce(a.account,b.account) account, coalesce(a.currency,b.currency) currency, coalesce(a.kind,b.kind) kind, a.n ln, b.n rn, a.amount la, b.amount ra, a.d ld, b.d rd from
 (select account, currency, kind, count(*) n, min(amount) amount, min(date) d from balances group by all) a full join (select account, currency, kind, count(*) n, min(amount) amount, min(date) d from other_balances group by all) b
 on a.account=b.account and a.currency=b.currency and a.kind=b.kind) where coalesce(ln,0)>1 or coalesce(rn,0)>1 or la is distinct from ra or ld is distinct from rd""")
def balance_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.balance_comparison(*(derive.spark_view(spark, sf_dir, n) for n in ("balances", "other_balances"))).select("account", "currency", "kind", "outcome")


_FAULTY = (
    ("b", """select *, case when source_ordinal%10=0 then '' else locator end loc, case when source_ordinal%500=6 then -source_ordinal else source_ordinal end so from bank"""),
    ("c", """select *, case when kind='opening' and account like '%3' then ' ' else locator end loc from balances"""),
)


@_register("validation_report", derive.duck_ctes(*_FAULTY) + """select 'locators_unique' "check", count(*)-count(distinct loc) violations from b union all select 'ordinals_unique', count(*)-count(distinct so) from b
 union all select 'rows_in_period', count(*) filter (booking_date not between date '1995-01-01' and date '1999-12-31') from b union all select 'locators_not_blank', count(*) filter (loc='') from b
 union all select 'accounts_not_blank', count(*) filter (source_ordinal%50=4) from b union all select 'ordinals_not_negative', count(*) filter (so<0) from b
 union all select 'balance_locators_unique', count(*)-count(distinct loc) from c union all select 'balances_in_period', count(*) filter (date not between date '1995-01-01' and date '1999-12-31') from balances
 union all select 'source_ids_known', count(*) filter (source_ordinal%1000=0) from bank union all select 'balance_accounts_not_blank', count(*) filter (account like '%7') from balances
 union all select 'balance_locators_not_blank', count(*) filter (kind='opening' and account like '%3') from balances""", cascade=False)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables with planted faults: a shorter period, rows of a file that is not the side's, and blank accounts, locators and balances."""
    rows, balances = derive.spark_view(spark, sf_dir, "bank"), derive.spark_view(spark, sf_dir, "balances")
    ordinal, account = F.col("source_ordinal"), F.col("account")
    rows = rows.select(
        F.when(ordinal % 10 == 0, "\u2003").otherwise(F.col("locator")).alias("locator"), F.when(ordinal % 50 == 4, "").otherwise(account).alias("account"),
        F.when(ordinal % 500 == 6, -ordinal).otherwise(ordinal).alias("source_ordinal"), "booking_date", F.when(ordinal % 1000 == 0, "source-other").otherwise(F.when(ordinal % 3 == 0, "source-a").otherwise("source-b")).alias("source_id"),
    )
    balances = balances.select("date", F.when(account.endswith("7"), "\t").otherwise(account).alias("account"), F.when((F.col("kind") == "opening") & account.endswith("3"), " ").otherwise(F.col("locator")).alias("locator"))
    return checks.validation(rows, balances, derive.START, date(1999, 12, 31), ("source-a", "source-b"))


@_register("checked_sums", """with x as (select 'C'||o_custkey account, case o_custkey%3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end currency, o_orderkey k,
 cast((cast(round(o_totalprice*100) as bigint) * 1000000000::hugeint * case when o_orderkey%3=0 then -1 else 1 end) as decimal(38,6)) + case when o_orderkey%16=0 then 0.25 when o_orderkey%16=1 then 0.5 else 0 end a from orders),
 p as (select *, cast(sum(a) over (partition by account, currency order by k rows unbounded preceding) as decimal(38,6)) s from x),
 sc as (select *, greatest(case when a%1=0 then 0 when (a*10)%1=0 then 1 else 2 end, case when (s-a)%1=0 then 0 when ((s-a)*10)%1=0 then 1 else 2 end) t from p),
 o as (select *, greatest(abs(a), abs(s-a), abs(s)) > case t when 0 then 9223372036854775807 when 1 then 922337203685477580.7 else 92233720368547758.07 end bad from sc)
 select account, currency, cast(arg_max(s, k)*100 as hugeint)::varchar total_hundredths, cast(min(s)*100 as hugeint)::varchar least_hundredths, cast(max(s)*100 as hugeint)::varchar greatest_hundredths, bool_or(bad) overflows from o group by all""", cascade=False)
def checked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each account in the order of its orders, large enough that a prefix of some leaves 64 bits: by its size, or by the scale of one amount."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)")
    amount = (F.when(k % 3 == 0, -cents).otherwise(cents).cast("decimal(31,6)") + F.when(k % 16 == 0, F.lit("0.25")).when(k % 16 == 1, F.lit("0.5")).otherwise(F.lit("0")).cast("decimal(31,6)")).cast("decimal(31,6)")
    c = F.col("o_custkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("C"), c.cast("string")).alias("account"), F.when(c % 3 == 0, "USD").when(c % 3 == 1, "EUR").otherwise("GBP").alias("currency"), k.alias("source_ordinal"), amount.alias("amount"))
    hundredths = lambda n: (F.col(n) * 100).cast("decimal(38,0)").cast("string").alias(f"{n}_hundredths")
    return sums.checked_sums(rows, chunk=4096).select("account", "currency", hundredths("total"), hundredths("least"), hundredths("greatest"), "overflows")


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rows(spark, sf_dir, "bank")
    names = ("locator", "source_ordinal", "account", "currency", "booking_date", "value_date", "amount", "strong_id", "reference", "payee", "description", "memo", "transaction_code", "cleared_status", "category")
    cols = {n: df[n] for n in names} | {"source_id": F.lit("source-x"), "running_balance": F.lit(None).cast("decimal(25,6)"), "original_values": F.create_map(F.lit("column:0"), F.col("locator")), "derived_fields": F.array(F.lit("currency"), F.lit("account"))}
    cols["amount"] = (df["amount"].cast("decimal(25,6)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(25,6)")
    return df.select("locator", C.fingerprint(cols).alias("fingerprint"))


_PARTS = ["'source-x'", "locator", "source_ordinal", "account", "currency", "booking_date", "null", "amt", "null", "strong_id", "reference", "null", "description", "null", "null", "cleared_status", "null", "orig", "'account'||chr(31)||'currency'"]
_FP = " || '|' || ".join(_FIELD.format(p) for p in _PARTS)
_FP_SQL = f"select locator, sha256({_FP}) fingerprint from (select *, regexp_replace(regexp_replace(cast(amount // 100 as varchar) || '.' || lpad(cast(amount % 100 as varchar), 2, '0'), '0+$', ''), '\\.$', '') amt, strlen('column:0')||':column:0'||strlen(locator)||':'||locator orig from bank)"
_register("fingerprints", _FP_SQL)(_fingerprinted)


@_register("exception_keys", "select kind, left_locators, right_locators, detail, exception_key from exk")
def exception_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exceptions of the whole run with their texts and keys, which bind the fingerprints of the rows that they name."""
    found = reconcile.with_keys(_result(spark, sf_dir).exceptions)
    return found.select("kind", _joined("left_locators").alias("left_locators"), _joined("right_locators").alias("right_locators"), "detail", "exception_key")


@_register("exceptions_summary", "select kind, count(*) n from ex group by 1")
def exceptions_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir, bound=False).exceptions.groupBy("kind").agg(F.count("*").alias("n"))


@_register("result_state", """select case when count(*) filter (kind in ('invalidRow','periodGapOrOverlap','ambiguousCandidate'))>0 then 'cannotConclude' when count(*)=0 then 'reconciled' else 'differenceFound' end state, count(*) exceptions,
 (select count(*) from matches) matches, (select count(*) from (select distinct account, currency from (select account, currency from bank union all select account, currency from ledger))) partitions from ex""")
def result_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conclusion and its metrics."""
    r = _result(spark, sf_dir, bound=False)
    return spark.createDataFrame([(r.state, r.exceptions.count(), r.matches.count(), r.totals.count())], "state string, exceptions long, matches long, partitions long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and exceptions by kind: the whole run."""
    r = _result(spark, sf_dir, bound=False)
    return r.matches.select("kind").unionByName(r.exceptions.select("kind")).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES["reconcile_summary"] = flagship
ORACLE_SQL["reconcile_summary"] = _sql("select kind, count(*) n from (select kind from matches union all select kind from ex) group by 1")


_STATEMENT = "(select kind, ls from ex where kind in ('duplicateInLeft','runningBalanceBreak') union all select case reason when 'sum' then 'balanceDifference' else 'periodGapOrOverlap' end, [] from arith where side='l' and reason is not null)"


@_register("statement_state", f"select case when count(*) filter (kind='periodGapOrOverlap')>0 then 'cannotConclude' when count(*)=0 then 'reconciled' else 'differenceFound' end state, count(*) exceptions from {_STATEMENT}")
def statement_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conclusion of a single statement (mode C)."""
    source = reconcile.Source("statement", _rows(spark, sf_dir, "bank_rb"), derive.spark_view(spark, sf_dir, "balances"))
    r = reconcile.run(reconcile.Job("singleStatement", Period(derive.START, derive.END), [source]))
    return spark.createDataFrame([(r.state, r.exceptions.count())], "state string, exceptions long")


#: The views of both exports, under the names that the tiers' SQL reads; they have no balances.
_EXPORTS = {n: derive.VIEWS[n] for n in ("o", "bank")} | {
    "bank_rb": "select *, cast(null as bigint) running_balance from bank",
    "ledger": "select * replace (case when (source_ordinal - (source_ordinal & 1)) {div} 2 % 29 = 0 then 'X' else cleared_status end as cleared_status) from bank",
}
_EXPORT_TIERS = _CASCADE[: [n for n, _ in _CASCADE].index("xp") + 1]
_EXPORT_EX = ("xe", """select case side when 'l' then 'duplicateInLeft' else 'duplicateInRight' end kind from dup
 union all select 'ambiguousCandidate' from sk where n_l>1 or n_r>1 union all select 'ambiguousCandidate' from ck where n_l>1 or n_r>1
 union all select 'ambiguousCandidate' from fr where lr=1 and lt>1 group by l union all select 'ambiguousCandidate' from fr where rr=1 and rt>1 group by r
 union all select what.kind from mut union all select 'possibleSplitOrMerge' from splits union all select 'currencyOrAccountMismatch' from xp
 union all select 'deletedFromNewerExport' from miss union all select 'addedToNewerExport' from unexp""")  # fmt: skip
_EXPORT_PARTS = ("xt", """select a.total is distinct from b.total apart from (select account, currency, sum(amount) total from bank_rb group by all) a
 full join (select account, currency, sum(amount) total from ledger group by all) b on a.account=b.account and a.currency=b.currency""")
_EXPLAINED = """select n changes, case when unsure then 'cannotConclude' when n=0 then 'reconciled' else 'differenceFound' end "before",
 case when unsure then 'cannotConclude' when n=0 then 'reconciled' when apart then 'differenceFound' else 'reconciledWithExplanations' end "after",
 case when unsure then 'cannotConclude' when n=0 then 'reconciled' else 'differenceFound' end unapproved
 from (select count(*) n, count(*) filter (kind='ambiguousCandidate')>0 unsure, (select count(*) filter (apart)>0 from xt) apart from xe)"""


@_register("explained_state", derive.duck_ctes(*_EXPORT_TIERS, _EXPORT_EX, _EXPORT_PARTS, views=_EXPORTS) + _EXPLAINED, cascade=False)
def explained_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports (mode B) of all rows that differ in the status of some: the conclusion before and after all differences were explained
    and approved, and where the approvals are withheld. Rows that both exports repeat are ambiguous, which nothing explains away."""
    older = _rows(spark, sf_dir, "bank")
    changed = F.shiftright("source_ordinal", 1) % 29 == 0
    newer = older.withColumn("cleared_status", F.when(changed, "X").otherwise(F.col("cleared_status")))
    none = spark.createDataFrame([], BALANCES)
    job = reconcile.Job("exportVsExport", Period(derive.START, derive.END), [reconcile.Source("olderExport", older, none), reconcile.Source("newerExport", newer, none)], POLICY, limited=False)
    first = reconcile.run(job).unordered()
    keys = reconcile.with_keys(first.exceptions)
    states = [reconcile.concluded(replace(job, decisions=keys.select("exception_key", F.lit("checked").alias("explanation"), F.lit(ok).alias("approved"))), first) for ok in (True, False)]
    return spark.createDataFrame([(first.exceptions.count(), first.state, *states)], "changes long, before string, after string, unapproved string")


@_register("comparison_rows", """select kind, l left_locator, r right_locator, a.amount left_amount, b.amount right_amount, a.description left_text, b.description right_text from
 (select kind, l, r from matches union all select kind, unnest(list_resize(ls, n)), unnest(list_resize(rs, n)) from (select *, greatest(len(ls), len(rs)) n from ex)) x
 left join l0 a on a.locator=x.l left join r0 b on b.locator=x.r where a.locator is not null or b.locator is not null""")
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as pairs, then the rows that exceptions name, side by side."""
    from tieout.report import comparison

    return comparison(_result(spark, sf_dir, bound=False), _rows(spark, sf_dir, "bank_rb"), _rows(spark, sf_dir, "ledger"))


@_register("statement_comparison", """select 'faulty' job, kind, l.locator left_locator, l.amount left_amount, l.description left_text from (select kind, unnest(ls) x from ex where kind in ('duplicateInLeft','runningBalanceBreak')) e join l0 l on l.locator=e.x
 union all select 'proven', 'statement', locator, amount, description from bank where locator not like '%D'""")
def statement_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single statement (mode C): the rows that its exceptions name, and, where everything proves, all its rows."""
    from tieout.report import comparison

    period = Period(derive.START, derive.END)
    run = lambda rows, balances: reconcile.run(reconcile.Job("singleStatement", period, [reconcile.Source("statement", rows, balances)]), bound=False)
    faulty = _rows(spark, sf_dir, "bank_rb")
    proven = _rows(spark, sf_dir, "bank").filter(~F.col("locator").endswith("D"))
    sums = proven.groupBy("account", "currency").agg(F.sum("amount").alias("sum"))
    balance = lambda kind, day, amount: sums.select(F.lit(kind).alias("kind"), "account", "currency", F.lit(day).alias("date"), amount.cast("bigint").alias("amount"), F.concat(F.lit(kind), "account", "currency").alias("locator"))
    balances = balance("opening", derive.START, F.lit(0)).unionByName(balance("closing", derive.END, F.col("sum")))
    parts = [comparison(run(rows, held), rows).select(F.lit(job).alias("job"), "kind", "left_locator", "left_amount", "left_text") for job, rows, held in (("faulty", faulty, derive.spark_view(spark, sf_dir, "balances")), ("proven", proven, balances))]
    return reduce(DataFrame.unionByName, parts)


_DECIDED = "select exception_key, 'seen: '||kind explanation, kind='dateChanged' approved from exk where kind in ('dateChanged', 'statusOrCategoryChanged')"
_FACTS = {"job": "job-1", "mode": "bankVsLedger", "period": "1995-01-01 to 2001-12-31", "limitation": "Rows, balances and decisions of these \"views\" only"}
_FILES = [{"role": "ledger", "filename": "ledger.csv", "details": "orders"}, {"role": "bank", "filename": "bank.csv", "details": "orders | twice"}]


def _decided(found: DataFrame) -> DataFrame:
    """Decisions that a reviewer made on two kinds of exceptions, one of them not approved."""
    kinds = reconcile.with_keys(found).filter(F.col("kind").isin("dateChanged", "statusOrCategoryChanged"))
    return kinds.select("exception_key", F.concat(F.lit("seen: "), "kind").alias("explanation"), (F.col("kind") == "dateChanged").alias("approved"))


def _quoted(cells: list[str]) -> str:
    return "['" + "','".join(c.replace("'", "''") for c in cells) + "']"


_REPORT = " union all ".join([
    "select 0 rank, '' k0, '' k1, '' k2, '' k3, '' k4, ['section','type','account','currency','left','right','difference','details'] cells",
    "select 1, '000', '', '', '', '', ['summary', state, '', '', '', '', '', 'Mill'] from (select case when count(*) filter (kind in ('invalidRow','periodGapOrOverlap','ambiguousCandidate'))>0 then 'cannotConclude' when count(*)=0 then 'reconciled' else 'differenceFound' end state from ex)",
    *[f"select 2, '{k:03d}', '', '', '', '', " + _quoted(["metadata", n, "", "", "", "", "", v]) for k, (n, v) in enumerate(_FACTS.items())],
    *[f"select 3, '{f['filename']}', '{f['role']}', '', '', '', " + _quoted(["source", f["role"], "", "", "", "", "", f"{f['filename']} | {f['details']}"]) for f in _FILES],
    "select 4, account, currency, '', '', '', ['total', 'sourceActivityComparison', account, currency, l::varchar, r::varchar, (l-r)::varchar, ''] from (select account, currency, cast(sum(l) as bigint) l, cast(sum(r) as bigint) r from (select account, currency, amount l, 0 r from bank union all select account, currency, 0, amount from ledger) group by all)",
    "select 5, l, r, kind, '', '', ['match', kind, '', '', l, r, '', ''] from matches",
    "select 6, kind, array_to_string(ls, ''), array_to_string(rs, ''), '', detail, ['exception', kind, '', '', array_to_string(ls, ' | '), array_to_string(rs, ' | '), '', detail] from ex",
    f"select 7, exception_key, '', '', '', '', ['decision', case when approved then 'approved' else 'unresolved' end, '', '', '', '', '', exception_key||' | '||explanation] from ({_DECIDED})",
])


@_register("report_rows", f"""select row_number() over (order by rank, k0, k1, k2, k3, k4, line) - 1 seq, cells[1] section, cells[2] as type, line from (select *, array_to_string(list_transform(cells, lambda x: '"'||replace(x, '"', '""')||'"'), ',') line from ({_REPORT}))""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the whole run, all sections in their order, with the number of each line and its eight quoted cells."""
    from tieout.report import report_table

    r = _result(spark, sf_dir)
    return report_table(spark, r, "Mill", _FACTS, _FILES, _decided(r.exceptions))


@_register("decision_lookup", f"select e.kind, e.left_locators, e.right_locators, e.exception_key, d.explanation, case when d.approved then 'approved' when not d.approved then 'unresolved' end decision from exk e left join ({_DECIDED}) d on d.exception_key=e.exception_key")
def decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exception with the decision on it, where there is one."""
    from tieout.report import explained

    found = _result(spark, sf_dir).exceptions
    return explained(found, _decided(found)).select("kind", _joined("left_locators").alias("left_locators"), _joined("right_locators").alias("right_locators"), "exception_key", "explanation", F.when(F.col("approved"), "approved").when(~F.col("approved"), "unresolved").alias("decision"))


def _list_json(c: str) -> str:
    return f"'['||array_to_string(list_transform({c}, lambda x: '\"'||x||'\"'), ',')||']'"


_LEAVES = " union all ".join([
    """select 'matches' part, row_number() over (order by l, r, kind) - 1 seq, sha256('{"kind":"'||kind||'","left_locator":"'||l||'","right_locator":"'||r||'"}') leaf from matches""",
    """select 'totals', row_number() over (order by account, currency) - 1, sha256('{"account":"'||account||'","currency":"'||currency||'","difference":'||(l-r)||',"kind":"sourceActivityComparison","left":'||l||',"right":'||r||'}')
 from (select account, currency, cast(sum(l) as bigint) l, cast(sum(r) as bigint) r from (select account, currency, amount l, 0 r from bank union all select account, currency, 0, amount from ledger) group by all)""",
    """select 'exceptions', row_number() over (order by kind, array_to_string(ls, ''), array_to_string(rs, ''), detail) - 1, sha256('{"detail":"'||detail||'","kind":"'||kind||'","left_locators":'||%s||',"right_locators":'||%s||',"source_fingerprints":'||%s||'}')
 from (select e.*, case when fps is null then [] else string_split(fps, ',') end f from exid e left join exfp using (id))""" % (_list_json("ls"), _list_json("rs"), _list_json("f")),
])
_FOLDED = "select part, seq//1024 seq, sha256(string_agg(leaf, '' order by seq)) leaf from {} group by part, seq//1024"


@_register("result_digest", f"""select n.part, n.n as "rows", case when n.n=0 then sha256('') when n.n=1 then (select leaf from leaves x where x.part=n.part and x.seq=0) when n.n<=1024 then (select leaf from up1 x where x.part=n.part and x.seq=0)
 when n.n<=1048576 then (select leaf from up2 x where x.part=n.part and x.seq=0) else (select leaf from up3 x where x.part=n.part and x.seq=0) end sha256
 from (select p.part, count(x.seq) n from (values ('matches'), ('exceptions'), ('totals')) p(part) left join leaves x on x.part=p.part group by p.part) n""", cascade=False)
def result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seal of the whole run: rows and root of the digest tree of its matches, exceptions and totals."""
    from tieout.evidence import result_seal

    found = result_seal(_result(spark, sf_dir))["parts"]
    return spark.createDataFrame([(n, p["rows"], p["sha256"]) for n, p in found.items()], "part string, rows long, sha256 string")


ORACLE_SQL["result_digest"] = derive.duck_ctes(*_CASCADE, ("leaves", _LEAVES), *((f"up{k}", _FOLDED.format("leaves" if k == 1 else f"up{k - 1}")) for k in (1, 2, 3))) + ORACLE_SQL["result_digest"]


@_register("verify_tables", """with a as (select k, 'B'||k as loc, amount, st from o where k%61<>0), b as (select k, 'B'||k as loc, amount + case when k%53=0 then 1 else 0 end amount, st from o where k%59<>0 union all select k, 'N'||k, amount, null from o where k%67=0
 union all select k, 'B'||k, amount, st from o where k%71=0)
 select '{"locator":"'||coalesce(x.loc, y.loc)||'"}' as key, case when x.loc is null then 'added' when y.loc is null then 'removed' else 'changed' end change from (select loc, list(row(amount, st) order by amount, st) r from a group by loc) x
 full join (select loc, list(row(amount, st) order by amount, st) r from b group by loc) y on y.loc=x.loc where x.r is distinct from y.r""", cascade=False)
def verify_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of the same orders, one with rows that are gone, new, changed and repeated: the keys in which they differ."""
    from tieout.operators.sealing import verify_tables as verified

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderkey", "k")
    k, rows = F.col("k"), o.select("k", F.concat(F.lit("B"), F.col("k").cast("string")).alias("locator"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"), F.col("o_orderstatus").alias("status"))
    new = rows.withColumn("amount", F.col("amount") + F.when(k % 53 == 0, 1).otherwise(0)).filter(k % 59 != 0)
    more = rows.filter(k % 67 == 0).select("k", F.concat(F.lit("N"), k.cast("string")).alias("locator"), "amount", F.lit(None).cast("string").alias("status"))
    twice = rows.filter(k % 71 == 0)
    return verified(rows.filter(k % 61 != 0).drop("k"), reduce(DataFrame.unionByName, [new, more, twice]).drop("k"), ["locator"], bucket=50)


ORACLE_SQL["verify_tables"] = ORACLE_SQL["verify_tables"].replace("with a as", derive.duck_ctes().rstrip() + ", a as", 1)


@_register("canonical_rows", r"""select k, '{"amount":{"canonical":"'||regexp_replace(regexp_replace((case when k%3=0 then '-' else '' end)||(c//100)||'.'||lpad((c%100)::varchar,2,'0'),'0+$',''),'\.$','')||'","mantissa":'||(case when k%3=0 then '-' else '' end)||(case when c%100=0 then c//100 when c%10=0 then c//10 else c end)||
 ',"scale":'||(case when c%100=0 then 0 when c%10=0 then 1 else 2 end)||'},"booking_date":"'||d||'","cells":{"a\"b":'||(case when k%7=0 then 'null' else '"'||st||'"' end)||',"z":"'||p||'"},"flags":'||(case when k%5=0 then '[]' when k%5=1 then 'null' else '["'||st||'",null]' end)||
 ',"locked":'||(case when k%2=0 then 'true' else 'false' end)||',"number":'||k||',"row":{"memo":'||(case when k%4=0 then 'null' else '"é\\\"'||p||'\n\u0001"' end)||',"none":null}}' as text
 from (select o_orderkey k, cast(round(o_totalprice*100) as bigint) c, cast(o_orderdate as date) d, o_orderpriority p, o_orderstatus st from orders)""", cascade=False)
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every kind of value as canonical JSON: amounts, dates, lists, maps, structs, nulls and texts that need escapes."""
    from tieout.functions.canonical import canonical_row

    o = _orders(spark, sf_dir).join(_texts(spark, sf_dir).select("k", "p", "st"), "k")
    k, none = F.col("k"), F.lit(None).cast("string")
    amount = (F.when(k % 3 == 0, -F.col("cents")).otherwise(F.col("cents")).cast("decimal(25,6)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(25,6)")
    memo = F.when(k % 4 != 0, F.concat(F.lit('é\\"'), "p", F.lit("\n\u0001")))
    flags = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 != 1, F.array("st", none))
    cells = F.create_map(F.lit("z"), "p", F.lit('a"b'), F.when(k % 7 != 0, F.col("st")))
    rows = o.select("k", F.struct(k.alias("number"), amount.alias("amount"), F.col("d").alias("booking_date"), (k % 2 == 0).alias("locked"), flags.alias("flags"), cells.alias("cells"), F.struct(memo.alias("memo"), none.alias("none")).alias("row")).alias("x"))
    return rows.select("k", "x.*").withColumn("text", canonical_row(rows.select("x.*"))).select("k", "text")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderdate").cast("date").alias("d"))


@_register("amount_parse", """with t as (select o_orderkey k, cast(round(o_totalprice*100) as bigint) c from orders), x as (select k, case k%5 when 0 then (c//100)||'.'||lpad((c%100)::varchar,2,'0') when 1 then '-'||(c//100)||'.5' when 2 then (c//100)||'e3' when 3 then ' '||(c//100) else '+'||(c//100) end raw, c from t)
 select k, raw, case k%5 when 0 then regexp_replace(regexp_replace((c//100)||'.'||lpad((c%100)::varchar,2,'0'),'0+$',''),'\\.$','') when 1 then raw when 4 then (c//100)::varchar end amount_text from x""", cascade=False)
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, whole = _orders(spark, sf_dir), F.expr("cast(cents div 100 as string)")
    kind = F.col("k") % 5
    raw = F.when(kind == 0, F.concat(whole, F.lit("."), F.lpad(F.expr("cast(cents % 100 as string)"), 2, "0"))).when(kind == 1, F.concat(F.lit("-"), whole, F.lit(".5"))).when(kind == 2, F.concat(whole, F.lit("e3"))).when(kind == 3, F.concat(F.lit(" "), whole)).otherwise(F.concat(F.lit("+"), whole))
    return o.select("k", raw.alias("raw")).withColumn("amount_text", C.amount_text(C.amount(F.col("raw"))))


@_register("date_parse", """select o_orderkey k, case when o_orderkey%7=0 then null else cast(o_orderdate as date) end iso, case when o_orderkey%7=1 then null else cast(o_orderdate as date) end dmy, cast(o_orderdate as date) lenient from orders""", cascade=False)
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    iso = F.when(F.col("k") % 7 == 0, F.date_format("d", "yyyy-M-d-")).otherwise(F.date_format("d", "yyyy-MM-dd"))
    dmy = F.when(F.col("k") % 7 == 1, F.date_format("d", "'x'dd/MM/yyyy")).otherwise(F.date_format("d", "dd/MM/yyyy"))
    return o.select("k", C.iso_date(iso).alias("iso"), C.delimited_date(dmy, "dmy").alias("dmy"), C.lenient_date(F.date_format("d", "M/d/yy"), "mdy").alias("lenient"))


@_register("excel_date", "select o_orderkey k, case when o_orderkey%90000=60 or o_orderkey%90000=0 then null else date '1899-12-31' + cast(o_orderkey%90000 - case when o_orderkey%90000>60 then 1 else 0 end as integer) end d1900, date '1904-01-01' + cast(o_orderkey%90000 as integer) d1904 from orders", cascade=False)
def excel_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.col("k") % 90000
    return _orders(spark, sf_dir).select("k", C.excel_date(serial).alias("d1900"), C.excel_date(serial, True).alias("d1904"))


@_register("implied_amount", """select o_orderkey k, c, case c when 'JPY' then cast(v as varchar) when 'KWD' then regexp_replace(regexp_replace((v//1000)||'.'||lpad((v%1000)::varchar,3,'0'),'0+$',''),'\\.$','') else regexp_replace(regexp_replace((v//100)||'.'||lpad((v%100)::varchar,2,'0'),'0+$',''),'\\.$','') end amount_text
 from (select *, cast(round(o_totalprice*100) as bigint) v, case o_orderkey%3 when 0 then 'JPY' when 1 then 'KWD' else 'USD' end c from orders)""", cascade=False)
def implied_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("k") % 3 == 0, "JPY").when(F.col("k") % 3 == 1, "KWD").otherwise("USD")
    return _orders(spark, sf_dir).withColumn("c", c).select("k", "c", C.amount_text(C.implied_amount(F.col("cents").cast("string"), F.col("c"))).alias("amount_text"))


@_register("signed_amount", """select o_orderkey k, case when o_orderkey%5=4 then null else cast(round(o_totalprice*100) as bigint) * case when o_orderkey%2=0 then 1 else -1 end * case when o_orderkey%3=0 then -1 else 1 end end signed_cents from orders""", cascade=False)
def signed_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    ind = F.when(F.col("k") % 5 == 4, "XXXX").when(F.col("k") % 2 == 0, "CRDT").otherwise("DBIT")
    return _orders(spark, sf_dir).select("k", C.signed(F.col("cents"), ind, F.col("k") % 3 == 0).alias("signed_cents"))


QUERIES.update(line_queries.QUERIES)
ORACLE_SQL.update(line_queries.ORACLE_SQL)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(x) for x in ("_bank", "_ledger", "_statement", "_old", "_new", "")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".OFX", ".sta", ".bai2", ".txt")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("f"), F.expr("o_orderkey div 2").cast("string"), role, suffix).alias("filename"))


_NAMES_SQL = "select 'f'||(o_orderkey//2)||['_bank','_ledger','_statement','_old','_new',''][o_orderkey%6+1]||['.csv','.OFX','.sta','.bai2','.txt'][o_orderkey%5+1] filename from orders"


@_register("format_detect", f"""select filename, case lower(regexp_extract(filename,'\\.([^.]*)$',1)) when 'csv' then 'csv' when 'ofx' then 'ofx' when 'sta' then 'mt940' when 'bai2' then 'bai2' end format from ({_NAMES_SQL})""", cascade=False)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.sources.detect import format_by_name

    return _names(spark, sf_dir).select("filename", format_by_name(F.col("filename")).alias("format"))


@_register("batch_pairing", f"""select base, case when roles in ('bank,ledger') then 'bankVsLedger' when roles='newerExport,olderExport' then 'exportVsExport' when roles='statement' then 'singleStatement' else 'unassigned' end mode, files from (
 select base, string_agg(role, ',' order by role) roles, string_agg(filename, ',' order by filename) files from (select filename, case when s='' then regexp_replace(filename,'\\.[^.]*$','') else regexp_replace(filename,'_[a-z]+\\.[^.]*$','') end base,
 case s when 'bank' then 'bank' when 'ledger' then 'ledger' when 'statement' then 'statement' when 'old' then 'olderExport' when 'new' then 'newerExport' else 'none' end as role from (select filename, regexp_extract(filename,'_([a-z]+)\\.[^.]*$',1) s from ({_NAMES_SQL}))) group by base)""", cascade=False)
def batch_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.sources.batch import paired

    return paired(_names(spark, sf_dir)).select("base", "mode", _joined("files").alias("files"))


@_register("revision_chain", """select user_id, event_id, case when rn<>rev then 'gap' end problem from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) rn,
 row_number() over (partition by user_id order by ts, event_id) + case when event_id%97=0 then 1 else 0 end rev from events) where rn<>rev""", cascade=False)
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.operators.revisions import broken_revisions

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    revised = e.select("user_id", "event_id", "ts", (n + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("revision"))
    return broken_revisions(revised, "user_id", ["ts", "event_id"], "revision").select("user_id", "event_id", "problem")


@_register("history_validation", """with e as (select user_id, event_id, cast(round(value*100) as bigint) cents, event_type, props, row_number() over (partition by user_id order by ts, event_id) rn from events),
 d as (select *, sha256('{"cents":'||cents||',"event_type":"'||event_type||'","props":"'||replace(props, '"', '\\"')||'"}') own from e),
 p as (select *, lag(own) over (partition by user_id order by rn) b_own, lag(event_id) over (partition by user_id order by rn) b_id from d),
 r as (select user_id, rn, event_id, b_id, event_id%97=0 moved, coalesce(b_id%97=0, false) b_moved, event_id%89=0 false_hash, coalesce(b_id%53=0, false) b_locked from p where event_id%101<>0 or rn=1)
 select user_id job, rn "revision", problem from (
 select user_id, rn, 'gap' problem from r where rn>1 and b_id%101=0 and rn>2 union all select user_id, rn, 'hash' from r where rn=1 and false_hash union all select user_id, rn, 'hash' from r where rn>1 and not (b_id%101=0 and rn>2) and false_hash
 union all select user_id, rn, 'afterLock' from r where rn>1 and not (b_id%101=0 and rn>2) and b_locked union all select user_id, rn, 'repeated' from r where moved union all select user_id, rn, 'repeated' from r where moved
 union all select user_id, rn, 'hash' from r where moved and rn=1 and false_hash union all select user_id, rn, 'hash' from r where moved and rn>1 and not (b_id%101=0 and rn>2) and false_hash
 union all select user_id, rn, 'gap' from r where moved and rn>1 and b_id%101=0 and rn>2 union all select user_id, rn, 'afterLock' from r where moved and rn>1 and not (b_id%101=0 and rn>2) and b_locked)""", cascade=False)
def history_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions of one job a user, each with the digest that it states for the one before: revisions that are gone, there twice, follow a
    lock, or state another digest than the content before has."""
    from tieout.operators import revisions

    content = ["cents", "event_type", "props"]
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order, id_ = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("event_id")
    rows = e.select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "event_type", "props", F.row_number().over(order).cast("long").alias("revision"))
    rows = rows.withColumn("own", revisions.content_digest(rows, content))
    stated = rows.withColumn("previous", F.when(id_ % 89 == 0, "false").otherwise(F.lag("own").over(order))).withColumn("state", F.when(id_ % 53 == 0, "locked").otherwise("draft"))
    stated = stated.filter((id_ % 101 != 0) | (F.col("revision") == 1))
    return revisions.history_problems(stated.unionByName(stated.filter(id_ % 97 == 0)), "user_id", "revision", "previous", "state", content)


# ---- functions and job tables over texts made of keys ----


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"))


_TEXTS = "(select o_orderkey k, cast(o_orderdate as date) d, o_orderpriority p, o_custkey c, o_orderstatus st from orders)"


@_register("ofx_dates", f"select k, case when k%6=5 then null else d end found from {_TEXTS}", cascade=False)
def ofx_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("k") % 6 == 5, F.date_format("d", "yyyy-MM-dd")).when(F.col("k") % 2 == 0, F.date_format("d", "yyyyMMdd'120000[-5:EST]'")).otherwise(F.date_format("d", "yyyyMMdd"))
    return _texts(spark, sf_dir).select("k", C.ofx_date(shown).alias("found"))


@_register("compact_dates", f"select k, case when k%5<>4 then try_cast((case when k%100>=70 then 1900 else 2000 end + k%100)::varchar||strftime(d, '-%m-%d') as date) end found from {_TEXTS}", cascade=False)
def compact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six digits of days that may not be in the year that they name (29 February), and texts of seven."""
    shown = F.concat(F.lpad((F.col("k") % 100).cast("string"), 2, "0"), F.date_format("d", "MMdd"), F.when(F.col("k") % 5 == 4, "x").otherwise(""))
    return _texts(spark, sf_dir).select("k", C.compact_date(shown).alias("found"))


@_register("source_ids", f"select k, 'source-'||sha256('file '||k||' of '||p) source_id from {_TEXTS}", cascade=False)
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("file "), F.col("k").cast("string"), F.lit(" of "), F.col("p")).cast("binary")
    return _texts(spark, sf_dir).select("k", F.concat(F.lit("source-"), F.sha2(content, 256)).alias("source_id"))


@_register("clean_texts", f"select k, case k%4 when 0 then null when 1 then p when 2 then p||'  '||st else p end found, regexp_replace(lower(p||' No. '||st), '[^a-z0-9]', '', 'g') header from {_TEXTS}", cascade=False)
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("k") % 4
    raw = F.when(kind == 0, " \t\u00a0\n").when(kind == 1, F.concat(F.lit("\u2003\t"), "p", F.lit("\r\n"))).when(kind == 2, F.concat(F.lit(" "), "p", F.lit("  "), "st", F.lit("\u00a0"))).otherwise(F.col("p"))
    return _texts(spark, sf_dir).select("k", C.cleaned(raw).alias("found"), C.normalized_header(F.concat("p", F.lit(" No. "), "st")).alias("header"))


@_register("folded_texts", f"select k, case when k%6<>5 then trim(regexp_replace(lower(strip_accents(case when k%2=0 then 'Réf-'||k||' ' else '' end||'Crème BRÛLÉE '||p||' Ñandú '||st)), '[^a-z0-9]+', ' ', 'g')) end found from {_TEXTS}", cascade=False)
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to compare, with letters beyond ASCII in either case; those that are too long have none."""
    k = F.col("k")
    reference, none = F.when(k % 2 == 0, F.concat(F.lit("Réf-"), k.cast("string"))), F.lit(None).cast("string")
    memo = F.when(k % 6 == 5, F.repeat(F.lit("é"), 300)).otherwise(F.concat(F.lit("\u00a0Ñandú\t"), "st"))
    return _texts(spark, sf_dir).select("k", C.comparison_text(reference, F.concat(F.lit("Crème BRÛLÉE "), "p"), none, memo, TEXT).alias("found"))


@_register("display_names", f"select k, case k%3 when 0 then 'Amount Changed' when 1 then 'Duplicate In Left' else 'Reconciled' end shown from {_TEXTS}", cascade=False)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("amountChanged"), F.lit("duplicateInLeft"), F.lit("reconciled")), (F.col("k") % 3 + 1).cast("int"))
    return _texts(spark, sf_dir).select("k", C.display_name(kind).alias("shown"))


@_register("timestamps", f"select k, k%5 in (0, 1) fits from {_TEXTS}", cascade=False)
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds in UTC: real ones, and others of the same or nearly the same shape."""
    kind, day = F.col("k") % 5, F.date_format("d", "yyyy-MM-dd")
    raw = F.when(kind == 0, F.concat(day, F.lit("T00:00:00Z"))).when(kind == 1, F.concat(day, F.lit("T23:59:59Z"))).when(kind == 2, F.concat(day, F.lit("T24:61:00Z"))).when(kind == 3, F.concat(day, F.lit("T12:00:00.5Z"))).otherwise(F.concat(F.lit("2026-99-99T"), F.lit("10:00:00Z")))
    return _texts(spark, sf_dir).select("k", C.whole_second(raw).alias("fits"))


@_register("tier_permits", f"""select k, k%3=2 or k%3=1 or k%5<2 lock_, k%3=2 or k%5<1 entity, k%3>=1 or k%5<1 profile, k%3=2 brand from {_TEXTS}""", cascade=False)
def tier_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.application import permits

    tier = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("accountant")), (F.col("k") % 3 + 1).cast("int"))
    return _texts(spark, sf_dir).select("k", *[permits(tier, what, F.col("k") % 5).alias("lock_" if what == "lock" else what) for what in ("lock", "entity", "profile", "brand")])


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions of jobs, one job for each customer."""
    state = F.when(F.col("k") % 3 == 0, "locked").otherwise("draft")
    result = F.element_at(F.array(*[F.lit(x) for x in ("reconciled", "differenceFound", "cannotConclude", "reconciledWithExplanations")]), (F.col("k") % 4 + 1).cast("int"))
    return _texts(spark, sf_dir).select(F.col("c").alias("job"), F.col("k").alias("revision"), state.alias("state"), result.alias("result_state"), (F.col("k") % 7 == 0).alias("sample"), (F.col("c") % 11).alias("entity"))


_JOBS = f"(select c job, k revision, case when k%3=0 then 'locked' else 'draft' end state, ['reconciled','differenceFound','cannotConclude','reconciledWithExplanations'][k%4+1] result_state, k%7=0 sample, c%11 entity from {_TEXTS})"


@_register("current_heads", f"select distinct on (job) job, revision, state, result_state, sample, entity from {_JOBS} order by job, revision desc", cascade=False)
def current_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.operators.revisions import current_heads as heads

    return heads(_jobs(spark, sf_dir), "job", "revision")


@_register("review_queue", f"select job, revision, state, result_state from {_JOBS} where state='draft' or result_state in ('differenceFound','cannotConclude')", cascade=False)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.application import review_queue as queue

    return queue(_jobs(spark, sf_dir)).select("job", "revision", "state", "result_state")


@_register("locked_records", f"select job, revision, sample from {_JOBS} where state='locked'", cascade=False)
def locked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.application import locked_records as locked

    return locked(_jobs(spark, sf_dir)).select("job", "revision", "sample")


@_register("free_lock_usage", f"select count(*) filter (state='locked' and not sample) used from {_JOBS}", cascade=False)
def free_lock_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).agg(F.count_if((F.col("state") == "locked") & ~F.col("sample")).alias("used"))


@_register("job_entities", f"select job, revision, case when entity<9 then 'Entity '||entity else 'Unassigned' end entity_name from {_JOBS}", cascade=False)
def job_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.application import entity_names

    entities = spark.range(9).select("id", F.concat(F.lit("Entity "), F.col("id").cast("string")).alias("name"))
    return entity_names(_jobs(spark, sf_dir), entities).select("job", "revision", "entity_name")


@_register("state_violations", f"""select 'ids_unique' "check", 0::bigint violations union all select 'names_not_blank', 1 union all select 'jobs_have_entities', count(*) filter (entity>=9) from {_JOBS}""", cascade=False)
def state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.application import violations

    entities = spark.range(9).select("id", F.when(F.col("id") == 4, " ").otherwise("name").alias("name"))
    return violations(entities, _jobs(spark, sf_dir).select("job", "entity"))


_DECISIONS = f"(select sha256('exception '||k) exception_key, case k%4 when 0 then ' ' else 'checked' end explanation, k%3<>0 approved from {_TEXTS})"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat(F.lit("exception "), F.col("k").cast("string")), 256)
    return _texts(spark, sf_dir).select(key.alias("exception_key"), F.when(F.col("k") % 4 == 0, " ").otherwise("checked").alias("explanation"), (F.col("k") % 3 != 0).alias("approved"), "k")


@_register("approved_decisions", f"select exception_key from {_DECISIONS} where approved and trim(explanation)<>''", cascade=False)
def approved_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.approved(_decisions(spark, sf_dir)).select("exception_key")


@_register("decision_upsert", f"select sha256('exception '||k) exception_key, case when k%5=0 then 'again' when k%4=0 then ' ' else 'checked' end explanation, case when k%5=0 then true else k%3<>0 end approved from {_TEXTS}", cascade=False)
def decision_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tieout.application import with_decision

    d = _decisions(spark, sf_dir)
    new = d.filter("k % 5 = 0").select("exception_key", F.lit("again").alias("explanation"), F.lit(True).alias("approved"))
    return with_decision(d.drop("k"), new)
