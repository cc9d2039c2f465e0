"""The whole reconciliation: three modes from canonical tables to a result."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions import columns as C
from tieout.model import DECISIONS, INCONCLUSIVE_KINDS, MANUAL_MATCHES, MATCHES, MODES, ArithmeticOverflow, IntegrityFailure, MatchingPolicy, Period, PeriodViolation, ResourceLimit, RoleMismatch
from tieout.operators import checks, matching, sums
from tieout.session import cut, together

ROW = ("source_id", "locator", "source_ordinal", "account", "currency", "booking_date", "value_date", "amount", "running_balance", "strong_id", "reference", "payee", "description", "memo", "transaction_code", "cleared_status", "category", "original_values", "derived_fields")


@dataclass
class Source:
    """One side: its rows and balances, and what its parser said of them."""

    role: str
    transactions: DataFrame
    balances: DataFrame
    completeness: str = "complete"
    invalid_locators: tuple = ()
    #: the files that its rows may come from; None: one, whichever it is
    source_ids: tuple[str, ...] | None = None
    #: what it was parsed for; None: not stated
    period: Period | None = None


@dataclass
class Job:
    mode: str
    period: Period
    sources: list[Source]
    policy: MatchingPolicy = field(default_factory=MatchingPolicy)
    manual_matches: DataFrame | None = None
    decisions: DataFrame | None = None
    #: whether the policy's limits on work refuse the job; they never change what is found
    limited: bool = True


@dataclass
class Result:
    state: str
    matches: DataFrame
    exceptions: DataFrame
    totals: DataFrame
    #: the same in no order
    loose: Result | None = None

    def unordered(self) -> Result:
        """For readers that put the rows in an order of their own, or in none: nothing is sorted for them."""
        return self.loose or self


def _exception(df: DataFrame, kind: str | Column, left: Column | None, right: Column | None, detail: Column | str) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.array_sort(left if left is not None else none).alias("left_locators"), F.array_sort(right if right is not None else none).alias("right_locators"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")
    )


def _sided(df: DataFrame, kind, locators: Column, detail, left: bool) -> DataFrame:
    return _exception(df, kind, locators if left else None, None if left else locators, detail)


def _validated(job: Job) -> list[Source]:
    """Sources in the order of the mode's roles, each read once: all that follows starts from their tables in the shared folder.
    Every check is an action, as a lazy one could be pruned away."""
    roles = MODES.get(job.mode)
    if roles is None or sorted(s.role for s in job.sources) != sorted(roles):
        raise RoleMismatch(f"{job.mode} with {[s.role for s in job.sources]}")
    for s in job.sources:
        if s.period is not None and s.period != job.period:
            raise PeriodViolation(f"{s.role} was read for another period")
    _unique_decisions(job)
    if job.mode == "singleStatement" and job.manual_matches is not None and job.manual_matches.limit(1).count():
        raise IntegrityFailure("one statement has nothing to match by hand")
    tables = together(*[partial(cut, df, f"{what}-{s.role}") for s in job.sources for what, df in (("rows", s.transactions.select(*ROW)), ("balances", s.balances))])
    held = [replace(s, transactions=tables[2 * k], balances=tables[2 * k + 1]) for k, s in enumerate(job.sources)]

    def looked_at(s: Source) -> None:
        bad = [r["check"] for r in checks.validation(s.transactions, s.balances, job.period.start, job.period.end, s.source_ids).filter("violations <> 0").collect()]
        if bad:
            raise (PeriodViolation if set(bad) <= set(checks.PERIOD_CHECKS) else IntegrityFailure)(f"{s.role}: {', '.join(bad)}")
        if over := sums.overflowing(s.transactions).select(*checks.PARTITION).limit(1).collect():
            raise ArithmeticOverflow(f"{s.role}: the sum of {over[0]['account']} {over[0]['currency']} leaves 64 bits")

    together(*[partial(looked_at, s) for s in held])
    return sorted(held, key=lambda s: roles.index(s.role))


def _unique_decisions(job: Job) -> None:
    if job.decisions is not None:
        n, keys = job.decisions.agg(F.count("*"), F.count_distinct("exception_key")).first()
        if n != keys:
            raise IntegrityFailure("two decisions on one exception, or one on none")


def _incomplete(job: Job, sources: list[Source]) -> bool:
    return any(s.completeness != "complete" for s in sources) or (job.mode == "singleStatement" and not sources[0].balances.limit(1).count())


def concluded(job: Job, result: Result) -> str:
    """The state of a job whose result is known (with fingerprints, as ``run`` gives it), under the decisions that the job has now: they change
    what follows from the exceptions and nothing that is found, so nothing is run again."""
    _unique_decisions(job)
    found = result.unordered()
    return _state(job, found.exceptions, found.totals, _incomplete(job, job.sources), job.mode == "singleStatement")


def _structural(spark: SparkSession, s: Source, left: bool) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in s.invalid_locators], "locator string")
    return _sided(rows, "invalidRow", F.array("locator"), "Source reported an invalid record", left)


def _bytes(c: str) -> Column:
    """The length of a cleaned text in bytes; identities tell lengths, not contents."""
    return F.coalesce(F.octet_length(C.cleaned(F.col(c))), F.lit(0)).cast("string")


def _part() -> Column:
    return F.concat_ws("|", "account", "currency")


def _identity(day: str, amount: str, *texts: tuple[str, str]) -> Column:
    told = [F.concat(F.lit(f" {name}["), _bytes(c), F.lit("]")) for name, c in texts]
    return F.concat(_part(), F.lit(" "), F.col(day).cast("string"), F.lit(" "), C.amount_text(F.col(amount)), *told)


def _strong_identity(c: str) -> Column:
    return F.concat(_part(), F.lit(" strong-id["), _bytes(c), F.lit("]"))


def _side_checks(spark: SparkSession, s: Source, rows: DataFrame, left: bool, period: Period, arithmetic: bool) -> list[DataFrame]:
    own = F.when(F.col("k_id").isNotNull(), _strong_identity("k_id")).otherwise(_identity("k_date", "k_amount", ("reference", "k_reference"), ("description", "k_description")))
    out = [_structural(spark, s, left), _sided(checks.duplicates(rows), "duplicateInLeft" if left else "duplicateInRight", F.col("locators"), F.concat(F.lit("Repeated identity: "), own), left)]
    text = lambda c: C.amount_text(F.col(c))
    told = F.concat(_part(), F.lit(": expected "), text("expected"), F.lit(", found "), text("found"))
    out.append(_sided(checks.running_balance_breaks(rows, s.balances), "runningBalanceBreak", F.array_compact("locators"), told, left))
    if arithmetic:
        sums = F.concat(F.lit(": opening "), text("opening_amount"), F.lit(" + activity "), text("activity"), F.lit(" = "), C.amount_text(F.col("opening_amount") + F.col("activity")), F.lit(", not "), text("closing_amount"))
        why = F.when(F.col("reason") == "count", ": expected exactly one opening and one closing balance").when(F.col("reason") == "dates", ": balance dates do not bound the selected period").otherwise(sums)
        out.append(_sided(checks.statement_arithmetic(rows, s.balances, period.start, period.end), F.col("kind"), F.col("locators"), F.concat(_part(), why), left))
    return out


def _manual(job: Job, left: DataFrame, right: DataFrame) -> DataFrame:
    """Decided pairs; a row that is gone, used twice, changed since or in another partition refuses the job."""
    m = job.manual_matches
    cols = lambda df, p: df.select(F.col("locator").alias(f"{p}_locator"), F.col("account").alias(f"{p}_a"), F.col("currency").alias(f"{p}_c"), C.fingerprint({n: df[n] for n in ROW}).alias(f"{p}_now"))
    joined = m.join(cols(left, "left"), "left_locator", "left").join(cols(right, "right"), "right_locator", "left")
    fits = F.col("left_now").eqNullSafe(F.col("left_fingerprint")) & F.col("right_now").eqNullSafe(F.col("right_fingerprint")) & F.col("left_a").eqNullSafe(F.col("right_a")) & F.col("left_c").eqNullSafe(F.col("right_c"))
    n, l, r, ok = joined.agg(F.count("*"), F.count_distinct("left_locator"), F.count_distinct("right_locator"), F.count_if(fits)).first()
    if not n == l == r == ok:
        raise IntegrityFailure("a manual match no longer holds")
    return m.select("left_locator", "right_locator", F.lit("manual").alias("kind"))


def run(job: Job, *, bound: bool = True) -> Result:
    """State, matches, exceptions with fingerprints, and totals. Nothing ambiguous is ever resolved. What proves each side, what is
    matched and what is summed up do not depend on each other and are made at the same time.

    Where ``bound`` is false and the job has no decisions, exceptions have no fingerprints: for readers of kinds and numbers only.
    """
    sources = _validated(job)
    spark = sources[0].transactions.sparkSession
    rows = [s.transactions for s in sources]
    single = job.mode == "singleStatement"

    def proven() -> DataFrame:
        found = []
        for k, (s, df) in enumerate(zip(sources, rows, strict=True)):
            found += _side_checks(spark, s, df, k == 0, job.period, single or bool(s.balances.limit(1).count()))
        if not single:
            found.append(_compared(sources))
        return cut(_told(found, 0), "proven")

    def summed() -> DataFrame:
        totals = checks.statement_totals(rows[0], sources[0].balances) if single else checks.partition_totals(*rows)
        totals = cut(totals.withColumn("kind", F.lit("statementBalanceEquation" if single else "sourceActivityComparison")), "totals")
        if over := sums.unfit(totals).limit(1).collect():
            raise ArithmeticOverflow(f"the total of {over[0]['account']} {over[0]['currency']} leaves 64 bits")
        return totals

    def matched() -> tuple[DataFrame, DataFrame | None]:
        if single:
            return spark.createDataFrame([], MATCHES), None
        tiers = Tiers(*rows, job.policy, _manual(job, *rows) if job.manual_matches is not None else None, job.limited)
        open_ = lambda: cut(_told(tiers.exceptions(job.mode), 1), "open")
        tiers.rest3  # once, before both steps ask for it, as they are before those that follow  # noqa: B018
        together(lambda: tiers.met, lambda: tiers.splits if job.policy.split_merge else None)
        return tuple(together(lambda: tiers.checked, open_))

    held, totals, (matches, open_) = together(proven, summed, matched)
    found = held if open_ is None else held.unionByName(open_)
    exceptions = cut(_bound(found, rows), "exceptions") if bound or job.decisions is not None else found.drop("n")
    state = _state(job, exceptions, totals, _incomplete(job, sources), single)
    loose = Result(state, matches, exceptions, totals)
    return Result(state, matches.orderBy("left_locator", "right_locator", "kind"), ordered(exceptions), totals.orderBy("account", "currency"), loose)


def _told(found: list[DataFrame], which: int) -> DataFrame:
    """Exceptions with a number, which is fixed where they are written and unlike those of the other table."""
    return reduce(DataFrame.unionByName, found).withColumn("n", F.monotonically_increasing_id() * 2 + which)


def _compared(sources: list[Source]) -> DataFrame:
    """Balances in which the sides do not agree."""
    compared = checks.balance_comparison(*(s.balances for s in sources))
    none, key = F.array().cast("array<string>"), F.concat(_part(), F.lit(" "), F.col("kind"))
    several = F.col("outcome") == "periodGapOrOverlap"
    sides = [F.when(several, none).otherwise(F.coalesce(f"{side}_locators", none)) for side in ("left", "right")]
    return _exception(compared, F.col("outcome"), *sides, F.concat(F.when(several, "Multiple balance markers for ").otherwise("Balance amount or date differs for "), key))


class Tiers:
    """The matching tiers in order. Each reads what the one before left over; frames that several readers need are cut from their
    lineage when they are first asked for, once. What goes from tier to tier is keys; texts to compare are made for the rows that
    reach the fuzzy tier. Where ``limited`` is false, the policy's limits on work do not refuse: all that there is is found."""

    KEYS = ("locator", "account", "currency", "booking_date", "amount", "strong_id", "reference")
    PARTS = ("reference", "description", "payee", "memo")

    def __init__(self, left: DataFrame, right: DataFrame, policy: MatchingPolicy, manual: DataFrame | None = None, limited: bool = True):
        self.left, self.right, self.policy, self.manual, self.limited = left, right, policy, manual, limited

    def _less(self, sides: tuple[DataFrame, DataFrame], pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        return tuple(together(*[partial(cut, matching.without(df, pairs, f"{s}_locator"), f"{name}-{s}") for df, s in zip(sides, ("left", "right"), strict=True)]))

    def _rest(self, sides: tuple[DataFrame, DataFrame], pairs: DataFrame, text: str, name: str) -> tuple[DataFrame, DataFrame]:
        """What a tier over rows with a ``text`` leaves: rows without it take no part, so they neither meet its pairs nor are written again."""
        blank = C.cleaned(F.col(text)).isNull()
        left_over = self._less(tuple(df.filter(~blank) for df in sides), pairs, name)
        return tuple(df.filter(blank).unionByName(own) for df, own in zip(sides, left_over, strict=True))

    @cached_property
    def rest0(self) -> tuple[DataFrame, DataFrame]:
        sides = tuple(df.select(*dict.fromkeys(self.KEYS + self.PARTS)) for df in (self.left, self.right))
        return sides if self.manual is None else self._less(sides, self.manual, "rest0")

    @cached_property
    def strong_groups(self) -> DataFrame:
        return cut(matching.strong(*self.rest0), "strong")

    @cached_property
    def strong(self) -> DataFrame:
        return matching.unique_pairs(self.strong_groups, "strongID")

    @cached_property
    def rest1(self) -> tuple[DataFrame, DataFrame]:
        return self._rest(self.rest0, self.strong, "strong_id", "rest1")

    @cached_property
    def composite_groups(self) -> DataFrame:
        return cut(matching.composite(*self.rest1), "composite")

    @cached_property
    def composite(self) -> DataFrame:
        return matching.unique_pairs(self.composite_groups, "exactComposite")

    @cached_property
    def rest2(self) -> tuple[DataFrame, DataFrame]:
        return self._rest(self.rest1, self.composite, "reference", "rest2")

    def _texts(self, side: str) -> DataFrame:
        """What is left of a side with the text to compare, made once; only texts beyond ASCII go through Python, and where there are none no
        worker starts."""
        rest, parts = self.rest2[side == "right"], [F.col(n) for n in self.PARTS]
        told = lambda ascii_only: C.comparison_text(*parts, self.policy.maximum_text_scalars, ascii_only=ascii_only)
        joined = F.concat_ws("", *parts)
        plain = F.length(joined) == F.octet_length(joined)
        kept = [F.when(~plain, F.col(n)).alias(n) for n in self.PARTS]
        keys = [c for c in self.KEYS if c not in ("strong_id", "reference")]
        # a text beyond ASCII is told below; a condition here would have each part told many times over
        full = cut(rest.select(*keys, C.cleaned(F.col("strong_id")).alias("strong_id"), told(True).alias("text"), *kept, plain.alias("plain")), f"texts-{side}")
        slim = lambda df: df.drop("plain", *self.PARTS)
        if not full.filter(~F.col("plain")).limit(1).count():
            return slim(full)
        return slim(full.filter("plain")).unionByName(slim(cut(full.filter(~F.col("plain")).withColumn("text", told(False)), f"folded-{side}")))

    @cached_property
    def candidates(self) -> DataFrame:
        """All pairs of rows; the tiers themselves only need the pairs of their classes."""
        pairs = self.class_pairs
        return matching.expanded(pairs, *self.members)

    @cached_property
    def texts(self) -> tuple[DataFrame, DataFrame]:
        self.rest2  # once, before both sides ask for it  # noqa: B018
        return tuple(together(partial(self._texts, "left"), partial(self._texts, "right")))

    @cached_property
    def classes(self) -> tuple[DataFrame, DataFrame]:
        return tuple(together(*[partial(cut, matching.text_classes(df), f"classes-{s}") for df, s in zip(self.texts, ("left", "right"), strict=True)]))

    @cached_property
    def members(self) -> tuple[DataFrame, DataFrame]:
        return tuple(matching.class_members(df, c) for df, c in zip(self.texts, self.classes, strict=True))

    @cached_property
    def class_pairs(self) -> DataFrame:
        found = cut(matching.class_pairs(*self.classes, self.policy.maximum_date_distance_days, self.policy.minimum_similarity_permille), "candidates")
        if self.limited and (found.agg(F.sum(F.col("n_l") * F.col("n_r"))).first()[0] or 0) > self.policy.maximum_fuzzy_candidate_pairs:
            raise ResourceLimit("fuzzy candidate pairs")
        return found

    @cached_property
    def ranks(self) -> DataFrame:
        return cut(matching.ranked(self.class_pairs), "ranks")

    @cached_property
    def fuzzy(self) -> DataFrame:
        return matching.mutual_best(self.ranks)

    @cached_property
    def rest3(self) -> tuple[DataFrame, DataFrame]:
        if self.policy.fuzzy:
            return self._less(tuple(df.drop("text") for df in self.texts), self.fuzzy, "rest3")
        return tuple(together(*[partial(cut, df.select(*self.KEYS), f"rest3-{s}") for df, s in zip(self.rest2, ("left", "right"), strict=True)]))

    @cached_property
    def matches(self) -> DataFrame:
        tiers = [*([self.manual] if self.manual is not None else []), self.strong, self.composite, *([self.fuzzy] if self.policy.fuzzy else [])]
        return cut(reduce(DataFrame.unionByName, tiers), "matches")

    @cached_property
    def met(self) -> DataFrame:
        """The matches beside their rows, once for what checks them and what tells how they differ."""
        return cut(matching.met(self.matches, self.left, self.right), "met")

    @cached_property
    def checked(self) -> DataFrame:
        """The matches, after it was seen that no row is in two and none crosses a partition, nor a fuzzy one an amount."""
        n, ok = self.met.agg(F.count("*"), F.count_if((F.col("left_times") == 1) & (F.col("right_times") == 1) & F.col("same_part") & ((F.col("tier") != "fuzzy") | F.col("same_amount")))).first()
        if not self.matches.count() == n == ok:
            raise IntegrityFailure("a match crossed a hard gate or used a row twice")
        return self.matches

    @cached_property
    def splits(self) -> DataFrame:
        days, size = self.policy.maximum_date_distance_days, self.policy.maximum_split_merge_group_size
        if self.limited and matching.split_merge_evaluations(*self.rest3, days, size).first()[0] > self.policy.maximum_split_merge_evaluations:
            raise ResourceLimit("split/merge evaluations")
        return cut(matching.split_merge(*self.rest3, days, size), "splits")

    def unpaired(self, side: str) -> DataFrame:
        """Unmatched rows of a side that no split or merge candidate has."""
        df = self.rest3[side == "right"]
        if not self.policy.split_merge:
            return df
        held = self.splits.select(F.explode(f"{side}_locators").alias("held")).distinct()
        return df.join(held, df["locator"] == F.col("held"), "left_anti")

    def ambiguous(self, tier: str) -> DataFrame:
        """Keys of a tier (``strong`` or ``composite``) that several rows of a side have, with the locators of all."""
        if tier == "strong":
            return matching.ambiguous(self.strong_groups, *self.rest0, matching.STRONG_KEY, "strong_id")
        return matching.ambiguous(self.composite_groups, *self.rest1, matching.COMPOSITE_KEY, "reference")

    def exceptions(self, mode: str) -> list[DataFrame]:
        """What matching cannot settle, without fingerprints."""
        missing, extra = ("missingFromLedger", "unexpectedLedgerItem") if mode == "bankVsLedger" else ("deletedFromNewerExport", "addedToNewerExport")
        l, r = F.col("left_locators"), F.col("right_locators")
        out = [
            _exception(self.ambiguous("strong"), "ambiguousCandidate", l, r, F.concat(F.lit("Strong identifier has multiple candidates: "), _strong_identity("strong_id"))),
            _exception(self.ambiguous("composite"), "ambiguousCandidate", l, r, F.concat(F.lit("Composite identity has multiple candidates: "), _identity("booking_date", "amount", ("reference", "reference")))),
            _exception(matching.changes(self.met), F.col("kind"), F.array("left_locator"), F.array("right_locator"), F.col("detail")),
            _exception(matching.cross_partition(*self.rest3), "currencyOrAccountMismatch", l, r, F.concat(F.lit("Strong identifier appears only in different account/currency partitions: "), F.col("strong_id"))),
        ]
        if self.policy.fuzzy:
            ties, at_left, own = matching.fuzzy_ties(self.ranks, *self.members), F.col("side") == "left", F.array("locator")
            told = F.concat(F.lit("Fuzzy candidates tie at "), F.col("permille").cast("string"), F.lit("/1000 similarity and "), F.col("days").cast("string"), F.lit(" day distance"))
            out.append(_exception(ties, "ambiguousCandidate", F.when(at_left, own).otherwise(F.col("candidates")), F.when(at_left, F.col("candidates")).otherwise(own), told))
        if self.policy.split_merge:
            out.append(_exception(self.splits, "possibleSplitOrMerge", l, r, F.concat(F.lit("Possible split/merge in "), _part(), F.lit(": exact combined amount "), C.amount_text(F.col("whole")))))
        for side, kind in (("left", missing), ("right", extra)):
            out.append(_sided(self.unpaired(side), kind, F.array("locator"), "No deterministic counterpart", side == "left"))
        return out


def _bound(exceptions: DataFrame, rows: list[DataFrame]) -> DataFrame:
    """Exceptions (tables, with their numbers) with the fingerprints of the rows they name; balances have none."""
    # rows are printed where they lie, and only the 32 bytes of prints are shuffled; both sides go through one join
    prints = lambda df, letter: df.select(F.lit(letter).alias("side"), "locator", F.unhex(C.fingerprint({c: df[c] for c in ROW})).alias("print"))
    both = reduce(DataFrame.unionByName, [prints(df, letter) for df, letter in zip(rows, "LR", strict=False)])
    named = [exceptions.select("n", F.lit(letter).alias("side"), F.explode(F.array_distinct(c)).alias("locator")) for letter, c in (("L", "left_locators"), ("R", "right_locators"))]
    # flat rows are shuffled by their number, and lists are only made behind it
    met = named[0].unionByName(named[1]).join(both, ["side", "locator"]).select("n", "side", "locator", "print").repartition("n")
    one = F.concat_ws(":", "side", "locator", F.lower(F.hex("print")))
    told = met.groupBy("n").agg(F.array_sort(F.collect_list(one)).alias("source_fingerprints"))
    return exceptions.join(told, "n", "left").select("kind", "left_locators", "right_locators", F.coalesce("source_fingerprints", F.array().cast("array<string>")).alias("source_fingerprints"), "detail")


def ordered(exceptions: DataFrame) -> DataFrame:
    joined = [F.array_join(c, "") for c in ("left_locators", "right_locators", "source_fingerprints") if c in exceptions.columns]
    return exceptions.orderBy("kind", *joined, "detail")


def with_keys(exceptions: DataFrame) -> DataFrame:
    return exceptions.withColumn("exception_key", C.exception_key(*(F.col(c) for c in ("kind", "left_locators", "right_locators", "source_fingerprints", "detail"))))


def approved(decisions: DataFrame) -> DataFrame:
    """Decisions that explain: approved, and with a text."""
    return decisions.filter(F.col("approved") & C.cleaned(F.col("explanation")).isNotNull())


def _state(job: Job, exceptions: DataFrame, totals: DataFrame, incomplete: bool, single: bool) -> str:
    """Nothing that is inconclusive can be explained away; explained differences also need arithmetic that closes."""
    keyed = exceptions
    if job.decisions is not None:
        keyed = with_keys(exceptions)
        explained = approved(job.decisions).select("exception_key", F.lit(True).alias("explained"))  # keys are unique: see _validated
        keyed = keyed.join(explained, "exception_key", "left")
    else:
        keyed = keyed.withColumn("explained", F.lit(None).cast("boolean"))
    n, open_, unexplained, balances = keyed.agg(F.count("*"), F.count_if(F.col("kind").isin(*INCONCLUSIVE_KINDS)), F.count_if(F.col("explained").isNull()), F.count_if(F.col("kind").isin("balanceDifference", "runningBalanceBreak"))).first()
    if incomplete or open_:
        return "cannotConclude"
    if not n:
        return "reconciled"
    closes = not balances and (single or not totals.filter("difference <> 0").limit(1).count())
    return "reconciledWithExplanations" if closes and not unexplained else "differenceFound"


__all__ = ["DECISIONS", "MANUAL_MATCHES", "Job", "Result", "Source", "Tiers", "concluded", "ordered", "run", "with_keys"]
