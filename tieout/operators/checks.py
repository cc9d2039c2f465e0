"""Proof of arithmetic: duplicates, running balances, statement equations, balance comparison, totals and job validation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions import columns as C
from tieout.session import cut

PARTITION = ("account", "currency")


def duplicates(rows: DataFrame) -> DataFrame:
    """Groups of more than one row of equal strong id, or without one of equal date, amount, reference and description.

    Groups are counted before any locator is collected, so rows that stand alone make no array (but for a pair of equal hashes).
    """
    sid = C.cleaned(F.col("strong_id"))
    sign = lambda c: F.when(sid.isNull(), c)
    keyed = rows.select(
        "locator", *PARTITION, sid.alias("k_id"), sign(F.col("booking_date")).alias("k_date"), sign(F.col("amount")).alias("k_amount"), sign(C.cleaned(F.col("reference"))).alias("k_reference"), sign(C.cleaned(F.col("description"))).alias("k_description")
    )
    keys = (*PARTITION, "k_id", "k_date", "k_amount", "k_reference", "k_description")
    # hashes of several rows first: all equal rows are among them, and they are few, so rows that stand alone are not shuffled where they are
    hashed = keyed.withColumn("h", F.xxhash64(*keys))
    several = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "several")
    return hashed.join(several, "h", "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("locator")).alias("locators")).filter("n > 1")


def openings(balances: DataFrame) -> DataFrame:
    """The opening of each partition that has exactly one."""
    return balances.filter("kind = 'opening'").groupBy(*PARTITION).agg(F.count("*").alias("n"), F.min("amount").alias("opening"), F.min("locator").alias("opening_locator")).filter("n = 1").drop("n")


def _walked(rows: DataFrame) -> DataFrame:
    """Rows with the running sum (``cum``), the last reported balance before them (``anchor``) and how many were reported before (``island``).

    Windows run inside a day of a partition; days are summed up and joined back, so no task sorts a whole partition.
    """
    reported, day = F.col("running_balance").isNotNull(), [*PARTITION, "booking_date"]
    place = F.struct("source_ordinal", "locator")
    order = Window.partitionBy(*day).orderBy("source_ordinal", "locator")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(reported, F.struct(F.col("running_balance").alias("balance"), F.col("inner").alias("cum"), "locator"))
    inner = rows.select("locator", *day, "source_ordinal", "amount", "running_balance").withColumn("inner", F.sum("amount").over(so_far)).withColumn("at", seen)
    inner = inner.withColumn("own", F.last("at", ignorenulls=True).over(before)).withColumn("count", F.coalesce(F.count_if(reported).over(before), F.lit(0)))
    days = inner.groupBy(*day).agg(F.sum("amount").alias("total"), F.count_if(reported).alias("many"), F.max_by("at", F.when(reported, place)).alias("end"))
    earlier = Window.partitionBy(*PARTITION).orderBy("booking_date").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda a: F.when(a.isNotNull(), F.struct(a["balance"].alias("balance"), (a["cum"] + F.col("off")).alias("cum"), a["locator"].alias("locator")))
    days = days.withColumn("off", F.coalesce(F.sum("total").over(earlier), F.lit(0))).withColumn("done", F.coalesce(F.sum("many").over(earlier), F.lit(0)))
    days = days.withColumn("end", moved(F.col("end"))).select(*day, "off", "done", F.last("end", ignorenulls=True).over(earlier).alias("prior"))
    return inner.join(days, day).select("locator", *day, "source_ordinal", "running_balance", (F.col("off") + F.col("inner")).alias("cum"), F.coalesce(moved(F.col("own")), F.col("prior")).alias("anchor"), (F.col("done") + F.col("count")).alias("island"))


#: Rows of a partition that one task walks whole; longer partitions are walked day by day.
WALK = 100_000


def running_balance_breaks(rows: DataFrame, balances: DataFrame, *, walk: int = WALK) -> DataFrame:
    """Rows whose reported balance is not the last one plus the activity since: ``expected``, ``found``, the anchor and all rows since.

    A break does not carry on: the reported balance is the next anchor. Partitions of up to ``walk`` rows, and the stretches between their reports, need one
    shuffle of their rows; longer ones are found by counting first, and of them only stretches that end in a break are listed.
    """
    sizes = rows.groupBy(*PARTITION).agg(F.count("*").alias("n"), F.count("running_balance").alias("reported"))
    most, reported = sizes.agg(F.max("n"), F.sum("reported")).first()
    if not reported:
        return _short_breaks(rows.limit(0), balances)
    if most <= walk:
        return _short_breaks(rows, balances)
    long = F.broadcast(cut(sizes.filter(F.col("n") > walk).select(*[F.col(c).alias(f"long_{c}") for c in PARTITION]), "long"))
    same = [F.col(c).eqNullSafe(F.col(f"long_{c}")) for c in PARTITION]
    of = lambda how: rows.join(long, same[0] & same[1], how)
    return _short_breaks(of("left_anti"), balances).unionByName(_long_breaks(of("left_semi"), balances))


def _short_breaks(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """Breaks of partitions that a task can walk whole."""
    reported, order = F.col("running_balance").isNotNull(), Window.partitionBy(*PARTITION).orderBy("booking_date", "source_ordinal", "locator")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    walked = rows.select("locator", *PARTITION, "booking_date", "source_ordinal", "amount", "running_balance").withColumn("island", F.coalesce(F.count_if(reported).over(before), F.lit(0))).withColumn("cum", F.sum("amount").over(so_far))
    walked = walked.withColumn("at", F.when(reported, F.struct(F.col("running_balance").alias("balance"), "cum", "locator")))
    walked = walked.withColumn("anchor", F.last("at", ignorenulls=True).over(before))
    # the row that is reported ends its island, so it is the only one
    end = lambda c: F.first(F.when(reported, F.col(c)), ignorenulls=True)
    islands = walked.groupBy(*PARTITION, "island").agg(end("at").alias("at"), end("anchor").alias("anchor"), F.sort_array(F.collect_list(F.struct("booking_date", "source_ordinal", "locator"))).alias("since"))
    checked = islands.filter("at is not null").join(openings(balances), list(PARTITION), "left")
    base = F.coalesce(F.col("anchor.balance"), F.col("opening"))
    broken = checked.withColumn("expected", base + F.col("at.cum") - F.coalesce(F.col("anchor.cum"), F.lit(0))).filter(base.isNotNull() & (F.col("expected") != F.col("at.balance")))
    first = F.coalesce(F.col("anchor.locator"), F.col("opening_locator"))
    return broken.select(*PARTITION, F.col("at.locator").alias("locator"), "expected", F.col("at.balance").alias("found"), F.concat(F.array(first), F.transform("since", lambda s: s["locator"])).alias("locators"))


def _long_breaks(rows: DataFrame, balances: DataFrame) -> DataFrame:
    walked = _walked(rows)
    checked = walked.filter("running_balance is not null").join(openings(balances), list(PARTITION), "left")
    base = F.coalesce(F.col("anchor.balance"), F.col("opening"))
    broken = checked.withColumn("expected", base + F.col("cum") - F.coalesce(F.col("anchor.cum"), F.lit(0))).filter(base.isNotNull() & (F.col("expected") != F.col("running_balance")))
    broken = broken.select(*PARTITION, "island", "locator", "expected", F.col("running_balance").alias("found"), F.coalesce(F.col("anchor.locator"), F.col("opening_locator")).alias("anchor_locator"))
    held = walked.join(broken.select(*PARTITION, "island"), [*PARTITION, "island"], "left_semi")
    members = held.groupBy(*PARTITION, "island").agg(F.sort_array(F.collect_list(F.struct("booking_date", "source_ordinal", "locator"))).alias("since"))
    return broken.join(members, [*PARTITION, "island"]).select(*PARTITION, "locator", "expected", "found", F.concat(F.array("anchor_locator"), F.transform("since", lambda s: s["locator"])).alias("locators"))


def _per_partition(rows: DataFrame, balances: DataFrame) -> DataFrame:
    act = rows.groupBy(*PARTITION).agg(F.sum("amount").alias("activity"))
    one = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    b = balances.groupBy(*PARTITION).agg(
        F.count_if(F.col("kind") == "opening").alias("n_open"), F.count_if(F.col("kind") == "closing").alias("n_close"),
        *[one(k, c).alias(f"{k}_{c}") for k in ("opening", "closing") for c in ("amount", "date", "locator")],
    )
    return act.join(b, list(PARTITION), "full_outer").withColumn("activity", F.coalesce("activity", F.lit(0))).fillna(0, ["n_open", "n_close"])


def statement_arithmetic(rows: DataFrame, balances: DataFrame, start: date, end: date) -> DataFrame:
    """``kind`` and ``reason`` of each partition that does not prove: ``count``, then ``dates``, then ``sum``."""
    p = _per_partition(rows, balances)
    single = (F.col("n_open") == 1) & (F.col("n_close") == 1)
    dates = (F.col("opening_date") == F.lit(start)) & (F.col("closing_date") == F.lit(end))
    closes = F.col("opening_amount") + F.col("activity") == F.col("closing_amount")
    reason = F.when(~single, "count").when(~dates, "dates").when(~closes, "sum")
    kind = F.when(reason == "sum", "balanceDifference").otherwise("periodGapOrOverlap")
    locators = F.when(reason == "count", F.array().cast("array<string>")).otherwise(F.array("opening_locator", "closing_locator"))
    return p.withColumn("reason", reason).filter("reason is not null").select(*PARTITION, kind.alias("kind"), "reason", locators.alias("locators"), "opening_amount", "activity", "closing_amount")


def statement_totals(rows: DataFrame, balances: DataFrame) -> DataFrame:
    """Opening plus activity against closing; a balance counts only where there is exactly one of its kind."""
    p = _per_partition(rows, balances)
    opening, closing = (F.when(F.col(n) == 1, F.col(c)).otherwise(0) for n, c in (("n_open", "opening_amount"), ("n_close", "closing_amount")))
    left = opening + F.col("activity")
    return p.select(*PARTITION, left.alias("left"), closing.alias("right"), (left - closing).alias("difference"))


def partition_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sums of both sides by partition in one pass."""
    both = left.select(*PARTITION, F.col("amount").alias("l"), F.lit(None).cast(left.schema["amount"].dataType).alias("r")).unionByName(right.select(*PARTITION, F.lit(None).cast(left.schema["amount"].dataType).alias("l"), F.col("amount").alias("r")))
    sums = both.groupBy(*PARTITION).agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left"), F.coalesce(F.sum("r"), F.lit(0)).alias("right"))
    return sums.withColumn("difference", F.col("left") - F.col("right"))


def balance_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """``outcome`` of each partition and kind of balance that does not agree."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(*PARTITION, "kind").agg(F.count("*").alias(f"{p}_n"), F.min("amount").alias(f"{p}_amount"), F.min("date").alias(f"{p}_date"), F.array_sort(F.collect_list("locator")).alias(f"{p}_locators"))

    j = side(left, "left").join(side(right, "right"), [*PARTITION, "kind"], "full_outer").fillna(0, ["left_n", "right_n"])
    several = (F.col("left_n") > 1) | (F.col("right_n") > 1)
    differ = ~F.col("left_amount").eqNullSafe(F.col("right_amount")) | ~F.col("left_date").eqNullSafe(F.col("right_date"))
    return j.withColumn("outcome", F.when(several, "periodGapOrOverlap").when(differ, "balanceDifference")).filter("outcome is not null")


#: What lies outside the period is a violation of it; every other check is one of integrity.
PERIOD_CHECKS = ("rows_in_period", "balances_in_period")


def validation(rows: DataFrame, balances: DataFrame, start: date, end: date, source_ids: tuple[str, ...] | None = None) -> DataFrame:
    """``check`` and ``violations``; all must be 0. One aggregate over each table.

    Rows must name one of ``source_ids``, or, where these are not known, all the same source.
    """
    inside = lambda c: F.col(c).between(F.lit(start), F.lit(end))
    row_checks = {
        "locators_unique": F.count("*") - F.count_distinct("locator"), "ordinals_unique": F.count("*") - F.count_distinct("source_ordinal"), "rows_in_period": F.count_if(~F.coalesce(inside("booking_date"), F.lit(False))),
        "locators_not_blank": F.count_if(C.cleaned(F.col("locator")).isNull()), "accounts_not_blank": F.count_if(C.cleaned(F.col("account")).isNull()), "ordinals_not_negative": F.count_if(F.col("source_ordinal") < 0),
    }
    if source_ids is not None:
        row_checks["source_ids_known"] = F.count_if(F.col("source_id").isNull() | ~F.col("source_id").isin(*source_ids))
    else:
        row_checks["source_ids_equal"] = F.greatest(F.count_distinct("source_id") - 1, F.lit(0)) + F.count_if(F.col("source_id").isNull())
    balance_checks = {
        "balance_locators_unique": F.count("*") - F.count_distinct("locator"), "balances_in_period": F.count_if(~F.coalesce(inside("date"), F.lit(False))),
        "balance_accounts_not_blank": F.count_if(C.cleaned(F.col("account")).isNull()), "balance_locators_not_blank": F.count_if(C.cleaned(F.col("locator")).isNull()),
    }
    out = None
    for df, checks in ((rows, row_checks), (balances, balance_checks)):
        wide = df.agg(*[c.cast("long").alias(k) for k, c in checks.items()])
        tall = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks])).alias("x")).select("x.check", "x.violations")
        out = tall if out is None else out.unionByName(tall)
    return out
