"""The matching tiers. Each reads the rows that the tier before left unmatched; ambiguity is reported and never resolved.

Rows have ``locator``, ``account``, ``currency``, ``booking_date``, ``amount``, ``strong_id``, ``reference`` and, for fuzzy matching,
``text`` (see ``comparison_text``). Amounts are exact: decimals or integers.
"""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions import columns as C
from tieout.session import cut

STRONG_KEY = ("account", "currency", "strong_id")
COMPOSITE_KEY = ("account", "currency", "booking_date", "amount", "reference")


def keyed_groups(left: DataFrame, right: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
    """One row per key on both sides: the key, ``n_l``, ``n_r``, and the smallest locator of either.

    Both sides go through one exchange, pre-aggregated, so a key that holds many rows costs each task one row of it. Keys with
    a blank text are left out; the text is compared cleaned and with its case.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("locator", *[C.cleaned(F.col(k)).alias(k) if k == text else F.col(k) for k in key], F.lit(name).alias("side")).filter(F.col(text).isNotNull())

    of = lambda name: F.col("side") == name
    both = side(left, "l").unionByName(side(right, "r")).groupBy(*key).agg(
        F.count_if(of("l")).alias("n_l"), F.count_if(of("r")).alias("n_r"), F.min(F.when(of("l"), F.col("locator"))).alias("left_locator"), F.min(F.when(of("r"), F.col("locator"))).alias("right_locator")
    )
    return both.filter("n_l > 0 and n_r > 0")


def unique_pairs(groups: DataFrame, kind: str) -> DataFrame:
    return groups.filter("n_l = 1 and n_r = 1").select("left_locator", "right_locator", F.lit(kind).alias("kind"))


def ambiguous(groups: DataFrame, left: DataFrame, right: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
    """Keys with more than one row on a side: the key and the sorted locators of all its rows."""
    # written, so that its size is known and rows need no shuffle to meet few keys
    keys = cut(groups.filter("n_l > 1 or n_r > 1").select(*key), "several")
    rows = []
    for df, name in ((left, "left_locators"), (right, "right_locators")):
        own = df.select("locator", *[C.cleaned(F.col(k)).alias(k) if k == text else F.col(k) for k in key])
        rows.append(own.join(keys, list(key)).groupBy(*key).agg(F.array_sort(F.collect_list("locator")).alias(name)))
    return rows[0].join(rows[1], list(key))


def without(df: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    return df.join(matches.select(F.col(column).alias("__m")), df["locator"] == F.col("__m"), "left_anti")


def strong(left: DataFrame, right: DataFrame) -> DataFrame:
    return keyed_groups(left, right, STRONG_KEY, "strong_id")


def composite(left: DataFrame, right: DataFrame) -> DataFrame:
    return keyed_groups(left, right, COMPOSITE_KEY, "reference")


#: Rows that agree in all of these are one class: what one of them may match, each may.
CLASS = ("account", "currency", "amount", "booking_date", "strong_id", "text")


def text_classes(rows: DataFrame) -> DataFrame:
    """The classes of a side's rows that have a text: ``locator`` (the smallest, which stands for the class), ``n`` rows, and what they agree in.

    Equal rows are counted before they are shuffled, so however many there are, a task gets one row of them from each other.
    """
    return rows.filter("text is not null").groupBy(*CLASS).agg(F.count("*").alias("n"), F.min("locator").alias("locator"))


def class_members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``locator`` of each row of the classes of several rows and ``of``, the locator that stands for its class. A class of one row is its row."""
    r, c = rows.alias("r"), cut(classes.filter("n > 1"), "shared").alias("c")
    same = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in CLASS])
    return r.join(c, same).select("r.locator", F.col("c.locator").alias("of"))


def _bucket(c: str, days: int) -> Column:
    """The bucket of a date. It is wide beside ``days``, so that most dates have all that is near to them in one."""
    return F.floor(F.unix_date(F.col(c)) / (4 * (days + 1)))


def _buckets(c: str, days: int) -> Column:
    """The one or two buckets of what is at most ``days`` from a date, a row each."""
    ends = [F.floor((F.unix_date(F.col(c)) + k) / (4 * (days + 1))) for k in (-days, days)]
    return F.explode(F.array_distinct(F.array(*ends)))


def class_pairs(left: DataFrame, right: DataFrame, days: int, permille: int) -> DataFrame:
    """Pairs of classes of equal account, currency and amount, at most ``days`` apart, without two different strong ids, whose texts are alike:
    the locators that stand for them, ``n_l`` and ``n_r`` rows, ``permille`` and ``days``.

    The hard gates are an equi-join, on a date bucket too: each left class looks into one or two buckets, each right class is in one, so
    a frequent amount is spread by date. Lengths bound the similarity before the edit distance is computed, which runs once for a pair of
    classes and not for each pair of their rows.
    """
    l, r = left.withColumn("bucket", _buckets("booking_date", days)).alias("l"), right.withColumn("bucket", _bucket("booking_date", days)).alias("r")
    a, b = F.col("l.text"), F.col("r.text")
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    gates = reduce(Column.__and__, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("account", "currency", "amount", "bucket")])
    ids = F.col("l.strong_id").isNull() | F.col("r.strong_id").isNull() | (F.col("l.strong_id") == F.col("r.strong_id"))
    near = C.date_distance(F.col("l.booking_date"), F.col("r.booking_date")) <= days
    could = shortest * 1000 >= permille * longest
    pairs = l.join(r, gates & near & ids & could).select(
        F.col("l.locator").alias("left_locator"), F.col("r.locator").alias("right_locator"), F.col("l.n").alias("n_l"), F.col("r.n").alias("n_r"),
        C.similarity_permille(a, b).alias("permille"), C.date_distance(F.col("l.booking_date"), F.col("r.booking_date")).cast("long").alias("days"),
    )
    return pairs.filter(F.col("permille") >= permille)


def _each(df: DataFrame, of: str, n: str, members: DataFrame, name: str) -> DataFrame:
    """``df`` for each row (``name``) of the class of ``n`` rows that ``of`` stands for; only classes of several rows meet their ``members``."""
    own = members.select(F.col("of").alias("__of"), F.col("locator").alias(name))
    return df.filter(F.col(n) == 1).withColumn(name, F.col(of)).unionByName(df.filter(F.col(n) > 1).join(own, F.col(of) == F.col("__of")).drop("__of"))


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows of the pairs of classes; ``left`` and ``right`` are :func:`class_members`. Its size is that of its result."""
    both = _each(_each(pairs, "left_locator", "n_l", left, "l_own"), "right_locator", "n_r", right, "r_own")
    return both.select(F.col("l_own").alias("left_locator"), F.col("r_own").alias("right_locator"), "permille", "days")


def fuzzy_candidates(left: DataFrame, right: DataFrame, days: int, permille: int) -> DataFrame:
    """Pairs of rows that may match, with ``permille`` and ``days``."""
    classes = [text_classes(df) for df in (left, right)]
    return expanded(class_pairs(*classes, days, permille), class_members(left, classes[0]), class_members(right, classes[1]))


def ranked(pairs: DataFrame) -> DataFrame:
    """Per side: the rank of each pair of classes (similarity, then distance) for each row of the class, and how many rows tie with it."""
    out = pairs
    for side, other in (("left", "n_r"), ("right", "n_l")):
        best = Window.partitionBy(f"{side}_locator").orderBy(F.desc("permille"), "days")
        same = Window.partitionBy(f"{side}_locator", "permille", "days")
        out = out.withColumn(f"{side}_rank", F.rank().over(best)).withColumn(f"{side}_ties", F.sum(other).over(same))
    return out


def mutual_best(ranks: DataFrame) -> DataFrame:
    """Pairs that are each other's only best; their classes have one row each."""
    return ranks.filter("left_rank = 1 and left_ties = 1 and right_rank = 1 and right_ties = 1").select("left_locator", "right_locator", F.lit("fuzzy").alias("kind"))


def fuzzy_ties(ranks: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per row with several best candidates: ``side``, its locator, those of the candidates, and what they tie at. ``left`` and ``right`` are
    :func:`class_members`; candidates are listed once for a class and then told to each of its rows."""
    out, members = [], {"left": left, "right": right}
    for side, other, n, m in (("left", "right", "n_l", "n_r"), ("right", "left", "n_r", "n_l")):
        tied = ranks.filter(f"{side}_rank = 1 and {side}_ties > 1")
        theirs = _each(tied, f"{other}_locator", m, members[other], "candidate")
        listed = theirs.groupBy(f"{side}_locator", n).agg(F.array_sort(F.collect_list("candidate")).alias("candidates"), F.min("permille").alias("permille"), F.min("days").alias("days"))
        own = _each(listed, f"{side}_locator", n, members[side], "locator")
        out.append(own.select(F.lit(side).alias("side"), "locator", "candidates", "permille", "days"))
    return out[0].unionByName(out[1])


POOL = ("account", "currency", "positive")


def _signed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("positive", F.col("amount") > 0)


def _near(singles: DataFrame, components: DataFrame, days: int) -> DataFrame:
    """Singles with the components of their partition and sign at most ``days`` apart: an equi-join on buckets of dates too.

    Singles have ``s_date``, components ``c_date``. A single looks into one or two buckets and a component is in one, so what meets in a
    task is bounded by what is near in time, however many rows a partition has.
    """
    s, c = singles.withColumn("bucket", _buckets("s_date", days)), components.withColumn("bucket", _bucket("c_date", days))
    return s.join(c, [*POOL, "bucket"]).filter(C.date_distance(F.col("s_date"), F.col("c_date")) <= days)


def _eligible(singles: DataFrame, components: DataFrame, days: int) -> DataFrame:
    """Components that a single may be made of; zero singles have none."""
    s = _signed(singles.filter("amount <> 0")).select(F.col("locator").alias("single"), F.col("amount").alias("whole"), F.col("booking_date").alias("s_date"), *POOL)
    c = _signed(components).select("locator", "amount", F.col("booking_date").alias("c_date"), *POOL)
    return _near(s, c, days).select("single", "whole", "locator", "amount", "account", "currency")


def split_merge_evaluations(left: DataFrame, right: DataFrame, days: int, size: int) -> DataFrame:
    """``evaluations``: how many combinations both directions have.

    Rows are counted by partition, sign and date first, and only these counts are joined: what decides whether the enumeration may
    run costs one row for each date of a partition, not for each pair.
    """
    parts = []
    for singles, components in ((left, right), (right, left)):
        s = _signed(singles.filter("amount <> 0")).groupBy(*POOL, F.col("booking_date").alias("s_date")).agg(F.count("*").alias("m"))
        c = _signed(components).groupBy(*POOL, F.col("booking_date").alias("c_date")).agg(F.count("*").alias("c"))
        parts.append(_near(s, c, days).groupBy(*POOL, "s_date", "m").agg(F.sum("c").cast("double").alias("n")).filter("n >= 2"))
    n, total = F.col("n"), F.lit(0.0)
    for k in range(2, size + 1):
        total = total + F.when(n >= k, reduce(lambda x, j: x * (n - j), range(1, k), n) / float(factorial(k))).otherwise(0.0)
    # exact below 2^53, and beyond any policy where it is not
    return parts[0].unionByName(parts[1]).agg(F.least(F.round(F.coalesce(F.sum(F.col("m") * total), F.lit(0.0))), F.lit(9e18)).cast("bigint").alias("evaluations"))


def split_merge(left: DataFrame, right: DataFrame, days: int, size: int) -> DataFrame:
    """``left_locators`` and ``right_locators`` (sorted) of a row on one side whose amount is the sum of 2 to ``size`` on the other, with
    the partition and the ``whole`` amount.

    A combination is put together from two halves, the second by an equi-join on the amount that the first leaves missing, so no more
    than half of a combination is ever enumerated. All components have the sign of the whole: none, and no half, exceeds it. Both
    directions go through the same joins; the components of singles, and each size of half, are written once for all their readers.
    """
    fits = lambda c: F.abs(c) <= F.abs(F.col("whole"))
    pools = []
    for singles, components, single_left in ((left, right, True), (right, left, False)):
        near = _eligible(singles, components, days).filter(fits(F.col("amount")))
        # singles of both sides may share a locator
        pools.append(near.select(F.struct(F.lit(single_left).alias("left"), F.col("single").alias("locator")).alias("single"), F.struct("account", "currency", "whole").alias("of"), "whole", "locator", "amount"))
    pool = cut(pools[0].unionByName(pools[1]), "components")
    halves = [pool.select("single", "of", "whole", F.array("locator").alias("parts"), F.col("locator").alias("first"), F.col("locator").alias("last"), F.col("amount").alias("sum"))]
    nxt = pool.select(F.col("single").alias("s"), F.col("locator").alias("n_locator"), F.col("amount").alias("n_amount"))
    for _ in range(1, (size + 1) // 2):
        longer = halves[-1].join(nxt, (F.col("single") == F.col("s")) & (F.col("n_locator") > F.col("last")) & fits(F.col("sum") + F.col("n_amount")))
        halves.append(cut(longer.select("single", "of", "whole", F.array_append("parts", F.col("n_locator")).alias("parts"), "first", F.col("n_locator").alias("last"), (F.col("sum") + F.col("n_amount")).alias("sum")), "halves"))
    out = []
    for k in range(2, size + 1):
        rest = halves[k // 2 - 1].select(F.col("single").alias("s"), F.col("parts").alias("r_parts"), F.col("first").alias("r_first"), F.col("sum").alias("r_sum"))
        done = halves[(k + 1) // 2 - 1].join(rest, (F.col("single") == F.col("s")) & (F.col("r_sum") == F.col("whole") - F.col("sum")) & (F.col("r_first") > F.col("last")))
        out.append(done.select("single", "of", F.concat("parts", "r_parts").alias("parts")))
    found = reduce(DataFrame.unionByName, out)
    at_left, one, many = F.col("single.left"), F.array("single.locator"), F.array_sort("parts")
    return found.select(F.when(at_left, one).otherwise(many).alias("left_locators"), F.when(at_left, many).otherwise(one).alias("right_locators"), "of.*").distinct()


def cross_partition(left: DataFrame, right: DataFrame) -> DataFrame:
    """Strong ids on both sides, in no partition of both: the id and the locators. Locators are collected for these ids only; whether a partition has
    an id on both sides is seen from one row for each id and partition."""
    id_ = C.cleaned(F.col("strong_id"))
    named = lambda df: df.select("locator", "account", "currency", id_.alias("strong_id")).filter("strong_id is not null")
    sides = [named(df) for df in (left, right)]
    each = sides[0].withColumn("at", F.lit(1)).unionByName(sides[1].withColumn("at", F.lit(2))).groupBy("strong_id", "account", "currency").agg(F.bit_or("at").alias("at"))
    apart = each.groupBy("strong_id").agg(F.bit_or("at").alias("all"), F.max("at").alias("most")).filter("all = 3 and most < 3").select("strong_id")
    own = [df.join(apart, "strong_id").groupBy("strong_id").agg(F.array_sort(F.collect_list("locator")).alias(f"{p}_locators")) for df, p in zip(sides, ("left", "right"), strict=True)]
    return own[0].join(own[1], "strong_id")


def mutations(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_locator``, ``right_locator``, ``kind`` and ``detail`` for each kind of difference between matched rows."""
    return changes(met(matches, left, right))


def changes(met: DataFrame) -> DataFrame:
    """:func:`mutations` of matches that :func:`met`."""
    return met.select("left_locator", "right_locator", F.explode("found").alias("x")).select("left_locator", "right_locator", "x.*")


COMPARED = ("account", "currency", "amount", "booking_date", "value_date", "strong_id", "reference", "description", "memo", "payee", "transaction_code", "cleared_status", "category")


def met(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Each match with how often its rows are matched, whether they agree in partition and amount, and the differences ``found`` where both rows are there.

    What is matched how often is counted before the rows come, so only locators are shuffled for it.
    """
    times = lambda s: F.count(f"{s}_locator").over(Window.partitionBy(f"{s}_locator"))
    of = lambda df, s, p: df.select(F.col("locator").alias(f"{s}_locator"), F.lit(True).alias(f"{p}_there"), *[F.col(c).alias(f"{p}_{c}") for c in COMPARED])
    # one after the other: the left locator last, as the left rows come first
    counted = matches.select("left_locator", "right_locator", F.col("kind").alias("tier")).withColumn("right_times", times("right")).withColumn("left_times", times("left"))
    m = counted.join(of(left, "left", "l"), "left_locator", "left").join(of(right, "right", "r"), "right_locator", "left")
    differ = lambda *names: reduce(Column.__or__, [~C.cleaned(F.col(f"l_{n}")).eqNullSafe(C.cleaned(F.col(f"r_{n}"))) for n in names])
    raw = lambda *names: reduce(Column.__or__, [~F.col(f"l_{n}").eqNullSafe(F.col(f"r_{n}")) for n in names])
    told = F.concat(C.amount_text(F.col("l_amount")), F.lit(" \u2192 "), C.amount_text(F.col("r_amount")))
    # fixed values: the texts are part of exception keys
    kinds = {
        "amountChanged": (raw("amount"), told), "dateChanged": (raw("booking_date", "value_date"), F.lit("Booking or value date changed")),
        "descriptionOrReferenceChanged": (differ("strong_id", "reference", "description", "memo", "payee", "transaction_code"), F.lit("Strong ID, reference, description, memo, payee or transaction code changed")),
        "statusOrCategoryChanged": (differ("cleared_status", "category"), F.lit("Cleared status or category changed")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), d.alias("detail"))) for k, (c, d) in kinds.items()]))
    return m.select("left_locator", "right_locator", "tier", "left_times", "right_times", (~raw("account", "currency")).alias("same_part"), (~raw("amount")).alias("same_amount"), F.when(F.col("l_there") & F.col("r_there"), found).alias("found"))
