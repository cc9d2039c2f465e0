"""Seals over tables of any size: digests that depend on the rows and their order alone, and what differs between two tables.

A seal is a tree over the rows in a stated total order. A leaf is the SHA-256 of a row's canonical JSON; a node is the SHA-256 of its
children's digests, ``FANOUT`` rows of the level below in order. Rows find their node by their place, so the tree is the same however
the table is partitioned, and no task holds more than a node's children. Only the root goes to the driver.

Two tables are compared by a tree over keys: rows lie in buckets by the first digits of their key's hash, so a row that is gone or new
changes one path and leaves all others as they are. The comparison goes down a level at a time where digests differ, and only the rows
of buckets that differ meet.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.canonical import canonical_row
from tieout.operators.numbering import numbered
from tieout.session import cut

FANOUT = 1024
#: Hex digits of a key's hash that each level of the tree of keys adds.
STEP = 2
#: Rows that a bucket of the tree of keys holds about.
BUCKET = 1_000


def leaves(df: DataFrame, *order: str | Column) -> DataFrame:
    """``seq`` and ``leaf``: the place and the digest of every row."""
    # digests travel as their 32 bytes, which sort as their digits do
    row = F.unhex(F.sha2(canonical_row(df), 256)).alias("leaf")
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    # rows that tie in the order are told apart by their digests; equal rows have equal ones
    slim = df.select(*[k.alias(f"o{n}") for n, k in enumerate(keys)], row)
    return numbered(slim, *[f"o{n}" for n in range(len(keys))], "leaf", keep=("leaf",)).select("seq", F.lower(F.hex("leaf")).alias("leaf"))


def fold(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One level up: ``seq`` and ``leaf`` of the nodes over ``level``."""
    children = F.array_sort(F.collect_list(F.struct("seq", F.unhex("leaf").alias("leaf"))))
    grouped = level.groupBy(F.expr(f"seq div {fanout}").alias("up")).agg(children.alias("c"))
    return grouped.select(F.col("up").alias("seq"), F.sha2(F.array_join(F.transform("c", lambda x: F.lower(F.hex(x["leaf"]))), ""), 256).alias("leaf"))


def seal(df: DataFrame, *order: str | Column, fanout: int = FANOUT) -> tuple[int, str]:
    """How many rows ``df`` has and the root of its tree; an empty table has the digest of no children."""
    level = leaves(df, *order)
    rows = n = level.count()
    while n > 1:
        level = cut(fold(level, fanout), "nodes")
        n = -(-n // fanout)
    root = level.first()
    return rows, root["leaf"] if root else hashlib.sha256(b"").hexdigest()


def _keyed(df: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Per key: its canonical text, the digest of all its rows and the bucket it lies in."""
    rows = df.select(canonical_row(df.select(*keys)).alias("key"), F.sha2(canonical_row(df), 256).alias("row"))
    # the rows of a key as a multiset: their number and the sums of eight pieces of their digests, whatever their order; 2^31 rows of a key fit
    piece = lambda k: F.sum(F.conv(F.substring("row", 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"p{k}")
    same = rows.groupBy("key").agg(F.count("*").alias("n"), *[piece(k) for k in range(8)])
    # digests travel as their 32 bytes
    return same.select("key", F.unhex(F.sha2(F.concat_ws(",", "n", *[f"p{k}" for k in range(8)]), 256)).alias("row"), F.substring(F.sha2("key", 256), 1, depth).alias("bucket"))


def key_tree(keyed: DataFrame, depth: int) -> DataFrame:
    """``prefix`` and ``digest`` of all buckets and of all that lies above them, down from the empty prefix."""
    # one digest for a key and its rows, so that a bucket's lists are of 32 bytes a key
    leaf = F.unhex(F.sha2(F.concat_ws("=", F.sha2("key", 256), F.hex("row")), 256))
    listed = keyed.select("bucket", leaf.alias("leaf")).groupBy("bucket").agg(F.array_sort(F.collect_list("leaf")).alias("held"))
    level = listed.select(F.col("bucket").alias("prefix"), F.sha2(F.array_join(F.transform("held", lambda x: F.hex(x)), ","), 256).alias("digest"))
    tree = [cut(level, "buckets")]
    for size in range(depth - STEP, -1, -STEP):
        above = tree[-1].groupBy(F.substring("prefix", 1, size).alias("up")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "prefix", "digest"))).alias("held"))
        tree.append(cut(above.select(F.col("up").alias("prefix"), F.sha2(F.array_join("held", ","), 256).alias("digest")), "buckets"))
    return reduce(DataFrame.unionByName, tree)


def _differing(left: DataFrame, right: DataFrame, within: DataFrame | None, size: int) -> DataFrame:
    """Prefixes of ``size`` digits, below those of ``within``, whose digests differ or that one side lacks."""
    at = lambda df, name: df.filter(F.length("prefix") == size).select("prefix", F.col("digest").alias(name))
    l, r = at(left, "l"), at(right, "r")
    if within is not None:
        up = within.select(F.col("prefix").alias("up"))
        l, r = (df.join(up, F.substring("prefix", 1, size - STEP) == F.col("up"), "left_semi") for df in (l, r))
    return cut(l.join(r, "prefix", "full_outer").filter(~F.col("l").eqNullSafe(F.col("r"))).select("prefix"), "differing")


def verify_tables(left: DataFrame, right: DataFrame, keys: list[str], *, bucket: int = BUCKET) -> DataFrame:
    """``key`` (canonical JSON of ``keys``) and ``change`` of each key whose rows differ: ``added`` (only ``right`` has it), ``removed`` or ``changed``.

    Both tables need the same columns; their order and types may not differ either, as the canonical text would. Rows of one key are
    compared as a multiset; null keys are keys. Equal tables give no rows after their roots were compared.
    """
    if left.dtypes != right.dtypes:
        left, right = left.select(*sorted(left.columns)), right.select(*sorted(right.columns))
    n, depth = max(left.count(), right.count()), STEP
    while n > bucket * 16**depth:
        depth += STEP
    sides = [cut(_keyed(df, keys, depth), f"keyed-{s}") for df, s in ((left, "left"), (right, "right"))]
    trees = [key_tree(df, depth) for df in sides]
    within = None
    for size in range(0, depth + 1, STEP):
        within = _differing(*trees, within, size)
        if not within.limit(1).count():
            break
    near = [df.join(within, df["bucket"] == within["prefix"], "left_semi").select("key", F.col("row").alias(s)) for df, s in zip(sides, "lr", strict=True)]
    both = near[0].join(near[1], "key", "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("l") != F.col("r"), "changed")
    return both.select("key", change.alias("change")).filter("change is not null")
