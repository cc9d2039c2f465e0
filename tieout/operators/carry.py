"""Running counts and carried values along an order, without a task that sorts a whole file.

The order is cut into chunks of equal width. Windows run inside a chunk; a row for each chunk, with its sums and last values, goes through
a window over the chunks, and what they bring along is joined back. Both compose: sums add up, and the last value of two stretches is the
second's, where it has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.session import cut

CHUNK = 1 << 16


def along(df: DataFrame, keys: list[str], order: str, *, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, chunk: int = CHUNK) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its expression over the rows of the same ``keys`` up to and with this one; and for each
    of ``last`` the last value of its expression that is not null. ``order`` is a whole number that no two rows of equal keys share.

    A chunk should hold some thousand rows: a row for each chunk goes to every task."""
    return carried(df.withColumn("__chunk", F.expr(f"`{order}` div {chunk}")), keys, order, sums=sums, last=last)


def carried(df: DataFrame, keys: list[str], order: str, *, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """As :func:`along`, for rows that have their ``__chunk``: chunks follow each other in ``order``.

    What the windows inside the chunks find is written once; the rows of chunks are made of it and are joined to it without a shuffle."""
    sums, last = sums or {}, last or {}
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut(df.select("*", *[F.sum(c.cast("long")).over(inside).alias(f"__s_{n}") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(inside).alias(f"__l_{n}") for n, c in last.items()]), "chunks")
    chunks = inner.groupBy(*keys, "__chunk").agg(*[F.max_by(f"__s_{n}", order).alias(f"__s_{n}") for n in sums], *[F.max_by(f"__l_{n}", order).alias(f"__l_{n}") for n in last])
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    brought = chunks.select(*keys, "__chunk", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__bs_{n}") for n in sums], *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__bl_{n}") for n in last])
    joined = inner.join(F.broadcast(brought), [*keys, "__chunk"])
    made = [(F.col(f"__s_{n}") + F.col(f"__bs_{n}")).alias(n) for n in sums] + [F.coalesce(f"__l_{n}", f"__bl_{n}").alias(n) for n in last]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != "__chunk"], *made)
