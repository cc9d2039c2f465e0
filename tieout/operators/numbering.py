"""Total orders without a window over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.session import cut


def numbered(df: DataFrame, *order: str | Column, name: str = "seq", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with ``name``: the place of each row in ``order``, from 0 without holes, and with its rows in that order.

    Rows are range-partitioned and sorted, written once with their range and their place in it, and a row of counts for each range
    gives the offsets. Rows that tie in ``order`` may take each other's place, so it should name all that tells rows apart.
    With ``keep`` only these columns are written and given back; what only orders rows is not.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(keep or df.columns))
    # the id of a partition is in the upper 31 bits, the row's place in the lower 33
    placed = cut(ranged.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    at = F.col("__place")
    sizes = placed.groupBy(F.shiftright(at, 33).alias("__range")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # a row for each range: as many as the write had tasks
    joined = placed.join(F.broadcast(offsets), F.shiftright(at, 33) == F.col("__range"))
    return joined.withColumn(name, F.col("__off") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("__place", "__range", "__off", "__n")
