"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order (``md5`` of seed, id and a hash of the other columns). The fractional rank of a row is
``(2 * rank - 1) / (2 * rows of its source)``; sorting all rows by it interleaves the sources in proportion, and cutting
that order into runs whose lengths differ by one at most gives every shard the mixture of the whole.

No window spans a source or the table. The order of a source is cut into ranges of its uniform key; rows are counted per
range, a running sum over the counts gives each range its offset, and ``row_number`` runs only inside a range. The order
across sources is cut into ranges of the fractional rank; how many rows fall into each follows by integer arithmetic from
the first counts. Only keys pass through these windows; whole rows are shuffled once, to meet their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.llm import ordering
from tieout.llm.storage import written

SHARDS = 24
SEED = 17
#: Rows equal in all plain columns whose places may be one list; where more are, rows are numbered and joined one by one, with one
#: more shuffle and the same outcome.
EQUAL_ROWS = 1_000


def refuse_reserved(columns: list[str]) -> None:
    """Raises where a table has names that :func:`interleave` uses within; Spark does not tell names apart by case."""
    if taken := [c for c in columns if c.lower().startswith("__il_")]:
        raise ValueError(f"reserved column names: {taken}")


def interleave(docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED, id_column: str = "doc_id", source_column: str = "source", range_rows: int | None = None) -> DataFrame:
    """``docs`` with ``shard`` (int, 0 to ``shards - 1``) and ``slot`` (long, gapless from 0 within the shard).

    Law ``rows``: row counts of shards differ by one at most. The result depends on the rows alone, never on how they are
    partitioned. Null sources are a stratum of their own; null and repeated ids, null, empty and very long texts are rows
    as any other. The order of rows follows from their ids and a hash of their other plain columns, so rows that share an id, or
    have none, are dealt as evenly as others; rows that are equal in all of them take neighbouring slots in any order. An empty table gives an empty
    result. Columns ``shard`` and ``slot`` of the input are replaced; names beginning with ``__il_`` are reserved and refused, both in any case of letters.
    """
    refuse_reserved(docs.columns)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    plain = {"string", "bigint", "int", "double", "float", "boolean", "date", "timestamp"}
    ties = [F.col(f"`{c}`") for c, kind in docs.select(*[f"`{c}`" for c in kept]).dtypes if kind in plain and c not in (id_column, source_column)]

    strata = docs.select(ordering.stratum(source_column).alias("__il_src"))
    per_source = strata.groupBy("__il_src").agg(F.count("*").alias("__il_n"))
    rows = per_source.agg(F.sum("__il_n")).first()[0] or 0
    ranges = ordering.ranges_for(rows, range_rows)

    slim = docs.select(ordering.shuffle_key(id_column, seed, *ties).alias("__il_key"), ordering.stratum(source_column).alias("__il_src"))
    slim = slim.withColumn("__il_b", ordering.key_range(F.col("__il_key"), ranges))
    cells = ordering.before(slim, ["__il_src"], "__il_b", F.lit(1), "__il_off", "__il_c").join(per_source, "__il_src")

    # range of rank r of n: ((2r - 1) * R) div 2n; the last rank of range g: ((2n(g + 1) + R - 1) div R) div 2
    first_g = f"((2 * (__il_off + 1) - 1) * {ranges}L) div (2 * __il_n)"
    last_g = f"((2 * (__il_off + __il_c) - 1) * {ranges}L) div (2 * __il_n)"
    spread = cells.select("*", F.explode(F.expr(f"sequence({first_g}, {last_g})")).alias("__il_g"))
    high = f"(((2 * __il_n * (__il_g + 1)) + {ranges - 1}L) div {ranges}L) div 2"
    low = f"(((2 * __il_n * __il_g) + {ranges - 1}L) div {ranges}L) div 2"
    counts = spread.groupBy("__il_g").agg(F.sum(F.expr(f"least(__il_off + __il_c, {high}) - greatest(__il_off, {low})")).alias("__il_m"))
    starts = counts.select("__il_g", F.coalesce(F.sum("__il_m").over(Window.orderBy("__il_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__il_start"))

    inside = Window.partitionBy("__il_src", "__il_b").orderBy("__il_key")
    ranked = (
        slim.withColumn("__il_i", F.row_number().over(inside))
        .join(cells.drop("__il_c"), ["__il_src", "__il_b"])
        .withColumn("__il_r", F.col("__il_off") + F.col("__il_i"))
        .withColumn("__il_g", F.expr(f"((2 * __il_r - 1) * {ranges}L) div (2 * __il_n)"))
        .withColumn("__il_f", (2 * F.col("__il_r") - 1) / (2.0 * F.col("__il_n")))
    )
    across = Window.partitionBy("__il_g").orderBy("__il_f", "__il_src", "__il_r")
    placed = ranked.withColumn("__il_i", F.row_number().over(across)).join(starts, "__il_g").withColumn("__il_p", F.expr("__il_start + __il_i - 1"))
    total = max(1, int(rows))
    placed = placed.withColumn("shard", F.expr(f"cast((__il_p * {shards}L) div {total}L as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    # keys and places went through the windows; the rows themselves meet their places in one join
    keys, turn = ["__il_key", "__il_src"], Window.partitionBy("__il_key", "__il_src")
    placed = placed.select(*keys, "shard", (F.col("__il_p") - first).cast("long").alias("slot"))
    whole = docs.select(*[F.col(f"`{c}`") for c in kept], ordering.shuffle_key(id_column, seed, *ties).alias("__il_key"), ordering.stratum(source_column).alias("__il_src"))
    in_turn = F.row_number().over(turn.orderBy(F.col(f"`{id_column}`")))
    most = slim.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= EQUAL_ROWS:
        # the places of equal rows are one short list, of which each takes its own; the join's partitioning serves the window too
        spots = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("__il_spots"))
        found = whole.join(spots, keys).withColumn("__il_t", in_turn).withColumn("__il_spot", F.element_at("__il_spots", F.col("__il_t")))
        return found.select(*[F.col(f"`{c}`") for c in kept], "__il_spot.shard", "__il_spot.slot")
    placed = placed.withColumn("__il_t", F.row_number().over(turn.orderBy("shard", "slot")))
    return whole.withColumn("__il_t", in_turn).join(placed, [*keys, "__il_t"]).select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under law ``rows``; a null text has no bytes (size 8, checksum 0)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digests = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = interleave(written(digests, "shard-digests"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
