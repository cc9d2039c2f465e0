"""Mixing sources to target weights with a low-discrepancy schedule.

Point ``i`` of the van der Corput sequence (the bits of ``i`` mirrored behind the binary point) falls into one of the
intervals that the cumulative targets cut out of [0, 1): slot ``i`` of the schedule is that source's. Every stretch of the
schedule therefore holds the sources in close to their target shares. The ``r``-th slot of a source takes block ``r`` of the
source: its documents in a seeded shuffled order, laid end to end and cut into blocks of equally many tokens, from the start
again once all are used (an epoch). A source that the first slots leave short takes the next points that fall into its interval,
so every source gets exactly the blocks that are due to it, however small it is.

Intervals are found by an equi-join on the upper bits of a point, so sources may be many. Ranks of slots and token positions of documents come from counts per range and running sums over those counts
(:mod:`tieout.llm.ordering`), never from a window over a whole source: a source may hold a third of all rows.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import merge
from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.llm import ordering
from tieout.llm.storage import written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_TOKENS = 64
SEED = 29
#: Bits of a point: room for 2^40 slots.
BITS = 40
#: Slots whose ranks are counted together.
CHUNK = 65_536
#: Upper bits of a point by which slots meet the intervals that overlap their cell.
CELL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def targets_of(sizes: dict, weights: dict, max_epochs: int = MAX_EPOCHS) -> dict:
    """Shares of the sum of sizes by weight; what a source would get above ``max_epochs`` times its size goes to the others.

    Exact fractions. One number per source is all that is ever here on the driver.
    """
    left, free, out = Fraction(sum(sizes.values())), dict(weights), {}
    while free:
        whole = sum(free.values())
        over = [s for s in free if left * free[s] / whole > max_epochs * sizes[s]]
        if not over:
            return out | {s: left * w / whole for s, w in free.items()}
        for s in over:
            out[s] = Fraction(max_epochs * sizes[s])
            left -= out[s]
            del free[s]
    return out


def _bounds(shares: list) -> list[tuple]:
    """(source, first point, end) of each source with a share, in units of ``2^-BITS``."""
    whole, run, out = sum(t for _, t in shares), Fraction(0), []
    for s, t in shares:
        if t:
            first, run = int(run / whole * (1 << BITS)), run + t
            out.append((s, first, int(run / whole * (1 << BITS))))
    return out


def _mirrored(prefix: int, bits: int) -> int:
    """The residue, modulo ``2^bits``, of the indices whose points begin with these bits."""
    return int(f"{prefix:0{bits}b}"[::-1], 2) if bits else 0


def points_below(n: int, x: int) -> int:
    """How many of the first ``n`` points are below ``x``: each 1 of ``x`` closes a dyadic interval, whose indices are a residue class."""
    if x >= 1 << BITS:
        return n
    found = 0
    for bits in range(1, BITS + 1):
        head = x >> (BITS - bits)
        if head & 1 and n > (r := _mirrored(head ^ 1, bits)):
            found += (n - 1 - r >> bits) + 1
    return found


def next_points(n: int, first: int, end: int, many: int) -> list[int]:
    """The next ``many`` indices from ``n`` on whose points are in the interval: a merge of the residue classes that make it up."""
    classes, at = [], first
    while at < end:
        bits = BITS - ((at & -at).bit_length() - 1 if at else BITS)
        while at + (1 << (BITS - bits)) > end:
            bits += 1
        r = _mirrored(at >> (BITS - bits), bits)
        classes.append((r + (max(0, n - r + (1 << bits) - 1) >> bits << bits), 1 << bits))
        at += 1 << (BITS - bits)
    return list(islice(merge(*(count(a, step) for a, step in classes)), many))


def schedule(spark: SparkSession, due: list[tuple]) -> DataFrame:
    """``__mx_src``, ``rank`` (0 to due - 1 within the source) and ``slot`` of all slots; ``due``: (source, slots) pairs.

    On the driver: a few numbers for each source, those of slots that small sources still lack after the common ones included.
    """
    due = [(s, n) for s, n in due if n]
    kind = "__mx_src string, rank long, slot long"
    slots, bounds = sum(n for _, n in due), _bounds([(s, Fraction(n)) for s, n in due])
    if not bounds:
        return spark.createDataFrame([], kind)
    late, wide = [], BITS - CELL_BITS
    for (s, n), (_, first, end) in zip(due, bounds, strict=True):
        have = points_below(slots, end) - points_below(slots, first)
        late += [(s, have + k, slot) for k, slot in enumerate(next_points(slots, first, end, n - have))] if have < n else []
    cells = [(s, first, end, n, cell) for (s, first, end), (_, n) in zip(bounds, due, strict=True) for cell in range(first >> wide, (end - 1 >> wide) + 1)]
    # as many rows as cells and sources; a local table whose size is known, so it is broadcast where it is small
    intervals = spark.createDataFrame(cells, "__mx_src string, first long, end long, due long, cell long")
    point = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long")
    numbered = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.expr(f"id div {CHUNK}L").alias("__mx_b")).withColumn("cell", F.expr(f"shiftright(point, {wide})"))
    placed = numbered.join(intervals, (numbered["cell"] == intervals["cell"]) & (F.col("point") >= F.col("first")) & (F.col("point") < F.col("end"))).select("slot", "__mx_src", "due", "__mx_b")
    offsets = ordering.before(placed, ["__mx_src"], "__mx_b", F.lit(1), "__mx_off", "__mx_c").drop("__mx_c")
    inside = Window.partitionBy("__mx_src", "__mx_b").orderBy("slot")
    ranked = placed.withColumn("__mx_i", F.row_number().over(inside)).join(offsets, ["__mx_src", "__mx_b"]).withColumn("rank", F.col("__mx_off") + F.col("__mx_i") - 1)
    return ranked.filter("rank < due").select("__mx_src", "rank", "slot").unionByName(spark.createDataFrame(late, kind))


def _digest(text_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")))


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return written(
        docs.select(
            F.col(f"`{id_column}`").alias("id"),
            ordering.stratum(source_column).alias("__mx_src"),
            F.coalesce(F.regexp_count(F.col(f"`{text_column}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _digest(text_column).alias("digest"),
        ),
        "mix-sizes",
    )


def _plan(sizes: DataFrame, weights, max_epochs: int, block_tokens: int):
    """Per source: size, target, blocks and slots due."""
    rows = {r["__mx_src"]: int(r["n"]) for r in sizes.groupBy("__mx_src").agg(F.sum("size").alias("n")).collect()}  # a row per source
    order = sorted(rows, key=lambda s: (s == "", s))  # by code point, null last
    targets = targets_of(rows, {s: weights[i % len(weights)] for i, s in enumerate(order)}, max_epochs)
    blocks = {s: max(1, -(-rows[s] // block_tokens)) for s in order}
    due = {s: round(targets[s] * blocks[s] / rows[s]) if rows[s] else 0 for s in order}
    return order, rows, targets, blocks, due


def mixture(docs: DataFrame, *, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"):
    """The mixed stream: ``(pieces, documents)``.

    ``pieces``: one row for each part of a document that a slot takes: ``slot``, ``epoch``, ``__mx_src``, ``at`` (position of the
    document in its source), ``id``, ``size``, ``digest`` (checksum of the text), ``first`` (word within the document) and ``words``.
    ``documents``: one row per input row with ``id``, ``size``, ``digest``, ``__mx_src``, ``at``, ``source_size`` and ``target``. Both join on (``__mx_src``, ``at``, ``id``, ``size``).

    Sizes are words. Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in
    order. Null and repeated ids are kept; rows that are equal in id, source and size are interchangeable. Other columns
    play no part, whatever their names. An empty table gives empty results. Reruns agree: ids, and sizes and checksums of texts where ids repeat, decide the order.
    """
    spark = docs.sparkSession
    sizes = _sized(docs, id_column, text_column, source_column)
    order, rows, targets, blocks, due = _plan(sizes, weights, max_epochs, block_tokens)
    facts = spark.createDataFrame(
        [(s, rows[s], float(targets[s]), blocks[s], due[s]) for s in order], "__mx_src string, source_size long, target double, blocks long, due long"
    )
    ranges = ordering.ranges_for(sizes.count())
    keyed = sizes.withColumn("__mx_key", ordering.shuffle_key("id", seed, F.col("size"), F.col("digest"))).withColumn("__mx_b", ordering.key_range(F.col("__mx_key"), ranges))
    offsets = ordering.before(keyed, ["__mx_src"], "__mx_b", F.col("size"), "__mx_off", "__mx_c").drop("__mx_c")
    so_far = Window.partitionBy("__mx_src", "__mx_b").orderBy("__mx_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    documents = (
        keyed.withColumn("__mx_w", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        .join(offsets, ["__mx_src", "__mx_b"])
        .join(facts, "__mx_src")
        .select("id", "size", "digest", "__mx_src", (F.col("__mx_off") + F.col("__mx_w")).alias("at"), "source_size", "target", "blocks", "due")
    )
    documents = written(documents, "mix-places")

    # block b of n over S tokens: [b * S div n, (b + 1) * S div n); token t is in block ((t + 1) * n - 1) div S
    pieces = (
        documents.filter("size > 0 and due > 0")
        .withColumn("block", F.explode(F.expr("sequence(((at + 1) * blocks - 1) div source_size, ((at + size) * blocks - 1) div source_size)")))
        .withColumn("from", F.expr("greatest(at, block * source_size div blocks)"))
        .withColumn("to", F.expr("least(at + size, (block + 1) * source_size div blocks)"))
        .select("__mx_src", "block", "at", "id", "size", "digest", (F.col("from") - F.col("at")).alias("first"), (F.col("to") - F.col("from")).alias("words"))
    )
    turns = schedule(spark, [(s, due[s]) for s in order]).join(facts.select("__mx_src", "blocks"), "__mx_src").select("__mx_src", "slot", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("epoch"))
    return turns.join(pieces, ["__mx_src", "block"]).select("slot", "epoch", "__mx_src", "at", "id", "size", "digest", "first", "words"), documents


def mixed_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """``docs`` with a row for each epoch in which the mix takes at least half of the document's words; the others go.

    Rows are found again by source, id and the text's checksum, so rows that share only an id, or have none, go or stay each by their
    own text; rows that are equal in all three get as many copies each as epochs take any of them.
    Documents without words (null, empty, white space) have nothing to take and go. Very long texts are one row as any other.
    A null source is a source of its own. Ties and repeated rows are kept apart by the order of :func:`mixture`. Columns may have
    any name. An empty table gives an empty result.
    """
    pieces, _ = mixture(docs, id_column=id_column, text_column=text_column, source_column=source_column, **options)
    times, turn = ordering.spare(docs.columns, "__mx_times", "__mx_turn")
    epochs = pieces.groupBy("__mx_src", "at", "id", "size", "digest", "epoch").agg(F.sum("words").alias("w")).filter("2 * w >= size")
    epochs = epochs.groupBy("__mx_src", "id", "digest").agg(F.count_distinct("epoch").cast("int").alias(times))
    source, own, digest = ordering.spare([*docs.columns, times, turn], "__mx_source", "__mx_own", "__mx_digest")
    epochs = epochs.select(F.col("__mx_src").alias(source), F.col("id").alias(own), F.col("digest").alias(digest), times)
    joined = docs.join(epochs, (ordering.stratum(source_column) == F.col(source)) & F.col(f"`{id_column}`").eqNullSafe(F.col(own)) & (_digest(text_column) == F.col(digest)))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces, documents = mixture(docs)
    taken = pieces.groupBy("__mx_src", "at", "id", "size").agg(F.sum("words").alias("taken"))
    d, t = documents.alias("d"), taken.alias("t")
    same = (F.col("d.__mx_src") == F.col("t.__mx_src")) & (F.col("d.at") == F.col("t.at")) & F.col("d.id").eqNullSafe(F.col("t.id")) & (F.col("d.size") == F.col("t.size"))
    return d.join(t, same, "left").select(F.col("d.id").alias("doc_id"), "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
