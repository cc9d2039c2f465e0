"""Near duplicates by MinHash bands with sequential Bayesian verification.

1. One pass gives each document the set of its word 5-shingles as a count, a 128-bit digest, 128 minima and 32 band keys of
   four minima each. At similarity 0.75 all bands miss a pair with probability (1 - 0.75^4)^32 = 5e-6.
2. Documents with equal digests are one class; only its smallest id goes on, so copies cost one row each from here. Copies meet
   their class dealt by hash over as many parts as a shuffle has; texts without words have no class and stay out.
3. Of the shingles of documents with company in a band bucket, those that one document alone has can be in no
   intersection. The rest bounds every intersection from above, exactly: documents and pairs that the bound keeps below the
   threshold go. So strangers that share a passage, and far edits of one original, cost no pairs.
4. In every bucket each member is paired with one hub that a hash picks per bucket: linearly many pairs, and as buckets
   differ in their hubs, a member of a large group meets many.
5. Pairs are compared signature batch by signature batch. With a uniform prior the similarity given ``m`` of ``n`` agreeing
   minima is Beta(m + 1, n - m + 1); a pair goes when its chance of reaching the threshold is below ``miss_probability``.
6. Survivors are verified on the full shingle sets: the best partner of each document first, then those whose ends are still
   in different components.
7. What is left are pairs of a bucket in different components: each member outside the largest component of its bucket is
   held against all members of other components, inside the join: by the bound of 3, by a second exact bound from bitmaps of
   hashed shingles (a bit that one has and the other lacks is a shingle outside the intersection), by batches, and what is left
   exactly. No pair inside a component is made. Large buckets are cut into blocks, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.components import components, extended, labelled
from tieout.llm.storage import row_keys, without_rows, written

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS = 32, 4
#: Minima compared at a time.
BATCH = 32
MISS_PROBABILITY = 1e-6
#: So many ids may be broadcast (8 bytes each); beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000

#: A signature is kept as longs of three 15-bit minima in lanes of 16 bits, so that plain SQL can count agreeing lanes.
LANES, PACKED = 3, -(-BANDS * ROWS // 3)
#: Members of a bucket that one task holds against as many others.
BLOCK_MEMBERS = 512
#: Bits of the bitmap of a set; for sets of more than about so many shingles it bounds nothing, and harms nothing.
BITS = 2048
_PROFILE = "id long, k1 long, k2 long, n_shingles long, d1 long, d2 long, sig array<long>, bits array<long>, bands array<long>"
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(seen: int, threshold: int, miss: float) -> int:
    """The fewest agreeing minima of ``seen`` at which the posterior chance of ``threshold`` percent is ``miss`` or more.

    The upper tail of Beta(m + 1, n - m + 1) at t is the chance of at most m successes in n + 1 draws of probability t.
    """
    t, below = threshold / 100, 0.0
    for m in range(seen + 1):
        below += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if below >= miss:
            return m
    return seen


def sets_of(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by row."""
    row, h = words.words(column)
    return words.distinct(*words.shingles(h, words.row_bounds(row, len(column)), size))


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole, "text"):
                yield _profile_batch(batch, size)

    return run


def _profile_batch(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    rows = batch.num_rows
    row, h = sets_of(batch.column(3), size)
    counts = np.bincount(row, minlength=rows)
    full = np.flatnonzero(counts)
    starts = np.searchsorted(row, full)
    d1, d2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    minima = np.zeros((rows, BANDS * ROWS), np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            d1[full] = np.add.reduceat(words.mix(h + np.uint64(11)), starts)
            d2[full] = np.add.reduceat(words.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            held = np.empty_like(h)
            for k, factor in enumerate(_FACTORS):
                np.multiply(h, factor, out=held)
                minima[full, k] = np.minimum.reduceat(held, starts)
    mixed = words.mix(minima)
    keys = np.zeros((rows, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + mixed[:, k::ROWS]
        keys = words.mix(keys + np.arange(BANDS, dtype=np.uint64))
    lanes = np.zeros((rows, PACKED * LANES), np.uint64)
    lanes[:, : BANDS * ROWS] = mixed >> np.uint64(49)
    lanes = lanes.reshape(rows, PACKED, LANES)
    sig = lanes[:, :, 0] | lanes[:, :, 1] << np.uint64(16) | lanes[:, :, 2] << np.uint64(32)
    there = np.zeros((rows, BITS), bool)
    there[row, (words.mix(h) >> np.uint64(20)).astype(np.int64) & (BITS - 1)] = True
    bits = np.packbits(there, axis=1).reshape(-1).view(np.int64)
    return pa.record_batch(
        [
            *batch.columns[:3],
            pa.array(counts, pa.int64()),
            pa.array(d1.view(np.int64)),
            pa.array(d2.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * PACKED, pa.int32()), pa.array(sig.reshape(-1).view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (BITS // 64), pa.int32()), pa.array(bits)),
            pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
        ],
        names=["id", "k1", "k2", "n_shingles", "d1", "d2", "sig", "bits", "bands"],
    )


def _minima(column: pa.Array) -> np.ndarray:
    """(rows x minima) of packed signatures."""
    longs = np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), PACKED)
    return longs.view(np.uint16).reshape(len(column), PACKED, 4)[:, :, :LANES].reshape(len(column), -1)[:, : BANDS * ROWS]


def agreeing(x: str, y: str, longs: int) -> str:
    """SQL for how many of the minima in the first so many longs agree.

    A lane of the exclusive or is at most 0x7FFF; adding 0x7FFF sets its high bit unless the lane is 0.
    """
    high, low = 0x800080008000, 0x7FFF7FFF7FFF
    spare = PACKED * LANES - BANDS * ROWS if longs == PACKED else 0
    differ = f"aggregate(zip_with(slice({x}, 1, {longs}), slice({y}, 1, {longs}), (p, q) -> bit_count(((p ^ q) + {low}L) & {high}L)), 0, (s, e) -> s + e)"
    return f"({longs * LANES - spare} - {differ})"


def _bits_reach(threshold: int) -> str:
    """SQL for whether x and y can reach the threshold by their bitmaps: x lacks the bits that only y has, and so its shingles."""
    lacks = "aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count({} & ~{})), 0, (s, e) -> s + e)"
    common = f"least(x.n_shingles - {lacks.format('p', 'q')}, y.n_shingles - {lacks.format('q', 'p')})"
    return f"100 * {common} >= {threshold} * (x.n_shingles + y.n_shingles - {common})"


def _compare(threshold: int, miss: float):
    """Sequential comparison of signatures; columns a, b, n_a, n_b, sig_a, sig_b to a, b, matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BANDS * ROWS
        for batch in batches:
            n = batch.num_rows
            na, nb = (np.asarray(batch.column(k)) for k in (2, 3))
            left, right = _minima(batch.column(4)), _minima(batch.column(5))
            live = np.flatnonzero(100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb))
            matches = np.zeros(n, np.int64)
            for done in range(0, width, BATCH):
                matches[live] += (left[live, done : done + BATCH] == right[live, done : done + BATCH]).sum(axis=1)
                live = live[matches[live] >= least_matches(done + BATCH, threshold, miss)]
            keep = pa.array(live)
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(matches[live])], names=["a", "b", "matches"])

    return run


def _verify(threshold: int, size: int):
    """Exact comparison; columns a, b, text_a, text_b to the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole, "text_a"):
                rows = batch.num_rows
                (ra, ha), (rb, hb) = sets_of(batch.column(2), size), sets_of(batch.column(3), size)
                na, nb = np.bincount(ra, minlength=rows), np.bincount(rb, minlength=rows)
                row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                twice = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
                common = np.bincount(row[twice], minlength=rows)
                keep = pa.array(np.flatnonzero((common > 0) & (100 * common >= threshold * (na + nb - common))))
                yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def with_ids(docs: DataFrame, ids: DataFrame, id_column: str, how: str) -> DataFrame:
    """``docs`` with (``left_semi``) or without (``left_anti``) the ids in column ``id``; few ids are broadcast, many shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    right = ids.select("id").alias("own")
    return docs.join(F.broadcast(right) if few else right, docs[f"`{id_column}`"] == F.col("own.id"), how)


def _explode(size: int):
    """Texts to (id, shingle) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.slices(whole, "text"):
                row, h = sets_of(batch.column(1), size)
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], names=["id", "h"])

    return run


def _own_counts(texts: DataFrame, size: int) -> DataFrame:
    """``id`` and ``own``: how many of its shingles no other id among ``texts`` has."""
    rows = texts.select("id", "text").mapInArrow(_explode(size), "id long, h long")
    return rows.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id = last").groupBy("id").agg(F.count("*").alias("own"))


class _Verifier:
    """Links among candidate pairs of class representatives."""

    def __init__(self, texts: DataFrame, reps: DataFrame, threshold: int, miss: float, size: int):
        self.texts, self.reps, self.threshold, self.miss, self.size = texts, reps, threshold, miss, size

    def survivors(self, pairs: DataFrame) -> DataFrame:
        a = self.reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
        b = self.reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
        return both.mapInArrow(_compare(self.threshold, self.miss), "a long, b long, matches long")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs.select("a", "b"), f"neardup-{name}-pairs")
        needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = written(with_ids(self.texts, needed, "id", "left_semi"), f"neardup-{name}-texts")
        left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return written(both.mapInArrow(_verify(self.threshold, self.size), "a long, b long"), f"neardup-{name}-links")

    def settled(self, pairs: DataFrame, groups: DataFrame | None, name: str) -> DataFrame:
        """Components after the links among ``pairs`` (a, b, matches): each document's best pair first, then what is still apart."""
        ends = pairs.select("a", "b", "matches", F.explode(F.array("a", "b")).alias("end"))
        best = ends.groupBy("end").agg(F.max(F.struct("matches", "a", "b")).alias("one")).select(F.col("one.a").alias("a"), F.col("one.b").alias("b")).distinct()
        links = self.links(best, f"{name}-best")
        groups = components(links, f"neardup-{name}-best") if groups is None else extended(groups, links, f"neardup-{name}-best")
        apart = labelled(labelled(pairs.select("a", "b"), groups, "a"), groups, "b").filter("label_a <> label_b").select("a", "b").join(best, ["a", "b"], "left_anti")
        return extended(groups, self.links(apart, f"{name}-apart"), f"neardup-{name}-apart")


def near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, size: int = SHINGLE, miss_probability: float = MISS_PROBABILITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Two documents are linked when their sets of distinct word shingles have ``100 * intersection >= threshold * union``.
    A text with fewer words than a shingle has one shingle, the whole sequence; null, empty and white-space texts have none,
    are linked with nothing and kept. Rows of equal sets are always together. Rows that share an id are one document to
    the links (the id of a component is theirs); a null id is never linked but by an equal set, whose id is then its component,
    and is kept where no row with an id has its set. Very long texts are read whole. Extra columns play no part, whatever their names. An empty table gives an empty result.
    """
    profile = _profiled(docs, size, id_column, text_column)
    return _components(docs, profile, threshold, size, miss_probability, id_column, text_column).select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "rep", "id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _profiled(docs: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), *row_keys(id_column, text_column), F.col(f"`{text_column}`").cast("string").alias("text"))
    return written(base.mapInArrow(_profile(size), _PROFILE), "neardup-profile")


def _components(docs: DataFrame, profile: DataFrame, threshold: int, size: int, miss_probability: float, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``n_shingles``, ``d1``, ``d2``, ``rep`` (smallest id of equal sets, null without words) and ``component`` of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    slim = profile.select("id", "k1", "k2", "n_shingles", "d1", "d2")
    full = slim.filter("n_shingles > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.withColumn("part", F.pmod(F.col("k1"), F.lit(parts)))
    # a class has at most one row for each part here, however many copies it has
    places = dealt.select("part", "d1", "d2").distinct().join(classes, ["d1", "d2"])
    members = dealt.join(places, ["part", "d1", "d2"]).select("id", "k1", "k2", "n_shingles", "d1", "d2", "rep")
    members = written(members.unionByName(slim.filter("n_shingles = 0").withColumn("rep", F.lit(None).cast("long"))), "neardup-members")
    heads = classes.filter("rep is not null").select("d1", "d2", F.col("rep").alias("id"))
    reps = profile.filter("n_shingles > 0").join(heads, ["d1", "d2", "id"]).dropDuplicates(["d1", "d2", "id"]).select("id", "n_shingles", "sig", "bits", "bands")
    reps = written(reps, "neardup-reps")

    every = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    company = written(every.join(every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "key"), "neardup-company")
    nodes = company.select("id").distinct()
    # an id that several sets share has no bound: the shingles of its own are those of all its texts
    several = reps.groupBy("id").agg(F.count("*").alias("sets")).filter("sets > 1").select("id")
    own = _own_counts(with_ids(base, nodes, "id", "left_semi"), size).join(several, "id", "left_anti")
    able = company.join(own, "id", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("own", F.lit(0))).filter(f"100 * shared >= {threshold} * n_shingles")
    able = written(able.select("id", "n_shingles", "shared", "band", "key"), "neardup-able")
    verifier = _Verifier(base, reps, threshold, miss_probability, size)

    def reach(x: str, y: str) -> Column:
        common = F.least(F.col(f"{x}.shared"), F.col(f"{y}.shared"))
        return 100 * common >= threshold * (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles") - common)

    # by even bands the member with the smallest share of shingles of its own, by odd bands any: the one is near to most members
    # of a group of edits of one original, the others differ from bucket to bucket
    chance = F.xxhash64("key", "id").cast("double") / float(1 << 63)
    rank = F.when(F.col("band") % 2 == 0, F.col("n_shingles") - F.col("shared") + F.xxhash64("id").cast("double") / float(1 << 64)).otherwise(chance)
    hub = F.min_by(F.struct("id", "n_shingles", "shared"), rank).alias("hub")
    hubs = able.groupBy("key").agg(F.count("*").alias("c"), hub).filter("c > 1").select("key", "hub.*")
    x, y = able.alias("x"), hubs.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & reach("x", "y")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    found = written(verifier.survivors(pairs.distinct()), "neardup-found")
    groups = verifier.settled(found, None, "hubs")

    def open_members(groups: DataFrame) -> DataFrame:
        """Rows of ``able`` in buckets with more than one component, with their component and the bucket's largest."""
        placed = written(labelled(able, groups, "id"), "neardup-placed")
        sizes = placed.groupBy("key", "label_id").agg(F.count("*").alias("c"))
        open_ = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("label_id", "c").alias("largest")).filter("groups > 1").select("key", "largest")
        return written(placed.join(open_, "key").join(reps.select("id", "bands", "sig", "bits"), "id"), "neardup-open")

    likely = F.lit(True)
    for longs in (PACKED // 4, PACKED // 2, PACKED):  # batch after batch, as the comparison of hub pairs
        seen = min(longs * LANES, BANDS * ROWS)
        likely = likely & F.expr(f"{agreeing('x.sig', 'y.sig', longs)} >= {least_matches(seen, threshold, miss_probability)}")
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.expr(agreeing("x.sig", "y.sig", PACKED)).alias("matches")]
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label_id") != F.col("y.label_id")) & reach("x", "y")

    members_left = open_members(groups)
    outside = members_left.filter("label_id <> largest")
    # a bucket as a grid: rows are blocks of members outside the largest component, columns blocks of all members
    many = lambda c: F.ceil(c / F.lit(BLOCK_MEMBERS)).cast("int")
    grid = members_left.groupBy("key").agg(many(F.count_if(F.col("label_id") != F.col("largest"))).alias("down"), many(F.count("*")).alias("across"))
    cell = lambda df, own, n, other, m: df.join(grid, "key").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    x = cell(outside, "i", "down", "j", "across").alias("x")
    y = cell(members_left, "j", "across", "i", "down").alias("y")
    first_shared_band = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) = x.band + 1")
    either = (F.col("y.label_id") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    same = (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & apart & either
    across = written(x.join(y, same & first_shared_band & F.expr(_bits_reach(threshold)) & likely).select(*pair).distinct().join(found.select("a", "b"), ["a", "b"], "left_anti"), "neardup-across")
    final = verifier.settled(across, groups, "rest")
    # rows of large components are dealt over parts, as copies were
    dealt = members.withColumn("part", F.pmod(F.col("k1"), F.lit(parts)))
    labels = dealt.filter("rep is not null").select("part", "rep").distinct().join(final, F.col("rep") == F.col("node"), "left").select("part", "rep", "component")
    return dealt.join(labels, ["part", "rep"], "left").drop("part")


def one_of_each(docs: DataFrame, *, threshold: int = THRESHOLD, size: int = SHINGLE, miss_probability: float = MISS_PROBABILITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep, and with one of each set of rows equal in id and text.

    Each row goes or stays by its own id and text. Of rows that share an id, those with different sets are all kept if one is; those
    of equal sets leave one. Texts without words (null, empty, white space) are linked with nothing and stay, also where they
    repeat. A row with a null id goes where its set, or one linked with it, has an id; of null-id rows of equal sets one stays.
    Which of rows that tie stays follows from a hash of their columns other than those with maps in them. Very long texts are read
    whole. Columns may have any name and type. An empty table gives an empty result.
    """
    profile = _profiled(docs, size, id_column, text_column)
    rows = written(_components(docs, profile, threshold, size, miss_probability, id_column, text_column), "neardup-rows")
    target = F.coalesce("component", "rep")
    copies = rows.filter((F.col("n_shingles") > 0) & target.isNotNull() & ~F.col("id").eqNullSafe(target)).select("k1", "k2").distinct()
    # rows that tie in id and set: one pair of keys stays, and of its rows one
    ties = rows.filter(F.col("n_shingles") > 0).groupBy("id", "d1", "d2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2")).alias("first")).filter("c > 1")
    ties = written(ties.select("id", "d1", "d2", "first.*"), "neardup-ties")
    if not ties.limit(1).count():
        return without_rows(docs, written(copies, "neardup-gone"), id_column, text_column)
    a, b = rows.alias("a"), ties.alias("b")
    tied = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.d1") == F.col("b.d1")) & (F.col("a.d2") == F.col("b.d2"))).select("a.k1", "a.k2", F.struct("a.k1", "a.k2").eqNullSafe(F.struct("b.k1", "b.k2")).alias("stays")).distinct()
    tied = written(tied, "neardup-tied")
    gone = written(copies.unionByName(tied.select("k1", "k2")).distinct(), "neardup-gone")
    heads = tied.filter("stays").select("k1", "k2").join(copies, ["k1", "k2"], "left_anti").alias("own")
    k1, k2 = row_keys(id_column, text_column)
    repeated = docs.join(heads, (k1 == F.col("own.k1")) & (k2 == F.col("own.k2")), "left_semi")
    plain = [F.col(f"`{c}`") for c, kind in repeated.dtypes if "map<" not in kind and "variant" not in kind]  # maps have no hash, wherever they lie
    one = repeated.groupBy(k1, k2).agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)]), F.xxhash64(*plain)).alias("one"))
    one = one.select(*[F.col(f"one.c{n}").alias(c) for n, c in enumerate(docs.columns)])
    return without_rows(docs, gone, id_column, text_column).unionByName(one)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
