"""Hard negatives by a blocked matrix product: anchors against all rows, in tiles of a two-dimensional grid.

Rows and anchors are dealt to blocks of bounded size and their vectors cut into at most ``CHUNKS`` runs of dimensions. Each pair of blocks
meets once for each run of dimensions and gives a partial tile of exact int64 scores, one strip for an anchor; the partial tiles of a
pair are shuffled together and added, and the sum is reduced to the few rows that can be among the first, before anything else moves.

Two products share the grid. The first pairs anchors with the blocks of their own label's bin and keeps the first positives of each;
these then go along with the anchors into the second, over all blocks, which keeps for each anchor and positive the first
rows of other labels whose score lies in the positive's window. No tile is stored, none is unbounded, and no table is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.llm.storage import written

#: Rows and anchors of a block, about; dimensions of a run at least, and runs at most.
ROWS, ANCHORS, DIMENSIONS, CHUNKS = 2048, 512, 32, 4
#: Labels are hashed to so many bins; the first product looks for an anchor's label in its own bin only.
BINS = 64
POSITIVES, NEGATIVES = 5, 10
#: A hundredth of what scores may reach, so that no window leaves 64 bits.
LARGEST = 2**56
_NEVER = -(2**62)


def usable(rows: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v`` (whole numbers) of the rows that take part."""
    named = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("long").alias("label"), F.col(f"`{vector_column}`").alias("v"))
    v, x = F.col("v"), lambda c: c.cast("double")
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(finite).select("id", "label", F.transform(v, lambda c: F.floor(F.lit(float(scale)) * x(c))).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; a vector that ends early has zeros there."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    if len(flat):
        out[np.arange(width) < sizes[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product as int64: in doubles where no sum can pass 2^53, else in whole numbers."""
    most = lambda m: int(np.abs(m.astype(np.int64)).max()) if m.size else 0
    if a.shape[1] * most(a) * most(b) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


_STRIPS = "rb long, ab long, dc int, anchor_id long, anchor_label long, goals array<struct<id:long,score:long>>, bytes int, strip binary"
_STRIP_TYPES = pa.schema([("rb", pa.int64()), ("ab", pa.int64()), ("dc", pa.int32()), ("anchor_id", pa.int64()), ("anchor_label", pa.int64()), ("goals", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))), ("bytes", pa.int32()), ("strip", pa.binary())])


def _multiplied(width: int):
    """One block of anchors times one block of rows over one run of dimensions: a strip of partial scores for each anchor, in order of
    the rows' ids and in the fewest bytes that hold them."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _STRIP_TYPES.empty_table()
        rows = rows.sort_by("id")
        tile = _product(_matrix(anchors["piece"], width), _matrix(rows["piece"], width))
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= tile.min() and tile.max() <= np.iinfo(t).max)
        strips = [s.tobytes() for s in tile.astype(kind)]
        return pa.table([anchors["rb"], anchors["ab"], anchors["dc"], anchors["anchor_id"], anchors["anchor_label"], anchors["goals"], pa.array([np.dtype(kind).itemsize] * len(strips), pa.int32()), pa.array(strips, pa.binary())], schema=_STRIP_TYPES)

    return run


def _added(strips: pa.Table, count: int) -> tuple[pa.Table, np.ndarray]:
    """The anchors of a tile (those of its first run of dimensions, by id) and its scores: the sum over the runs."""
    runs, heads, tile = strips["dc"].to_numpy(), None, None
    for k in np.unique(runs):
        part = strips.filter(pa.array(runs == k)).sort_by("anchor_id")
        if tile is None:
            heads, tile = part, np.zeros((part.num_rows, count), np.int64)
        for i, (size, strip) in enumerate(zip(part["bytes"].to_pylist(), part["strip"], strict=True)):
            tile[i] += np.frombuffer(strip.as_buffer(), f"<i{size}")
    return heads, tile


_POSITIVE = "anchor_id long, positive_id long, score long"
_POSITIVE_TYPES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
_NEGATIVE_TYPES = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])


def _best_positives(most: int):
    def run(strips: pa.Table, rows: pa.Table) -> pa.Table:
        if not strips.num_rows or not rows.num_rows:
            return _POSITIVE_TYPES.empty_table()
        rows = rows.sort_by("id")
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        heads, tile = _added(strips, len(ids))
        own, label = heads["anchor_id"].to_numpy(), heads["anchor_label"].to_numpy()
        tile[(labels[None, :] != label[:, None]) | (ids[None, :] == own[:, None])] = _NEVER
        first = np.argsort(-tile, axis=1, kind="stable")[:, :most]
        scores = np.take_along_axis(tile, first, 1)
        real = scores != _NEVER
        return pa.table([np.broadcast_to(own[:, None], first.shape)[real], ids[first][real], scores[real]], schema=_POSITIVE_TYPES)

    return run


def _best_negatives(most: int, low: int, high: int):
    """Per anchor and positive the first rows of other labels with ``low * p <= 100 * s <= high * p``."""

    def run(strips: pa.Table, rows: pa.Table) -> pa.Table:
        if not strips.num_rows or not rows.num_rows:
            return _NEGATIVE_TYPES.empty_table()
        rows = rows.sort_by("id")
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        heads, tile = _added(strips, len(ids))
        tile[labels[None, :] == heads["anchor_label"].to_numpy()[:, None]] = _NEVER
        order = np.argsort(-tile, axis=1, kind="stable")
        falling = -np.take_along_axis(tile, order, 1)
        out = []
        for i, (anchor, goals) in enumerate(zip(heads["anchor_id"].to_pylist(), heads["goals"].to_pylist(), strict=True)):
            for goal in goals:
                p = goal["score"]
                begin = int(np.searchsorted(falling[i], -(high * p // 100), "left"))
                end = min(int(np.searchsorted(falling[i], -(-(-low * p // 100)), "right")), begin + most)
                if begin < end:
                    out.append((anchor, goal["id"], p, ids[order[i, begin:end]], -falling[i, begin:end]))
        if not out:
            return _NEGATIVE_TYPES.empty_table()
        many = [len(x[3]) for x in out]
        anchor, positive, score = (np.repeat(np.array([x[k] for x in out], np.int64), many) for k in range(3))
        return pa.table([anchor, positive, np.concatenate([x[3] for x in out]), score, np.concatenate([x[4] for x in out])], schema=_NEGATIVE_TYPES)

    return run


def _tiles(rows: DataFrame, anchors: DataFrame, dimensions: int, kind: str, reduce: Callable, schema: str) -> DataFrame:
    """The grid: ``rows`` (``rb``, ``ab``, ``id``, ``label``, ``v``) and ``anchors`` (``goals`` too) meet by block and run of dimensions, partial tiles
    are shuffled to their block and added, and ``reduce`` makes rows of ``schema`` of each sum."""
    width = max(DIMENSIONS, -(-dimensions // CHUNKS))
    runs = max(1, -(-dimensions // width))
    cut = lambda df: df.withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("piece", F.slice("v", F.col("dc") * width + 1, width).cast(f"array<{kind}>"))
    left = cut(rows).select("rb", "ab", "dc", "id", "piece")
    right = cut(anchors).select("rb", "ab", "dc", F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), "goals", "piece")  # names of its own: both sides come from one table
    grid = ("rb", "ab", "dc")
    strips = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(_multiplied(width), _STRIPS)
    return strips.groupBy("rb", "ab").cogroup(rows.select("rb", "ab", "id", "label").groupBy("rb", "ab")).applyInArrow(reduce, schema)


def _first(df: DataFrame, keys: Iterable[str], score: str, tie: str, most: int) -> DataFrame:
    """The first rows of each key; what cannot be among them is dropped before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", anchor: Callable[[Column], Column] = lambda i: i % 100 == 0,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, scale: int = 256, block: tuple[int, int] = (ROWS, ANCHORS),
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (int from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    Components become ``floor(scale * x)``; a score is the exact inner product; higher ones come first, ties by smaller id. The positives of
    an anchor (a row whose id ``anchor`` selects) are its first other rows of equal label; of rows of another label, those whose score is
    from ``low`` to ``high`` hundredths of a positive's are its negatives.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Rows that share an id count once, by the
    smallest label and vector. A vector that is shorter than others counts as zero beyond its end. Labels are whole numbers. An empty table
    gives an empty result, as do anchors without positives. Values whose scores could pass 2^56 raise ``OverflowError``. Other columns are not
    looked at, whatever their names.
    """
    one = usable(rows, id_column, vector_column, label_column, scale).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    bin_ = F.pmod(F.xxhash64("label"), F.lit(BINS)).cast("int")
    held = written(one.select("id", "label", bin_.alias("bin"), "v"), "vectors")
    is_anchor = anchor(F.col("id"))
    n, largest, dimensions = held.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.max(F.size("v"))).first()
    largest, dimensions = int(largest or 0), max(0, int(dimensions or 0))
    if dimensions * largest * largest >= LARGEST:
        raise OverflowError(f"{dimensions} components of up to {largest}: scores could pass 2^56")
    kind = "smallint" if largest < 2**15 else "int" if largest < 2**31 else "bigint"
    # a row for each bin at most: how many blocks it has
    counted = {r["bin"]: r for r in held.groupBy("bin").agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).collect()}
    blocks = lambda what, size: F.element_at(F.array(*[F.lit(-(-counted[k][what] // size) if k in counted else 0) for k in range(BINS)]), F.col("bin") + 1)
    spread, none = F.xxhash64("id"), F.lit(None).cast("array<struct<id:long,score:long>>")
    of_bin = lambda part: F.col("bin").cast("long") * 2**32 + part
    all_ = lambda count: F.explode(F.sequence(F.lit(0), count - 1))

    rb, ab = blocks("rows", block[0]), blocks("anchors", block[1])
    row_side = held.filter(ab > 0).select(of_bin(F.pmod(spread, rb)).alias("rb"), "bin", "id", "label", "v", all_(ab).alias("a")).withColumn("ab", of_bin(F.col("a")))
    anchor_side = held.filter(is_anchor).select(of_bin(F.pmod(spread, ab)).alias("ab"), "bin", "id", "label", "v", none.alias("goals"), all_(rb).alias("r")).withColumn("rb", of_bin(F.col("r")))
    near = _first(_tiles(row_side, anchor_side, dimensions, kind, _best_positives(positives), _POSITIVE), ["anchor_id"], "score", "positive_id", positives)
    goals = written(near.groupBy(F.col("anchor_id").alias("at")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("goals")), "positives")

    total = sum(r["anchors"] for r in counted.values())
    row_blocks, anchor_blocks = F.lit(max(1, -(-n // block[0]))).cast("long"), F.lit(max(1, -(-total // block[1]))).cast("long")
    row_side = held.select(F.pmod(spread, row_blocks).alias("rb"), "id", "label", "v", all_(anchor_blocks).alias("ab"))
    anchor_side = held.filter(is_anchor).join(goals, F.col("id") == F.col("at")).select(F.pmod(spread, anchor_blocks).alias("ab"), "id", "label", "v", "goals", all_(row_blocks).alias("rb"))
    found = _tiles(row_side, anchor_side, dimensions, kind, _best_negatives(negatives, low, high), _NEGATIVE)
    return _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows of ``embeddings``; labels of ids divisible by 7 are moved by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


ORACLE_SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, cast(list_dot_product(a.v, b.v) as bigint) score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
 p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
 select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank, s.vec_id negative_id, p.positive_score, s.score negative_score
 from p join s on s.anchor_id = p.anchor_id where not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
 qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 10"""
