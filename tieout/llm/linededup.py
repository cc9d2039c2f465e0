"""Lines that many documents share, dropped from all but one of them, with DataFrame functions only.

A line's key is the line without white space at either end, A-Z in lower case; keys of fewer than ``shortest`` code points never go. Only
a 128-bit hash, the document and the place of each longer line are shuffled: they are range-partitioned by (hash, document) and
sorted by document and place within, so that a line which a third of all documents hold lies in as many ranges as it has rows for. A run
of the sorted stream is one key in one document; its first occurrence counts the document. How many documents hold a key, and which
has the largest id, are sums over runs, a row of each key and task.

What returns to the documents is a bitmap of the lines they keep, run-length coded as kept stretches, never text; it is joined to them
by id and a hash of the text, and documents that lose nothing have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.llm.storage import written

SHORTEST, DOCUMENTS = 40, 5
#: So many shared keys (40 bytes each), and so many kept stretches (8 bytes each) of so many documents, may be broadcast, after they
#: were counted; beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_STRETCHES = 200_000, 2_000_000
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of a text, joined again; a null bitmap keeps all. Each line is copied once, whatever it keeps."""
    own = lines(text)
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(keep, lambda s: F.slice(own, s["start"] + 1, s["length"]))), "\n"))


def _stretches(dropped: Column, n: Column) -> Column:
    """Kept stretches of ``n`` lines from the sorted places that go: what lies between one that goes and the next."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n))
    between = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.struct((F.element_at(edges, k) + 1).alias("start"), (F.element_at(edges, k + 1) - F.element_at(edges, k) - 1).alias("length")))
    return F.filter(between, lambda s: s["length"] > 0)


def _held(docs: DataFrame, shortest: int, id_column: str, text_column: str) -> DataFrame:
    """The slim rows: ``hash`` of a key, ``id``, ``own`` (a hash of the text), ``n`` lines of it, ``pos`` and whether it is the ``first`` of its key in the document."""
    text = F.col(f"`{text_column}`").cast("string")
    split = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.xxhash64(text).alias("own"), lines(text).alias("lines"))
    each = split.select("id", "own", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line")).withColumn("line", F.trim("line", F.lit(_BLANKS)))
    slim = each.filter(F.char_length("line") >= shortest).select(F.unhex(F.md5(F.translate("line", _UPPER, _LOWER))).alias("hash"), "id", "own", "n", "pos")
    run = Window.partitionBy("hash", "id").orderBy("pos", "own")
    # the ranges serve the window: it sorts within them and nothing is shuffled again
    return slim.repartitionByRange("hash", "id").withColumn("first", F.row_number().over(run) == 1)


def keep_bitmaps(docs: DataFrame, *, shortest: int = SHORTEST, documents: int = DOCUMENTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``own``, ``n_lines``, ``n_dropped`` and ``keep`` of each document that loses lines: kept stretches (``start`` from 0, ``length``) in order.

    A key that at least ``documents`` ids hold goes from all but the largest of them, wherever and however often it stands; in the
    largest every line stays. Rows that share an id are one document for the counts and each has its own bitmap; rows without an id
    are together one document, below all others. Equal rows share one bitmap. Null and empty texts have one empty line, which
    stays; tables without long lines, and empty ones, give no bitmaps. Other columns are not looked at, whatever their names.
    """
    held = written(_held(docs, shortest, id_column, text_column), "line-runs")
    shared = written(held.filter("first").groupBy("hash").agg(F.count("*").alias("holders"), F.max("id").alias("holder")).filter(F.col("holders") >= documents).select("hash", "holder"), "shared-lines")
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    gone = held.join(F.broadcast(shared) if few else shared, "hash").filter("id is null or id < holder")
    per = gone.groupBy("id", "own").agg(F.array_sort(F.collect_set("pos")).alias("dropped"), F.first("n").alias("n"))
    return per.select("id", "own", F.col("n").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), _stretches(F.col("dropped"), F.col("n")).alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` as struct ``doc``, with ``n_lines``, ``n_dropped`` and ``keep`` (null where every line stays). Few bitmaps go to the documents;
    many are shuffled with them. ``bitmaps`` should be a table: it is counted first."""
    n, stretches = bitmaps.agg(F.count("*"), F.sum(F.size("keep"))).first()
    small = n <= BROADCAST_ROWS and (stretches or 0) <= BROADCAST_STRETCHES
    b = bitmaps.select("id", "own", "n_dropped", "keep").alias("b")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc").getField(text_column).cast("string")
    same = F.col("doc").getField(id_column).cast("long").eqNullSafe(F.col("b.id")) & (F.xxhash64(text) == F.col("b.own"))
    joined = whole.join(F.broadcast(b) if small else b, same, "left")
    return joined.select("doc", F.size(lines(text)).cast("long").alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.col("b.keep").alias("keep"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the counts of their lines and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = with_bitmaps(docs, written(keep_bitmaps(docs), "line-bitmaps"))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("doc.text"), F.col("keep")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
 k as (select doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 s as (select key, max(doc_id) holder from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
 d as (select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id < s.holder gone from k left join s on s.key = k.key)
 select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from d group by doc_id"""
