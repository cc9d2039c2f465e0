"""How far the sources of a language are from each other and from the language, by sorted streams of (lang, term, source, document).

Tasks count the terms of their documents and let a part of so many documents go as partial rows: lang, term, source, part, the documents
of the part that hold the term and its occurrences. Parts are then dealt by (lang, term) and sorted by (lang, term, source, part), ahead of them by
a hash of (lang, term), which costs a sort far less than texts do; one scan over the sorted stream adds up the run of each source and the run of each term, whose documents decide whether it stays. Where a term
is frequent within parts, its rows are first dealt by their part too, and added up there, so no task meets all rows of one word.

A last sorted stream has the sources of each language, with their totals, ahead of its terms: sources are dealt to every slot, terms to one.
Scanning it, a task adds for each term what it contributes to each pair of sources and keeps the first terms of each source; sums of pairs and first terms of
all slots are then put together. Nothing is broadcast and nothing passes the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.llm.storage import written

DOCUMENTS, TERMS, SCALE = 10, 10, 1_000_000_000
#: Terms that a task holds before it lets a part go.
HELD = 700_000
#: A term that so many documents of a part hold is frequent there; its rows are dealt to so many places first.
FREQUENT, PLACES = 32, 64
#: Rows of kept terms that one slot of the last stream has about.
SLOT_ROWS = 60_000
#: Numbers that one step of the last scan works on at a time.
STEP = 1_000_000

#: Term characters are A-Z, a-z and all beyond ASCII: in UTF-8 every byte from 0x80 on belongs to one.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_PARTIAL = "lang string, term string, source string, part long, df long, n long"
_PARTIAL_TYPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("part", pa.int64()), ("df", pa.int64()), ("n", pa.int64())])


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def _parts(held: int):
    """Documents (lang, source, text as bytes) to partial rows; a row without a term says that the source occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, groups, size = (context.partitionId() if context else 0) << 32, {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                words = [b"", *n]
                made = [pa.array([x] * len(words), pa.string()) for x in (lang, source)]
                raw = pa.array(words, pa.binary())
                term = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())  # cut at ASCII, so as valid as the text
                table = pa.table([made[0], term, made[1], pa.array(np.full(len(words), part)), pa.array([0, *map(df.__getitem__, n)], pa.int64()), pa.array([0, *n.values()], pa.int64())], schema=_PARTIAL_TYPES)
                yield from table.to_batches(20_000)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                before, words = len(n), terms(text.as_py())
                n.update(words)
                df.update(set(words))
                size += len(n) - before
                if size >= held:
                    yield from rows()
                    part, groups, size = part + 1, {}, 0
        yield from rows()

    return run


def _summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial rows to one for each run of (lang, term, source): documents and occurrences added up. A run that a batch cuts goes on in the next."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(_PARTIAL_TYPES)
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        begins = _begins(table, ("lang", "term", "source"))
        sums = [np.add.reduceat(table[c].to_numpy(), begins) for c in ("df", "n")]
        table = table.take(begins).set_column(4, "df", pa.array(sums[0])).set_column(5, "n", pa.array(sums[1]))
        rest = table.slice(table.num_rows - 1)
        yield from table.slice(0, table.num_rows - 1).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def _begins(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where the runs of equal columns begin."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in columns:
        whole = table[c].combine_chunks()
        new[1:] |= pc.not_equal(whole.slice(1), whole.slice(0, len(whole) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _kept_runs(least: int):
    """Summed runs, sorted by (lang, term, source), to the rows of terms that stay; the rows of sources (no term) always do. A term goes
    on until another begins, through as many batches as it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def decided(table: pa.Table) -> Iterator[pa.RecordBatch]:
            begins = _begins(table, ("lang", "term"))
            many = np.diff(np.append(begins, table.num_rows))
            stays = np.add.reduceat(table["df"].to_numpy(), begins) >= least
            first = np.zeros(table.num_rows, np.int64)
            first[begins] = 1
            source = pc.equal(table["term"], "").to_numpy()
            keep = np.repeat(stays, many) | source
            out = pa.table([table["lang"], table["term"], table["source"], table["n"], pa.array(np.where(source, 0, first))], schema=_KEPT_TYPES)
            yield from out.filter(pa.array(keep)).to_batches()

        for batch in _summed_runs(batches):
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            if rest.num_rows < 5_000:
                continue
            rest = rest.combine_chunks()
            begins = _begins(rest, ("lang", "term"))
            if begins[-1]:
                yield from decided(rest.slice(0, int(begins[-1])))
                rest = rest.slice(int(begins[-1]))
        if rest is not None and rest.num_rows:
            yield from decided(rest.combine_chunks())

    return run


_KEPT = "lang string, term string, source string, n long, first long"
_KEPT_TYPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("first", pa.int64())])


def _share(count: np.ndarray, total, kept: int) -> np.ndarray:
    """``1 + floor(10^9 * (count + 2) / (total + 2 * kept))``, exact however large the counts are."""
    below = np.maximum(np.asarray(total) + 2 * kept, 1)
    if count.size and int(count.max()) + 2 >= 2**63 // SCALE:
        return (1 + SCALE * (count.astype(object) + 2) // below).astype(np.int64)
    return 1 + SCALE * (count + 2) // below


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Language:
    """One language in one slot: its sources, then its terms in order; sums over pairs of sources, and first terms, as they come.

    A pair to which a term gives nothing but its absence in both sources has the same value for all such terms; it is counted, and only
    the rows that occur are worked on: ``own[a, b]`` is what terms of ``a`` change against that, ``both`` what is in it twice.
    """

    def __init__(self, lang: str, sources: list[str], totals: list[int], kept: int, total: int, first: int):
        self.lang, self.sources, self.totals, self.kept, self.total, self.first = lang, sources, np.array(totals, np.int64), kept, total, first
        self.at = {s: k for k, s in enumerate(sources)}
        absent = _share(np.zeros(len(sources), np.int64), self.totals, kept)
        self.absent, self.base = absent, _apart(absent[:, None], absent[None, :])
        self.own, self.both, self.seen = np.zeros_like(self.base), np.zeros_like(self.base), 0

    def add(self, words: pa.ChunkedArray, sources: list[str], n: np.ndarray) -> tuple:
        """Rows of whole terms; returns the columns source, term and value of those that may be among the first."""
        at = np.array([self.at[s] for s in sources])
        begins = _begins(pa.table({"term": words}), ("term",))
        t = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
        p = np.tile(self.absent, (len(begins), 1))
        mine = _share(n, self.totals[at], self.kept)
        p[t, at] = mine
        there = np.zeros(p.shape, bool)
        there[t, at] = True
        self.seen += len(begins)
        for a in np.unique(at):
            of_a = np.flatnonzero(at == a)
            more = _apart(mine[of_a, None], p[t[of_a]]) - self.base[a]
            self.own[a] += more.sum(0)
            self.both[a] += np.where(there[t[of_a]], more, 0).sum(0)
        q = _share(np.add.reduceat(n, begins), self.total, self.kept)[t]
        over = np.flatnonzero(mine > q)
        value = _apart(mine[over], q[over])
        order = np.lexsort((t[over], -value, at[over]))
        over, value = over[order], value[order]
        s = at[over]
        if len(over):
            new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            place = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
            over, value, s = over[place < self.first], value[place < self.first], s[place < self.first]
        return [self.sources[k] for k in s], words.take(pa.array(over)), value

    def pairs(self, all_: bool) -> pa.Table:
        sums = self.seen * self.base + self.own + self.own.T - self.both
        a, b = np.nonzero(~np.eye(len(self.sources), dtype=bool) & (all_ | (sums != 0)))
        names = np.array(self.sources, object)
        return _found(self.lang, names[a].tolist(), "pair", pa.array(names[b].tolist(), pa.string()), sums[a, b])


_FOUND = "lang string, source string, part string, item string, value long"
_FOUND_TYPES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _found(lang: str, sources: list[str], part: str, items, values: np.ndarray) -> pa.Table:
    return pa.table([pa.array([lang] * len(sources), pa.string()), pa.array(sources, pa.string()), pa.array([part] * len(sources), pa.string()), items, pa.array(values, pa.int64())], schema=_FOUND_TYPES)


def _scanned(first: int, step_numbers: int):
    """The last stream, sorted by slot, lang, kind, term and source: partial sums of pairs and first terms of each slot and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, now, rest = None, [], None, None

        def worked(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
            step = max(1, step_numbers // max(1, len(now.sources)))
            rest = table
            while table.num_rows and (last or table.num_rows > step):
                begins = _begins(table, ("term",))
                ends = np.append(begins[1:], table.num_rows)
                ready = ends if last else ends[:-1]
                if not len(ready):
                    return
                end = int(ready[max(0, np.searchsorted(ready, step, "right") - 1)])
                own, words, values = now.add(table["term"].slice(0, end), table["source"].slice(0, end).to_pylist(), table["n"].slice(0, end).to_numpy())
                yield from _found(now.lang, own, "term", words, values).to_batches()
                rest = table = table.slice(end)

        def opened() -> _Language:
            return _Language(key[1], [h[0] for h in heads], [h[1] for h in heads], heads[0][2], heads[0][3], first)

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal now, rest
            if key is None:
                return
            now = now or opened()
            if rest is not None:
                yield from worked(rest.slice(0, 0), True)
            yield from now.pairs(key[0] == 0).to_batches()
            now, rest = None, None

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            edges = [*_begins(table, ("slot", "lang", "kind")).tolist(), table.num_rows]
            for begin, end in zip(edges, edges[1:]):
                piece = table.slice(begin, end - begin)
                at = (piece["slot"][0].as_py(), piece["lang"][0].as_py())
                if at != key:
                    yield from closed()
                    key, heads = at, []
                if piece["kind"][0].as_py() == 0:
                    heads += zip(*(piece[c].to_pylist() for c in ("source", "n", "kept", "total")), strict=True)
                else:
                    now = now or opened()
                    yield from worked(piece, False)
        yield from closed()

    return run


def divergence(docs: DataFrame, *, documents: int = DOCUMENTS, first: int = TERMS, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", held: int = HELD) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value`` and ``rank`` (int from 1 in each group and part).

    ``pair``: every other source of the language and how far it is, over all terms kept; ``term``: the first terms of which the source has a larger
    share than the language. Null text, lang and source read as empty; each row is a document, repeated or not; texts are read
    whole; ties go by the item's bytes. Sources without terms have their pairs too; one that is alone in its language has none, and an empty table
    gives nothing. Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = docs.select(text(lang_column).alias("lang"), text(source_column).alias("source"), text(text_column).cast("binary").alias("text"))
    parts = written(slim.mapInArrow(_parts(held), _PARTIAL), "term-parts")

    columns = ("lang", "term", "source", "part", "df", "n")
    run = lambda df: df.sortWithinPartitions("hash", *columns[:4]).select(*columns)
    hashed = lambda df: df.withColumn("hash", F.xxhash64("lang", "term"))
    frequent = hashed(parts.filter(F.col("df") >= FREQUENT))
    frequent = run(frequent.repartition("lang", "term", F.pmod(F.xxhash64("part"), F.lit(PLACES)))).mapInArrow(_summed_runs, _PARTIAL)
    runs = frequent.unionByName(parts.filter(F.col("df") < FREQUENT))
    # a source's row without a term is one of its own, however many parts it has
    dealt = F.when(F.col("term") == "", F.col("source")).otherwise(F.lit(""))
    kept = written(run(hashed(runs).repartition("lang", "term", dealt)).mapInArrow(_kept_runs(documents), _KEPT), "kept-terms")

    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("total"))
    slots = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // SLOT_ROWS)))
    none = lambda kind: F.lit(None).cast(kind)
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    heads = per_source.join(per_lang, "lang").select(every.alias("slot"), "lang", F.lit(0).alias("kind"), none("string").alias("term"), "source", "n", "kept", "total")
    rows = kept.filter("term <> ''").select(F.pmod(F.hash("lang", "term"), F.lit(slots)).alias("slot"), "lang", F.lit(1).alias("kind"), "term", "source", "n", none("long").alias("kept"), none("long").alias("total"))
    stream = heads.unionByName(rows).repartition(slots, "slot").sortWithinPartitions("slot", "lang", "kind", "term", "source")
    found = written(stream.mapInArrow(_scanned(first, STEP), _FOUND), "divergence")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))

    pairs = ranked(found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    best = ranked(found.filter("part = 'term'")).filter(F.col("rank") <= first)
    return pairs.unionByName(best)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: each source against the others of its language, and its terms against the language."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') txt from documents),
 w as (select doc_id, lang, source, unnest(regexp_extract_all(txt, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
 keep as (select lang, term from w group by lang, term having count(distinct doc_id) >= 10),
 c as (select w.lang, w.source, w.term, count(*) n from w join keep on keep.lang = w.lang and keep.term = w.term group by all),
 g as (select d.lang, d.source, coalesce(max(x.n), 0) n from (select distinct lang, source from d) d left join (select lang, source, sum(n) n from c group by all) x on x.lang = d.lang and x.source = d.source group by all),
 v as (select lang, count(*) v from keep group by lang),
 l as (select lang, term, sum(n) n from c group by all), ln as (select lang, sum(n) n from c group by all),
 p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) as hugeint) p from g join v on v.lang = g.lang join keep k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 q as (select l.lang, l.term, cast(1 + (1000000000::hugeint * (l.n + 2)) // (ln.n + 2 * v.v) as hugeint) q from l join ln on ln.lang = l.lang join v on v.lang = l.lang),
 s as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
 pr as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(s.f, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
 t as (select p.lang, p.source, 'term' part, p.term item, cast((p.p - q.q) * (p.p - q.q) // (p.p + q.q) as bigint) as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
 r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (select * from pr union all select * from t))
 select * from r where part = 'pair' or rank <= 10"""
