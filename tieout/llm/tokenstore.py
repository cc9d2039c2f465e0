"""Token ids in a content-addressed store.

Encoding. A text's ids, and an end id, are cut into chunks where a rolling hash over the last ids has its low bits zero
(content-defined, so equal passages cut alike), at most ``MAX_CHUNK`` long. A chunk is named by the BLAKE2b hash of its ids.

Store. ``chunks/`` holds every distinct chunk once, ``recipes/`` one row per document in ascending id order (its length, the
names of its chunks in order, and their Merkle root), ``manifest/`` one row per recipe file: first and last id, documents,
tokens and the Merkle root of its documents' roots, ``top/`` one row: files, documents, tokens and the root over the manifest.
All are Parquet.

Reading. Every chunk is read once: its bytes must have its name, and every name in a recipe must have a chunk. Every distinct
recipe must fold to its root, every file's roots to its manifest, the manifest to the top; what is missing raises as what was
changed does. The checksum of a document comes from those of its chunks by CRC combination, so ids never move again.

One pass encodes; one shuffle by name makes chunks unique. When read, copies share a root and cost one recipe in each recipe
file; joins are by file and root, or file and name, so a text or a passage that a third of all rows hold is dealt over all files.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.llm import words
from tieout.llm.storage import fresh_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
WINDOW, AVERAGE_CHUNK, MAX_CHUNK = 16, 2048, 16384
NAME_BYTES = 16
#: Units that a worker remembers; then it forgets them all.
REMEMBERED = 1_200_000
#: Bytes that texts must not hold to be encoded by units: control bytes but line feed, and leads of letters beyond U+024F.
_OTHER = np.ones(256, bool)
_OTHER[[10, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False
_GEAR = np.random.Generator(np.random.PCG64(505)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OUT = "kind int, name binary, id long, n long, body binary"
_ENCODERS: dict = {}


class Known:
    """A hash table of 64-bit keys other than 0 to their order of arrival; whole arrays are looked up and added at a time."""

    def __init__(self, most: int):
        bits = (4 * most).bit_length()
        self.keys, self.places, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The order of each key, -1 where it is not there."""
        at = (keys >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.places[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.places[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not there, in their order."""
        at, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of several at one place the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.places[at[won]] = self.size + won
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.size += len(keys)


class Encoder:
    """A tokenizer of the tokenizers library, whose results for units of text are remembered.

    A unit is a word with the one white-space byte before it. Byte-level BPE encodes each piece that its pre-tokenizer cuts
    by itself; where white space stands in single spaces and line feeds between words, a space always begins a piece and a line
    feed is one, so the ids of a text are those of its units. Other texts, and those with a special token's string or with
    characters whose class may differ between libraries, are encoded whole. Units are told apart by 64-bit hashes.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        own = self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer is not None else b""
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_unit = b'"ByteLevel"' in own and b'"add_prefix_space":false' in own and self.tokenizer.normalizer is None and len(feed) == 1
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = np.array(feed[:1], self.kind)
        self._forget()

    def _forget(self, room: int = 0) -> None:
        self.known = Known(max(REMEMBERED, room))
        self.flat, self.used = np.zeros(1 << 20, self.kind), 0
        self.begin, self.count = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, units: list[str], together: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units end to end, and how many each has; many units go in one text, a line each."""
        bare = [u.removeprefix("\n") for u in units]
        flat, count = [], []
        starts = range(0, len(bare), together)
        for begin, ids in zip(starts, self._whole(["\n".join(bare[k : k + together]) for k in starts]), strict=True):
            own = bare[begin : begin + together]
            feeds = np.flatnonzero(ids == self.feed[0])
            if len(feeds) == len(own) - 1:
                flat.append(np.delete(ids, feeds))
                count.append(np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1)
            else:
                each = self._whole(own)
                flat.extend(each)
                count.append(np.array([len(x) for x in each]))
        flat, count = np.concatenate(flat), np.concatenate(count)
        fed = np.array([u[0] == "\n" for u in units])
        return np.insert(flat, (np.cumsum(count) - count)[fed], self.feed[0]), count + fed

    def _remember(self, keys: np.ndarray, units: list[str]) -> None:
        ids, count = self._encoded(units)
        first, n = self.known.size, len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : first + n] = self.used + np.cumsum(count) - count
        self.count[first : first + n] = count
        self.used += len(ids)
        self.known.add(keys)

    def _safe(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which rows can be encoded by units."""
        rows = len(at) - 1
        if not self.by_unit:
            return np.zeros(rows, bool)
        if not len(raw):
            return np.ones(rows, bool)
        space, bad = (raw == 32) | (raw == 10), _OTHER[raw]
        bad[1:] |= space[1:] & space[:-1]
        bad[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC9) & (raw[1:] > 0x8F)
        full = np.flatnonzero(np.diff(at))
        bad[at[full]] |= space[at[full]]
        bad[at[full + 1] - 1] |= space[at[full + 1] - 1]
        text = raw.tobytes()
        for special in self.special:
            k = text.find(special)
            while k >= 0:
                bad[k] = True
                k = text.find(special, k + 1)
        seen = np.concatenate([[0], np.cumsum(bad)])
        return seen[at[1:]] == seen[at[:-1]]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with ``end_id`` behind it, and where each begins and all end."""
        raw, at = words.text_bytes(texts)
        rows, safe = len(texts), self._safe(raw, at)
        row, start, end = words.spans(raw, at)
        kept = safe[row]
        row, start, end = row[kept], start[kept], end[kept]
        start = start - (start > at[row])
        # a full stop or comma behind a letter or digit is a piece by itself, so words with and without one share a unit
        row, start, end = _apart(raw, row, start, end)
        hashes = np.maximum(words.hash_spans(raw, start, end, lower=False), np.uint64(1))
        places = self.known.find(hashes)
        new = np.flatnonzero(places < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.known.size + len(keys) > REMEMBERED:
                self._forget(len(hashes))
                keys, first, new = *np.unique(hashes, return_index=True), np.arange(len(hashes))
            text, where = raw.tobytes(), new[first]
            self._remember(keys, [text[b:e].decode() for b, e in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            places[new] = self.known.find(hashes[new])
        begin, count, flat = self.begin[places], self.count[places], self.flat[: self.used]
        other = np.flatnonzero(~safe)
        if len(other):
            ids = self._whole([raw[at[k] : at[k + 1]].tobytes().decode() for k in other.tolist()])
            size = np.array([len(x) for x in ids], np.int32)
            begin = np.concatenate([begin, (len(flat) + np.cumsum(size) - size).astype(np.int32)])
            count, row, flat = np.concatenate([count, size]), np.concatenate([row, other]), np.concatenate([flat, *ids])
            order = np.argsort(row, kind="stable")
            begin, count, row = begin[order], count[order], row[order]
        total = int(count.sum())
        source = np.repeat(begin - (np.cumsum(count, dtype=np.int32) - count), count) + np.arange(total, dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, count, rows).astype(np.int64) + 1)])
        out, own = np.full(total + rows, end_id, self.kind), np.ones(total + rows, bool)
        own[bounds[1:] - 1] = False
        out[own] = flat[source]
        return out, bounds


_STOP, _BEFORE_STOP = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[44, 46]] = True
_BEFORE_STOP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _apart(raw: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units whose last byte is a stop behind a letter or digit become two."""
    if not len(start):
        return row, start, end
    split = _STOP[raw[end - 1]] & _BEFORE_STOP[raw[np.maximum(end - 2, 0)]] & (end - 2 >= start)
    place = np.arange(len(start)) + np.cumsum(split) - split
    more = place[split] + 1
    out = [np.empty(len(start) + len(more), np.int64) for _ in range(3)]
    out[0][place], out[1][place], out[2][place] = row, start, end - split
    out[0][more], out[1][more], out[2][more] = row[split], end[split] - 1, end[split]
    return out[0], out[1], out[2]


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def cuts(ids: np.ndarray, at: np.ndarray, average: int = AVERAGE_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of texts laid end to end, ``at`` being where each begins and all end; ``average``: a power of two.

    The hash covers the last ``WINDOW`` ids of the text, so no chunk but a text's last is shorter, and equal texts cut alike.
    """
    n = len(ids)
    with np.errstate(over="ignore"):
        rolled = _GEAR[ids & np.uint32(0xFFFF) if ids.dtype != np.uint16 else ids]
        # sum of gear * M^age over the window, by doubling: M^(2^k) shifts a window of 2^k ids
        factor, span = 0x9E3779B97F4A7C15, 1
        while span < WINDOW:
            older = rolled[:-span] * np.uint64(factor)
            rolled = rolled.copy()
            rolled[span:] += older
            factor, span = factor * factor % (1 << 64), span * 2
        ends = np.flatnonzero(words.mix(rolled) & np.uint64(average - 1) == 0) + 1
    begin = at[np.searchsorted(at, ends - 1, side="right") - 1]
    ends = np.unique(np.concatenate([ends[(ends - begin >= WINDOW) & (ends < n)], at[1:]]))
    out, last = [], 0
    for end in ends.tolist():
        while end - last > most:
            last += most
            out.append(last)
        out.append(end)
        last = end
    return out


def name_of(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=NAME_BYTES).digest()


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and nodes are told apart, an odd node moves up as it is."""
    level = [name_of(b"\0" + x) for x in names] or [name_of(b"")]
    while len(level) > 1:
        level = [name_of(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        size, pack = own.kind.itemsize, zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in words.slices(whole, "text"):
                stream, at = own.encode(batch.column(1), end_id)
                raw, ends = stream.tobytes(), cuts(stream, at)
                rows, here, names, last, k = [], set(), [], 0, 0
                ids, begins = batch.column(0).to_pylist(), at.tolist()
                for e in ends:
                    body = raw[last * size : e * size]
                    name = name_of(body)
                    names.append(name)
                    if name not in here:
                        here.add(name)
                        rows.append((0, name, None, e - last, pack(body)))
                    last = e
                    if e == begins[k + 1]:
                        recipe = b"".join(names)
                        rows.append((1, name_of(repr(ids[k]).encode() + recipe), ids[k], e - begins[k], recipe))
                        names, k = [], k + 1
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "name", "id", "n", "body"])

    return run


_RECIPES = "part int, seq long, id long, n long, recipe binary, root binary"


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes of one file: their place in it and their roots."""
    seen = 0
    for batch in batches:
        recipes = batch.column(3).to_pylist()
        roots = [merkle([r[k : k + NAME_BYTES] for k in range(0, len(r), NAME_BYTES)]) for r in recipes]
        place = pa.array(np.arange(seen, seen + len(roots)))
        seen += len(roots)
        yield pa.record_batch([batch.column(0), place, *batch.columns[1:4], pa.array(roots, pa.binary())], names=["part", "seq", "id", "n", "recipe", "root"])


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """Chunks (kind 0) and recipes as encoded (kind 1) of a store; an empty store has no files to tell their columns."""
    return spark.read.schema("name binary, id long, n long, body binary, times long, kind int").parquet(f"{path}/objects")


def write_store(docs: DataFrame, path: str | None = None, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Encode every row of ``docs`` into a store at ``path`` (the shared folder if None) and return the path.

    A null text counts as empty: its ids are the end id alone. Rows with a null id come first. Repeated rows are kept, each
    with a recipe of its own. Very long texts are cut like any other. Extra columns play no part. An empty table gives a store
    without rows.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-store")
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    encoded = base.mapInArrow(_encode(tokenizer, end_id), _OUT)
    # recipes of equal rows have equal names: how many there were is counted, and they are spread out again below
    unique = encoded.groupBy("kind", "name").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("body").alias("body"), F.count("*").alias("times"))
    unique.write.partitionBy("kind").parquet(f"{path}/objects")
    objects = _objects(spark, path)
    rows = objects.filter("kind = 1").select("id", "n", F.col("body").alias("recipe"), F.explode(F.expr("sequence(1, cast(times as int))")).alias("copy"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "recipe", "copy").sortWithinPartitions(F.col("id").asc_nulls_first(), "recipe", "copy")
    placed = ordered.select(F.spark_partition_id().alias("part"), "id", "n", "recipe").mapInArrow(_roots, _RECIPES)
    placed.write.parquet(f"{path}/recipes")
    recipes = spark.read.schema(placed.schema).parquet(f"{path}/recipes")
    _manifest(recipes).write.parquet(f"{path}/manifest")
    _top(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")).write.parquet(f"{path}/top")
    return path


#: Children of a node of the manifest's trees.
FAN = 1024


def _manifest(recipes: DataFrame) -> DataFrame:
    """Per recipe file: the ids it spans, its documents and tokens, and the root of the tree over its documents' roots.

    A node is the SHA-256 of up to ``FAN`` children in order, so no task holds more than that many at a time; a file of
    ``FAN`` squared documents, a million, has two levels.
    """

    def node(place: str, child: str):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, child))), lambda x: x[child]), ""), 256)

    leaf = F.hex(F.concat("root", F.encode(F.concat_ws(":", F.lit("leaf"), F.coalesce(F.col("id").cast("string"), F.lit("null")), "n"), "UTF-8"))).alias("leaf")
    facts = [F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("documents"), F.sum("n").alias("tokens")]
    level = recipes.select("part", F.expr(f"seq div {FAN}L").alias("place"), "seq", "id", "n", leaf).groupBy("part", "place").agg(*facts, node("seq", "leaf").alias("leaf"))
    up = [F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")]
    level = level.groupBy("part", F.expr(f"place div {FAN}L").alias("above")).agg(*up, node("place", "leaf").alias("leaf"))
    return level.groupBy("part").agg(*up, node("above", "leaf").alias("root"))


_MANIFEST = "part int, first_id long, last_id long, documents long, tokens long, root string"
_TOP = "files long, documents long, tokens long, root string"


def _top(manifest: DataFrame) -> DataFrame:
    """One row, also where there are no files; the manifest has a row for each partition of a shuffle, never more."""
    line = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in manifest.columns])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", line.alias("line")))), lambda x: x["line"]), "\n")
    return manifest.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "tokens")], F.sha2(lines, 256).alias("root"))


def _whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Recipes and manifest of a store, after they were found to agree with each other and the top."""
    recipes, manifest, top = (spark.read.schema(kind).parquet(f"{path}/{x}") for x, kind in (("recipes", _RECIPES), ("manifest", _MANIFEST), ("top", _TOP)))
    if top.collect() != _top(manifest).collect():
        raise ValueError("the manifest is not what the store's top says")
    a, b = manifest.alias("a"), _manifest(recipes).alias("b")
    differ = ~reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in manifest.columns])
    if n := a.join(b, F.col("a.part") == F.col("b.part"), "full_outer").filter(differ).count():
        raise ValueError(f"{n} recipe files do not agree with the manifest")
    return recipes, manifest


_CRC_TABLES: list[np.ndarray] = []


def _crc_tables(bits: int) -> list[np.ndarray]:
    """By ``k``: four tables of 256 that apply to a CRC-32 register what 2^k zero bytes do to it, a linear map."""

    def applied(images: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for k in range(32):
            out ^= np.where(values >> np.uint32(k) & np.uint32(1), images[k], np.uint32(0))
        return out

    if not _CRC_TABLES:
        byte = np.arange(256, dtype=np.uint32)
        _CRC_TABLES.append(None)
        images = np.array([0xEDB88320, *[1 << k for k in range(31)]], np.uint32)  # one zero bit
        for _ in range(3):
            images = applied(images, images)
        _CRC_TABLES[0] = (images, np.stack([applied(images, byte << np.uint32(8 * j)) for j in range(4)]))
    while len(_CRC_TABLES) < bits:
        images = _CRC_TABLES[-1][0]
        images = applied(images, images)
        byte = np.arange(256, dtype=np.uint32)
        _CRC_TABLES.append((images, np.stack([applied(images, byte << np.uint32(8 * j)) for j in range(4)])))
    return [t for _, t in _CRC_TABLES[:bits]]


def crc32_shifted(sums: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """crc32 values moved on by so many bytes: crc32(a + b) is crc32(a) moved on by len(b), xor crc32(b)."""
    out = sums.astype(np.uint32)
    for k, table in enumerate(_crc_tables(int(zeros.max(initial=0)).bit_length())):
        own = np.flatnonzero(zeros >> k & 1)
        v = out[own]
        out[own] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
    return out


def _read_chunks(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sums = []
            for name, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = unpack(body)
                ids = np.frombuffer(body, kind)
                if name_of(body) != name or len(ids) != n:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                sums.append(zlib.crc32(ids.astype("<u4")))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["name", "n", "crc"])

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, root, chunks' places, names, counts and checksums) to (part, root, tokens, checksum), the root being folded again."""
    for batch in batches:
        if not batch.num_rows:
            continue
        roots, lists = batch.column(1).to_pylist(), batch.column(2)
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        parts = lists.flatten()
        if missing := parts.field("crc").null_count:
            raise ValueError(f"the store lacks {missing} chunks that recipes name")
        owner = np.repeat(np.arange(len(roots)), np.diff(bounds))
        seq, n, crc = (np.asarray(parts.field(k)) for k in ("seq", "n", "crc"))
        names = parts.field("name").to_pylist()
        order = np.lexsort((seq, owner))
        n, crc = n[order], crc[order]
        totals = np.add.reduceat(n, bounds[:-1])
        after = np.repeat(np.cumsum(totals), np.diff(bounds)) - np.cumsum(n)
        sums = np.bitwise_xor.reduceat(crc32_shifted(crc, 4 * after), bounds[:-1])
        place = order.tolist()
        for k, root in enumerate(roots):
            if merkle([names[x] for x in place[bounds[k] : bounds[k + 1]]]) != root:
                raise ValueError(f"recipe {root.hex()} does not fold to its root")
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.array(sums.astype(np.int64))], names=["part", "root", "tokens", "crc"])


def _split_recipe():
    return F.expr(f"transform(sequence(0, octet_length(recipe) div {NAME_BYTES} - 1), k -> struct(k as seq, substring(recipe, k * {NAME_BYTES} + 1, {NAME_BYTES}) as name))")


def read_store(spark: SparkSession, path: str, *, kind: str = "<u2") -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of every document, all verified.

    Raises where a chunk, a recipe, a row of the manifest or the top is missing or does not hold what it says. ``kind``: the ids'
    form, two or four bytes.
    """
    recipes, manifest = _whole(spark, path)
    chunks = _objects(spark, path).filter("kind = 0").select("name", "n", "body").mapInArrow(_read_chunks(kind), "name binary, n long, crc long")
    distinct = recipes.select("part", "root", "recipe").dropDuplicates(["part", "root"])
    refs = distinct.select("part", "root", F.explode(_split_recipe()).alias("ref")).select("part", "root", "ref.seq", "ref.name")
    # a name has at most one row for each file here, however many recipes hold it
    facts = refs.select("part", "name").distinct().join(chunks, "name", "left")
    joined = refs.join(facts, ["part", "name"], "left").groupBy("part", "root").agg(F.collect_list(F.struct("seq", "name", "n", "crc")).alias("parts"))
    folded = joined.mapInArrow(_fold, "part int, root binary, tokens long, crc long")
    offsets = manifest.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.select("part", "seq", "id", "n", "root").withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, "part", "left")
    there = F.col("crc").isNotNull() & F.col("before").isNotNull() & (F.col("n") == F.col("tokens"))
    crc = F.when(there, F.col("crc")).otherwise(F.raise_error(F.lit("a document has lost its chunks or its place")).cast("long"))
    return starts.join(folded, ["part", "root"], "left").select(F.col("id").alias("doc_id"), (F.col("before") + F.col("own")).alias("start"), F.col("tokens").alias("n_tokens"), crc.alias("ids_crc32"))


def restore(spark: SparkSession, path: str, *, kind: str = "<u2") -> DataFrame:
    """``doc_id`` and ``ids`` of every document, put together again from its chunks; raises where one is missing or changed."""
    recipes, _ = _whole(spark, path)
    refs = recipes.select("part", "seq", "id", F.explode(_split_recipe()).alias("ref")).select("part", F.col("seq").alias("row"), "id", "ref.seq", "ref.name")
    chunks = _objects(spark, path).filter("kind = 0").select("name", "body")
    facts = refs.select("part", "name").distinct().join(chunks, "name", "left")
    joined = refs.join(facts, ["part", "name"], "left").groupBy("part", "row", "id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "body"))).alias("parts"))

    def unpacked(x: dict) -> bytes:
        body = zstandard.decompress(x["body"]) if x["body"] is not None else b""
        if name_of(body) != x["name"]:
            raise ValueError(f"chunk {x['name'].hex()} is missing or does not hold what its name says")
        return body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(map(unpacked, own)), kind).astype(np.int32) for own in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return joined.select("id", "parts").mapInArrow(run, "doc_id long, ids array<int>")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to a store and read back from its files."""
    return read_store(spark, write_store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
