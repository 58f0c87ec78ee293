"""Token ids in binary shards, with a minimal perfect hash index for access by key.

A shard file holds the ids of a run of rows in ascending key order and ends in
its index. Layout, all little-endian:

    ids      count x (2 bytes if the vocabulary allows, else 4)
    starts   (rows + 1) x 8   first id of each row
    keys     rows x 8         keys in order (see key_hash), for reading in order
    slots    rows x 4         row of each slot of the perfect hash
    prints   rows x 4         fingerprint of the key in each slot
    levels   the perfect hash: for each level its bit count (8) and bits
    footer   "PTI1", width, levels, rows, ids (4, 4, 4, 8, 8)

The hash is built in levels: a key's hash names a bit, bits named once stay,
keys whose bits clash go to the next level. A key's slot is the number of set
bits before its own. A stored fingerprint tells foreign keys apart. The
manifest, a table of a row for each shard, has the shards' key ranges in pages
of ``PAGE`` shards: a key leads to a page by bisection of the pages' ranges, to
its shard within the page, and to the row by two or three hashes.

Writing is safe against lost tasks: an attempt writes files of its own name
and the manifest has those of the attempt that counted.

Defined results
- null or empty text: only the end id; null keys come first, in order of their texts
- rows with one key are kept, side by side; access by key finds all of them
- keys are integers; a key of another type is an error (number such rows first)
- an empty table gives no shards and an empty manifest
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.llm.bpe import texts
from prismill.llm.store import Scratch
from prismill.llm.wordhash import mix

FOOTER = struct.Struct("<4sIIQQ")
MAGIC = b"PTI1"
#: Null keys are stored as the least integer.
NULL_KEY = -(2**63)
#: Where a shard's rows stand in the order of keys: its part, and its number in that part.
MANIFEST = "part int, shard int, path string, first_key bigint, last_key bigint, rows bigint, tokens bigint"
#: Shards of a page of the manifest.
PAGE = 256
#: A part has so many bytes of text at most, about, whatever the session's number of partitions.
PART_BYTES = 256 << 20
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(64)]


class Perfect:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, n = [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.before.append(counts + n - bits)
            n += int(counts[-1]) if len(counts) else 0
        self.size = n

    @classmethod
    def build(cls, keys: np.ndarray) -> Perfect:
        levels: list[np.ndarray] = []
        left = keys.astype(np.int64).view(np.uint64)
        while len(left):
            m = 2 * len(left) + 1
            at = (mix(left ^ _SEEDS[len(levels) % 64]) % np.uint64(m)).astype(np.int64)
            hits = np.bincount(at, minlength=m)
            levels.append(hits == 1)
            left = left[hits[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key is surely not in the set."""
        k = keys.astype(np.int64).view(np.uint64)
        out, todo = np.full(len(k), -1, np.int64), np.arange(len(k))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = (mix(k[todo] ^ _SEEDS[level % 64]) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = before[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(12345)) >> np.uint64(32)).astype(np.uint32)


def pack(ids: list[np.ndarray], keys: np.ndarray, width: int) -> bytes:
    """A shard's bytes from each row's ids and the keys in ascending order."""
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(i) for i in ids], out=starts[1:])
    own, first = np.unique(keys, return_index=True)
    h = Perfect.build(own)
    slots, prints = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    at = h.slots(own)
    slots[at], prints[at] = first, fingerprint(own)
    body = [np.concatenate([*ids, np.zeros(0, "<u4")]).astype(f"<u{width}").tobytes(), starts.tobytes(), keys.astype("<i8").tobytes(), struct.pack("<Q", len(own)), slots.tobytes(), prints.tobytes()]
    for bits in h.levels:
        body += [struct.pack("<Q", len(bits)), np.packbits(bits, bitorder="little").tobytes()]
    return b"".join([*body, FOOTER.pack(MAGIC, width, len(h.levels), len(ids), int(starts[-1]))])


class Shard:
    """A shard file opened for reading: rows in order, or by key."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, levels, self.rows, self.tokens = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = self.tokens * self.width
        self.ids = np.frombuffer(data, f"<u{self.width}", self.tokens)
        self.starts = np.frombuffer(data, "<u8", self.rows + 1, at).astype(np.int64)
        at += 8 * (self.rows + 1)
        self.keys = np.frombuffer(data, "<i8", self.rows, at)
        at += 8 * self.rows
        (n,) = struct.unpack_from("<Q", data, at)
        self.slots = np.frombuffer(data, "<u4", n, at + 8)
        self.prints = np.frombuffer(data, "<u4", n, at + 8 + 4 * n)
        at += 8 + 8 * n
        bits = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", data, at)
            size = (m + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8), count=m, bitorder="little").astype(bool))
            at += 8 + size
        self.hash = Perfect(bits)

    def row(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 where there is none."""
        keys = np.asarray(keys, np.int64)
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.slots[slot[ok]]
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1) if len(self.keys) else out


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def read_shard(path: str) -> Shard:
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        return Shard(f.readall())


def _writer(batches: Iterator[pa.RecordBatch], folder: str, encode, end: int, width: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Shards from a partition's rows (key, text), which come in order; a shard is closed at ``limit`` ids."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids, keys, count, out = [], [], 0, []
    fs, at = _open(folder)
    tail = np.array([end], "<u4")

    def close():
        nonlocal ids, keys, count
        k = np.concatenate(keys)
        name = f"{part:06d}-{len(out):04d}-{uuid.uuid4().hex}.ids"
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(pack(ids, k, width))
        out.append((part, len(out), f"{folder}/{name}", int(k[0]), int(k[-1]), len(k), count))
        ids, keys, count = [], [], 0

    for batch in batches:
        column, done = batch.column(0).fill_null(NULL_KEY).to_numpy(), 0
        for some in texts(batch.column(1)):
            got = [np.append(x, tail).astype(f"<u{width}") for x in encode(some)]
            ids += got
            keys.append(column[done : done + len(some)])
            done += len(some)
            count += sum(map(len, got))
            if count >= limit:
                close()
    if keys:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "path", "first_key", "last_key", "rows", "tokens"])


def write(docs: DataFrame, encode, end: int, scratch: Scratch, vocabulary: int, key: str = "doc_id", text: str = "text", parts: int | None = None, shard_tokens: int = 1 << 24) -> DataFrame:
    """Write all rows in ascending key order as shards; the manifest, with the ids before each shard and the shard's page.

    encode gives the ids of each of a list of texts and is sent to the executors. Rows of one
    key may be dealt to several parts, by a hash of their text, so that no key is too large for a task.
    """
    spark = docs.sparkSession
    folder = scratch.folder("shards")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} isn't an integer")
    if not parts:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    width = 2 if vocabulary <= 1 << 16 else 4
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ties = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    d = d.withColumn("tie", ties).repartitionByRange(parts, F.col("key").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("key").asc_nulls_first(), "tie").select("key", "text")
    manifest = scratch.table(d.mapInArrow(lambda b: _writer(b, folder, encode, end, width, shard_tokens), MANIFEST), "manifest")
    return scratch.table(_placed(manifest, scratch), "placed")


def _placed(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """The manifest with the ids before each shard, and its page.

    Sums run over a part's shards, over a block of 1,000 parts and over the blocks, so that
    none but the last has more than its own in one task, and that has a millionth of all parts' shards.
    """
    block = F.floor(F.col("part") / 1000)
    parts = scratch.table(manifest.groupBy("part").agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).withColumn("block", block), "parts")
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    before = lambda by, at: (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = blocks.select("block", total("n", before(None, "block")).alias("block_n"), total("k", before(None, "block")).alias("block_k"))
    parts = parts.select("part", "block", total("n", before("block", "part")).alias("part_n"), total("k", before("block", "part")).alias("part_k"))
    out = manifest.join(parts.join(blocks, "block"), "part")
    first = total("tokens", before("part", "shard")) + F.col("part_n") + F.col("block_n")
    page = F.floor((F.col("shard") + F.col("part_k") + F.col("block_k")) / PAGE)
    return out.select(*manifest.columns, first.cast("long").alias("before"), page.cast("long").alias("page"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            s = read_shard(path)
            found = s.find(np.unique(s.keys))
            first = np.unique(s.keys, return_index=True)[1]
            if not np.array_equal(found, first):
                raise ValueError(f"the index of {path} doesn't lead to its rows")
            crc = [zlib.crc32(s.row(i).astype("<u4")) for i in range(s.rows)]
            keys = pa.array(s.keys, mask=s.keys == NULL_KEY)
            yield pa.RecordBatch.from_arrays([keys, pa.array(s.starts[:-1] + before), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])


def described(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read all shards back: key, start (ids before the row), n_tokens and ids_crc32 of each row."""
    n = max(1, manifest.count())
    return manifest.repartition(min(n, 10_000)).mapInArrow(_rows, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the given keys: (key, ids) for each row found, by page, shard range and perfect hash."""
    k = keys.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    # One row for each PAGE shards, with three numbers.
    bounds = manifest.groupBy("page").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("page").collect()
    low, high = (np.array([r[c] for r in bounds], np.int64) for c in ("low", "high"))

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            first, n = np.searchsorted(high, own, "left"), np.searchsorted(low, own, "right")
            n = np.maximum(n - first, 0)
            page = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(page.astype(np.int64))], names=["key", "page"])

    pages = manifest.groupBy("page").agg(F.collect_list(F.struct("first_key", "last_key", "path")).alias("shards"))
    has = lambda s: (F.col("key") >= s["first_key"]) & (F.col("key") <= s["last_key"])
    near = k.mapInArrow(paged, "key bigint, page bigint").join(pages, "page").select("key", F.explode(F.filter("shards", has)).alias("s"))
    near = near.select("s.path", "key").repartition("path").sortWithinPartitions("path", "key")

    def run(batches):
        path = shard = None
        for batch in batches:
            for p, q in zip(batch.column("path").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if p != path:
                    path, shard = p, read_shard(p)
                i = int(shard.find(np.array([q]))[0])
                while 0 <= i < shard.rows and shard.keys[i] == q:
                    yield pa.RecordBatch.from_arrays([pa.array([None if q == NULL_KEY else q], pa.int64()), pa.array([shard.row(i).tolist()], pa.list_(pa.int64()))], names=["key", "ids"])
                    i += 1

    return near.mapInArrow(run, "key bigint, ids array<bigint>").withColumnRenamed("key", key)
