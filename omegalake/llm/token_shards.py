"""Token shards: raw id payloads with a minimal perfect hash index from document key to offset.

A shard set is a Parquet table in a shared folder, written by Spark's committer, so that lost
executors and repeated tasks leave no half-written shard. Each of its rows is one block:

=========  ======  ==============================================================
column     type    meaning
=========  ======  ==============================================================
shard      int     ascending with the keys
block      int     ascending within the shard
first_key  long    smallest key of the block (row groups are skipped by it)
last_key   long    largest key of the block
n_ids      long    ids of the block
payload    binary  ids of all its documents, one after the other, little-endian
index      binary  header, hash levels, fingerprints, row numbers, keys, offsets
=========  ======  ==============================================================

Index: eight unsigned 64-bit numbers (magic, bytes of an id, documents, documents without key,
keys, levels, hash words, 0), then level sizes, hash words, a fingerprint and a row number
for each key (32 bits each, at the key's hash), document keys (64 bits) and offsets (64 bits,
one more than documents). A lookup hashes the key, compares the fingerprint and reads two offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows
from .encoders import TEXTS_A_STEP, encoder
from .mphf import MinimalPerfectHash, fingerprints

MAGIC = 0x31303053444E4B54
#: Ids of a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 20

SHARDS = "shard int, block int, first_key long, last_key long, n_ids long, payload binary, index binary"


def pack_block(keys: list[int | None], id_lists: list[bytes], id_bytes: int) -> tuple[bytes, bytes]:
    """(payload, index) of documents with ascending keys; documents without key come first."""
    width = f"<u{id_bytes}"
    payload = b"".join(np.frombuffer(x, "<u4").astype(width).tobytes() for x in id_lists)
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in id_lists])]).astype("<i8")
    without = sum(k is None for k in keys)
    own = np.array([0] * without + keys[without:], "<i8")
    distinct, rows = np.unique(own[without:], return_index=True)  # of repeated keys the first
    hashed = MinimalPerfectHash.build(distinct)
    at = hashed(distinct)
    marks, numbers = np.empty(len(distinct), "<u4"), np.empty(len(distinct), "<u4")
    marks[at], numbers[at] = fingerprints(distinct), rows + without
    head = np.array([MAGIC, id_bytes, len(keys), without, len(distinct), len(hashed.sizes), len(hashed.words), 0], "<u8")
    parts = (head, hashed.sizes.astype("<i8"), hashed.words.astype("<u8"), marks, numbers, own, offsets)
    return payload, b"".join(x.tobytes() for x in parts)


class Block:
    """A block as read back."""

    def __init__(self, payload: bytes, index: bytes):
        magic, width, docs, self.without, keys, levels, words, _ = np.frombuffer(index, "<u8", 8).tolist()
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 64

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(index, kind, n, at)
            at += found.nbytes
            return found

        sizes, bits = take("<i8", levels), take("<u8", words)
        self._hash = MinimalPerfectHash(bits, sizes)
        self._marks, self._rows = take("<u4", keys), take("<u4", keys)
        self.keys, self.offsets = take("<i8", docs), take("<i8", docs + 1)
        self._ids = np.frombuffer(payload, f"<u{width}")

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, row: int) -> int | None:
        return None if row < self.without else int(self.keys[row])

    def ids(self, row: int) -> np.ndarray:
        return self._ids[self.offsets[row] : self.offsets[row + 1]]

    def _by_fingerprint(self, keys: np.ndarray) -> np.ndarray:
        """The row that the hash gives each key, or -1 where the fingerprint differs."""
        if not len(self._marks):
            return np.full(len(keys), -1, np.int64)
        slot = self._hash(keys)
        hit = (slot >= 0) & (self._marks[slot] == fingerprints(keys.astype(np.int64).view(np.uint64)))
        return np.where(hit, self._rows[slot].astype(np.int64), -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key (the first, if the key is repeated), or -1: the fingerprint keeps most absent keys out, the key itself decides."""
        rows = self._by_fingerprint(keys)
        return np.where((rows >= 0) & (self.keys[rows] == keys), rows, -1) if len(self.keys) else rows

    def looked_up(self) -> np.ndarray:
        """The row of every document: by the hash of its key, if it is the first with this key, else its own."""
        at = np.arange(len(self))
        own = self.keys[self.without :]
        first = self.without + np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
        at[first] = self._by_fingerprint(self.keys[first])
        if (at < 0).any():
            raise ValueError("the index misses a key of its block")
        return at


def write_shards(docs: DataFrame, path: str, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, keeps_spaces: bool = False) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the shards in ascending key order.

    Texts are spread by ranges of the key (and of the row, so that a key borne by many rows is
    spread too), encoded in that order and put into blocks of about ``BLOCK_IDS`` ids. Null text
    is empty; documents without a key come first and can't be looked up; of documents with the
    same key the first is looked up. No documents: no rows.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, keys, lists, held = TaskContext.get().partitionId(), 0, [], [], 0
        encode = encoder(vocabulary, keeps_spaces).encode
        end, id_bytes = np.array([end_id], "<u4").tobytes(), 0

        def flushed() -> pa.RecordBatch:
            nonlocal block, keys, lists, held
            payload, index = pack_block(keys, lists, id_bytes)
            known = [k for k in keys if k is not None]
            row = ([shard], [block], [known[0] if known else None], [known[-1] if known else None], [held], [payload], [index])
            block, keys, lists, held = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "block", "first_key", "last_key", "n_ids", "payload", "index"])

        id_bytes = 2 if encoder(vocabulary, keeps_spaces).size <= 1 << 16 else 4
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_A_STEP):
                some = batch.slice(at, TEXTS_A_STEP)
                for k, ids in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    keys.append(k)
                    lists.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield flushed()
        if keys:
            yield flushed()
        encoder(vocabulary, keeps_spaces).shrink()

    source = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    ordered = source.repartitionByRange("k", "row").sortWithinPartitions("k", "row").select("k", "t")
    with arrow_rows(docs.sparkSession, TEXTS_A_STEP):
        ordered.mapInArrow(blocks, SHARDS).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def shard_rows(shards: DataFrame) -> DataFrame:
    """A row for each document, read from the files: key, start (ids of all before it), n_tokens, ids_crc32.

    Every key is looked up by its hash, and what is read is the document that the index gives for it; documents
    without key and those that repeat the key of the one before are read by row.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = Block(batch.column(2)[r].as_py(), batch.column(3)[r].as_py())
                n, at = len(b), b.looked_up()
                starts, sizes = b.offsets[at], b.offsets[at + 1] - b.offsets[at]
                crc = [zlib.crc32(b.ids(k).astype("<u4").tobytes()) for k in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[r].as_py()] * n, pa.int32()), pa.array([batch.column(1)[r].as_py()] * n, pa.int32()), pa.array([b.key(k) for k in range(n)], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["shard", "block", "key", "own_start", "n_tokens", "ids_crc32"],
                )

    each = shards.select("shard", "block", "payload", "index").mapInArrow(rows, "shard int, block int, key long, own_start long, n_tokens long, ids_crc32 long")
    # Running totals: of the blocks within their shard, and of the shards (as many rows as writing tasks).
    sizes = shards.select("shard", "block", "n_ids")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("all")).select("shard", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    per_block = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inside"))
    base = per_block.join(per_shard, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))
    return each.join(base, ["shard", "block"]).select("key", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def look_up(shards: DataFrame, keys: list[int]) -> DataFrame:
    """(key, ids) of those of the wanted keys that are there; keys: as many as a driver's list may hold.

    Of documents with the same key that with the smallest (shard, block, row) is given.
    Blocks outside the keys' range are skipped by the files' statistics; within a block each
    key costs one hash, one fingerprint and two offsets.
    """
    wanted = np.unique(np.array(keys, np.int64))
    if not len(wanted):
        return shards.sparkSession.createDataFrame([], "key long, ids array<long>")

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, block, low, high, payload, index = (c[r].as_py() for c in batch.columns)
                asked = wanted[np.searchsorted(wanted, low) : np.searchsorted(wanted, high, "right")]
                if len(asked):
                    b = Block(payload, index)
                    hits = [(int(k), b.ids(a).tolist()) for k, a in zip(asked, b.find(asked)) if a >= 0]
                    place = [pa.array([x] * len(hits), pa.int32()) for x in (shard, block)]
                    yield pa.RecordBatch.from_arrays([*place, pa.array([k for k, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.list_(pa.int64()))], ["shard", "block", "key", "ids"])

    near = shards.where((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0])))
    hits = near.select("shard", "block", "first_key", "last_key", "payload", "index").mapInArrow(found, "shard int, block int, key long, ids array<long>")
    return hits.groupBy("key").agg(F.min_by("ids", F.struct("shard", "block")).alias("ids"))
