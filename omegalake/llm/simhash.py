"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Fingerprints link at three or fewer differing bits, so two linked fingerprints x and y have a
value between them that is at most one bit from the one and at most two from the other. Every
fingerprint emits its variants, the shuffle brings equal variants together, and wherever a
variant is at most one bit from some fingerprint (its hub), all fingerprints that emitted it
are at most three bits from the hub: they are linked to the hub, never to each other. A variant
is emitted by at most 2,081 fingerprints, so no group grows with the corpus.

Two facts halve the two-bit variants twice over without losing a link. Fingerprints that
differ in three bits differ in parity, so only those of even parity emit two-bit variants. And
of any three bits two lie in the same half of the fingerprint, so only two-bit variants within a
half are needed.

Variants are not shuffled themselves. A variant's place is made of the parities of groups of its
bits, so the hundreds of variants of a fingerprint lie in a few dozen places: the fingerprint goes
to each of these once, and its variants are made there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_count, staged

BITS = 64
SHINGLE = 3
SEED = 42
#: Largest number of differing bits of a link; the variants below are made for three.
DISTANCE = 3

_ONE = [1 << i for i in range(BITS)]
_HALVES = (range(BITS // 2), range(BITS // 2, BITS))
_NEAR = [0, *_ONE]
_FAR = [0, *_ONE, *((1 << i) | (1 << j) for half in _HALVES for i, j in combinations(half, 2))]
#: There are at least 2 ** _SPARE places for each partition, so that partitions get alike shares of the variants.
_SPARE = 9
#: Bytes of a text taken apart at once; they end before white space.
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text: ASCII letters lower-cased, words between ASCII white space,
    three-word shingles with repeats (fewer words: all of them), XXH64. No words: 0."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, ones, n, words = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []

    def count(shingles: Iterable[bytes]) -> None:
        nonlocal n, ones
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            some = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + BLOCK_BYTES)
        stop = space.start() if space else len(data)
        words = words[1 - SHINGLE :] + data[at:stop].split()  # the last words go on in the next block
        count(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
        at = stop
    if not n and words:
        count([b" ".join(words)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, fp): fp holds the fingerprint's 64 bits as a signed long; equal texts have equal content."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                fps = np.array([fingerprint(t.as_py()) for t in some.column(2)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(fps)], ["doc_id", "content", "fp"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("t"))
    return source.mapInArrow(hashed, "doc_id long, content long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _bit_groups(partitions: int) -> list[int]:
    """Groups of neighbouring bits, as many in each half, enough for the places that so many partitions need."""
    n = 2 * -(-(partitions.bit_length() + _SPARE) // 2)
    return [sum(b for i, b in enumerate(_ONE) if i * n // BITS == g) for g in range(n)]


def _variants(nodes: DataFrame, partitions: int) -> DataFrame:
    """(v, fp): the variants of each of ``nodes.fp``; equal ones come to the same one of so many partitions.

    The place of fp ^ mask is that of fp, moved by the mask's own parities. Masks of the same move go together.
    """
    groups, moves, masks, own = _bit_groups(partitions), [], [], []
    for some in (_FAR, _NEAR):
        by_move = defaultdict(list)
        for mask in some:
            by_move[sum((mask & g).bit_count() % 2 << k for k, g in enumerate(groups))].append(_signed(mask))
        own.append([*range(len(moves), len(moves) + len(by_move))])
        moves += by_move.keys()
        masks += by_move.values()
    fp, even = F.col("fp"), F.bit_count("fp") % 2 == 0
    place = reduce(Column.bitwiseOR, (F.shiftleft((F.bit_count(fp.bitwiseAND(F.lit(_signed(g)))) % 2).cast("long"), k) for k, g in enumerate(groups)))
    sent = nodes.select("fp", F.explode(F.when(even, F.lit(own[0])).otherwise(F.lit(own[1]))).alias("k"))
    there = sent.repartition(partitions, place.bitwiseXOR(F.get(F.lit(moves), "k").cast("long")))
    return there.select("fp", F.explode(F.get(F.lit(masks), "k")).alias("mask")).select(fp.bitwiseXOR(F.col("mask")).alias("v"), "fp")


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each variant's fingerprints with its hub; rows come sorted by variant."""

    def links(v: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        close = np.bitwise_count(v ^ fp) <= 1
        hub = np.minimum.reduceat(np.where(close, fp, np.uint64(0xFFFFFFFFFFFFFFFF)), first)
        some = np.logical_or.reduceat(close, first)
        sizes = np.diff(np.append(first, len(v)))
        hub, some = np.repeat(hub, sizes), np.repeat(some, sizes)
        # A bitwise check besides, so that no link rests on the argument above alone.
        linked = some & (fp != hub) & (np.bitwise_count(fp ^ hub) <= DISTANCE)
        return pa.RecordBatch.from_arrays([pa.array(hub[linked].view(np.int64)), pa.array(fp[linked].view(np.int64))], ["a", "b"])

    held_v, held_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        v = np.concatenate([held_v, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(v):
            continue
        whole = int(np.argmax(v == v[-1]))  # the last variant may go on in the next batch
        held_v, held_fp = v[whole:], fp[whole:]
        if whole:
            yield links(v[:whole], fp[:whole])
    if len(held_v):
        yield links(held_v, held_fp)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``nodes.fp`` that connect all at most three bits apart."""
    # A fingerprint is sent to dozens of places, so these rows are spread first.
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.select("fp").repartition(partitions, "fp")
    # Shares are not quite alike, so there are more partitions: no task sorts more variants than if each variant were dealt out alone.
    met = _variants(spread, 2 * partitions).sortWithinPartitions("v").mapInArrow(_stars, "a long, b long")
    return met.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the smallest node it is connected with.

    Alternates large-star and small-star (Kiveris et al., 2014) until the edges no longer
    change: then there are as many as before, and none that was not there. Each round is written to the shared folder; nothing but
    a count comes to the driver. The neighbours of a node that very many have are not brought together. No edges: no rows.
    """

    def star(e: DataFrame, rows: int, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = both.distinct()
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        joined = joined_by_count(both, least, "a", rows)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    edges = staged(edges.distinct(), "links")
    rows, changed = edges.count(), True
    while rows and changed:
        before, n = edges, rows
        edges = staged(star(star(edges, 2 * n, large=True), 2 * n, large=False), "stars")
        rows = edges.count()
        changed = rows != n or not edges.join(before, ["a", "b"], "left_anti").isEmpty()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows, (fp, n, root) of each distinct one, and (root, n, first) of each component.

    first: its row of the smallest doc_id, and of the smallest content among those; rows without doc_id come last.
    """
    own = staged(fingerprints(docs, key, text), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "content")
    nodes = staged(own.groupBy("fp").agg(F.count("*").alias("n"), F.min(row).alias("first")), "nodes")
    roots = components(links(nodes))
    named = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "named")
    least = staged(named.groupBy("root").agg(F.count("*").alias("n"), F.min("first").alias("first")), "components")
    return own, named.select("fp", "n", "root"), least


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other. Rows with the same doc_id
    each get a row. A null doc_id takes part with its text but never names a component, unless
    no member has an id (then null). Empty table: no rows.
    """
    own, named, least = _grouped(docs, key, text)
    component = least.select("root", "n", F.col("first.doc_id").alias("component_id"))
    classes = staged(joined_by_count(named.withColumnRenamed("n", "times"), component, "root", named.count()).select("fp", F.col("times").alias("n"), "component_id"), "classes")
    return joined_by_count(own, classes, "fp", own.count()).select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with its columns as they are: that with the smallest id.

    Where several texts of a group bear the smallest id, that with the smallest hash stays; of rows that
    repeat id and text one stays, whose other columns have the smallest hash. Documents without id stay only where
    no member of their group has one, and then one of them. An id that bears texts of several groups may stay several times.
    """
    own, _, least = _grouped(docs, key, text)
    times = own.groupBy("doc_id", "content").agg(F.count("*").alias("rows"))
    first = least.select(F.col("first.doc_id").alias("id"), F.col("first.content").alias("hash"))
    chosen = staged(first.join(times, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("content"))).select("id", "hash", F.col("rows") > 1), "chosen").toDF("id", "hash", "repeated")

    def rows_of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[key].cast("long").eqNullSafe(some["id"]) & (F.xxhash64(docs[text]) == some["hash"]), "left_semi")

    single, repeated = rows_of(chosen.where("not repeated")), chosen.where("repeated")
    if repeated.isEmpty():
        return single
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    alike = rows_of(repeated).select(F.col(key).alias("k"), F.xxhash64(text).alias("c"), whole.alias("row"), F.xxhash64(F.to_json(whole)).alias("order"))
    return single.union(alike.groupBy("k", "c").agg(F.min_by("row", "order").alias("row")).select("row.*"))


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
