"""Packing token pieces into fixed-length sequences by exact-complement hashing, then best fit.

Only the histogram of piece lengths (one entry for each length up to the sequence length)
decides how sequences are made up, so the plan is computed once on the driver at a size that
the corpus doesn't change. The pieces themselves stay distributed: each gets a rank among those
of its length and looks up its place in the plan.
"""

from __future__ import annotations

import operator
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, staged, unused
from .encoders import TEXTS_A_STEP, encoder

#: Pieces of one length that are ranked together; a frequent length is dealt into as many parts as that takes.
RANKED_TOGETHER = 1000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SumIndex:
    """For each sum up to ``size``, the single lengths, pairs and triples on hand that make it exactly.

    Pairs are held by their larger part and triples by one part and the sum of the other two.
    ``count`` only falls, so an entry whose lengths are used up is dropped when it is met.
    """

    def __init__(self, count: np.ndarray, size: int):
        self.count = count
        lengths = [x for x in range(size, 0, -1) if count[x]]
        self.pairs: dict[int, list[int]] = {}
        for a in lengths:
            for b in lengths[bisect_left(lengths, -min(a, size - a), key=operator.neg) :]:
                self.pairs.setdefault(a + b, []).append(a)
        self.triples: dict[int, list[int]] = {}
        for a in lengths:
            for total in self.pairs:
                if a + total <= size:
                    self.triples.setdefault(a + total, []).append(a)

    def _has(self, *parts: int) -> bool:
        return all(self.count[x] >= parts.count(x) for x in parts)

    def _first(self, entries: list[int], lives, fits) -> int:
        """The first entry that fits, or 0; entries that no longer live are dropped on the way."""
        k = 0
        while k < len(entries):
            if not lives(entries[k]):
                del entries[k]
            elif fits(entries[k]):
                return entries[k]
            else:
                k += 1
        return 0

    def making(self, total: int, besides: tuple[int, ...], most: int = 3) -> tuple[int, ...]:
        """One, two or three lengths (``most`` at most) that make ``total`` and are on hand besides the given ones; () if none."""
        if self._has(total, *besides):
            return (total,)
        if most < 2:
            return ()
        if a := self._first(self.pairs.get(total, []), lambda a: self._has(a, total - a), lambda a: self._has(a, total - a, *besides)):
            return a, total - a

        def rest(a: int) -> int:
            return self._first(self.pairs.get(total - a, []), lambda b: self._has(b, total - a - b), lambda b: self._has(a, b, total - a - b, *besides))

        if most < 3:
            return ()
        if a := self._first(self.triples.get(total, []), lambda a: self._has(a) and bool(self.pairs.get(total - a)), lambda a: self._has(a, *besides) and rest(a) > 0):
            return a, (b := rest(a)), total - a - b
        return ()


def exact_fills(count: np.ndarray, size: int, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Sequences filled without a gap: (lengths, how many), taken off ``count``.

    From the longest length down, the gap is looked up in the index of sums: a single length, a
    pair, a triple (``most``: how many lengths at most); a hit is used as often as the counts allow.
    """
    made, index = [], SumIndex(count, size)
    for length in range(size, 0, -1):
        while count[length] > 0:
            rest = index.making(size - length, (length,), most) if length < size else ()
            if length + sum(rest) != size:
                break
            items = (length, *rest)
            times = min(int(count[x]) // n for x, n in Counter(items).items())
            made.append((items, times))
            for x in items:
                count[x] -= times
    return made


def best_fit(count: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of what is left, many alike pieces at a time."""
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(items: tuple[int, ...], times: int) -> None:
        by_gap.setdefault(size - sum(items), []).append((items, times))

    for length in range(size, 0, -1):
        left = int(count[length])
        while left:
            gap = min((g for g in by_gap if g >= length), default=None)
            if gap is None:
                each = min(left, size // length)
                put((length,) * each, left // each)
                left %= each
                continue
            items, times = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
            used = min(times, left)
            if times > used:
                put(items, times - used)
            put((*items, length), used)
            left -= used
        count[length] = 0
    return [x for made in by_gap.values() for x in made]


class Plan:
    """Where the pieces of each length go: segments of ranks with their first sequence and offset."""

    def __init__(self, counts: dict[int, int], size: int):
        """Gaps are filled by triples, by pairs at most, by singles only or by best fit alone: whichever makes the fewest sequences."""
        count = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            count[length] = n
        least, made = -(-int(count @ np.arange(size + 1)) // size), None
        for most in (3, 2, 1, 0):
            left = count.copy()
            own = (exact_fills(left, size, most) if most else []) + best_fit(left, size)
            if made is None or sum(n for _, n in own) < sum(n for _, n in made):
                made = own
            if sum(n for _, n in made) == least:
                break
        self.sequences, used, rows = 0, Counter(), []
        for items, times in made:
            offset = 0
            for x in items:
                rows.append((x, used[x], self.sequences, offset))
                used[x] += times
                offset += x
            self.sequences += times
        rows.sort()
        self._length, self._rank, self._sequence, self._offset = np.array(rows or np.zeros((0, 4)), np.int64).T
        self._first = np.searchsorted(self._length, np.arange(size + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these ranks among their length, from 0."""
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            own = length == x
            low, high = self._first[x], self._first[x + 1]
            at[own] = low + np.searchsorted(self._rank[low:high], rank[own], "right") - 1
        return self._sequence[at] + rank - self._rank[at], self._offset[at]


def cut_pieces(docs: DataFrame, vocabulary: str, *, size: int = 1024, key: str = "doc_id", text: str = "text", end_id: int = 2, keeps_spaces: bool = True, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and cuts what is longer than ``size``.

    The pieces of a long document all have ``size`` ids but the first, which has the rest. Null
    text is empty (one piece of one id). with_ids: adds the ids as bytes, unsigned 32-bit.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, end = encoder(vocabulary, keeps_spaces), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_A_STEP):
                some, rows = batch.slice(at, TEXTS_A_STEP), []
                for k, data in zip(some.column(0).to_pylist(), own_encoder.encode(some.column(1))):
                    data += end
                    n = len(data) // 4
                    ends = range((n - 1) % size + 1, n + 1, size)
                    for p, stop in enumerate(ends):
                        start = max(0, stop - size) if p else 0
                        own = data[4 * start : 4 * stop]
                        rows.append((k, p, start, stop - start, zlib.crc32(own), *[own] * with_ids))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        own_encoder.shrink()

    source = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return source.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def pack(pieces: DataFrame, *, size: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``size`` tokens in ``length``.

    Every piece is placed; a sequence's pieces lie one after the other from offset 0. Repeated
    rows are separate pieces: rows are numbered in the table that is kept in the shared folder, and dealt by number, so
    equal ones are spread over as many tasks as others. No pieces: no rows.
    """
    # The pieces' own columns travel in one, so that no name of theirs meets one of these.
    own = F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("own")
    numbered = staged(pieces.select(own, F.col("length").alias("length"), F.monotonically_increasing_id().alias("row")), "pieces")
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, size)
    parts_of = F.array(*(F.lit(-(-histogram.get(n, 1) // RANKED_TOGETHER)) for n in range(1, size + 1)))
    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("row"), F.element_at(parts_of, F.col("length").cast("int"))))
    parts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("row")
    # The pieces lie by (length, part) already, so the join moves only the few bases.
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "part"])
    ranked = ranked.select("own.*", (F.col("base") + F.col("rank")).alias(unused("rank", pieces.columns)))
    width = len(pieces.columns)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(width).to_numpy(zero_copy_only=False)
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:width], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Cuts and packs documents; encoded once, the pieces are kept in the shared folder."""
    with arrow_rows(docs.sparkSession, TEXTS_A_STEP):
        return pack(cut_pieces(docs, vocabulary, **options), size=options.get("size", 1024))
