"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives every vector a long hash string: first some cross-polytope digits (the coordinate of a random
rotation that is largest in size, with its sign; near vectors share it far more often than single-bit hashes),
then sign bits of random projections down to BITS bits, so that strings that many rows share are split further. The
number of digits grows with the table, so that a prefix of all digits holds some rows.

A query descends in each tree to the longest prefix that it shares with other rows, and ascends in step over all
trees, from level to level of shorter prefixes, until the rows that share its prefix, counted over all trees, are
enough. Where that leads up to the digits, it does not ascend further, to prefixes 2 x size times as frequent, but goes
sideways: to the prefixes that it would have had with the next largest coordinates, the likeliest first (multi-probe).
All rows under its prefixes are met, in every tree, and scored by their exact cosine. A query that has not found as many as
asked for so ascends further, to the root at last, where all rows are met. No table is too small for the trees.

Trees are sorted and cut into ranges of (tree, string, id), so neither a tree nor a frequent string has
to fit a task. Prefixes that cross a range's border are counted over all ranges, and a query visits each range
that its prefixes lie in. Equal vectors enter the trees once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged

#: Trees, bits of a hash string.
TREES, BITS = 48, 62
#: Rows that a query is to meet, counted over all trees: SHARE * rows ** POWER.
SHARE, POWER = 9.64, 0.55
#: Prefixes that a query looks under in each tree, at least and at most; coordinates of a digit that count as near.
FEWEST, PROBES, NEAR = 2, 96, 16
SEED = 20
#: Sorted rows of a range, about.
RANGE_ROWS = 200_000
#: Pairs that are scored at once.
PAIRS = 50_000


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    # Vectors travel as they come, half as wide if single; all sums are made in double precision.
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.coalesce(usable, F.lit(False)))


def _plan(n: int, size: int, enough: int, trees: int) -> tuple[int, int]:
    """(digits, probes): the most digits of which at most PROBES prefixes hold about enough rows, if rows are spread evenly."""

    def probes(digits: int) -> float:
        return enough * (2 * size) ** digits / (max(1, n) * trees)

    digits = 1
    while (digits + 1) * _digit_bits(size) <= BITS and probes(digits + 1) <= PROBES:
        digits += 1
    return digits, max(FEWEST, min(PROBES, math.ceil(probes(digits))))


def _digit_bits(size: int) -> int:
    return (2 * size - 1).bit_length()


def _levels(size: int, digits: int) -> list[int]:
    """Bits of the prefixes that a query climbs: none, the digits one by one, and longer ones in growing steps."""
    levels = [k * _digit_bits(size) for k in range(digits + 1)]
    while levels[-1] < BITS:
        levels.append(min(BITS, levels[-1] + 1 + (len(levels) - digits - 1) // 3))
    return levels


def _hashes(units: np.ndarray, trees: int, seed: int, digits: int = 1, probes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(n, trees) hash strings, and (n, trees, probes) prefixes of all digits, the likeliest first; the first is a row's own."""
    n, size = units.shape
    bits, near = _digit_bits(size), min(NEAR, size)
    rest = BITS - digits * bits
    found, prefixes = np.zeros((n, trees), np.int64), np.zeros((n, trees, probes), np.int64)
    for tree in range(trees):
        r = np.random.default_rng([seed, tree])
        own, cost, probe = np.zeros(n, np.int64), np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for _ in range(digits):
            rotated = units @ np.linalg.qr(r.normal(size=(size, size)))[0].astype(np.float32)
            sides = 2 * np.arange(size) + (rotated < 0)
            rotated = np.abs(rotated)
            own = (own << bits) + np.take_along_axis(sides, rotated.argmax(axis=1)[:, None], 1)[:, 0]
            if probes:
                order = np.argsort(-rotated, axis=1, kind="stable")[:, :near]
                sized = np.take_along_axis(rotated, order, 1)
                short = (sized[:, :1] - sized) ** 2
                cost = (cost[:, :, None] + short[:, None]).reshape(n, -1)
                probe = ((probe << bits)[:, :, None] + np.take_along_axis(sides, order, 1)[:, None]).reshape(n, -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
                cost, probe = np.take_along_axis(cost, best, 1), np.take_along_axis(probe, best, 1)
        signs = units @ r.normal(size=(size, rest)).astype(np.float32) > 0
        found[:, tree] = (own << rest) + signs @ (np.int64(1) << np.arange(rest, dtype=np.int64)[::-1])
        if probes:
            # In a vector of few numbers there may be fewer prefixes than wanted.
            prefixes[:, tree] = np.concatenate([probe, np.repeat(probe[:, :1], max(0, probes - probe.shape[1]), 1)], 1)[:, :probes]
    return found, prefixes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.ravel()))


def _units(column: pa.Array) -> np.ndarray:
    x = _matrix(column).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _hashed(trees: int, seed: int, digits: int):
    """Rows with their hash string in each tree."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*some.columns, _lists(_hashes(_units(some.column(2)), trees, seed, digits)[0])], ["id", "wanted", "v", "hs"])

    return rows


def _runs(levels: list[int]):
    """Of a sorted range: its first row (level -1), how many rows share each prefix that matters here or crosses a border, and the prefixes of searched rows (q)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        trees, hs, ids, wanted = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(4))

        def found(q, tree: int, level: int, prefix, n) -> pa.RecordBatch:
            size = len(prefix)
            q = pa.nulls(size, pa.int64()) if q is None else pa.array(q)
            return pa.RecordBatch.from_arrays([q, pa.array(np.full(size, tree, np.int32)), pa.array(np.full(size, level, np.int32)), pa.array(prefix), pa.array(n)], ["q", "tree", "level", "prefix", "n"])

        yield found(ids[:1], int(trees[0]), -1, hs[:1], np.zeros(1, np.int64))
        for tree in np.unique(trees):
            begin, end = np.searchsorted(trees, [tree, tree + 1])
            h, w, own = hs[begin:end], wanted[begin:end], ids[begin:end]
            for level, bits in enumerate(levels):
                prefix = h >> (BITS - bits)
                starts = np.concatenate([[0], 1 + np.flatnonzero(np.diff(prefix))])
                n = np.diff(np.append(starts, len(h)))
                shared = n > 1
                shared[[0, -1]] = True
                kept = shared & (np.add.reduceat(w.astype(np.int64), starts) > 0)
                kept[[0, -1]] = True
                yield found(None, int(tree), level, prefix[starts[kept]], n[kept])
                # At the root one tree holds all rows.
                asking = w & np.repeat(shared, n) if level or tree == 0 else np.zeros(len(w), bool)
                yield found(own[asking], int(tree), level, prefix[asking], np.ones(int(asking.sum()), np.int64))

    return rows


def _dealt(bounds: list[tuple[int, int, int]], levels: list[int], digits: int, probes: int, seed: int, looked: int):
    """Rows and searched rows for each range: part, tree, whether a row, string, first strings and length of the prefixes looked under, id, vector.

    bounds: the first row of each range. A searched row goes to all ranges that its prefixes can lie in, once to each. looked: the
    first so many trees are dealt; one is enough for the root.
    """
    trees = np.array([b[0] for b in bounds])
    by_tree = {}

    def of(tree: int):
        if tree not in by_tree:
            begin, end = np.searchsorted(trees, [tree, tree + 1])
            by_tree[tree] = int(begin), np.array([b[1] for b in bounds[begin:end]], np.int64), np.array([b[2] for b in bounds[begin:end]], np.int64)
        return by_tree[tree]

    def of_rows(some: pa.RecordBatch, tree: int, h: np.ndarray) -> pa.RecordBatch:
        ids = some.column(0).to_numpy()
        begin, first, least = of(tree)
        parts = np.searchsorted(first, h, "right")
        # Where a range begins within rows of one string, ids decide.
        for x in np.intersect1d(h, first):
            a, b = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
            parts[h == x] = a + np.searchsorted(least[a:b], ids[h == x], "right")
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array((parts + begin - 1).astype(np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(np.ones(n, bool)), pa.array(h), pa.nulls(n, pa.list_(pa.int64())), pa.array(np.zeros(n, np.int64)), some.column(0), some.column(2)], _DEALT)

    def of_searched(some: pa.RecordBatch, tree: int, h: np.ndarray, prefixes: np.ndarray) -> pa.RecordBatch | None:
        level = some.column(1).to_numpy()
        begin, first, _ = of(tree)
        rest = BITS - np.array(levels)[level]
        aside = level == digits
        times = np.where(aside, probes, np.where((level > 0) | (tree == 0), 1, 0))
        q = np.repeat(np.arange(len(h)), times)
        low = np.where(np.repeat(aside, times), 0, (h >> rest << rest)[q])
        low[np.repeat(aside, times)] = (prefixes[aside] << (BITS - levels[digits])).ravel()
        high = low + (np.int64(1) << rest[q]) - 1
        a, b = np.searchsorted(first, low, "left"), np.searchsorted(first, high, "right")
        n = b - a + 1
        part = np.repeat(a + begin - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Before the first range of all there is none; a prefix that is looked under twice counts once.
        q, low, part = np.repeat(q, n)[part >= 0], np.repeat(low, n)[part >= 0], part[part >= 0]
        order = np.lexsort((low, part, q))
        q, low, part = q[order], low[order], part[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (part[1:] != part[:-1]) | (low[1:] != low[:-1])
        q, low, part = q[new], low[new], part[new]
        if not len(q):
            return None
        starts = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (part[1:] != part[:-1])]))
        lows = pa.ListArray.from_arrays(np.append(starts, len(q)).astype(np.int32), pa.array(low))
        at, k = pa.array(q[starts]), len(starts)
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(np.full(k, tree, np.int32)), pa.array(np.zeros(k, bool)), pa.array(low[starts]), lows, pa.array(((np.int64(1) << rest[q[starts]]) - 1)), some.column(0).take(at), some.column(2).take(at)], _DEALT)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                hs, searched = _matrix(some.column(3)), some.column(1)[0].as_py() >= 0
                prefixes = _hashes(_units(some.column(2)), hs.shape[1], seed, digits, probes)[1] if searched else None
                for tree in range(looked):
                    found = of_searched(some, tree, hs[:, tree], prefixes[:, tree]) if searched else of_rows(some, tree, hs[:, tree])
                    if found is not None:
                        yield found

    return rows


_DEALT = ["part", "tree", "row", "low", "lows", "width", "id", "v"]


def _met(kept: int):
    """For each searched row of a tree's range, the best of the range's rows that lie under its prefixes."""

    def scored(asked, h: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        of, lows, widths, q, xq, nq = asked
        norms = np.sqrt((x * x).sum(axis=1))
        i = np.searchsorted(h, lows, "left")
        n = np.searchsorted(h, lows + widths, "right") - i
        there = np.flatnonzero(n > 0)
        upto = np.cumsum(n[there])
        for at in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            pair = np.arange(at, min(at + PAIRS, int(upto[-1])))
            k = np.searchsorted(upto, pair, "right")
            rows, cols = of[there[k]], i[there[k]] + pair - (upto[k] - n[there[k]])
            # Each pair's cosine from its own two vectors, the same in every tree.
            cosine = (xq[rows] * x[cols]).sum(axis=1) / (nq[rows] * norms[cols])
            order = np.lexsort((ids[cols], -cosine, rows))
            rows, cols, cosine = rows[order], cols[order], cosine[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < kept
            yield pa.RecordBatch.from_arrays([pa.array(q[rows[best]]), pa.array(ids[cols[best]]), pa.array(cosine[best])], ["q", "id", "score"])

    def joined(asked):
        """(query of each prefix, prefix's first string, width, ids, vectors, norms) of all searched rows so far."""
        lows = [a for lows, *_ in asked for a in lows]
        sizes = [len(a) for a in lows]
        widths, q, x = (np.concatenate([a[c] for a in asked]) for c in (1, 2, 3))
        of = np.repeat(np.arange(len(q)), sizes)
        return of, np.concatenate(lows), widths[of], q, x, np.sqrt((x * x).sum(axis=1))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, ready = None, [], None
        for batch in batches:
            part, tree, row, low, width, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 5, 6))
            x = _matrix(batch.column(7)).astype(np.float64)
            cuts = [0, *(1 + np.flatnonzero((np.diff(part) != 0) | (np.diff(tree) != 0) | (row[1:] != row[:-1]))), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at != (part[a], tree[a]):
                    at, asked, ready = (part[a], tree[a]), [], None
                if not row[a]:
                    lows = batch.column(4).slice(a, b - a)
                    ends = lows.offsets.to_numpy()
                    flat = lows.flatten().to_numpy(zero_copy_only=False)
                    asked.append((np.split(flat, (ends - ends[0])[1:-1]), width[a:b], ids[a:b], x[a:b]))
                elif asked:
                    ready = ready or joined(asked)
                    yield from scored(ready, low[a:b], ids[a:b], x[a:b])

    return rows


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, *, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, window: int | None = None, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all other rows.

    queries: rows of ``vectors``, by their key. score: cosine in double precision on the
    original vectors; ties go to the smaller id. Null, zero, null-holding and non-finite vectors and
    rows without id take no part. Vectors of different lengths have no cosine: each length has its own forest. Of rows that repeat
    an id with the same vector one takes part. Fewer than k candidates: all of them. No valid
    vectors: no rows. window: a query has met enough rows when they are as many as this on either side
    in each tree; by default the number follows from the number of rows.
    """
    valid = _valid(vectors, key, vector).withColumn("size", F.size("v"))
    asked = queries.select(F.col(key).cast("long").alias("id")).distinct()
    # As many lengths as there are kinds of vectors in the table, not as there are rows.
    sizes = sorted(r["size"] for r in valid.select("size").distinct().collect()) or [1]
    found = [_nearest(valid.where(F.col("size") == size).drop("size"), asked, size, k, trees, window, seed) for size in sizes]
    return functools.reduce(DataFrame.union, found)


def _nearest(valid: DataFrame, asked: DataFrame, size: int, k: int, trees: int, window: int | None, seed: int) -> DataFrame:
    """The search among (id, v) of one length."""
    rows = staged(valid.join(asked.withColumn("asked", F.lit(True)), "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "vectors")
    distinct = staged(rows.groupBy("v").agg(F.min("id").alias("rep"), F.max("asked").alias("wanted")), "distinct-vectors")

    kind, n = distinct.schema["v"].dataType.simpleString(), distinct.count()
    enough = 2 * window * trees if window else int(SHARE * n**POWER)
    digits, probes = _plan(n, size, enough, trees)
    levels = _levels(size, digits)
    hashed = staged(distinct.select("rep", "wanted", "v").mapInArrow(_hashed(trees, seed, digits), f"id long, wanted boolean, v {kind}, hs array<long>"), "hashed-vectors")
    ranges = max(int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * trees // RANGE_ROWS)
    forest = hashed.select("id", "wanted", F.posexplode("hs").alias("tree", "h")).select("tree", "h", "id", "wanted")
    ordered = forest.repartitionByRange(ranges, "tree", "h", "id").sortWithinPartitions("tree", "h", "id")
    runs = staged(ordered.mapInArrow(_runs(levels), "q long, tree int, level int, prefix long, n long"), "prefixes")
    bounds = sorted((r.tree, r.prefix, r.q) for r in runs.where("level < 0").collect())
    shared = runs.where("q is null").groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"))
    counted = runs.where("q is not null and level >= 0").select("q", "tree", "level", "prefix").join(shared, ["tree", "level", "prefix"])
    counts = counted.groupBy("q", "level").agg(F.sum("n").alias("n"))

    def climbed(rows_met: int):
        """Each query's longest prefixes that hold so many rows over all trees, or the root."""
        return F.coalesce(F.max(F.when(F.col("n") >= rows_met, F.col("level"))), F.lit(0))

    def first(frame: DataFrame, by: str, most: int, *order) -> DataFrame:
        ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        return ranked.where(F.col("rank") <= most)

    # Of equal vectors only the k + 1 smallest ids can be among the k nearest.
    least = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    members = members.join(distinct.select("v", "rep"), "v").select("rep", "id")
    dealt = f"part int, tree int, row boolean, low long, lows array<long>, width long, id long, v {kind}"

    def met(asking: DataFrame, looked: int = trees) -> DataFrame:
        """(q, id, score): the best ids met by these queries (q, level)."""
        deal = _dealt(bounds, levels, digits, probes, seed, looked)
        searched = hashed.where("wanted").join(asking, F.col("id") == F.col("q")).select("id", "level", "v", "hs").mapInArrow(deal, dealt)
        spread = hashed.select("id", F.lit(-1).alias("level"), "v", "hs").mapInArrow(deal, dealt).union(searched)
        sorted_parts = spread.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("part", "tree", "row", "low")
        scored = sorted_parts.mapInArrow(_met(k + 1), "q long, id long, score double")
        # One more than asked for: a query's own row is among them.
        best = first(scored.distinct(), "q", k + 1, F.desc("score"), "id").select("q", F.col("id").alias("rep"), "score")
        return staged(first(best.join(members, "rep"), "q", k + 1, F.desc("score"), "id").select("q", "id", "score"), "nearest")

    expanded = met(counts.groupBy("q").agg(F.greatest(climbed(enough), F.lit(digits)).alias("level")))
    higher = counts.where(F.col("level") < digits).groupBy("q").agg(climbed((k + 1) * trees).alias("level"))
    for rooted in (False, True) if digits > 1 else (True,):
        few = hashed.where("wanted").select(F.col("id").alias("q")).join(expanded.groupBy("q").agg(F.count("*").alias("found")), "q", "left")
        few = staged(few.where(F.coalesce("found", F.lit(0)) <= k).select("q"), "few-found")
        if few.isEmpty():
            break
        more = met(few.withColumn("level", F.lit(0)), 1) if rooted else met(few.join(higher, "q"))
        expanded = expanded.join(few, "q", "left_anti").union(more)
    queried = rows.where("asked").select("id", "v").distinct().join(distinct.select("v", "rep"), "v").select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    pairs = queried.join(expanded, "q").where("query_id != id")
    return first(pairs, "query_id", k, F.desc("score"), "id").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
