"""JSON arrays and result files of any size, read in byte ranges by many tasks.

Spark's text reader cuts files at every closing brace, and its splits at the first one of each range, so a range begins
right after a brace and nothing but "within a string or not" and the depth of nesting is unknown there. Both follow
from the ranges before it: each range's effect is found for either beginning, the effects, a row for each range,
are composed file by file, and then every range tells its records' text apart on its own. Records that
cross a border are put together from their pieces; no other text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import staged

#: A broadcast row for each range: 64 MB or so at this many; more are joined by a shuffle.
BROADCAST_RANGES = 1_000_000
#: Depth of the array that holds the records, by a file's first character.
DEPTHS = {ord("["): 1, ord("{"): 2}
_SPACES = np.isin(np.arange(256), list(b" \t\n\r"))

_EFFECT = "path string, block long, file_bytes long, bytes long, first int, flips int, moves array<long>, starts array<map<long,long>>"
_STATE = "path string, block long, target int, inside int, depth long, before long"


class _Structure:
    """Braces and brackets of a run of text, and how many string ends lie before each."""

    def __init__(self, chunks: list[str]):
        self.data = "}".join([*chunks, ""]).encode("utf-8", "surrogatepass")
        b = np.frombuffer(self.data, np.uint8)
        quotes = np.flatnonzero(b == 34)
        if b"\\" in self.data:
            last = np.maximum.accumulate(np.where(b != 92, np.arange(len(b)), -1))
            quotes = quotes[(quotes - 1 - np.where(quotes > 0, last[quotes - 1], -1)) % 2 == 0]
        self.at = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
        kind = b[self.at]
        self.sign = np.where((kind == 123) | (kind == 91), 1, -1)
        self.parity = np.searchsorted(quotes, self.at) % 2
        self.flips = len(quotes) % 2
        # An opening brace after a colon is a member's value, else an element.
        solid = np.maximum.accumulate(np.where(_SPACES[b], -1, np.arange(len(b))))
        opens = kind == 123
        ahead = np.where(self.at > 0, solid[self.at - 1], -1)
        self.element = opens & ((ahead < 0) | (b[ahead] != 58))
        self.closes = kind == 125

    def depths(self, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the marks are outside of strings, depth after each), from 0 and the given beginning."""
        outside = (self.parity ^ inside) == 0
        return outside, np.cumsum(self.sign * outside)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, block, first row, row after the last) of adjoining rows of one range."""
    paths, blocks = batch.column("path").to_pylist(), batch.column("block").to_pylist()
    low = 0
    for k in range(1, len(paths) + 1):
        if k == len(paths) or (paths[k], blocks[k]) != (paths[low], blocks[low]):
            yield paths[low], blocks[low], low, k
            low = k


def _effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range what it does to a reader that begins outside or inside of a string: moves in depth, and elements begun at each depth."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("file_bytes", pa.int64()), ("bytes", pa.int64()), ("first", pa.int32()), ("flips", pa.int32()), ("moves", pa.list_(pa.int64())), ("starts", pa.list_(pa.map_(pa.int64(), pa.int64())))])
    now = None

    def row():
        return pa.RecordBatch.from_pylist([now | {"starts": [list(s.items()) for s in now["starts"]]}], schema)

    for batch in batches:
        for path, block, low, high in _runs(batch):
            if now is None or (now["path"], now["block"]) != (path, block):
                if now:
                    yield row()
                now = {"path": path, "block": block, "file_bytes": batch.column("file_bytes")[low].as_py(), "bytes": 0, "first": None, "flips": 0, "moves": [0, 0], "starts": [{}, {}]}
            part = _Structure(batch.column("value").slice(low, high - low).to_pylist())
            if now["first"] is None:
                # What ends with the brace that the reader cut off, or at the file's end.
                bare = part.data.lstrip(b"\xef\xbb\xbf \t\n\r")
                now["first"] = bare[0] if bare else None
            for begun in (0, 1):
                inside = begun ^ now["flips"]
                outside, depth = part.depths(inside)
                at, n = np.unique(depth[outside & part.element] - 1 + now["moves"][begun], return_counts=True)
                for a, c in zip(at.tolist(), n.tolist()):
                    now["starts"][begun][a] = now["starts"][begun].get(a, 0) + c
                now["moves"][begun] += int(depth[-1]) if len(depth) else 0
            now["flips"] ^= part.flips
            now["bytes"] += len(part.data)
    if now:
        yield row()


def _composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order to the state that each begins with: within a string, depth, elements before."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("target", pa.int32()), ("inside", pa.int32()), ("depth", pa.int64()), ("before", pa.int64())])
    path = None
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if r["path"] != path:
                path, target, inside, depth, before = r["path"], DEPTHS.get(r["first"], 0), 0, 0, 0
            found.append({"path": path, "block": r["block"], "target": target, "inside": inside, "depth": depth, "before": before})
            before += dict(r["starts"][inside]).get(target - depth, 0)
            depth, inside = depth + r["moves"][inside], inside ^ r["flips"]
        yield pa.RecordBatch.from_pylist(found, schema)


def _told_apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of elements: kind 0 whole, 1 a piece, 2 text of the file around them."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
    of, found, size = None, [], 0

    def add(pos: int, kind: int, parts: list[bytes]) -> None:
        nonlocal size, order
        text = b"".join(parts)
        if kind < 2 or text.strip(b" \t\n\r,"):
            found.append((of[0], pos, of[1], order, kind, text.decode("utf-8", "surrogatepass")))
            order += 1
            size += len(text)

    def ended() -> None:
        # A range's last text: a piece of an element, or text around them.
        if of is not None and kept:
            add(number - 1, 1 if within else 2, kept)

    for batch in batches:
        targets, insides, depths, befores = (batch.column(c) for c in ("target", "inside", "depth", "before"))
        for path, block, low, high in _runs(batch):
            target = targets[low].as_py()
            if of != (path, block):
                ended()
                of, order = (path, block), 0
                inside, depth, number = insides[low].as_py(), depths[low].as_py(), befores[low].as_py()
                within, whole, kept = bool(target) and depth > target and number > 0, False, []
            if not target:
                continue
            part = _Structure(batch.column("value").slice(low, high - low).to_pylist())
            outside, after = part.depths(inside)
            after = after + depth
            starts = part.at[outside & part.element & (after == target + 1)]
            ends = part.at[outside & part.closes & (after == target)]
            marks = sorted([(int(s), 0) for s in starts] + [(int(e) + 1, 1) for e in ends])
            at = 0
            for stop, closing in marks:
                if closing and within:
                    kept.append(part.data[at:stop])
                    add(number - 1, 0 if whole else 1, kept)
                    at, kept, within = stop, [], False
                elif not closing:
                    kept.append(part.data[at:stop])
                    add(number, 2, kept)
                    at, kept, within, whole = stop, [], True, True
                    number += 1
            kept.append(part.data[at:])
            depth, inside = int(after[-1]) if len(after) else depth, inside ^ part.flips
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            found, size = [], 0
    ended()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _chunks(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    read = spark.read.option("lineSep", "}")
    read = read.option("pathGlobFilter", glob) if glob else read
    return read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_bytes"), "value")


class JsonFiles:
    """Files that hold an array of objects, or an object with one array of objects among its members (an envelope).

    Other members of an envelope may be objects without objects in them. Elements that are no objects are left out and
    have no place. Files are read twice, once for the effects of the ranges; their texts are kept in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], glob: str | None = None):
        self._chunks = _chunks(spark, path, glob)
        self._effects = staged(self._chunks.mapInArrow(_effects, _EFFECT), "json-effects")
        self._states = staged(self._effects.repartition("path").sortWithinPartitions("path", "block").mapInArrow(_composed, _STATE), "json-states")
        self._texts = None

    def _told(self) -> DataFrame:
        if self._texts is None:
            if self._states.count() <= BROADCAST_RANGES:
                # Rows stay in the order in which they are read.
                known = self._chunks.join(F.broadcast(self._states), ["path", "block"])
            else:
                numbered = self._chunks.withColumn("row", F.monotonically_increasing_id())
                known = numbered.join(self._states, ["path", "block"]).sortWithinPartitions("path", "block", "row").drop("row")
            told = known.select("path", "block", "value", "target", "inside", "depth", "before").mapInArrow(_told_apart, "path string, pos long, block long, part long, kind int, text string")
            self._texts = staged(told, "json-texts")
        return self._texts

    def records(self) -> DataFrame:
        """(path, pos, text) of every element, numbered from 0 in each file."""
        told = self._told()
        pieces = told.where("kind = 1").groupBy("path", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("all"))
        mended = pieces.select("path", "pos", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"))
        return told.where("kind = 0").select("path", "pos", "text").unionByName(mended)

    def headers(self) -> DataFrame:
        """(path, text) of each envelope, its elements left out."""
        around = self._told().where("kind = 2").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("all"))
        # Where a file doesn't end with a brace, the reader's last cut was given one.
        more = self._effects.groupBy("path").agg((F.sum("bytes") - F.max("file_bytes")).cast("int").alias("more"))
        text = F.array_join(F.transform("all", lambda x: x["text"]), "")
        return around.join(more, "path").select("path", F.substring(text, F.lit(1), F.length(text) - F.col("more")).alias("text"))

    def outlines(self) -> DataFrame:
        """(path, kind, whole) of each file that isn't empty: array, object or other, and whether it ends outside of strings and closed."""
        ends = self._states.join(self._effects.select("path", "block", "file_bytes", "bytes", "flips", "moves"), ["path", "block"])
        state = F.struct("target", F.col("inside").bitwiseXOR(F.col("flips")).alias("inside"), (F.col("depth") + F.get("moves", F.col("inside"))).alias("depth"))
        end = ends.groupBy("path").agg(F.max_by(state, "block").alias("e"), (F.sum("bytes") - F.max("file_bytes")).alias("more"))
        kind = F.element_at(F.array(F.lit("other"), F.lit("array"), F.lit("object")), F.col("e.target") + 1)
        # Where the file doesn't end with a brace, one too many was counted at its end.
        return end.select("path", kind.alias("kind"), ((F.col("e.inside") == 0) & (F.col("e.depth") + F.col("more") == 0)).alias("whole"))
