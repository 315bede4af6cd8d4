"""Conversation prefix trie, merged family first.

A family is the conversations of one base id. Each is rebuilt from its first turns in the base conversation and
its own later turns; a family's small trie is built in one pass, and only its combined nodes are shuffled and
merged with those of other families. Conversations of very many turns go in blocks, whose nodes are merged alike.

A turn is known by a 128-bit digest; a node by the sum, modulo 2^128, of the digests of its turns, each hashed
with its place. So a node's key does not depend on who builds it, and blocks of a long conversation need only
the sum of what lies before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import heavy_parted, in_blocks, joined_by_count, staged

#: Conversations of one family lie within so many ids; the base's first turns, at most SHARED - 1, are put before the others' own.
FAMILY, SHARED = 100, 6
#: Rows of a conversation that one task holds at most; more go in blocks.
BLOCK_ROWS = 1 << 12
#: Key of the textless root.
ROOT = b"\0" * 16

_NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("points", pa.int64()), ("ends", pa.list_(pa.int64()))])
_NODE_DDL = "key binary, parent binary, depth long, conv_id long, n_convs long, points long, ends array<long>"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for role and text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def placed_digest(place: int, digest: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(place.to_bytes(8, "little") + digest, digest_size=16).digest(), "little")


def _key(total: int) -> bytes:
    return (total & ((1 << 128) - 1)).to_bytes(16, "little")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = conversations.where("conv_id is not null")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    return known.select(F.col("conv_id").cast("long").alias("conv"), base.cast("long").alias("base"), head.alias("head"), "turn", role.alias("role"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("points"))


def _families(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Combined nodes of each family's trie. heads: the first turns of base conversations, with their position."""

    def build(own: pa.Table, base: pa.Table) -> pa.Table:
        first = sorted(zip(base["position"].to_pylist(), base["digest"].to_pylist(), base["points"].to_pylist()))
        rows: dict[int, list[tuple[int, bytes, int]]] = {}
        heads: dict[int, int] = {}
        for conv, head, position, digest, points in zip(*(own[c].to_pylist() for c in ("conv", "head", "position", "digest", "points"))):
            rows.setdefault(conv, []).append((position, digest, points))
            heads[conv] = head
        nodes: dict[int, list] = {}
        for conv in sorted(rows):
            path = [*first[: heads[conv]], *sorted(rows[conv])[heads[conv] :]]
            total, parent = 0, None
            for depth in range(len(path) + 1):
                if depth:
                    parent, total = total, (total + placed_digest(depth - 1, path[depth - 1][1])) & ((1 << 128) - 1)
                node = nodes.get(total)
                if node is None:
                    node = nodes[total] = [parent, depth, conv, 0, path[depth - 1][2] if depth else 0, []]
                node[3] += 1
            node[5].append(conv)
        columns = zip(*((_key(k), None if p is None else _key(p), *rest) for k, (p, *rest) in nodes.items()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE) if nodes else _NODE.empty_table()

    mine = turns.select("base", "conv", "head", "position", "digest", "points")
    return mine.groupBy("base").cogroup(heads.groupBy("base")).applyInArrow(build, _NODE_DDL)


def _long_nodes(long: DataFrame, heads: DataFrame, rows: int) -> DataFrame:
    """Nodes of conversations of more than ``rows`` turns, block by block."""
    placed = staged(in_blocks(long, "conv", ["turn", "role", "digest"], F.lit(1), rows), "trie-turns")
    firsts = heads.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("position", "digest", "points"))).alias("first"))
    # A long conversation has more turns than any head, so it has rows of its own after it.
    known = placed.groupBy("conv").agg(F.any_value("base").alias("base"), F.any_value("head").alias("head"), F.count("*").alias("n")).join(firsts, "base", "left")
    known = staged(known.select("conv", "head", "n", F.coalesce(F.slice("first", 1, F.col("head")), F.array()).alias("first")), "trie-heads")
    counted = known.select("conv", F.size("first").alias("shared"), "n")
    after = joined_by_count(placed, counted, "conv", known.agg(F.sum("n")).first()[0]).where("position >= head")
    own = after.select("conv", "block", (F.col("position") - F.col("head") + F.col("shared")).alias("place"), "digest", "points")
    before = known.select("conv", F.lit(-1).cast("long").alias("block"), F.posexplode("first").alias("place", "t")).select("conv", "block", F.col("place").cast("long").alias("place"), "t.digest", "t.points")
    rebuilt = staged(own.unionByName(before), "trie-rebuilt")

    def total(group: pa.Table) -> pa.Table:
        found = sum(placed_digest(p, d) for p, d in zip(group["place"].to_pylist(), group["digest"].to_pylist()))
        return pa.table({"conv": group["conv"][:1], "block": group["block"][:1], "total": pa.array([_key(found)], pa.binary()), "n": pa.array([len(group)], pa.int64())})

    def start(group: pa.Table) -> pa.Table:
        ordered, so_far, found = group.sort_by("block"), 0, []
        for t in ordered["total"].to_pylist():
            found.append(_key(so_far))
            so_far += int.from_bytes(t, "little")
        last = [False] * (len(found) - 1) + [True]
        return pa.table({"conv": ordered["conv"], "block": ordered["block"], "start": pa.array(found, pa.binary()), "last": pa.array(last)})

    def nodes(rows: pa.Table, starts: pa.Table) -> pa.Table:
        conv, so_far, found = rows["conv"][0].as_py(), int.from_bytes(starts["start"][0].as_py(), "little"), []
        ordered = sorted(zip(rows["place"].to_pylist(), rows["digest"].to_pylist(), rows["points"].to_pylist()))
        if ordered[0][0] == 0:
            found.append((ROOT, None, 0, conv, 1, 0, []))
        for place, digest, points in ordered:
            parent, so_far = so_far, so_far + placed_digest(place, digest)
            found.append((_key(so_far), _key(parent), place + 1, conv, 1, points, []))
        if starts["last"][0].as_py():
            found[-1][-1].append(conv)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _NODE)], schema=_NODE)

    totals = rebuilt.groupBy("conv", "block").applyInArrow(total, "conv long, block long, total binary, n long")
    starts = totals.groupBy("conv").applyInArrow(start, "conv long, block long, start binary, last boolean")
    return rebuilt.groupBy("conv", "block").cogroup(starts.groupBy("conv", "block")).applyInArrow(nodes, _NODE_DDL)


def _ends(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where conversations end.

    Families cover disjoint ranges of ids, so their lists in order of the first id are in order throughout. They
    pass by in that order; the state of one digest is all that a task keeps.
    """

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of = None, None
        schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                told = ",".join(map(str, ids)).encode()
                if key != of:
                    if state:
                        done.append({"key": of, "ends_sha256": state.hexdigest()})
                    state, of = hashlib.sha256(told), key
                else:
                    state.update(b"," + told)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([{"key": of, "ends_sha256": state.hexdigest()}], schema)

    ended = nodes.where(F.size("ends") > 0).select("key", "ends", F.get("ends", F.lit(0)).alias("least"))
    return ended.repartition("key").sortWithinPartitions("key", "least").select("key", "ends").mapInArrow(digests, "key binary, ends_sha256 string")


def _subtree_sums(shared: DataFrame, deepest: int) -> DataFrame:
    """(key, leaves, saved) of nodes with several members, summed over their subtrees, without the root.

    Pointer jumping: in every round each node adds its sum so far to the node that its pointer leads to, and the
    pointer leaps as far again, so the rounds are the logarithm of the depth. ``shared``: key, parent, leaves and saved
    of each node alone; its pointers never lead to the root.
    """
    state = shared
    reach = 1
    while reach < deepest:
        moving = state.where("parent is not null")
        sums = staged(moving.groupBy(F.col("parent").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n")), "trie-sums")
        targets = staged(sums.join(state.select("key", F.col("parent").alias("leap")), "key").select(F.col("key").alias("parent"), "leap", "n"), "trie-leaps")
        leaps = joined_by_count(moving.select("key", "parent"), targets, "parent", sums.agg(F.sum("n")).first()[0] or 0).select("key", F.col("leap").alias("parent"))
        grown = state.drop("parent").join(sums.drop("n"), "key", "left").join(leaps, "key", "left")
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        state = staged(grown.select("key", "parent", *added), "trie-state")
        reach *= 2
    return state.select("key", "leaves", "saved")


def prefix_trie(conversations: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; those of one number by role, then by digest. Rows without conv_id
    belong to no family and are left out; other columns too. Repeated rows are repeated turns. No rows, no nodes.
    """
    turns = _turns(conversations)
    short, long = heavy_parted(turns, "conv", F.lit(1), rows)
    by = Window.partitionBy("base", "conv").orderBy("turn", "role", "digest")
    placed = short.repartition("base").withColumn("position", (F.row_number().over(by) - 1).cast("long"))
    heads = placed.where(f"conv = base and position < {SHARED - 1}").select("base", "position", "digest", "points")
    if long is not None:
        # Of a long base conversation only the least turns are wanted.
        least = F.slice(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "points"))), 1, SHARED - 1)
        ranked = long.where("conv = base").groupBy("base", F.pmod(F.xxhash64("digest"), F.lit(1024)).alias("salt")).agg(least.alias("t"))
        few = ranked.groupBy("base").agg(F.slice(F.sort_array(F.flatten(F.collect_list("t"))), 1, SHARED - 1).alias("t")).select("base", F.posexplode("t").alias("position", "t"))
        heads = staged(heads.unionByName(few.select("base", F.col("position").cast("long").alias("position"), "t.digest", "t.points")), "trie-firsts")
    found = _families(placed, heads)
    if long is not None:
        found = found.unionByName(_long_nodes(long, heads, rows))
    parts = staged(found, "trie-parts")
    merged = parts.groupBy("key").agg(F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.any_value("points").alias("points"))
    nodes = staged(merged, "trie-nodes")
    children = staged(nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")), "trie-children")
    known = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = staged(known.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("single", F.lit(0))).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("points")).drop("single", "points"), "trie-known")
    at_root = F.col("parent") == F.lit(ROOT)
    shared = known.where("n_convs > 1 and depth > 0").select("key", F.when(~at_root, F.col("parent")).alias("parent"), "leaves", "saved", "depth")
    deepest, all_saved = shared.agg(F.max("depth"), F.sum("saved")).first()
    sums = _subtree_sums(shared.drop("depth"), deepest or 0).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    all_leaves, edges = known.agg(F.count_if(F.col("n_children") == 0), F.count_if(F.col("parent").isNotNull())).first()
    summed = known.join(sums, "key", "left").join(_ends(parts), "key", "left")
    root = F.col("depth") == 0
    counted = summed.select(
        "parent", "conv_id", "depth", "n_convs", "n_children", F.when(root, F.lit(all_leaves)).otherwise(F.coalesce("n_leaves", F.lit(1))).cast("long").alias("n_leaves"),
        F.when(root, F.lit(all_saved or 0)).otherwise(F.coalesce("saved_tokens", F.lit(0))).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    parents = nodes.join(children.select("key", F.col("n_children").alias("n")), "key").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n")
    below = joined_by_count(counted.where("parent is not null"), parents, "parent", edges)
    return below.drop("parent").unionByName(counted.where("parent is null").drop("parent").withColumn("parent_conv_id", F.lit(None).cast("long")))
