"""Conversation structure repair by error-correcting Earley parsing.

A conversation should read ``(s?(ua)+)?`` in the first letters of its roles. The role grammar is weighted and
written left-recursively; besides the rules that keep a row it has error productions that delete, rerole or
insert one. A chart set holds, for each item, the least (cost, audit); the completed item yields the repair.

Left recursion gives every item the same origin, so a chart set has a handful of items and parsing is linear.
Long conversations are parsed in blocks from each possible item at a block's start, and the blocks' tables,
which compose like matrices, are folded in rounds; no task holds a whole long conversation's texts.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_WEIGHT, ROW_WEIGHT, heavy_parted, in_blocks, joined_by_count, staged

#: The grammar: (whole, its left part, the terminal after it). EMPTY stands for no message so far, the others for the role of the last one.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
RULES = (
    (EMPTY, EMPTY, "gone"), (SYSTEM, EMPTY, "s"), (SYSTEM, SYSTEM, "gone"), (USER, EMPTY, "u"), (USER, SYSTEM, "u"),
    (USER, ASSISTANT, "u"), (USER, USER, "gone"), (ASSISTANT, USER, "a"), (ASSISTANT, ASSISTANT, "gone"),
)
#: What completes a conversation.
ACCEPTED = (EMPTY, ASSISTANT)
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: Blocks folded at once.
FOLD = 64
#: Signatures up to this length are remembered, so many of them in each worker.
SHORT, REMEMBERED = 32, 50_000

_SPACE = r"\x20\x09-\x0D"
_MESSAGE = "array<struct<edit:string,at:int,role:string>>"
_TABLE = "array<struct<start:int,end:int,cost:long,audit:string>>"


def _terminals(symbol: str) -> dict[str, tuple[int, str]]:
    """How one row can be read: terminal -> (cost, edit), with the error productions of the terminals."""
    found = {"gone": (COSTS["D"], "D")}
    if symbol != "D":
        more = TRUNCATED * symbol.isupper()
        for role in "ua":
            found[role] = (COSTS["R"] + more, "R")
        if symbol.lower() in "sua":
            found[symbol.lower()] = (COSTS["K"] + more, "K")
    return found


def _closed(items: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """A chart set with all that insertions complete; cheapest first, so each item is settled once."""
    agenda, done = [(cost, audit, whole) for whole, (cost, audit) in items.items()], {}
    heapq.heapify(agenda)
    while agenda:
        cost, audit, part = heapq.heappop(agenda)
        if part not in done:
            done[part] = (cost, audit)
            for whole, left, terminal in RULES:
                if left == part and terminal in "ua" and whole not in done:
                    heapq.heappush(agenda, (cost + COSTS["I"], audit + "I", whole))
    return done


def parse(signature: str, start: int = EMPTY) -> dict[int, tuple[int, str]]:
    """Completed items at the end of the rows: item -> least (cost, audit), parsed from the item ``start``.

    signature: a character for each row: D if it must go, else the first letter of its role (x for any
    other than s, u and a), a capital if it is truncated.
    """
    items = _closed({start: (0, "")})
    for symbol in signature:
        read, following = _terminals(symbol), {}
        for whole, left, terminal in RULES:
            if left in items and terminal in read:
                cost, audit = items[left]
                more, edit = read[terminal]
                one = (cost + more, audit + edit)
                if whole not in following or one < following[whole]:
                    following[whole] = one
        items = _closed(following)
    return items


def _table(signature: str) -> list[dict]:
    return [{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in parse(signature, s).items()]


@functools.lru_cache(REMEMBERED)
def _short_table(signature: str) -> list[dict]:
    return _table(signature)


def composed(one: list[dict], two: list[dict]) -> list[dict]:
    """The table of two adjoining pieces: the least (cost, audit) over all items between them."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for x in one:
        for y in two:
            if x["end"] == y["start"]:
                key, value = (x["start"], y["end"]), (x["cost"] + y["cost"], x["audit"] + y["audit"])
                if key not in found or value < found[key]:
                    found[key] = value
    return [{"start": s, "end": e, "cost": c, "audit": a} for (s, e), (c, a) in found.items()]


def _tables(signatures: pa.Array) -> pa.Array:
    found = [_short_table(x) if len(x) <= SHORT else _table(x) for x in signatures.to_pylist()]
    return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))


def _scripts(audits: pa.Array, before: pa.Array, odd: pa.Array) -> pa.Array:
    """The messages that an audit, or a piece of one, makes: edit, row and, where it isn't the row's, role.

    Roles follow from the place among all messages: an odd number of them starts with the system's.
    """

    def script(audit: str, place: int, odd: int) -> list[dict]:
        found, row = [], 0
        for edit in audit:
            role = ("user", "assistant")[(place - odd) % 2] if edit in "RI" else None
            found.append({"edit": edit, "at": row, "role": role})
            place += edit != "D"
            row += edit != "I"
        return found

    scripts = [script(*x) for x in zip(audits.to_pylist(), before.to_pylist(), odd.to_pylist())]
    return pa.array(scripts, pa.list_(pa.struct([("edit", pa.string()), ("at", pa.int32()), ("role", pa.string())])))


def _best(table: str) -> Column:
    """(cost, audit) of the cheapest completed item; ties to the least audit."""
    kept = F.filter(table, lambda x: (x["start"] == EMPTY) & x["end"].isin(*ACCEPTED))
    return F.array_min(F.transform(kept, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))


def _outputs(audit: Column) -> Column:
    return F.length(F.regexp_replace(audit, "D", ""))


def _judged(rows: DataFrame, first: Column) -> DataFrame:
    """Adds each row's fault and symbol. first: position of the first row with its role and text."""
    blank, whole = ~F.col("text").rlike(f"[^{_SPACE}]"), F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    fault = F.when(blank, "blank").when(first < F.col("position"), "duplicate").when(~whole, "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return rows.withColumn("fault", fault).withColumn("symbol", symbol)


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block: counts, borders, signature and the rows themselves, by position."""
    by = Window.partitionBy("conv", "block").orderBy("position")
    marked = rows.withColumn("pair", F.concat(F.lag("initial").over(by), "initial")).withColumn("new", ~F.col("turn").eqNullSafe(F.lag("turn").over(by)))
    border = F.struct("position", "initial", "turn")
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    found = marked.groupBy("conv", "block").agg(
        *faults, F.count_if(~F.col("pair").isin("su", "ua", "au")).alias("illegal"), F.count_if(F.col("new") & F.col("turn").isNotNull()).alias("turns"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.min(border).alias("head"), F.max(border).alias("tail"),
        F.sort_array(F.collect_list(F.struct("position", "symbol", "turn", "role", "text"))).alias("rows"),
    )
    return found.withColumn("signature", F.array_join(F.transform("rows", lambda r: r["symbol"]), ""))


_GAPS = "coalesce(high - low + 1 - turns, 0) as gaps"
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _messages(script: str, rows: str) -> Column:
    def message(s: Column) -> Column:
        row = F.when(s["edit"] != "I", F.get(F.col(rows), s["at"]))
        return F.struct(s["edit"].alias("edit"), row["turn"].alias("turn"), F.coalesce(s["role"], row["role"]).alias("role"), F.coalesce(row["text"], F.lit("")).alias("text"))

    return F.transform(script, message)


def _folded(tables: DataFrame) -> DataFrame:
    """(conv, table) of whole conversations from (conv, block, table), FOLD blocks at a time."""
    schema = f"conv {tables.schema['conv'].dataType.simpleString()}, block long, table {_TABLE}"

    def fold(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        table = functools.reduce(composed, (r["table"] for r in rows))
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "block": rows[0]["block"] // FOLD, "table": table}], group.schema)

    last = tables.agg(F.max("block")).first()[0]
    while last > 0:
        level = tables.withColumn("_of", F.floor(F.col("block") / FOLD))
        tables, last = staged(level.groupBy("conv", "_of").applyInArrow(lambda _, g: fold(g.select(["conv", "block", "table"])), schema), "repair-tables"), last // FOLD
    return tables.select("conv", "table")


def _pieces(whole: DataFrame) -> DataFrame:
    """(conv, gaps, counts, cost, audit, sizes) -> a row for each block, with its piece of the audit and the number of messages before.

    The counts come with every piece, the audit with the first.
    """
    fields = [("_conv", pa.int64()), ("_block", pa.int64()), ("piece", pa.string()), ("before", pa.int64()), ("odd", pa.int64()), ("blocks", pa.int64()), *((c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")), ("audit", pa.string())]
    kind = whole.schema["conv"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("_conv", batch.schema.field("conv").type), *fields[1:]])
            for r in batch.to_pylist():
                found, at, before, audit = [], 0, 0, r["audit"]
                told = {c: r[c] for c in ("gaps", *_COUNTS, "cost")} | {"_conv": r["conv"], "blocks": len(r["sizes"]), "odd": (len(audit) - audit.count("D")) % 2}
                for here in r["sizes"]:
                    end, left = at, here["n"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    end = len(audit) if here is r["sizes"][-1] else end
                    piece, at = audit[at:end], end
                    found.append(told | {"_block": here["block"], "piece": piece, "before": before, "audit": None if here["block"] else audit})
                    before += len(piece) - piece.count("D")
                yield pa.RecordBatch.from_pylist(found, schema)

    return whole.mapInArrow(cut, f"_conv {kind}, _block long, piece string, {', '.join(f'{n} long' for n, _ in fields[3:-1])}, audit string")


def _repaired_long(rows: DataFrame, most: int) -> DataFrame:
    """Conversations of several blocks."""
    placed = staged(in_blocks(rows, "conv", ["turn", "role", "text"], F.lit(ROW_WEIGHT) + F.octet_length("text"), most), "repair-rows")
    same = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.length("role"), "role", "text"), 256)
    placed = placed.withColumn("same", same)
    firsts = staged(placed.groupBy("same").agg(F.min("position").alias("first"), F.count("*").alias("n")), "repair-firsts")
    known = joined_by_count(placed, firsts, "same", firsts.agg(F.sum("n")).first()[0])
    blocks = staged(_blocks(_judged(known, F.col("first"))).withColumn("table", F.arrow_udf(_tables, _TABLE)("signature")), "repair-blocks")
    best = _folded(blocks.select("conv", "block", "table")).select(F.col("conv").alias("_conv"), _best("table").alias("best"))
    by = Window.partitionBy("conv").orderBy("block")
    linked = blocks.withColumn("prior", F.lag("tail").over(by)).withColumn("here", F.struct("block", F.size("rows").alias("n")))
    joint = F.coalesce((~F.concat("prior.initial", "head.initial").isin("su", "ua", "au")).cast("long"), F.lit(0))
    again = F.coalesce((F.col("prior.turn") == F.col("head.turn")).cast("long"), F.lit(0))
    reports = linked.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in _COUNTS[:3]), F.sum(F.col("illegal") + joint).alias("illegal"), F.sum(F.col("turns") - again).alias("turns"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list("here")).alias("sizes"),
    )
    reports = staged(reports.join(best, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", F.expr(_GAPS), *_COUNTS, "best.cost", "best.audit", "sizes"), "repair-reports")
    joined = blocks.select("conv", "block", "rows").join(_pieces(reports), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    scripted = joined.withColumn("script", F.arrow_udf(_scripts, _MESSAGE)("piece", "before", "odd"))
    return scripted.select("conv", "block", "blocks", "gaps", *_COUNTS, "cost", "audit", _messages("script", "rows").alias("messages"))


def _repaired(conversations: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Conversations of one block, and of several if there are any."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")).withColumn("initial", F.substring("role", 1, 1))
    short, long = heavy_parted(rows, "conv", F.lit(ROW_WEIGHT) + F.octet_length("text"), most)
    by = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = short.withColumn("position", (F.row_number().over(by) - 1).cast("long")).withColumn("block", F.lit(0).cast("long"))
    placed = placed.withColumn("first", F.min("position").over(Window.partitionBy("conv", "role", "text")))
    best = _blocks(_judged(placed, F.col("first"))).withColumn("table", F.arrow_udf(_tables, _TABLE)("signature")).withColumn("best", _best("table"))
    scripted = best.withColumn("script", F.arrow_udf(_scripts, _MESSAGE)("best.audit", F.lit(0).cast("long"), (_outputs(F.col("best.audit")) % 2).cast("long")))
    found = scripted.select(F.col("conv").alias("conv_id"), "block", F.lit(1).cast("long").alias("blocks"), F.expr(_GAPS), *_COUNTS, "best.cost", "best.audit", _messages("script", "rows").alias("messages"))
    return found, long and staged(_repaired_long(long, most), "long-conversations").withColumnRenamed("conv", "conv_id")


def repair(conversations: DataFrame, most: int = BLOCK_WEIGHT) -> DataFrame:
    """Repaired conversations in blocks: conv_id, block, blocks, gaps, counts of faults, cost, audit and messages.

    Each message has its edit (K kept, R reroled, D deleted, I inserted), turn, role and text; those deleted
    are listed too. The audit is given in block 0. Rows of one turn come by role, then text; equal rows are
    duplicates of the first. Null roles and texts are one space. Rows without id are one conversation; other
    columns are left out. A conversation that weighs ``most`` or less (its bytes, and ROW_WEIGHT for each row) is one block.
    """
    short, long = _repaired(conversations, most)
    return short.unionByName(long) if long else short


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of id and turn: dropped, emptied, stripped of sentence ends, repeated or given the user's role."""
    space = F.lit(" ")
    kept = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    told = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    hurt = kept.withColumn("kind", F.crc32(told) % 20).where("kind != 0")
    return hurt.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def _lines(messages: str) -> Column:
    kept = F.filter(messages, lambda m: m["edit"] != "D")
    return F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def _streamed(blocks: DataFrame) -> DataFrame:
    """(conv_id, sha256) of lines that lie in several blocks, which pass by in order; the state of one digest is all that is kept."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of, schema = None, None, None
        for batch in batches:
            done, schema = [], pa.schema([batch.schema.field("conv_id"), pa.field("sha256", pa.string())])
            for r in batch.to_pylist():
                if r["block"] == 0:
                    if state:
                        done.append({"conv_id": of, "sha256": state.hexdigest()})
                    state, of, begun = hashlib.sha256(), r["conv_id"], False
                if r["n"]:
                    state.update(("\n" * begun + r["lines"]).encode("utf-8", "surrogatepass"))
                    begun = True
            yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([{"conv_id": of, "sha256": state.hexdigest()}], schema)

    told = blocks.select("conv_id", "block", F.size(F.filter("messages", lambda m: m["edit"] != "D")).alias("n"), _lines("messages").alias("lines"))
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digests, f"conv_id {kind}, sha256 string")


def reports(conversations: DataFrame, every: DataFrame, most: int = BLOCK_WEIGHT) -> DataFrame:
    """A row for each ``conv_id`` of ``every``: gaps, counts of faults, cost, audit and the SHA-256 of the repaired ``role:text`` lines.

    A digest can't be made in parts, so the lines of a conversation of several blocks pass through one task, block
    by block. Ids without rows in ``conversations`` have zeros, an empty audit and the digest of nothing.
    """
    short, long = _repaired(conversations, most)
    columns = ["gaps", *_COUNTS, "cost", "audit"]
    whole = short.select(F.col("conv_id").alias("_id"), *columns, F.sha2(_lines("messages"), 256).alias("sha256"))
    if long:
        digests = _streamed(long)
        told = long.where("block = 0").select(F.col("conv_id").alias("_id"), *columns)
        whole = whole.unionByName(told.join(digests, told["_id"].eqNullSafe(digests["conv_id"])).drop("conv_id"))
    ids = every.select("conv_id").distinct()
    found = ids.join(whole, ids["conv_id"].eqNullSafe(whole["_id"]), "left")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns[:-1]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
