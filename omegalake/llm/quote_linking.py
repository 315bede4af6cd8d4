"""Chat formatting by quotation linking.

A message's lines are parsed into its own text and quoted passages with their nesting level.
Quoted lines, sentences, paragraphs and whole quoted passages are normalised and hashed, and joined to the
messages of the same conversation that say them first; the message that most of them lead to is the one
replied to, of the outermost level that leads anywhere if levels are told apart. Conversations are built in reply order: each message, without its quotes,
comes after the one it answers and before all later answers to that one (depth first, answers by turn).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.keyed import running_total
from .common import joined_by_count, staged

_QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
#: Lines that introduce a quotation.
_ATTRIBUTION = re.compile(r"\s*(?:On\b.*\bwrote|Am\b.*\bschrieb\b.*|Le\b.*\ba écrit|El\b.*\bescribió)\s*:\s*")
_WORD = re.compile(r"\w+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")

_MESSAGE = "own string, levels int, quoted array<long>, said array<long>, depths array<int>"


def normalised_hash(text: str) -> int | None:
    """Hash of the words in lower case, or None without words."""
    words = _WORD.findall(text.lower())
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63) if words else None


def parse(text: str) -> tuple[str, int, list[int], list[int]]:
    """(text without quotes, deepest level, hashes of what it quotes, hashes of what it says).

    A line's level is the number of ``>`` before its text; adjoining lines of one level are a
    passage. Lines that introduce a quotation go with it. Hashed are the lines, sentences, paragraphs and
    whole of each passage and of its own text; line breaks within sentences and paragraphs don't count.
    """
    return parse_levels(text)[:4]


def _parts(text: str) -> list[str]:
    paragraphs = _PARAGRAPH.split(text)
    return [*text.split("\n"), *(s for p in paragraphs for s in _SENTENCE.split(p)), *paragraphs, text]


def parse_levels(text: str) -> tuple[str, int, list[int], list[int], list[int]]:
    """As ``parse``, and the outermost level of each hash that it quotes."""
    passages: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _QUOTED.fullmatch(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if not passages or passages[-1][0] != level:
            passages.append((level, []))
        passages[-1][1].append(rest)
    for (level, lines), (following, _) in zip(passages, passages[1:]):
        if following > level and lines and _ATTRIBUTION.fullmatch(lines[-1]):
            lines.pop()
    own = "\n".join("\n".join(lines) for level, lines in passages if level == 0)
    own = re.sub(r"\n{3,}", "\n\n", own).strip()

    def hashes(parts: Iterable[str]) -> list[int]:
        return list(dict.fromkeys(h for p in parts if (h := normalised_hash(p)) is not None))

    depths: dict[int, int] = {}
    for level, lines in passages:
        for h in hashes(_parts("\n".join(lines))) if level else ():
            depths[h] = min(level, depths.get(h, level))
    return own, max((level for level, _ in passages), default=0), list(depths), hashes(_parts(own)), list(depths.values())


def _parsed(messages: DataFrame) -> DataFrame:
    kept = messages.columns

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_levels(t or "") for t in batch.column(len(kept) - 1).to_pylist()]
            own, levels, quoted, said, depths = zip(*found) if found else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.string()), pa.array(levels, pa.int32()), pa.array(quoted, pa.list_(pa.int64())), pa.array(said, pa.list_(pa.int64())), pa.array(depths, pa.list_(pa.int32()))], [*kept[:-1], "own", "levels", "quoted", "said", "depths"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields[:-1])
    return messages.mapInArrow(rows, f"{schema}, {_MESSAGE}")


def _positions(messages: DataFrame) -> DataFrame:
    """Adds ``position``: a message's number in its conversation, from 0, by turn.

    Ranges of (conversation, turn) rather than whole conversations are ranked, so that one
    conversation may hold any share of the messages.
    """
    order = ["conv", "turn", "role", "text"]
    ranged = messages.repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged-messages")
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "role", "text", "row")) - 1
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = ranged.withColumn("own_rank", own)
    placed = ranked.join(bases, ranked["conv"].eqNullSafe(bases["c"]) & (ranked["part"] == bases["p"]))
    return placed.select("conv", "turn", "role", (F.col("base") + F.col("own_rank")).alias("position"), "text")


def link_quotes(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", nested: bool = False) -> DataFrame:
    """A row for each message: conv_id, position, turn, role, reply_to, n_quotes, n_linked, levels, text.

    position: place in the conversation, by turn (ties by role and text). reply_to: position of
    the message that most of its quotes lead to (of equals the latest), else of the one before; null for
    the first. nested: only quotes of the outermost level that leads to a message decide, since deeper ones
    are what that message quoted itself. n_quotes counts distinct quoted lines, sentences, paragraphs and passages, n_linked those found in an earlier message of the
    conversation (each leads to the first that says it). text: the message without quotes. Null
    text is empty; messages without conversation form one; repeated rows are separate messages.
    """
    own = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parsed = staged(_parsed(_positions(own.select("conv", "turn", "role", "row", "text"))), "parsed-messages")
    passage = F.struct("conv", "h").alias("passage")  # structs with null fields are equal
    said = parsed.select("conv", F.explode("said").alias("h"), F.col("position").alias("at"))
    first = said.groupBy(passage).agg(F.min("at").alias("source"))
    asked = parsed.select("conv", F.explode(F.arrays_zip("quoted", "depths")).alias("z"), "position").select("conv", "position", F.col("z.quoted").alias("h"), F.col("z.depths").alias("depth"))
    asked = asked.select("conv", "position", "depth", passage)
    # A passage that very many messages quote is not brought to one task.
    times = asked.groupBy("passage").agg(F.count("*").alias("n"))
    met = joined_by_count(asked, first.join(times, "passage"), "passage", asked.count())
    links = met.where(F.col("source") < F.col("position")).select("conv", "position", "source", (F.col("depth") if nested else F.lit(1)).alias("depth"))
    votes = links.groupBy("conv", "position", "depth", "source").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("conv", "position").agg(F.max(F.struct(-F.col("depth"), "votes", "source"))["source"].alias("source"), F.sum("votes").alias("n_linked")).alias("c")
    p = parsed.alias("p")
    joined = p.join(chosen, F.col("p.conv").eqNullSafe(F.col("c.conv")) & (F.col("p.position") == F.col("c.position")), "left")
    before = F.when(F.col("p.position") > 0, F.col("p.position") - 1)
    return joined.select(
        F.col("p.conv").alias("conv_id"), F.col("p.position").alias("position"), F.col("p.turn").alias("turn"), F.col("p.role").alias("role"),
        F.coalesce("c.source", before).alias("reply_to"), F.size("p.quoted").cast("long").alias("n_quotes"), F.coalesce("c.n_linked", F.lit(0)).alias("n_linked"),
        F.col("p.levels").alias("levels"), F.col("p.own").alias("text"),
    )


def _same(a: str, b: str, at: str):
    """The row of ``b`` for the message that ``at`` of ``a`` names."""
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{at}") == F.col(f"{b}.position"))


def reply_order(linked: DataFrame) -> DataFrame:
    """(conv, position, place) of (conv, position, reply_to): each message's number in reply order, from 0.

    A message is followed by its first answer with all that answer that one, then by its next answer, and
    so on: the tree of answers, depth first, answers by position. Where every message answers the one before,
    that is their order. Else the next message in the tree is found for all at once, and distances to the end by pointers that
    reach twice as far in each round: as many rounds as the logarithm of the longest conversation, each
    with joins on single messages, so that a conversation of any size is spread.
    """
    jumps = linked.where("reply_to != position - 1").select("conv").distinct().alias("j")
    if jumps.isEmpty():
        return linked.select("conv", "position", F.col("position").alias("place"))
    conversation = F.col("l.conv").eqNullSafe(F.col("j.conv"))
    straight = linked.alias("l").join(jumps, conversation, "left_anti").select("conv", "position", F.col("position").alias("place"))
    nodes = staged(linked.alias("l").join(jumps, conversation, "left_semi").select("conv", "position", "reply_to"), "messages-in-trees")
    # The next answer to the same message has the next number among all answers.
    numbered = staged(running_total(nodes.where("reply_to is not null"), ["conv", "reply_to", "position"], F.lit(1), "number"), "answers")
    later = numbered.select((F.col("number") - 1).alias("number"), F.col("conv").alias("c"), F.col("reply_to").alias("r"), F.col("position").alias("sibling"))
    answers = numbered.join(later, "number", "left").select("conv", "position", F.when(F.col("conv").eqNullSafe(F.col("c")) & (F.col("reply_to") == F.col("r")), F.col("sibling")).alias("sibling"))
    # After a message without answers comes the next answer beside it or beside the nearest message above that has one.
    own = nodes.alias("n").join(answers.alias("a"), _same("n", "a", "position"), "left").select("n.conv", "n.position", F.col("sibling").alias("found"), F.when(F.col("sibling").isNull(), F.col("reply_to")).alias("above"))
    own = staged(own, "above")
    while not own.where("above is not null").isEmpty():
        found, above = F.coalesce("a.found", "b.found"), F.when(F.coalesce("a.found", "b.found").isNull(), F.col("b.above"))
        own = staged(own.alias("a").join(own.alias("b"), _same("a", "b", "above"), "left").select("a.conv", "a.position", found.alias("found"), above.alias("above")), "above")
    child = nodes.where("reply_to is not null").groupBy("conv", F.col("reply_to").alias("position")).agg(F.min("position").alias("child"))
    ahead = own.alias("a").join(child.alias("b"), _same("a", "b", "position"), "left").select("a.conv", "a.position", F.coalesce("child", "found").alias("next"), F.lit(1).cast("long").alias("left"))
    ahead = staged(ahead, "ahead")
    while not ahead.where("next is not null").isEmpty():
        left = F.col("a.left") + F.coalesce("b.left", F.lit(0))
        ahead = staged(ahead.alias("a").join(ahead.alias("b"), _same("a", "b", "next"), "left").select("a.conv", "a.position", F.col("b.next").alias("next"), left.alias("left")), "ahead")
    whole = F.struct("conv").alias("whole")
    sizes = nodes.groupBy(whole).agg(F.count("*").alias("n"), F.count("*").alias("size"))
    placed = joined_by_count(ahead.select("conv", "position", "left", whole), sizes, "whole", nodes.count())
    return straight.union(placed.select("conv", "position", (F.col("size") - F.col("left")).alias("place")))


def as_conversations(linked: DataFrame, most: int = 1000) -> DataFrame:
    """(conv_id, part, n_messages, messages) of ``link_quotes``: each conversation in reply order, in parts of at most ``most`` messages.

    A message: place (its number in reply order), position, turn, role, reply_to, n_quotes, n_linked,
    levels and its text without quotes. No messages: no rows.
    """
    linked = staged(linked, "linked-messages")
    order = reply_order(linked.select(F.col("conv_id").alias("conv"), "position", "reply_to"))
    placed = linked.alias("l").join(order.alias("o"), F.col("l.conv_id").eqNullSafe(F.col("o.conv")) & (F.col("l.position") == F.col("o.position")))
    message = F.struct("o.place", "l.position", "l.turn", "l.role", "l.reply_to", "l.n_quotes", "l.n_linked", "l.levels", "l.text")
    parts = placed.groupBy("l.conv_id", F.floor(F.col("o.place") / most).alias("part"))
    return parts.agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(message)).alias("messages"))
