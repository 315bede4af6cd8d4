"""Formula tokens and what follows from them, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("X", "F", "G", "U", "W", "R", "M", "!", "&", "|", "->", "<->")
UNARY_TEMPORAL, BINARY_TEMPORAL, LOGICAL = ("X", "F", "G"), ("U", "W", "R", "M"), ("!", "&", "|", "->", "<->")

#: Lenient tokens: operators and parentheses; a lone < or -; and runs of anything else.
LENIENT = r"<->|->|[()&|!]|[<-]|[^\s()&|!<-]+"
#: Corpus tokens: doubled and bracketed operators; operator letters break words wherever they stand; a slash is dropped.
CORPUS = r"<->|->|&&|\|\||\[\]|<>|[()!&|]|[UWRMXFG]|[^\s()!&|UWRMXFG<>\[\]/-]+|[<>\[\]-]"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    return _matches(text, LENIENT)


def corpus_tokens(text: Column) -> Column:
    """With [] as G, <> as F, && as & and || as |."""
    standard = F.create_map(*(F.lit(x) for pair in (("[]", "G"), ("<>", "F"), ("&&", "&"), ("||", "|")) for x in pair))
    return renamed(_matches(text, CORPUS), standard)


def is_operator(token: Column) -> Column:
    return token.isin(*OPERATORS)


def is_proposition(token: Column) -> Column:
    return ~token.isin(*OPERATORS, "(", ")", "true", "false")


def core(found: Column) -> Column:
    """Tokens without parentheses."""
    return F.filter(found, lambda t: ~t.isin("(", ")"))


def size(found: Column) -> Column:
    return F.size(core(found))


def operators(found: Column) -> Column:
    """Distinct operators in order of appearance."""
    return F.array_distinct(F.filter(found, is_operator))


def propositions(found: Column) -> Column:
    return F.array_distinct(F.filter(found, is_proposition))


def count_of(found: Column, operator: str) -> Column:
    return F.size(F.filter(found, lambda t: t == operator))


def operator_counts(found: Column) -> Column:
    """All operators, those that don't occur with 0."""
    return F.create_map(*(x for op in OPERATORS for x in (F.lit(op), count_of(found, op))))


def paren_depth(found: Column) -> Column:
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, t: Column) -> Column:
        now = F.when(t == "(", s["now"] + 1).when(t == ")", F.greatest(F.lit(0), s["now"] - 1)).otherwise(s["now"])
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(found, state, step, lambda s: s["most"])


def temporal_nesting(found: Column) -> Column:
    """Scan depth: a unary temporal token opens a level, every ) closes one while any is open."""
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, t: Column) -> Column:
        now = F.when(t.isin(*UNARY_TEMPORAL), s["now"] + 1).when(t == ")", F.greatest(F.lit(0), s["now"] - 1)).otherwise(s["now"])
        seen = F.when(t.isin(*BINARY_TEMPORAL), F.greatest(F.lit(1), now)).otherwise(now)
        return F.struct(now.alias("now"), F.greatest(s["most"], seen).alias("most"))

    return F.aggregate(found, state, step, lambda s: s["most"])


def nesting(found: Column) -> Column:
    return F.greatest(paren_depth(found), temporal_nesting(found))


def behaviour_label(found: Column) -> Column:
    temporal = F.filter(found, lambda t: t.isin(*UNARY_TEMPORAL, *BINARY_TEMPORAL))
    return (
        F.when(F.size(temporal) == 0, "non_temporal")
        .when(F.forall(temporal, lambda t: t == "G"), "safety")
        .when(F.forall(temporal, lambda t: t == "F"), "eventuality")
        .when(F.exists(temporal, lambda t: t.isin(*BINARY_TEMPORAL)), "until_release")
        .when(F.exists(temporal, lambda t: t == "X"), "next_step")
        .otherwise("mixed_temporal")
    )


#: Tag and the texts that must and must not occur.
TAGS = (
    ("safety", ("G(",), ("F(",)),
    ("liveness", ("F(",), ("G(",)),
    ("recurrence", ("G(F(",), ()),
    ("persistence", ("F(G(",), ()),
    ("until", ("U",), ()),
    ("weak_until", ("W",), ()),
    ("release", ("R",), ()),
    ("next_step", ("X(",), ()),
    ("conditional", ("->",), ()),
)


def behaviour_tags(text: Column) -> Column:
    """Tags of a rendered formula, or ["other"]."""
    found = []
    for tag, needed, absent in TAGS:
        test = F.lit(True)
        for part in needed:
            test = test & text.contains(part)
        for part in absent:
            test = test & ~text.contains(part)
        found.append(F.when(test, F.lit(tag)))
    tags = F.array_compact(F.array(*found))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("other")))


def renaming(found: Column) -> Column:
    """Propositions in order of appearance to prop_1, prop_2, ..."""
    own = propositions(found)
    return F.map_from_arrays(own, F.transform(own, lambda _, k: F.concat(F.lit("prop_"), k + 1)))


def renamed(found: Column, mapping: Column) -> Column:
    """Tokens by the mapping, which is made once for each row."""
    return F.get(F.transform(F.array(mapping), lambda m: F.transform(found, lambda t: F.coalesce(F.try_element_at(m, t), t))), F.lit(0))


def canonical(found: Column) -> Column:
    """Tokens with canonical names, separated by spaces."""
    return F.array_join(renamed(found, renaming(found)), " ")


def is_trivial(found: Column) -> Column:
    """A single proposition, negated or not."""
    own = core(found)
    one = (F.size(own) == 1) & F.exists(own, is_proposition)
    return one | ((F.size(own) == 2) & (F.get(own, F.lit(0)) == "!") & is_proposition(F.get(own, F.lit(1))))


# Measures of well-formed formulas.

#: Tokens of dataset formulas: operator letters are tokens wherever a word could begin; words have no leading underscore.
STRICT = r"(?U)<->|->|[()!&|]|[UWRMXFG]|[^\W_]\w*"
#: How tightly binary operators bind; those of RIGHT group to the right.
LEVELS = {"<->": 0, "->": 1, "|": 2, "&": 3, "U": 4, "W": 4, "R": 4, "M": 4}
RIGHT = (0, 1)
#: Operators that the temporal depth counts.
DEEPENING = ("X", "F", "G", "U", "R", "W")
#: Formulas with more open parentheses at once have no measures.
MOST_OPEN = 2_000

_FRAME = "struct<floor:array<int>,rise:array<int>,tfloor:array<int>,trise:array<int>,ops:int,tops:int>"


def _struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _fresh() -> Column:
    """A parenthesis without pending operators."""
    none, still = F.array_repeat(F.lit(-1), 5), F.array_repeat(F.lit(0), 5)
    return _struct(floor=none, rise=still, tfloor=none, trise=still, ops=F.lit(0), tops=F.lit(0)).cast(_FRAME)


def _lifted(value: Column, floor: Column, rise: Column, above: Column | int) -> Column:
    """A depth under the pending operators that bind tighter than ``above``, the tightest first."""
    return F.aggregate(F.sequence(F.lit(4), F.lit(0), F.lit(-1)), value, lambda x, k: F.when(k > above, F.greatest(F.get(floor, k), x + F.get(rise, k))).otherwise(x))


def measures(text: Column) -> Column:
    """(size, depth, temporal_depth) of a formula, null if it is not well formed; without a parser, in one pass over its tokens.

    What is pending in a parenthesis (left operands and operators, at most one set of them for each binding strength, and
    prefix operators) turns the depth x of the operand to come into max(floor, x + rise). Such functions compose to one of
    their kind, so a parenthesis is a few numbers, and a formula a stack of them.
    """
    found = F.regexp_extract_all(text, F.lit(STRICT), F.lit(0))
    clean = F.regexp_replace(text, F.lit(STRICT + r"|\s"), F.lit("")) == ""
    stack = F.array().cast(f"array<{_FRAME}>")
    level_of = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    start = _struct(stack=stack, frame=_fresh(), depth=F.lit(0), tdepth=F.lit(0), due=F.lit(True), good=F.lit(True))

    def step(s: Column, t: Column) -> Column:
        frame, stack, due = s["frame"], s["stack"], s["due"]
        deepens = t.isin(*DEEPENING).cast("int")
        level = F.coalesce(F.try_element_at(level_of, t), F.lit(-1))

        def state(**changed: Column) -> Column:
            return _struct(**{n: changed.get(n, s[n]) for n in ("stack", "frame", "depth", "tdepth", "due", "good")})

        prefix = state(frame=frame.withField("ops", frame["ops"] + 1).withField("tops", frame["tops"] + deepens), good=s["good"] & due)
        opened = state(stack=F.array_append(stack, frame), frame=_fresh(), good=s["good"] & due)
        # The operand is whole: its prefix operators are spent.
        spent = frame.withField("ops", F.lit(0)).withField("tops", F.lit(0))
        atom = state(frame=spent, depth=frame["ops"], tdepth=frame["tops"], due=F.lit(False), good=s["good"] & due)
        # A binary operator: all that binds tighter, or as tight and groups to the left, has its right operand.
        above = F.when(level.isin(*RIGHT), level).otherwise(level - 1)
        left, tleft = _lifted(s["depth"], frame["floor"], frame["rise"], above), _lifted(s["tdepth"], frame["tfloor"], frame["trise"], above)

        def pending(floor: Column, rise: Column, value: Column, add: Column) -> tuple[Column, Column]:
            # max(floor, max(value + add, x + add) + rise)
            own = F.greatest(F.get(floor, level), value + add + F.get(rise, level))
            first = value + add
            held = level.isin(*RIGHT)
            return (
                F.transform(floor, lambda v, k: F.when(k > level, -1).when(k == level, F.when(held, own).otherwise(first)).otherwise(v)),
                F.transform(rise, lambda v, k: F.when(k > level, 0).when(k == level, F.when(held, v + add).otherwise(add)).otherwise(v)),
            )

        floor, rise = pending(frame["floor"], frame["rise"], left, F.lit(1))
        tfloor, trise = pending(frame["tfloor"], frame["trise"], tleft, deepens)
        binary = state(frame=_struct(floor=floor, rise=rise, tfloor=tfloor, trise=trise, ops=F.lit(0), tops=F.lit(0)).cast(_FRAME), due=F.lit(True), good=s["good"] & ~due)
        outer = F.get(stack, F.size(stack) - 1)
        closed = state(
            stack=F.slice(stack, F.lit(1), F.greatest(F.lit(0), F.size(stack) - 1)), frame=F.coalesce(outer, _fresh()).withField("ops", F.lit(0)).withField("tops", F.lit(0)),
            depth=_lifted(s["depth"], frame["floor"], frame["rise"], -1) + F.coalesce(outer["ops"], F.lit(0)), tdepth=_lifted(s["tdepth"], frame["tfloor"], frame["trise"], -1) + F.coalesce(outer["tops"], F.lit(0)),
            due=F.lit(False), good=s["good"] & ~due & outer.isNotNull(),
        )
        read = F.when(t.isin("!", "X", "F", "G"), prefix).when(t == "(", opened).when(t == ")", closed).when(level >= 0, binary).otherwise(atom)
        return F.when(s["good"], read).otherwise(s)

    def end(s: Column) -> Column:
        whole = s["good"] & ~s["due"] & (F.size(s["stack"]) == 0)
        depth = _lifted(s["depth"], s["frame"]["floor"], s["frame"]["rise"], -1)
        return F.when(whole, _struct(size=F.lit(0), depth=depth, temporal_depth=_lifted(s["tdepth"], s["frame"]["tfloor"], s["frame"]["trise"], -1)))

    read = F.aggregate(found, start, step, end)
    return F.when(clean & (paren_depth(found) <= MOST_OPEN), read.withField("size", size(found)))
