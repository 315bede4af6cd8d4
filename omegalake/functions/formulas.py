"""Formula functions that need the grammar, as Arrow functions over distinct values.

All take formula texts and remember results per worker. Texts that don't parse give null (and
``parse_error`` in the metrics). Apply cheap native filters first, and to a table of distinct formulas
where texts repeat.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..logic import decide, rewrite, syntax

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _fields(**kinds: T.DataType) -> T.StructType:
    # Types as objects: a type in words needs a session to be read, and workers import this module too.
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


#: Order in which one of several equivalent formulas is preferred.
PREFERENCE = _fields(size=_I, depth=_I, operators=_I, length=_I, text=_S)
METRICS = _fields(
    ast_size=_I, ast_depth=_I, temporal_depth=_I, operator_counts=T.MapType(_S, _I), propositions=T.ArrayType(_S), is_temporal=_B, is_trivial=_B, looks_unsatisfiable=_B,
    rendered=_S, simplified=_S, selected=_S, normalized=_S, preference=PREFERENCE, parse_error=_B,
)


#: Formulas nested deeper count as not parsed.
DEEPEST = 150


@lru_cache(maxsize=1 << 15)
def _parsed(text: str | None, dialect: str = "strict"):
    if text is None or not text.strip():
        return None
    try:
        found = syntax.parse(text, {"strict": syntax.STRICT, "checker": syntax.CHECKER}[dialect])
        return found if syntax.depth(found) <= DEEPEST else None
    except (ValueError, RecursionError):
        return None


@lru_cache(maxsize=1 << 15)
def _metrics(text: str | None) -> dict:
    f = _parsed(text)
    if f is None:
        return {"parse_error": text is not None}
    size, depth, operators, length, shown = rewrite.preference(f)
    return {
        "ast_size": size,
        "ast_depth": syntax.depth(f),
        "temporal_depth": depth,
        "operator_counts": dict(syntax.operator_counts(f)),
        "propositions": syntax.propositions(f),
        "is_temporal": rewrite.is_temporal(f),
        "is_trivial": rewrite.is_trivial(f),
        "looks_unsatisfiable": rewrite.looks_unsatisfiable(f),
        "rendered": shown,
        "simplified": syntax.render(rewrite.simplify(f)),
        "selected": syntax.render(syntax.checker_names(rewrite.selected(f))),
        "normalized": syntax.render(syntax.canonical_names(f)),
        "preference": {"size": size, "depth": depth, "operators": operators, "length": length, "text": shown},
        "parse_error": False,
    }




@F.pandas_udf(METRICS)
def ltl_metrics(texts: pd.Series) -> pd.DataFrame:
    rows = [_metrics(t) for t in texts]
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in METRICS.fieldNames()})


#: What the functions of one formula give, and the grammar that they read it by.
_VALUES = {
    "nl": (syntax.english, "strict"),
    "simplify": (lambda f: syntax.render(rewrite.simplify(f)), "strict"),
    "canonical": (lambda f: syntax.render(syntax.canonical_names(rewrite.simplify(rewrite.without_weak_operators(f)))), "strict"),
    "signature": (decide.signature, "checker"),
    "status": (decide.status, "checker"),
    "is_valid": (lambda f: True, "checker"),
}


@lru_cache(maxsize=1 << 17)
def _value(name: str, text: str | None):
    function, dialect = _VALUES[name]
    f = _parsed(text, dialect)
    return None if f is None else function(f)


def _function(name: str, kind: T.DataType = _S):
    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_value(name, t) for t in texts], dtype=object)

    return of


ltl_to_nl, ltl_simplify, ltl_canonical = _function("nl"), _function("simplify"), _function("canonical")
ltl_signature, ltl_status, ltl_is_valid = _function("signature"), _function("status"), _function("is_valid", _B)


@lru_cache(maxsize=1 << 15)
def _automaton(text: str | None) -> dict:
    f = _parsed(text, "checker")
    found = decide.automaton_size(f) if f is not None else None
    return {"states": found[0], "transitions": found[1]} if found else {}


@F.pandas_udf(_fields(states=_I, transitions=_I))
def ltl_automaton(texts: pd.Series) -> pd.DataFrame:
    """Nodes and edges of the formula's graph of obligations (this library's own measure of automaton size)."""
    rows = [_automaton(t) for t in texts]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("states", "transitions")})


@lru_cache(maxsize=1 << 16)
def _equivalent(a: str | None, b: str | None) -> bool | None:
    f, g = _parsed(a, "checker"), _parsed(b, "checker")
    return None if f is None or g is None else decide.equivalent(f, g)


@F.pandas_udf(_B)
def ltl_equivalent(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two formulas hold on the same words; null if either doesn't parse or the bound is reached."""
    return pd.Series([_equivalent(x, y) for x, y in zip(a, b)], dtype=object)


def ltl_equivalent_or_false(a: Column, b: Column) -> Column:
    return F.coalesce(ltl_equivalent(a, b), F.lit(False))


@lru_cache(maxsize=1 << 15)
def _repaired(text: str) -> dict:
    if not text:
        return {"status": "empty_output"}
    if _parsed(text, "checker") is not None:
        return {"formula": text, "status": "already_valid"}
    try:
        try:
            f, status = syntax.parse(text, syntax.LOOSE), "restructured_from_infix"
        except ValueError:
            f, status = syntax.best_letter_prefix(text), "restructured_from_prefix"
        shown = f if f is None else syntax.render_repaired(f)
    except RecursionError:
        shown = None
    if shown is None:
        return {"status": "parse_failed"}
    return {"formula": shown, "status": status} if _parsed(shown, "checker") is not None else {"status": "normalized_but_invalid"}


@F.pandas_udf(_fields(formula=_S, status=_S))
def ltl_repair(texts: pd.Series) -> pd.DataFrame:
    """Model output (cleaned by ``text.raw_output``) in the target syntax: kept if valid, else read as infix, else as
    the longest prefix form in it."""
    rows = [_repaired(t or "") for t in texts]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("formula", "status")})


@F.pandas_udf(_S)
def ltl_from_word_prefix(texts: pd.Series) -> pd.Series:
    """Polish notation with spelled words as infix; null where tokens are left over or missing."""

    def read(text):
        try:
            return syntax.word_prefix(text)
        except (ValueError, TypeError, RecursionError):
            return None

    return pd.Series([read(t) for t in texts], dtype=object)


def is_nnf(found: Column) -> Column:
    """Whether lenient tokens form a fully parenthesised formula of &, |, U, X, F and G with only propositions negated.

    The tokens, joined, are reduced by replacing innermost well-formed parts with an atom; native. Every round
    that changes anything takes a token away, so there are as many rounds as tokens, and none is missing at any depth.
    Meant for distinct formulas.
    """
    atom = F.transform(found, lambda t: F.when(t.rlike(r"^prop_\w+$"), F.lit("p")).otherwise(t))
    text = F.concat(F.lit(" "), F.array_join(atom, " "), F.lit(" "))

    def reduced(text: Column, _: Column) -> Column:
        text = F.regexp_replace(text, r" \( p \) ", " p ")
        text = F.regexp_replace(text, r" ! p ", " q ")
        text = F.regexp_replace(text, r" [XFG] [pq] ", " q ")
        return F.regexp_replace(text, r" \( [pq] (?:[&|U] [pq] )?\) ", " q ")

    rounds = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)))
    return F.trim(F.aggregate(rounds, text, reduced)).isin("p", "q")


def scanned_depth(found: Column, deepening: tuple[str, ...] = ("U", "W", "R", "M")) -> Column:
    """``syntax.scanned_depth`` of an array of tokens."""

    @F.pandas_udf(_I)
    def of(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else syntax.scanned_depth(list(a), deepening) for a in arrays], dtype=object)

    return of(found)
