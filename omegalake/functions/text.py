"""Clean-up of texts and model output, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lex import renamed


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(blank_to_null(c.cast("string")) for c in columns))


def surface_form(text: Column) -> Column:
    """Without white space and parentheses."""
    return F.regexp_replace(text, r"[\s()]", "")


def has_different_simplified(original: Column, simplified: Column) -> Column:
    a, b = F.trim(original), F.trim(simplified)
    return F.coalesce((a != "") & (b != "") & (a != b) & (surface_form(a) != surface_form(b)), F.lit(False))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def with_equivalence_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.json$", "_with_equivalence.json")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unfenced(text: Column) -> Column:
    """The first non-empty part of a fenced answer, language marks removed; then a leading ``LTL:`` removed."""
    bare = _strip(text)
    parts = F.transform(F.split(bare, "```"), lambda p: _strip(F.replace(F.replace(p, F.lit("ltl"), F.lit("")), F.lit("LTL"), F.lit(""))))
    first = F.get(F.filter(parts, lambda p: p != ""), F.lit(0))
    chosen = F.when(bare.startswith("```"), F.coalesce(first, bare)).otherwise(bare)
    return _strip(F.regexp_replace(chosen, r"^(?:LTL|ltl):", ""))


def raw_output(text: Column) -> Column:
    """One line, without a leading ``LTL`` or ``Output`` mark."""
    one_line = F.regexp_replace(_strip(text), r"[\r\n]", " ")
    for mark in ("LTL", "Output"):
        one_line = F.regexp_replace(one_line, rf"(?i)^\s*{mark}\s*[:\-]?\s*", "")
    return _strip(F.regexp_replace(one_line, r"\s+", " "))


#: Words of model output and what they stand for.
WORD_OPERATORS = (
    ("globally|always", "G"),
    ("finally|eventually", "F"),
    ("next", "X"),
    ("until", "U"),
    ("releases?", "R"),
    ("and", "&"),
    ("or", "|"),
    ("not|negation|negate", "!"),
    ("imply|implies|implie|implicate", "->"),
    ("equivalent|equivalence|equals?", "<->"),
    ("tt", "true"),
    ("ff", "false"),
)
#: Signs of model output and what they stand for.
SIGNS = (("¬", "!"), ("∧", "&"), ("∨", "|"), ("→", "->"), ("↔", "<->"))


def spelled_out(text: Column) -> Column:
    """Words and signs of model output as operators; tokens without ``,.;:`` at their ends."""
    found = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), SIGNS, unfenced(text))
    found = reduce(lambda t, p: F.regexp_replace(t, rf"(?i)\b(?:{p[0]})\b", p[1]), WORD_OPERATORS, found)
    parts = F.transform(F.split(_strip(found), r"\s+"), lambda t: F.btrim(t, F.lit(" ,.;:")))
    return F.array_join(F.filter(parts, lambda t: t != ""), " ")


def wrapped_operands(text: Column) -> Column:
    """``G prop_1`` as ``G(prop_1)``, the same for F, X and !; spaces collapsed."""
    found = F.regexp_replace(_strip(text), r"\s+", " ")
    found = F.regexp_replace(found, r"(\b[GFX]|!)\s+(prop_\d+|true|false)\b", "$1($2)")
    return _strip(found)


def without_extra_closing(text: Column) -> Column:
    """Closing parentheses that close nothing left out."""
    state = F.struct(F.lit(0).alias("open"), F.lit("").alias("text"))

    def step(s: Column, c: Column) -> Column:
        extra = (c == ")") & (s["open"] == 0)
        now = s["open"] + F.when(c == "(", 1).when((c == ")") & ~extra, -1).otherwise(0)
        return F.struct(now.alias("open"), F.when(extra, s["text"]).otherwise(F.concat(s["text"], c)).alias("text"))

    return F.aggregate(F.split(text, ""), state, step, lambda s: s["text"])


def with_missing_closing(text: Column) -> Column:
    missing = F.length(F.regexp_replace(text, r"[^(]", "")) - F.length(F.regexp_replace(text, r"[^)]", ""))
    return F.concat(text, F.repeat(F.lit(")"), F.greatest(F.lit(0), missing)))


#: Words of outside corpora.
CORPUS_WORDS = (("finally|eventually", "F"), ("globally|always", "G"), ("next", "X"), ("until", "U"), ("not", "!"), ("and", "&"), ("or", "|"))


def corpus_formula(text: Column) -> Column:
    """Outside notation (words, ``&&``, ``XX``, ``prop 1``) in this one, operands of unary operators in parentheses."""
    found = reduce(lambda t, p: F.regexp_replace(t, rf"(?i)\b(?:{p[0]})\b", p[1]), CORPUS_WORDS, _strip(text))
    found = F.regexp_replace(found, r"(?i)\bprop\s+(\d+)\b", "prop_$1")
    found = F.replace(F.replace(found, F.lit("&&"), F.lit("&")), F.lit("||"), F.lit("|"))
    found = F.regexp_replace(found, r"([()!&|])", " $1 ")
    found = F.regexp_replace(found, r"(<->|->|[UWRMFGX])", " $1 ")
    found = _strip(F.regexp_replace(found, r"\s+", " "))
    found = F.regexp_replace(found, r"(\b[GFX]|!) \(", "$1(")
    found = F.regexp_replace(found, r"(\b[GF]|!) ((?!X\b|F\b|G\b)[A-Za-z][A-Za-z0-9_]*)\b", "$1($2)")
    found = F.regexp_replace(found, r"\bX ((?!X\b|F\b|G\b)[A-Za-z][A-Za-z0-9_]*)\b", "X($1)")
    return _strip(F.regexp_replace(F.regexp_replace(found, r"\(\s+", "("), r"\s+\)", ")"))


def placeholders(*texts: Column) -> Column:
    """Distinct ``prop_n`` of several texts, by their number."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\bprop_(\d+)\b"), F.lit(1)) for t in texts)))
    numbers = F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("long"))))
    return F.transform(numbers, lambda n: F.concat(F.lit("prop_"), n))


def letter_mapping(text: Column, gold: Column) -> Column:
    """a, b, ... to the placeholders of the text, or of the gold formula if the text has none."""
    own = placeholders(text)
    props = F.slice(F.when(F.size(own) > 0, own).otherwise(placeholders(gold)), 1, 26)
    return F.map_from_arrays(F.transform(props, lambda _, k: F.char(k + F.ascii(F.lit("a")))), props)


RESERVED = ("F", "G", "X", "U", "R", "W", "M", "true", "false", "tt", "ff")


def names_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*RESERVED)))


def replaced_names(text: Column, mapping: Column) -> Column:
    """Whole names replaced at once by a map."""
    parts = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b|."), F.lit(0))
    return F.array_join(renamed(parts, mapping), "")


def pair_mapping(gold: Column, predicted: Column) -> Column:
    """Names of gold, then of the prediction, to prop_1, prop_2, ..."""
    own = F.array_union(names_in(gold), names_in(predicted))
    return F.map_from_arrays(own, F.transform(own, lambda _, k: F.concat(F.lit("prop_"), k + 1)))


def prompt(sentence: Column, template: str) -> Column:
    """A prompt template with the sentence in place of ``{sentence}``."""
    before, _, after = template.partition("{sentence}")
    return F.concat(F.lit(before), sentence, F.lit(after))
