"""The benchmark as seen in the driver's tables: a formula dataset from ``part``, a result log from ``events``.

The tables hold no formulas, so records get one of twelve template formulas by their key. What holds of each
template is known, which gives the SQL side of every query an answer without a parser.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Template(NamedTuple):
    ltl: str
    simplified: str
    same: str  # an equivalent formula
    other: str  # a formula that isn't equivalent
    size: int
    depth: int
    temporal_depth: int
    nnf: bool
    label: str
    tag: str
    nesting: int
    operators: str
    english: str


TEMPLATES = (
    Template("F(@a)", "F(@a)", "(true U @a)", "G(@a)", 2, 1, 1, True, "eventuality", "liveness", 1, "F", "eventually, (@a is true)"),
    Template("G(@a)", "G(@a)", "!(F(!(@a)))", "F(@a)", 2, 1, 1, True, "safety", "safety", 1, "G", "always, (@a is true)"),
    Template("X(@a)", "X(@a)", "!(X(!(@a)))", "@a", 2, 1, 1, True, "next_step", "next_step", 1, "X", "in the next step, (@a is true)"),
    Template("(@a U @b)", "(@a U @b)", "(@b | (@a & X((@a U @b))))", "(@a W @b)", 3, 1, 1, True, "until_release", "until", 1, "U", "(@a is true) holds until (@b is true)"),
    Template("G(F(@a))", "G(F(@a))", "!(F(G(!(@a))))", "F(G(@a))", 3, 2, 2, True, "mixed_temporal", "recurrence", 2, "G F", "always, (eventually, (@a is true))"),
    Template("F(G(@a))", "F(G(@a))", "!(G(F(!(@a))))", "G(F(@a))", 3, 2, 2, True, "mixed_temporal", "persistence", 2, "F G", "eventually, (always, (@a is true))"),
    Template("G((@a -> F(@b)))", "G((@a -> F(@b)))", "G((!(@a) | F(@b)))", "G((@a -> @b))", 5, 3, 2, False, "mixed_temporal", "conditional", 3, "G -> F", "always, (if (@a is true), then (eventually, (@b is true)))"),
    Template("(G(@a) & F(@b))", "(F(@b) & G(@a))", "(F(@b) & G(@a))", "(G(@a) | F(@b))", 5, 2, 1, True, "mixed_temporal", "other", 2, "G & F", "(always, (@a is true)) and (eventually, (@b is true))"),
    Template("!((@a U @b))", "!((@a U @b))", "(!(@a) R !(@b))", "(!(@a) U !(@b))", 4, 2, 1, False, "until_release", "until", 2, "! U", "it is not the case that ((@a is true) holds until (@b is true))"),
    Template("(@a W @b)", "(@a W @b)", "((@a U @b) | G(@a))", "(@a U @b)", 3, 1, 1, False, "until_release", "weak_until", 1, "W", "(@a is true) holds until (@b is true) holds, or else (@a is true) keeps holding forever"),
    Template("(@a R @b)", "(@a R @b)", "(@b W (@a & @b))", "(@a W @b)", 3, 1, 1, False, "until_release", "release", 1, "R", "(@b is true) must hold until (@a is true) holds, and if it never does, then (@b is true) must keep holding forever"),
    Template("X(X((!(@a) | @b)))", "X(X((@b | !(@a))))", "X(X((@a -> @b)))", "X((!(@a) | @b))", 6, 4, 2, True, "next_step", "next_step", 4, "X ! |", "in the next step, (in the next step, ((@a is false) or (@b is true)))"),
)


def case(field: str, number: str = "t", quoted: bool = True) -> str:
    """A CASE over the templates; text with the propositions put in, which need columns a and b."""
    parts = []
    for k, t in enumerate(TEMPLATES):
        value = getattr(t, field)
        shown = str(value).lower() if isinstance(value, bool) else value if not quoted else f"'{value}'"
        parts.append(f"WHEN {k} THEN {shown}")
    found = f"CASE {number} {' '.join(parts)} END"
    return f"replace(replace({found}, '@a', a), '@b', b)" if quoted else found


DATASET = f"""
SELECT CAST(p_partkey AS BIGINT) AS pos, CAST(p_partkey AS BIGINT) AS id, t, a, b, {case("ltl")} AS LTL, {case("same")} AS same_formula, {case("other")} AS other_formula,
  p_name AS natural_paraphrase, CASE WHEN p_partkey % 6 = 0 THEN '  ' ELSE concat(p_name, ' ', p_brand) END AS paraphrase_gpt, concat(p_type, ' ', p_name, ' then ', p_brand) AS paraphrase_gemini,
  CASE WHEN p_partkey % 5 = 0 AND p_partkey > 0 THEN CAST(p_partkey - 1 AS BIGINT) END AS source_record_id, CAST(p_size AS INT) AS automaton_size
FROM (SELECT *, CAST(p_partkey % 12 AS INT) AS t, concat('prop_', CAST(1 + p_partkey % 5 AS STRING)) AS a, concat('prop_', CAST(6 + p_partkey % 4 AS STRING)) AS b FROM {{part}}) AS p
"""

RESULTS = """
SELECT CAST(event_id AS BIGINT) AS pos, CAST(event_id % (SELECT count(*) FROM {part}) AS BIGINT) AS record_id,
  CASE event_type WHEN 'signup' THEN 'natural_paraphrase' WHEN 'view' THEN 'paraphrase_gpt' WHEN 'click' THEN 'paraphrase_gemini' WHEN 'purchase' THEN 'paraphrase_deepseek' END AS input_field,
  CASE user_id % 5 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'gpt-5.5' WHEN 2 THEN 'claude-opus-4-7' WHEN 3 THEN 'deepseek-v4-flash' ELSE 'finetuned-t5' END AS model,
  CASE WHEN user_id % 2 = 0 THEN 'zeroshot' ELSE 'fewshot' END AS prompt_setting,
  CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value < 40 END AS equivalent, value
FROM {events}
"""

MODELS = ["claude-opus-4-7", "deepseek-v4-flash", "finetuned-t5", "gpt-5.4", "gpt-5.5"]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DATASET, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESULTS, part=spark.read.parquet(f"{sf_dir}/part.parquet"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def oracle(body: str) -> str:
    """SQL over ``dataset`` and ``results`` for the driver's engine."""
    tables = f"WITH dataset AS ({DATASET.format(part='part')}), results AS ({RESULTS.format(part='part', events='events')})"
    return f"{tables}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
