"""Outside corpora and generated formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions import lex
from ..functions import text as tx
from ..logic import syntax
from ..operators import semantic
from ..operators.keyed import first_per_key

#: 43 formulas of an outside benchmark, in its own notation.
FORMULAS = (
    "G(a -> F e)", "G(!(a & b))", "G(a -> X (X (X b)))", "e U (G (F d))", "(F b) -> (!b U (a & !b))", "G(a -> b)", "G (a && b)", "G a && G(b -> !c)",
    "G(a -> F b) -> G F c", "G F a -> G F b", "G F a || G F b", "F G ! a", "G (!(a && b) -> F c)", "G(!(a &&b)) && G(a || b)", "G ((a <-> b) -> (c <-> d))", "(! a) U b",
    "G (a -> X G ! b)", "(b U (b & ! a)) | G b", "G !(a & b)", "G (a && X b -> X X c)", "G (a -> X F b)", "a && G (a -> X ! a && X X ! a && X X X ! a && X X X X ! a && X X X X X a)",
    "G F a || X b", "G (a)", "G (a -> (b | X b))", "G (a | b | c)", "G (a -> F b)", "! G (! (a && X a))", "! G (! (a && X a))", "G ( a -> (X !a | XX !a | XXX !a))", "G ( a -> X b)",
    "F (a && b)", "F a && F b", "G (a <-> X b)", "b -> X ((c U a) || G c)", "(a U b) || G a", "finally ( not prop 1)", "globally ( not prop 1)", "next prop 1", "prop 1 until prop 2",
    "finally (prop 1 and prop 2)", "globally (prop 1 and prop 2)", "finally (prop 1 or prop 2)",
)


def outside(spark: SparkSession) -> DataFrame:
    """(pos, raw, LTL): the outside formulas in this library's notation."""
    raw = spark.createDataFrame(list(enumerate(FORMULAS)), "pos long, raw string")
    return raw.withColumn("LTL", tx.corpus_formula("raw"))


def summary_of(formulas: DataFrame) -> DataFrame:
    """One row: total, unique_non_trivial, max_size, max_propositions, max_temporal_depth, unread."""
    distinct = formulas.groupBy("LTL").agg(F.count("*").alias("n")).withColumn("m", fm.ltl_metrics("LTL"))
    return distinct.agg(
        F.sum("n").alias("total"),
        F.count_if(~F.coalesce("m.is_trivial", F.lit(True))).alias("unique_non_trivial"),
        F.max("m.ast_size").alias("max_size"),
        F.max(F.size("m.propositions")).alias("max_propositions"),
        F.max("m.temporal_depth").alias("max_temporal_depth"),
        F.sum(F.when(F.col("m.parse_error"), F.col("n")).otherwise(0)).alias("unread"),
    )


def summary(spark: SparkSession) -> DataFrame:
    return summary_of(outside(spark))


def calibration(records: DataFrame) -> DataFrame:
    """(pos, LTL, mapping) of each formula in ``ltlequ``, with canonical names; the mapping goes from old to new."""
    each = records.select("pos", F.explode("ltlequ").alias("raw")).withColumn("tokens", lex.corpus_tokens(F.col("raw")))
    mapped = each.withColumn("mapping", lex.renaming(F.col("tokens")))
    return mapped.select("pos", F.array_join(lex.renamed(F.col("tokens"), F.col("mapping")), " ").alias("LTL"), "mapping")


#: Defaults of the generator: propositions, depth, size, odds of an early proposition, weights of operators with one and two operands.
PROPOSITIONS = tuple(f"prop_{k}" for k in range(1, 11))
MAX_DEPTH, MIN_SIZE, MAX_SIZE, EARLY, ONE, TWO = 10, 15, 25, 0.02, 0.45, 0.95
ONE_OPERATORS, TWO_OPERATORS = ("X", "F", "G", "!"), ("U", "&", "|", "->")
#: Draws of one row before it gives up.
DRAWS = 200


def random_formula(r: np.random.Generator, depth: int = 0) -> syntax.Formula:
    """Operators while depth allows: a proposition early with odds EARLY, else by the weights 1 : ONE : TWO."""
    if depth >= MAX_DEPTH or r.random() < EARLY:
        return str(r.choice(PROPOSITIONS))
    kind = r.choice(3, p=np.array([1, ONE, TWO]) / (1 + ONE + TWO))
    if kind == 0:
        return str(r.choice(PROPOSITIONS))
    if kind == 1:
        return str(r.choice(ONE_OPERATORS)), random_formula(r, depth + 1)
    return str(r.choice(TWO_OPERATORS)), random_formula(r, depth + 1), random_formula(r, depth + 1)


def random_formulas(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """(pos, LTL): a formula of MIN_SIZE to MAX_SIZE nodes for each row that draws one, seeded by (seed, pos)."""

    @F.pandas_udf("string")
    def drawn(ids: pd.Series) -> pd.Series:
        def one(k):
            r = np.random.default_rng([seed, int(k)])
            for _ in range(DRAWS):
                f = random_formula(r)
                if MIN_SIZE <= syntax.size(f) <= MAX_SIZE:
                    return syntax.render(f)
            return None

        return ids.map(one)

    return spark.range(rows).select(F.col("id").alias("pos"), drawn("id").alias("LTL")).where("LTL is not null")


def generated(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """Generated formulas that are new, not trivial, temporal and satisfiable, with their metrics, in the dataset's form."""
    unique = first_per_key(random_formulas(spark, rows, seed).withColumn("key", lex.canonical(lex.tokens(F.col("LTL")))), ["key"]).drop("key")
    accepted = semantic.filter_formulas(unique).where(F.size("reasons") == 0)
    checked = accepted.withColumn("satisfiability", fm.ltl_status("accepted_form")).where("satisfiability in ('satisfiable', 'tautology')")
    tokens = lex.tokens(F.col("accepted_form"))
    measured = checked.withColumn("m", fm.ltl_metrics("accepted_form"))
    return measured.select("pos", F.col("accepted_form").alias("LTL"), F.col("LTL").alias("generated_formula"), F.col("m.simplified").alias("simplified_formula"), "satisfiability", "m.ast_size", "m.ast_depth", "m.temporal_depth", F.size(lex.propositions(tokens)).alias("num_atomic_props"), F.array_join(lex.behaviour_tags(F.col("m.simplified")), ",").alias("temporal_behavior"))
