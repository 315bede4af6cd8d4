"""Registered queries with, where SQL can say the same, their SQL for the driver's engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formulas as fm
from ..functions import lex, providers
from ..functions import text as tx
from ..operators import edits, keyed, rates, semantic, stats, variants
from ..shared import staged
from . import corpora, events, files  # noqa: F401  (events and files register their own queries)
from .benchmark import MODELS, case, dataset, results
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _measured(formulas: DataFrame, filtered: bool = False) -> DataFrame:
    """Adds ``m``, size, depth and temporal depth, taken once from each distinct formula.

    filtered: rows are then chosen by ``m``. It asks for a count, so that the filter stays after the grouping and doesn't
    measure each record's formula, in the few tasks that read the records.
    """
    texts, m = formulas.select(F.col("LTL").alias("_f")), lex.measures(F.col("_f"))
    if filtered:
        measures = texts.groupBy("_f").agg(F.count("*").alias("_n")).select("_f", F.when(F.col("_n") > 0, m).alias("m"))
    else:
        measures = texts.distinct().withColumn("m", m)
    return formulas.join(measures, formulas["LTL"] == measures["_f"]).drop("_f")


_OK = "coalesce(status = 'ok', false) AND coalesce(equivalent, false)"
_RATES = f"""count(*) AS total, count(*) AS effective_total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (equivalent) AS equivalent,
  count(*) FILTER ({_OK}) AS success, count(*) FILTER (status = 'error') AS error, round(count(*) FILTER ({_OK}) * 1.0 / count(*), 9) AS success_rate"""
_TOKENS = r"regexp_extract_all(LTL, '<->|->|[()&|!]|[<-]|[^[:space:]()&|!<-]+')"
_CORE = f"list_filter({_TOKENS}, lambda x: x NOT IN ('(', ')'))"
_OPS = "('X','F','G','U','W','R','M','!','&','|','->','<->')"


def _bucket_sql(bucket: str, name: str, by: str = "model, prompt_setting", where: str = "true", source: str = "dataset") -> str:
    return f"""SELECT {by}, {name}, count(*) AS total, count(*) FILTER ({_OK}) AS success, round(count(*) FILTER ({_OK}) * 1.0 / count(*), 9) AS success_rate
FROM results JOIN (SELECT *, {bucket} AS {name} FROM {source}) d ON record_id = d.id WHERE {where} GROUP BY {by}, {name}"""


# Analytics over result logs.


@query(f"SELECT model, {_RATES} FROM results GROUP BY model")
def q01_model_comparison(spark, d):
    return _rounded(rates.overall(results(spark, d), ["model"]), "success_rate").orderBy(F.desc("success_rate"), "model")


@query("SELECT input_field, " + ", ".join(f"""round(avg(CASE WHEN model = '{m}' THEN ({_OK})::INT END), 9) AS "{m}" """ for m in MODELS) + " FROM results GROUP BY input_field")
def q02_paraphrase_matrix(spark, d):
    return rates.matrix(results(spark, d), MODELS)


@query(f"SELECT coalesce(input_field, 'unknown') AS input_field, {_RATES} FROM results GROUP BY 1")
def q03_summary_by_field(spark, d):
    return _rounded(rates.by_field(results(spark, d)), "success_rate")


@query(_bucket_sql(case("size", quoted=False), "formula_size"))
def q04_success_by_size(spark, d):
    found = rates.by_bucket(results(spark, d), dataset(spark, d), lex.size(lex.tokens(F.col("LTL"))), "formula_size", ("model", "prompt_setting"))
    return _rounded(found, "success_rate").orderBy("model", "prompt_setting", "formula_size")


@query(_bucket_sql(case("temporal_depth", quoted=False), "temporal_depth"))
def q05_success_by_depth(spark, d):
    return _rounded(rates.by_bucket(results(spark, d), _measured(dataset(spark, d), filtered=True), F.col("m.temporal_depth"), "temporal_depth", ("model", "prompt_setting")), "success_rate")


@query(_bucket_sql("automaton_size", "size"))
def q06_success_by_automaton(spark, d):
    return _rounded(rates.by_bucket(results(spark, d), dataset(spark, d), F.col("automaton_size"), "size", ("model", "prompt_setting")), "success_rate")


@query(_bucket_sql("automaton_size", "size", where="d.size <= 50"))
def q06_automaton_panel(spark, d):
    """The panel's range, as published."""
    return _rounded(rates.by_bucket(results(spark, d), dataset(spark, d), F.col("automaton_size"), "size", ("model", "prompt_setting"), between=rates.AUTOMATON_SIZES), "success_rate")


#: Fixed value: longer descriptions are left out of success by length.
MOST_WORDS = 75
_WORDS = "len(regexp_extract_all({0}, '[^[:space:]]+'))"


@query(f"""WITH texts AS (UNPIVOT (SELECT id, natural_paraphrase, paraphrase_gpt, paraphrase_gemini FROM dataset) ON natural_paraphrase, paraphrase_gpt, paraphrase_gemini INTO NAME input_field VALUE source_text)
SELECT model, words, count(*) AS total, count(*) FILTER ({_OK}) AS success, round(count(*) FILTER ({_OK}) * 1.0 / count(*), 9) AS success_rate
FROM results r JOIN (SELECT id, input_field, CAST({_WORDS.format("source_text")} AS INT) AS words FROM texts WHERE trim(source_text) <> '') t ON t.words <= {MOST_WORDS} AND r.record_id = t.id AND r.input_field = t.input_field GROUP BY model, words""")
def q07_success_by_nl_length(spark, d):
    texts = keyed.unpivoted(dataset(spark, d), ["id"], ["natural_paraphrase", "paraphrase_gpt", "paraphrase_gemini"])
    lengths = texts.select(F.col("id").alias("record_id"), "input_field", tx.word_count(F.col("source_text")).alias("words")).where(f"words <= {MOST_WORDS}")
    joined = results(spark, d).groupBy("record_id", "input_field", "model").agg(F.count("*").alias("n"), F.count_if(rates.success()).alias("s")).join(lengths, ["record_id", "input_field"])
    found = joined.groupBy("model", "words").agg(F.sum("n").alias("total"), F.sum("s").alias("success"))
    return found.withColumn("success_rate", F.round(F.col("success") / F.col("total"), 9))


_MIN_SIZE = f"""SELECT o.*, least({case("size", "o.t", False)}, coalesce({case("size", "s.t", False)}, 99)) AS least_size FROM dataset o LEFT JOIN dataset s ON o.source_record_id = s.id"""


def _least_sizes(spark, d):
    own = dataset(spark, d).withColumn("size", lex.size(lex.tokens(F.col("LTL"))))
    source = own.select(F.col("id").alias("_sid"), F.col("size").alias("_ssize"))
    return own.join(source, own["source_record_id"] == source["_sid"], "left").withColumn("least_size", F.least("size", "_ssize"))


@query(_bucket_sql("least_size", "size", source=f"({_MIN_SIZE})"))
def q08_success_by_min_equivalent(spark, d):
    return _rounded(rates.by_bucket(results(spark, d), _least_sizes(spark, d), F.col("least_size"), "size", ("model", "prompt_setting")), "success_rate")


def _in_normal_form(formulas: DataFrame) -> DataFrame:
    """Those in negation normal form, with their size; judged once for each distinct formula."""
    tokens = lex.tokens(F.col("LTL"))
    judged = formulas.select("LTL").distinct().select("LTL", lex.size(tokens).alias("size"), fm.is_nnf(tokens).alias("nnf"))
    # Staged, so that the filter doesn't judge each record.
    return formulas.join(staged(judged, "judged").where("nnf").drop("nnf"), "LTL")


@query(_bucket_sql(case("size", quoted=False), "formula_size", where=case("nnf", "d.t", False)))
def q09_success_by_size_nnf(spark, d):
    return _rounded(rates.by_bucket(results(spark, d), _in_normal_form(dataset(spark, d)), F.col("size"), "formula_size", ("model", "prompt_setting")), "success_rate")


@query(f"SELECT CAST({_WORDS.format('natural_paraphrase')} AS INT) AS words, count(*) AS n FROM dataset GROUP BY 1")
def q10_nl_length_distribution(spark, d):
    return dataset(spark, d).groupBy(tx.word_count(F.col("natural_paraphrase")).alias("words")).agg(F.count("*").alias("n"))


@query(f"SELECT {case('size', quoted=False)} AS size, count(*) AS n FROM dataset WHERE {case('nnf', quoted=False)} GROUP BY 1")
def q10_nnf_size_distribution(spark, d):
    return _in_normal_form(dataset(spark, d)).groupBy("size").agg(F.count("*").alias("n"))


@query(f"""SELECT model, formula_size, total, success, round(p, 9) AS success_rate, round(e, 9) AS standard_error, round(greatest(0, p - e), 9) AS low, round(least(1, p + e), 9) AS high FROM (
SELECT *, sqrt(p * (1 - p) / total) AS e FROM (SELECT model, formula_size, total, success, success * 1.0 / total AS p FROM ({_bucket_sql(case("size", quoted=False), "formula_size", "model")})))""")
def q11_error_bands(spark, d):
    found = rates.by_bucket(results(spark, d), dataset(spark, d), lex.size(lex.tokens(F.col("LTL"))), "formula_size", ("model",))
    return _rounded(rates.with_band(found), "success_rate", "standard_error", "low", "high")


def _record_measures(spark, d):
    return _measured(_least_sizes(spark, d)).select(F.col("id").alias("record_id"), "size", tx.word_count(F.col("natural_paraphrase")).alias("words"), "least_size", F.col("m.temporal_depth").alias("nesting"), "automaton_size")


def _measures(spark, d):
    return results(spark, d).withColumn("outcome", rates.success().cast("int")).join(_record_measures(spark, d), "record_id")


def _rank_correlation(spark, d):
    """The log is counted by record and outcome before it meets the measures."""
    counted = results(spark, d).groupBy("record_id", rates.success().cast("int").alias("outcome")).agg(F.count("*").alias("rows"))
    return stats.spearman(counted.join(_record_measures(spark, d), "record_id"), _NAMES, "outcome", "rows")


_NAMES = ["words", "size", "least_size", "nesting", "automaton_size"]


def _rho_sql(measure: str, digits: int = 6) -> str:
    ranks = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return f"SELECT '{measure}' AS measure, count(*) AS n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), {digits}) AS rho FROM (SELECT {ranks.format(measure)} AS x, {ranks.format('outcome')} AS y FROM m)"


_MEASURES = f"""m AS (SELECT r.*, ({_OK})::INT AS outcome, size, words, least_size, nesting, automaton_size FROM results r JOIN (SELECT id, {case("size", quoted=False)} AS size, {_WORDS.format("natural_paraphrase")} AS words, least_size, {case("temporal_depth", quoted=False)} AS nesting, automaton_size FROM ({_MIN_SIZE}) l) d ON record_id = d.id)"""


@query(f"SELECT * FROM (WITH {_MEASURES} {' UNION ALL '.join(_rho_sql(m) for m in _NAMES)})")
def q12_spearman(spark, d):
    found = _rank_correlation(spark, d)
    return found.select("measure", "n", F.round("rho", 6).alias("rho"))


#: Simpson's rule for the error function, in steps of a two-thousandth of x.
_ERF_SQL = "2 / sqrt(pi()) * x / 6000 * list_sum(list_transform(range(2001), lambda k: (CASE WHEN k % 2000 = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(x * k / 2000) * (x * k / 2000))))"


@query(f"""SELECT measure, n, round(rho, 6) AS rho, round(z, 6) AS z, CASE WHEN rho IS NOT NULL THEN coalesce(round(1 - {_ERF_SQL}, 6), 0) END AS p_value FROM (
SELECT *, abs(z) / sqrt(2) AS x FROM (SELECT *, CASE WHEN n >= 4 AND abs(rho) < 1 THEN ln((1 + rho) / (1 - rho)) / 2 * sqrt((n - 3) / 1.06) END AS z FROM (
WITH {_MEASURES} {' UNION ALL '.join(_rho_sql(m, 15) for m in _NAMES)})))""")
def q12_spearman_p_values(spark, d):
    found = stats.p_values(_rank_correlation(spark, d))
    return found.select("measure", "n", *(F.round(c, 6).alias(c) for c in ("rho", "z", "p_value")))


@query()
def q13_logistic_regression(spark, d):
    measured = stats.standardized(_measures(spark, d).select("outcome", *(F.col(c).cast("double").alias(c) for c in _NAMES)), _NAMES)
    fitted = [tuple(v for k, v in r.items() if k != "group") for r in stats.logistic_fit(measured, _NAMES, "outcome")]
    return spark.createDataFrame(fitted, "term string, coefficient double, se double, z double, p_value double, odds_ratio double, n long, log_likelihood double")


_LAW_SIZES = (5, 20, 40)


def _law_sql(where: str) -> str:
    """Thirty of Newton's steps from zero, on counts of each size and outcome."""
    return f"""SELECT model, round(b0, 6) AS beta0, round(b1, 6) AS beta1, CAST(total AS BIGINT) AS n, round(-b0 / b1, 3) AS size50, {", ".join(f"round(1 / (1 + exp(-b0 - b1 * {s})), 6) AS p_size_{s}" for s in _LAW_SIZES)} FROM (
WITH RECURSIVE cells AS (SELECT model, automaton_size AS x, ({_OK})::INT AS y, count(*) AS n FROM results JOIN dataset ON record_id = id WHERE {where} GROUP BY 1, 2, 3),
fit(model, k, b0, b1, total) AS (
  SELECT model, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), sum(n) FROM cells GROUP BY model UNION ALL
  SELECT model, k + 1, b0 + (h11 * s0 - h01 * s1) / (h00 * h11 - h01 * h01), b1 + (h00 * s1 - h01 * s0) / (h00 * h11 - h01 * h01), total FROM (
    SELECT model, k, b0, b1, total, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11, sum(n * (y - p)) AS s0, sum(n * (y - p) * x) AS s1
    FROM (SELECT f.*, x, y, n, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM fit f JOIN cells c ON f.model = c.model WHERE k < 30) GROUP BY model, k, b0, b1, total))
SELECT * FROM fit WHERE k = 30)"""


def _laws(spark, d, setting=None):
    measured = _measures(spark, d).select("model", "prompt_setting", F.col("automaton_size").alias("ast_size"), F.col("outcome").alias("success"))
    found = stats.predicted_success(stats.scaling_law(measured, setting=setting), list(_LAW_SIZES))
    return found.select("model", "n", F.round("size50", 3).alias("size50"), *(F.round(c, 6).alias(c) for c in found.columns if c not in ("model", "n", "size50")))


@query(_law_sql("true"))
def q14_scaling_law(spark, d):
    return _laws(spark, d)


@query(_law_sql("prompt_setting = 'fewshot'"))
def q14_scaling_law_fewshot(spark, d):
    return _laws(spark, d, ("prompt_setting", "fewshot"))


@query(f"SELECT model, automaton_size AS ast_size, count(*) AS n, round(avg(({_OK})::INT), 9) AS mean_success FROM results JOIN dataset ON record_id = id GROUP BY 1, 2")
def q14_mean_success_by_size(spark, d):
    return _measures(spark, d).groupBy("model", F.col("automaton_size").alias("ast_size")).agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 9).alias("mean_success"))


@query(f"SELECT op, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS op FROM dataset) WHERE op IN {_OPS} GROUP BY op")
def q15_operator_totals(spark, d):
    counts = dataset(spark, d).select(F.explode(lex.operator_counts(lex.tokens(F.col("LTL")))).alias("op", "n"))
    return counts.where("n > 0").groupBy("op").agg(F.sum("n").alias("n"))


@query(f"""SELECT count(*) AS records, 0 AS parse_failures, CAST(sum(len(list_filter({_TOKENS}, lambda x: x LIKE 'prop%'))) AS BIGINT) AS propositions, min({case("size", quoted=False)}) AS min_size, max({case("size", quoted=False)}) AS max_size,
max({case("depth", quoted=False)}) AS max_depth, max({case("temporal_depth", quoted=False)}) AS max_temporal_depth FROM dataset""")
def q15_field_statistics(spark, d):
    m = _measured(dataset(spark, d)).withColumn("n_props", F.size(F.filter(lex.tokens(F.col("LTL")), lambda t: t.startswith("prop"))).cast("long"))
    return m.agg(F.count("*").alias("records"), F.count_if(F.col("m").isNull()).cast("int").alias("parse_failures"), F.sum("n_props").alias("propositions"), F.min("m.size").alias("min_size"), F.max("m.size").alias("max_size"), F.max("m.depth").alias("max_depth"), F.max("m.temporal_depth").alias("max_temporal_depth"))


_SHAPES = " UNION ALL ".join(f"SELECT '{f}' AS field, '{m}' AS measure, {case(m, quoted=False)} + {more} AS value FROM dataset" for f, extra in (("LTL", 0), ("negated", 1)) for m, more in (("size", extra), ("depth", extra), ("temporal_depth", 0)))


@query(f"SELECT field, measure, CAST(value AS INT) AS value, count(*) AS n FROM ({_SHAPES}) GROUP BY ALL")
def q15_field_histograms(spark, d):
    """Of each formula field how many records have each size, depth and temporal depth; formulas are measured once."""
    fields = dataset(spark, d).select("id", "LTL", F.concat(F.lit("!("), "LTL", F.lit(")")).alias("negated"))
    counted = keyed.unpivoted(fields, ["id"], ["LTL", "negated"]).groupBy(F.col("input_field").alias("field"), F.col("source_text").alias("formula")).agg(F.count("*").alias("n"))
    # Staged, since a filter on what is measured would else be moved to before the grouping, onto each record.
    measured = staged(counted.withColumn("m", lex.measures(F.col("formula"))), "measured").where("m is not null")
    each = F.explode(F.create_map(*(x for c in ("size", "depth", "temporal_depth") for x in (F.lit(c), F.col(f"m.{c}")))))
    return measured.select("field", "n", each.alias("measure", "value")).groupBy("field", "measure", "value").agg(F.sum("n").alias("n"))


@query(f"SELECT size, count(*) AS n FROM (SELECT DISTINCT coalesce(source_record_id, id) AS k, min(least_size) OVER (PARTITION BY coalesce(source_record_id, id)) AS size FROM ({_MIN_SIZE})) GROUP BY size")
def q16_min_equivalent_distribution(spark, d):
    per_source = _least_sizes(spark, d).groupBy(F.coalesce("source_record_id", "id").alias("k")).agg(F.min("least_size").alias("size"))
    return per_source.groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT automaton_size AS size, count(*) AS n FROM dataset WHERE automaton_size IS NOT NULL GROUP BY 1")
def q17_automaton_distribution(spark, d):
    return dataset(spark, d).where("automaton_size is not null").groupBy(F.col("automaton_size").alias("size")).agg(F.count("*").alias("n"))


def _with_variants(spark, d):
    """Every seventh record in its other, equivalent wording."""
    return dataset(spark, d).withColumn("LTL", F.when(F.col("id") % 7 == 0, F.col("same_formula")).otherwise(F.col("LTL")))


_VARIANTS = f"v AS (SELECT pos, t, {case('ltl')} AS key, CASE WHEN id % 7 = 0 THEN same_formula ELSE LTL END AS f FROM dataset)"


@query(f"SELECT * FROM (WITH {_VARIANTS} SELECT arg_min(f, pos) AS class_leader, count(DISTINCT f) AS n_formulas, count(*) AS n_rows FROM v GROUP BY key)")
def q18_semantic_groups(spark, d):
    return semantic.class_sizes(_with_variants(spark, d)).orderBy(F.desc("n_rows"), "class_leader")


# Published figures of that corpus, but for the largest number of propositions (given as 3): one of the formulas has four.
@query("SELECT CAST(43 AS BIGINT) AS total, CAST(42 AS BIGINT) AS unique_non_trivial, CAST(33 AS INT) AS max_size, CAST(4 AS INT) AS max_propositions, CAST(6 AS INT) AS max_temporal_depth, CAST(0 AS BIGINT) AS unread")
def q19_corpus_summary(spark, d):
    return corpora.summary(spark)


@query(f"""SELECT r.pos, CASE WHEN r.pos % 3 = 2 THEN NULL ELSE r.pos % 3 = 0 END AS equivalent, CASE WHEN d.id IS NULL THEN 'missing_ground_truth' WHEN r.pos % 3 = 2 THEN 'missing_prediction' ELSE 'checked' END AS check_status
FROM results r LEFT JOIN (SELECT * FROM dataset WHERE id % 13 <> 0) d ON r.record_id = d.id WHERE d.id IS NOT NULL
UNION ALL SELECT r.pos, NULL, 'missing_ground_truth' FROM results r WHERE record_id % 13 = 0""")
def q20_equivalence_annotation(spark, d):
    gold = dataset(spark, d).where("id % 13 != 0").select(F.col("id").alias("record_id"), "LTL", "same_formula", "other_formula")
    joined = results(spark, d).select("pos", "record_id").join(gold, "record_id", "left")
    predicted = joined.withColumn("predicted", F.expr("case pos % 3 when 0 then same_formula when 1 then other_formula end"))
    pairs = predicted.where("predicted is not null").select("LTL", "predicted").distinct().withColumn("equivalent", fm.ltl_equivalent("LTL", "predicted"))
    checked = predicted.join(pairs, ["LTL", "predicted"], "left")
    status = F.when(F.col("LTL").isNull(), "missing_ground_truth").when(F.col("predicted").isNull(), "missing_prediction").otherwise("checked")
    return checked.select("pos", "equivalent", status.alias("check_status"))


@query(f"SELECT id, concat('!(!(', LTL, '))') AS original, {case('simplified')} AS simplified, true AS equivalent FROM dataset")
def q21_simplifiable_report(spark, d):
    doubled = dataset(spark, d).select("id", F.concat(F.lit("!(!("), "LTL", F.lit("))")).alias("original"))
    # Staged, so that the filter doesn't simplify each record's formula.
    shorter = staged(doubled.select("original").distinct().withColumn("simplified", fm.ltl_simplify("original")), "simplified").where("simplified != original")
    distinct = shorter.withColumn("equivalent", fm.ltl_equivalent("original", "simplified"))
    return doubled.join(distinct, "original").select("id", "original", "simplified", "equivalent")


@query()
def q22_generate_and_filter(spark, d):
    return corpora.generated(spark, 200)


@query(f"""SELECT id, {case("size", quoted=False)} AS formula_size, {case("nesting", quoted=False)} AS nesting_depth, {case("operators")} AS operators, {case("label")} AS temporal_behavior, {case("nnf", quoted=False)} AS is_nnf FROM dataset""")
def q23_enrichment(spark, d):
    found = dataset(spark, d).withColumn("tokens", lex.tokens(F.col("LTL")))
    tokens = F.col("tokens")
    return found.select("id", lex.size(tokens).alias("formula_size"), lex.nesting(tokens).alias("nesting_depth"), F.array_join(lex.operators(tokens), " ").alias("operators"), lex.behaviour_label(tokens).alias("temporal_behavior"), fm.is_nnf(tokens).alias("is_nnf"))


@query("SELECT id AS record_id, 'natural_paraphrase' AS input_field, CASE WHEN id % 4 = 3 THEN 'error' ELSE 'ok' END AS status, CASE WHEN id % 4 = 3 THEN NULL ELSE id % 4 < 2 END AS equivalent FROM dataset")
def q24_evaluation(spark, d):
    from ..streaming.evaluation import entries

    own = dataset(spark, d)
    answer = F.expr("case id % 4 when 0 then concat('LTL: ', LTL) when 1 then concat('```ltl\n', same_formula, '\n```') when 2 then other_formula end")
    tasks = own.select(F.col("id").alias("record_id"), F.lit("natural_paraphrase").alias("input_field"), F.col("natural_paraphrase").alias("source_text"), F.col("LTL").alias("original_ltl"), answer.alias("raw_model_output"))
    return entries(tasks, lambda t: t).select("record_id", "input_field", "status", "equivalent")


@query("""SELECT pos, record_id, input_field, status, equivalent FROM (SELECT *, row_number() OVER (PARTITION BY record_id, input_field, model ORDER BY coalesce(equivalent, false) DESC, (status = 'ok') DESC, pos DESC) AS k FROM results) WHERE k = 1""")
def q25_best_entries(spark, d):
    return keyed.best_per_key(results(spark, d), ["record_id", "input_field", "model"]).select("pos", "record_id", "input_field", "status", "equivalent")


# Keys, order and sets.


@query("SELECT pos, record_id, input_field, status FROM (SELECT *, row_number() OVER (PARTITION BY record_id, input_field ORDER BY pos DESC) AS k FROM results) WHERE k = 1")
def r_latest_per_key(spark, d):
    return keyed.latest_per_key(results(spark, d), ["record_id", "input_field"]).select("pos", "record_id", "input_field", "status")


@query("SELECT pos, record_id FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS k FROM results) WHERE k = 1")
def r_first_per_key(spark, d):
    return keyed.first_per_key(results(spark, d), ["record_id"]).select("pos", "record_id")


@query(f"SELECT model, count(*) AS keys, count(*) FILTER ({_OK}) AS success, round(count(*) FILTER ({_OK}) * 1.0 / count(*), 9) AS success_rate FROM (SELECT *, row_number() OVER (PARTITION BY record_id, input_field, model ORDER BY pos DESC) AS k FROM results) WHERE k = 1 GROUP BY model")
def r_latest_success_rate(spark, d):
    last = keyed.latest_per_key(results(spark, d), ["record_id", "input_field", "model"])
    return last.groupBy("model").agg(F.count("*").alias("keys"), F.count_if(rates.success()).alias("success")).withColumn("success_rate", F.round(F.col("success") / F.col("keys"), 9))


@query(f"SELECT model, count(*) AS total, count(*) FILTER (NOT (model = 'finetuned-t5' AND status = 'error')) AS effective_total, count(*) FILTER ({_OK}) AS success, round(count(*) FILTER ({_OK}) * 1.0 / count(*) FILTER (NOT (model = 'finetuned-t5' AND status = 'error')), 9) AS success_rate FROM results GROUP BY model")
def r_rates_without_errors(spark, d):
    found = rates.overall(results(spark, d), ["model"], F.col("model") == "finetuned-t5")
    return _rounded(found.select("model", "total", "effective_total", "success", "success_rate"), "success_rate")


@query("SELECT automaton_size, count(*) AS n, min(r) AS tied_rank FROM (SELECT automaton_size, rank() OVER (ORDER BY automaton_size) + (count(*) OVER (PARTITION BY automaton_size) - 1) / 2.0 AS r FROM dataset) GROUP BY 1")
def r_tied_ranks(spark, d):
    ranked = stats.tied_ranks(dataset(spark, d).select("automaton_size"), "automaton_size", "r")
    return ranked.groupBy("automaton_size").agg(F.count("*").alias("n"), F.min("r").alias("tied_rank"))


@query("SELECT max(id) + 1 AS next_id FROM dataset")
def r_next_id(spark, d):
    return keyed.next_id(dataset(spark, d))


@query("SELECT pos, row_number() OVER (ORDER BY pos) + 100 AS id FROM results WHERE status = 'ok'")
def r_sequential_ids(spark, d):
    return keyed.sequential_ids(results(spark, d).where("status = 'ok'").select("pos"), ["pos"], "id", 100)


@query(f"SELECT pos, round(sum(({_OK})::INT) OVER (ORDER BY pos) * 1.0 / row_number() OVER (ORDER BY pos), 9) AS running_accuracy FROM results")
def r_running_accuracy(spark, d):
    summed = keyed.running_total(results(spark, d).select("pos", rates.success().cast("long").alias("s")), ["pos"], F.col("s"), "hits")
    counted = keyed.running_total(summed, ["pos"], F.lit(1), "rows")
    return counted.select("pos", F.round(F.col("hits") / F.col("rows"), 9).alias("running_accuracy"))


@query("SELECT min(pos) AS pos, f AS LTL FROM (SELECT pos, trim(other_formula) AS f FROM dataset WHERE id >= 50) WHERE f NOT IN (SELECT LTL FROM dataset WHERE id < 50) GROUP BY f")
def r_append_new(spark, d):
    own = dataset(spark, d)
    new = own.where("id >= 50").select("pos", F.concat(F.lit(" "), "other_formula").alias("LTL"))
    return keyed.append_new(own.where("id < 50"), new).select("pos", F.trim("LTL").alias("LTL"))


@query("""WITH tasks AS (SELECT id AS record_id, 'natural_paraphrase' AS input_field FROM dataset WHERE trim(natural_paraphrase) <> '' UNION ALL SELECT id, 'paraphrase_gpt' FROM dataset WHERE trim(paraphrase_gpt) <> ''),
done AS (SELECT record_id, input_field FROM (SELECT *, row_number() OVER (PARTITION BY record_id, input_field ORDER BY pos DESC) AS k FROM results) WHERE k = 1 AND status = 'ok')
SELECT * FROM tasks ANTI JOIN done USING (record_id, input_field)""")
def r_not_done(spark, d):
    tasks = keyed.unpivoted(dataset(spark, d), ["id"], ["natural_paraphrase", "paraphrase_gpt"]).select(F.col("id").alias("record_id"), "input_field")
    return keyed.not_done(tasks, results(spark, d), ["record_id", "input_field"])


@query("SELECT id, 'natural_paraphrase' AS input_field, natural_paraphrase AS source_text FROM dataset UNION ALL SELECT id, 'paraphrase_gpt', paraphrase_gpt FROM dataset WHERE trim(paraphrase_gpt) <> ''")
def r_unpivot(spark, d):
    return keyed.unpivoted(dataset(spark, d), ["id"], ["natural_paraphrase", "paraphrase_gpt"])


@query("SELECT concat(id, '_original') AS pair_id, 'original' AS variant, LTL, same_formula AS paired_formula FROM dataset UNION ALL SELECT concat(id, '_simplified'), 'simplified', same_formula, LTL FROM dataset")
def r_simplifiable_pairs(spark, d):
    return keyed.simplifiable_pairs(dataset(spark, d).withColumn("simplified_formula", F.col("same_formula"))).select("pair_id", "variant", "LTL", "paired_formula")


@query("SELECT d.id AS id, d.LTL, s.LTL AS source_ltl FROM dataset d LEFT JOIN dataset s ON d.source_record_id = s.id")
def r_source_lookup(spark, d):
    own = dataset(spark, d)
    source = own.select(F.col("id").alias("source_record_id"), F.col("LTL").alias("source_ltl"))
    return own.join(source, "source_record_id", "left").select("id", "LTL", "source_ltl")


@query("SELECT LTL, count(*) AS n FROM dataset GROUP BY LTL ORDER BY n DESC, LTL LIMIT 10")
def r_top_groups(spark, d):
    return dataset(spark, d).groupBy("LTL").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "LTL").limit(10)


@query("SELECT pos, id, LTL FROM dataset ORDER BY pos LIMIT 10")
def r_preview(spark, d):
    return dataset(spark, d).select("pos", "id", "LTL").orderBy("pos").limit(10)


@query("SELECT id, CASE WHEN id < 20 THEN NULL ELSE 'simplified_from_existing' END AS origin FROM dataset WHERE id BETWEEN 10 AND 30")
def r_range_and_conditional_column(spark, d):
    return dataset(spark, d).where(F.expr("try_cast(id as bigint) between 10 and 30")).select("id", F.when(F.col("id") >= 20, "simplified_from_existing").alias("origin"))


@query("SELECT abs(round(avg(x), 6)) AS mean, round(stddev_samp(x), 6) AS deviation, round(min(x), 6) AS least FROM (SELECT (automaton_size - avg(automaton_size) OVER ()) / stddev_samp(automaton_size) OVER () AS x FROM dataset)")
def r_standardized(spark, d):
    found = stats.standardized(dataset(spark, d).select(F.col("automaton_size").cast("double").alias("x")), ["x"])
    return found.agg(F.abs(F.round(F.avg("x"), 6)).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("deviation"), F.round(F.min("x"), 6).alias("least"))


@query(f"""WITH {_VARIANTS} SELECT min(pos) AS pos, arg_min(f, (CASE WHEN (f = key) = (t NOT IN (7, 11)) THEN 0 ELSE 1 END) * 1000000000 + pos) AS LTL FROM v GROUP BY key""")
def r_semantic_upsert(spark, d):
    own = _with_variants(spark, d).select("pos", "LTL")
    return semantic.upsert(own.where("pos < 100"), own.where("pos >= 100").withColumn("pos", F.col("pos") - 99))


@query(f"""WITH {_VARIANTS}, p AS (SELECT pos, key, CASE WHEN (f = key) = (t NOT IN (7, 11)) THEN 0 ELSE 1 END AS pref FROM v),
m AS (SELECT *, min(pref) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM p)
SELECT CASE WHEN earlier IS NULL THEN 'inserted' WHEN pref < earlier THEN 'replaced' ELSE 'skipped' END AS outcome, count(*) AS n FROM m WHERE pos >= 30 GROUP BY 1""")
def r_merge_outcomes(spark, d):
    own = _with_variants(spark, d).select("pos", "LTL")
    return semantic.merge_outcomes(own.where("pos < 30"), own.where("pos >= 30").withColumn("pos", F.col("pos") - 29)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_VARIANTS} SELECT DISTINCT f AS formula, arg_min(f, pos) OVER (PARTITION BY key) AS class_leader FROM v")
def r_equivalence_classes(spark, d):
    return semantic.classes(_with_variants(spark, d))


@query("SELECT id, true AS plain, false AS broken FROM dataset")
def r_validity(spark, d):
    own = dataset(spark, d)
    judged = own.select("LTL").distinct().select("LTL", *(lex.measures(f).isNotNull().alias(n) for n, f in (("plain", F.col("LTL")), ("broken", F.concat("LTL", F.lit(" U"))))))
    return own.join(judged, "LTL").select("id", "plain", "broken")


@query()
def r_automaton_size(spark, d):
    own = dataset(spark, d).select("id", "LTL")
    distinct = own.select("LTL").distinct().withColumn("graph", fm.ltl_automaton("LTL"))
    return own.join(distinct, "LTL").select("id", "graph.states", "graph.transitions", (F.col("graph.states") + F.col("graph.transitions")).alias("size"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS answer FROM events")
def r_provider_answers(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    word = F.to_json(F.struct(F.col("event_type").alias("text")))
    response = F.concat(F.lit('{"candidates":[{"content":{"parts":['), word, F.lit("]}}]}"))
    anthropic = F.concat(F.lit('{"content":['), word, F.lit("]}"))
    chat = F.concat(F.lit('{"choices":[{"message":{"content":"'), "event_type", F.lit('"}}]}'))
    kind = F.element_at(F.array(*map(F.lit, ("gemini", "anthropic", "mistral", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    shown = F.when(kind == "gemini", response).when(kind == "anthropic", anthropic).otherwise(chat)
    return events.select("event_id", providers.answer(kind, shown).alias("answer"))


# Two records of one template have the same form but for the names; none is trivial or without temporal operators.
@query("""SELECT pos, LTL, CASE WHEN first < pos THEN 'redundant' ELSE '' END AS reasons, CASE WHEN first = pos THEN LTL END AS accepted_form FROM (SELECT *, min(pos) OVER (PARTITION BY t) AS first FROM dataset)""")
def r_filter_formulas(spark, d):
    return semantic.filter_formulas(dataset(spark, d).select("pos", "LTL")).withColumn("reasons", F.array_join("reasons", ","))


_ROOMS = ["red_room", "blue_room", "green_room", "yellow_room"]


# However they are drawn, a template has two different variants, each naming its propositions by different rooms.
@query("SELECT id, id AS template_id, k AS variant, CASE WHEN strpos(LTL, b) > 0 THEN 2 ELSE 1 END AS names, LTL AS restored FROM dataset, (VALUES (1), (2)) AS v(k)")
def r_grounded_variants(spark, d):
    made = variants.grounded_variants(dataset(spark, d).select("id", "LTL"), _ROOMS, 2, ("LTL",))
    # Equal variants would have one number.
    number = F.dense_rank().over(Window.partitionBy("id").orderBy(F.to_json("ap_mapping")))
    back = F.map_from_entries(F.transform(F.map_entries("ap_mapping"), lambda e: F.struct(e["value"], e["key"])))
    shown = made.withColumn("variant", number).withColumn("known", F.size(F.array_intersect(F.map_values("ap_mapping"), F.array(*map(F.lit, _ROOMS)))))
    return shown.select("id", "template_id", "variant", F.col("known").alias("names"), tx.replaced_names(F.col("LTL"), back).alias("restored"))


# Formulas.


@query(f"SELECT id, array_to_string({_TOKENS}, ' ') AS tokens, CAST(len({_CORE}) AS INT) AS n FROM dataset")
def r_tokens(spark, d):
    tokens = lex.tokens(F.col("LTL"))
    return dataset(spark, d).select("id", F.array_join(tokens, " ").alias("tokens"), lex.size(tokens).alias("n"))


@query(f"SELECT id, CAST(len(list_distinct(list_filter({_TOKENS}, lambda x: x LIKE 'prop%'))) AS INT) AS n_props, CAST(len(list_filter({_TOKENS}, lambda x: x = 'F')) AS INT) AS n_f FROM dataset")
def r_token_counts(spark, d):
    tokens = lex.tokens(F.col("LTL"))
    return dataset(spark, d).select("id", F.size(lex.propositions(tokens)).alias("n_props"), lex.count_of(tokens, "F").alias("n_f"))


@query(f"SELECT id, array_to_string(list_transform({_TOKENS}, lambda x: CASE WHEN x LIKE 'prop%' THEN CASE WHEN x = list_filter({_TOKENS}, lambda y: y LIKE 'prop%')[1] THEN 'prop_1' ELSE 'prop_2' END ELSE x END), ' ') AS canonical FROM dataset")
def r_canonical_names(spark, d):
    return dataset(spark, d).select("id", lex.canonical(lex.tokens(F.col("LTL"))).alias("canonical"))


@query(f"SELECT id, {case('tag')} AS tags, {case('label')} AS label FROM dataset")
def r_behaviour(spark, d):
    text = F.col("LTL")
    return dataset(spark, d).select("id", F.array_join(lex.behaviour_tags(text), ",").alias("tags"), lex.behaviour_label(lex.tokens(text)).alias("label"))


@query(f"SELECT id, {case('size', quoted=False)} AS ast_size, {case('depth', quoted=False)} AS ast_depth, {case('temporal_depth', quoted=False)} AS temporal_depth, LTL AS rendered, false AS is_trivial FROM dataset")
def r_formula_metrics(spark, d):
    shown = dataset(spark, d).select("LTL").distinct().withColumn("x", fm.ltl_metrics("LTL"))
    return _measured(dataset(spark, d)).join(shown, "LTL").select("id", F.col("m.size").alias("ast_size"), F.col("m.depth").alias("ast_depth"), "m.temporal_depth", "x.rendered", "x.is_trivial")


@query(f"SELECT id, {case('english')} AS back_translation FROM dataset")
def r_back_translation(spark, d):
    own = dataset(spark, d)
    distinct = own.select("LTL").distinct().withColumn("back_translation", fm.ltl_to_nl("LTL"))
    return own.join(distinct, "LTL").select("id", "back_translation")


@query("SELECT id, true AS same, false AS other FROM dataset")
def r_equivalence(spark, d):
    own = dataset(spark, d)
    distinct = own.select("LTL", "same_formula", "other_formula").distinct().withColumn("same", fm.ltl_equivalent("LTL", "same_formula")).withColumn("other", fm.ltl_equivalent("LTL", "other_formula"))
    return own.join(distinct, ["LTL", "same_formula", "other_formula"]).select("id", "same", "other")


@query("SELECT id, 'satisfiable' AS plain, 'unsatisfiable' AS contradiction, 'tautology' AS excluded_middle FROM dataset")
def r_satisfiability(spark, d):
    own = dataset(spark, d)
    both = own.select("LTL").distinct()
    judged = both.select("LTL", fm.ltl_status("LTL").alias("plain"), fm.ltl_status(F.concat(F.lit("("), "LTL", F.lit(" & !("), "LTL", F.lit("))"))).alias("contradiction"), fm.ltl_status(F.concat(F.lit("("), "LTL", F.lit(" | !("), "LTL", F.lit("))"))).alias("excluded_middle"))
    return own.join(judged, "LTL").select("id", "plain", "contradiction", "excluded_middle")


@query(f"SELECT id, {case('simplified')} AS simplified FROM dataset")
def r_simplify(spark, d):
    own = dataset(spark, d).select("id", F.concat(F.lit("(true & !(!("), "LTL", F.lit(")))")).alias("f"))
    distinct = own.select("f").distinct().withColumn("simplified", fm.ltl_simplify("f"))
    return own.join(distinct, "f").select("id", "simplified")


@query("SELECT id, 'already_valid' AS plain, 'restructured_from_prefix' AS prefix, concat('(', a, ' -> F (', b, '))') AS formula, 'empty_output' AS nothing FROM dataset")
def r_repair(spark, d):
    own = dataset(spark, d).select("id", tx.raw_output(F.concat(F.lit("LTL: "), "LTL")).alias("p"), F.concat(F.lit("i "), "a", F.lit(" F "), "b").alias("q"))
    outputs = own.select(F.explode(F.array("p", "q", F.lit(""))).alias("output")).distinct().withColumn("r", fm.ltl_repair("output"))
    read = own
    for name, output in (("x", F.col("p")), ("y", F.col("q")), ("z", F.lit(""))):
        read = read.withColumn("_o", output).join(outputs.select(F.col("output").alias("_o"), F.col("r").alias(name)), "_o").drop("_o")
    return read.select("id", F.col("x.status").alias("plain"), F.col("y.status").alias("prefix"), F.col("y.formula").alias("formula"), F.col("z.status").alias("nothing"))


@query("SELECT id, concat('(G(', a, ') -> F(!(', b, ')))') AS infix FROM dataset")
def r_word_prefix(spark, d):
    own = dataset(spark, d).select("id", F.concat(F.lit("LTL: -> G "), "a", F.lit(" F ! "), "b").alias("f"))
    return own.join(own.select("f").distinct().withColumn("infix", fm.ltl_from_word_prefix("f")), "f").select("id", "infix")


@query(f"SELECT id, CASE WHEN t IN (9, 10) THEN 0 ELSE {case('temporal_depth', quoted=False)} END AS until_only, {case('temporal_depth', quoted=False)} AS all_binary FROM dataset")
def r_scanned_depth(spark, d):
    own = dataset(spark, d)
    tokens = lex.tokens(F.col("LTL"))
    distinct = own.select("LTL").distinct().select("LTL", fm.scanned_depth(tokens, ("U",)).alias("until_only"), fm.scanned_depth(tokens).alias("all_binary"))
    return own.join(distinct, "LTL").select("id", "until_only", "all_binary")


@query("SELECT id, CASE WHEN id BETWEEN 5 AND 60 AND trim(paraphrase_gpt) = '' THEN LTL ELSE paraphrase_gpt END AS paraphrase_gpt FROM dataset")
def r_filled(spark, d):
    return edits.filled(dataset(spark, d), "paraphrase_gpt", F.col("LTL"), ids=(5, 60)).select("id", "paraphrase_gpt")


@query("SELECT id, LTL, NULL AS origin, NULL AS source FROM dataset UNION ALL SELECT row_number() OVER (ORDER BY pos) + (SELECT max(id) FROM dataset), same_formula, 'simplified_from_existing', id FROM dataset WHERE id % 3 = 0")
def r_with_simplified(spark, d):
    own = dataset(spark, d).select("pos", "id", "LTL", F.when(F.col("id") % 3 == 0, F.col("same_formula")).otherwise(F.col("LTL")).alias("simplified_formula"))
    return edits.with_simplified(own).select("id", "LTL", "origin", F.col("source_record_id").alias("source"))


# Texts.


@query("SELECT id, concat('G(', a, ') & F(', b, ')') AS formula FROM dataset")
def r_spelled_out(spark, d):
    return dataset(spark, d).select("id", tx.wrapped_operands(tx.spelled_out(F.concat(F.lit("LTL: always "), "a", F.lit(", and eventually "), "b", F.lit(".")))).alias("formula"))


@query("SELECT id, LTL AS fenced, LTL AS marked FROM dataset")
def r_unfenced(spark, d):
    return dataset(spark, d).select("id", tx.unfenced(F.concat(F.lit("```ltl\n"), "LTL", F.lit("\n```"))).alias("fenced"), tx.raw_output(F.concat(F.lit(" Output:  "), "LTL", F.lit("\n"))).alias("marked"))


@query("SELECT id, LTL AS trimmed, concat('((', LTL, '))') AS completed FROM dataset")
def r_parentheses(spark, d):
    return dataset(spark, d).select("id", tx.without_extra_closing(F.concat("LTL", F.lit(")"))).alias("trimmed"), tx.with_missing_closing(F.concat(F.lit("(("), "LTL")).alias("completed"))


@query("SELECT id, concat(a, ',', b) AS placeholders, concat('a=', a, ',b=', b) AS letters FROM dataset")
def r_placeholders(spark, d):
    text = F.concat(F.col("b"), F.lit(" and "), F.col("a"), F.lit(" and "), F.col("b"))
    letters = F.transform(F.map_entries(tx.letter_mapping(text, F.col("LTL"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return dataset(spark, d).select("id", F.array_join(tx.placeholders(text), ",").alias("placeholders"), F.array_join(letters, ",").alias("letters"))


@query("SELECT id, 'prop_1 U prop_2' AS gold, 'F(prop_2)' AS predicted FROM dataset")
def r_pair_names(spark, d):
    own = dataset(spark, d).withColumn("g", F.concat(F.lit("x_"), "a", F.lit(" U "), "b")).withColumn("p", F.concat(F.lit("F("), "b", F.lit(")")))
    mapped = own.withColumn("m", tx.pair_mapping(F.col("g"), F.col("p")))
    return mapped.select("id", tx.replaced_names(F.col("g"), F.col("m")).alias("gold"), tx.replaced_names(F.col("p"), F.col("m")).alias("predicted"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS INT) AS words FROM documents")
def r_word_counts(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("SELECT id, regexp_replace(LTL, '[[:space:]()]', '', 'g') AS surface, regexp_replace(concat(LTL, '.json'), '[^A-Za-z0-9._-]', '_', 'g') AS file, concat('x/', id, '_with_equivalence.json') AS path FROM dataset")
def r_surface_and_names(spark, d):
    return dataset(spark, d).select("id", tx.surface_form(F.col("LTL")).alias("surface"), tx.safe_name(F.concat("LTL", F.lit(".json"))).alias("file"), tx.with_equivalence_path(F.concat(F.lit("x/"), "id", F.lit(".json"))).alias("path"))


@query("SELECT id, CASE WHEN trim(paraphrase_gpt) <> '' THEN paraphrase_gpt ELSE natural_paraphrase END AS chosen FROM dataset")
def r_first_present(spark, d):
    return dataset(spark, d).select("id", tx.first_present(F.col("paraphrase_gpt"), F.col("natural_paraphrase")).alias("chosen"))


@query("SELECT id, concat('Translate: ', natural_paraphrase, chr(10), 'LTL:') AS prompt FROM dataset")
def r_prompts(spark, d):
    return dataset(spark, d).select("id", tx.prompt(F.col("natural_paraphrase"), "Translate: {sentence}\nLTL:").alias("prompt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def r_json_field(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_NAMED = {"GPT54_fewshot": "gpt-5.4", "Claude_fewshot": "claude-opus-4-7", "my_t5_run": "finetuned-t5", "other": "other"}


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'claude-opus-4-7' WHEN 2 THEN 'finetuned-t5' ELSE 'other' END AS model, CASE WHEN id % 4 < 2 THEN 'fewshot' ELSE 'zeroshot' END AS prompt_setting FROM dataset")
def r_model_names(spark, d):
    from ..functions import names

    stem = F.element_at(F.array(*map(F.lit, _NAMED)), (F.col("id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("results/"), stem, F.lit(".json"))
    return dataset(spark, d).select("id", names.model_name(F.lit(None).cast("string"), path).alias("model"), names.prompt_setting(F.lit(None).cast("string"), path).alias("prompt_setting"))
