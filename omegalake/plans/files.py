"""Queries that write a table in each file format and read it back, ask a service, and apply the token functions of outside corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions import lex
from ..functions import text as tx
from ..operators import keyed, variants
from ..shared import fresh_path
from ..sources import readers, translators, writers
from . import corpora
from .benchmark import dataset, results
from .registry import query


@query("SELECT row_number() OVER (PARTITION BY pos // 10000 ORDER BY pos) - 1 AS place, id, LTL, natural_paraphrase FROM dataset")
def r_array_files(spark, d):
    path = fresh_path(spark, "array-files")
    writers.write_arrays(dataset(spark, d).select("pos", "id", "LTL", "natural_paraphrase"), path)
    return readers.read_array(spark, path).select(F.col("pos").alias("place"), "id", "LTL", "natural_paraphrase")


@query("SELECT id, LTL, natural_paraphrase, source_record_id FROM dataset")
def r_line_files(spark, d):
    path = fresh_path(spark, "line-files")
    writers.write_lines(dataset(spark, d).select("id", "LTL", "natural_paraphrase", "source_record_id"), path)
    return readers.read_lines(spark, path).select("id", "LTL", "natural_paraphrase", "source_record_id")


def _result_files(spark, d):
    path = fresh_path(spark, "result-files")
    log = results(spark, d).select("pos", F.col("pos").alias("id"), "record_id", "input_field", F.col("model").alias("translation_model"), "prompt_setting", "status", "equivalent")
    writers.write_results(log, path)
    return path


@query("SELECT pos AS id, record_id, input_field, model AS translation_model, prompt_setting, status, equivalent FROM results")
def r_result_envelopes(spark, d):
    read = readers.read_results(spark, _result_files(spark, d), strict=True)
    return read.select("id", "record_id", "input_field", F.col("header_translation_model").alias("translation_model"), F.col("header_prompt_setting").alias("prompt_setting"), "status", "equivalent")


@query("SELECT count(*) AS files FROM (SELECT DISTINCT model, prompt_setting, pos // 10000 AS part FROM results)")
def r_result_listing(spark, d):
    return readers.result_files(spark, _result_files(spark, d)).agg(F.count("*").alias("files"))


@query("SELECT model, CAST(floor(value) AS INT) AS ast_size, count(*) AS n, count(*) FILTER (pos % 3 < 2) AS successes FROM results WHERE value IS NOT NULL GROUP BY 1, 2")
def r_csv_instances(spark, d):
    path = fresh_path(spark, "instances")
    said = F.element_at(F.array(F.lit("1"), F.lit("true"), F.lit("no")), (F.col("pos") % 3 + 1).cast("int"))
    own = results(spark, d).where("value is not null").select("model", F.floor("value").cast("int").alias("ast_size"), said.alias("success"), F.col("prompt_setting").alias("setting"))
    own.write.option("header", True).csv(path)
    read = readers.read_instances(spark, path)
    return read.groupBy("model", "ast_size").agg(F.count("*").alias("n"), F.sum("success").alias("successes"))


@query("SELECT CAST(record_id // 3 AS VARCHAR) AS key, max(pos) AS pos FROM results WHERE record_id % 7 <> 0 GROUP BY 1")
def r_dataset_index(spark, d):
    key = F.when(F.col("record_id") % 7 == 0, F.concat(F.lit("x"), F.col("record_id").cast("string"))).otherwise(F.floor(F.col("record_id") / 3).cast("string"))
    return keyed.dataset_index(results(spark, d).select("pos", key.alias("key")), "key").select("key", "pos")


@query("""SELECT id AS record_id, CASE WHEN id % 4 < 2 THEN concat('LTL: say ', id, CASE id % 4 WHEN 0 THEN ' fine' ELSE ' busy' END) END AS raw_model_output,
  CASE id % 4 WHEN 2 THEN '400 refused' WHEN 3 THEN '503 down' END AS request_error FROM dataset""")
def r_asked_with_retries(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("fine", "busy", "refused", "down"))), (F.col("id") % 4 + 1).cast("int"))
    tasks = dataset(spark, d).select(F.col("id").alias("record_id"), F.concat(F.lit("say "), F.col("id").cast("string"), F.lit(" "), kind).alias("source_text"))

    def service():
        """Answers; a busy one only at the third time of asking."""
        last = {"sentence": None, "times": 0}

        def ask(sentence):
            last.update(sentence=sentence, times=last["times"] + 1 if sentence == last["sentence"] else 1)
            if sentence.endswith("refused"):
                raise translators.ServiceError(400, "refused")
            if sentence.endswith("down") or (sentence.endswith("busy") and last["times"] < 3):
                raise translators.ServiceError(503, "down")
            return "LTL: " + sentence

        return ask

    return translators.asked(tasks, service, wait=lambda seconds: None).select("record_id", "raw_model_output", "request_error")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events")
def r_timestamps(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


# Tokens of outside corpora, names and grammar.

_PATTERN = "'<->|->|[()&|!]|[<-]|[^[:space:]()&|!<-]+'"


def _in_corpus_notation(formula):
    for own, other in (("G(", "[]("), ("F(", "<>("), ("&", "&&"), ("|", "||")):
        formula = F.replace(formula, F.lit(own), F.lit(other))
    return formula


@query(f"SELECT id, array_to_string(regexp_extract_all(LTL, {_PATTERN}), ' ') AS tokens FROM dataset")
def r_corpus_tokens(spark, d):
    return dataset(spark, d).select("id", F.array_join(lex.corpus_tokens(_in_corpus_notation(F.col("LTL"))), " ").alias("tokens"))


@query(f"""WITH f AS (SELECT pos, regexp_extract_all(LTL, {_PATTERN}) AS w FROM dataset UNION ALL SELECT pos, regexp_extract_all(same_formula, {_PATTERN}) FROM dataset),
n AS (SELECT *, list_filter(w, lambda x: x LIKE 'prop%') AS p FROM f)
SELECT pos, array_to_string(list_transform(w, lambda x: CASE WHEN x NOT LIKE 'prop%' THEN x WHEN x = p[1] THEN 'prop_1' ELSE 'prop_2' END), ' ') AS LTL, CAST(len(list_distinct(p)) AS INT) AS names FROM n""")
def r_calibration_formulas(spark, d):
    listed = F.array(_in_corpus_notation(F.col("LTL")), _in_corpus_notation(F.col("same_formula")))
    return corpora.calibration(dataset(spark, d).select("pos", listed.alias("ltlequ"))).select("pos", "LTL", F.size("mapping").alias("names"))


@query("""SELECT id, CASE WHEN strpos(LTL, b) = 0 THEN a WHEN strpos(LTL, a) = 0 THEN b WHEN strpos(LTL, a) < strpos(LTL, b) THEN concat(a, ',', b) ELSE concat(b, ',', a) END AS names,
  strpos(LTL, b) > 0 AS has_second FROM (SELECT id, a, b, same_formula AS LTL FROM dataset)""")
def r_distinct_names(spark, d):
    names = lex.propositions(lex.tokens(F.col("same_formula")))
    return dataset(spark, d).select("id", F.array_join(names, ",").alias("names"), F.array_contains(names, F.col("b")).alias("has_second"))


@query("SELECT id, LTL AS restored, CASE WHEN strpos(LTL, b) > 0 THEN 2 ELSE 1 END AS names FROM dataset, range(2)")
def r_grounding_restored(spark, d):
    grounded = variants.grounded_variants(dataset(spark, d).select("id", "LTL"), ["red_room", "blue_room", "green_room", "yellow_room"], 2, ("LTL",))
    back = F.map_from_entries(F.transform(F.map_entries("ap_mapping"), lambda e: F.struct(e["value"], e["key"])))
    return grounded.select("id", tx.replaced_names(F.col("LTL"), back).alias("restored"), F.size("ap_mapping").alias("names"))


#: Formulas over two propositions, whether they are well formed, whether in negation normal form, and their tokens but for parentheses.
SYNTAX = (
    ("G((@a -> X(@b)))", True, False, 5),
    ("(@a U", False, False, 2),
    ("((@a & !(@b)) | X(@a))", True, True, 7),
    ("F(!(X(@a)))", True, False, 4),
    ("G F", False, False, 2),
    ("(@a M @b)", True, False, 3),
    ("@a & & @b", False, False, 4),
    ("(F(@a) U (G(@b) & X(@a)))", True, True, 8),
    ("(@a <-> @b)", True, False, 3),
    ("((@a)", False, False, 1),
    ("!(@a)", True, True, 2),
)

#: Pairs of formulas over two propositions, and whether they mean the same.
PAIRS = (
    ("F((@a | @b))", "(F(@a) | F(@b))", True),
    ("F((@a & @b))", "(F(@a) & F(@b))", False),
    ("G((@a & @b))", "(G(@a) & G(@b))", True),
    ("G((@a | @b))", "(G(@a) | G(@b))", False),
    ("G(F(G(@a)))", "F(G(@a))", True),
    ("X((@a U @b))", "(X(@a) U X(@b))", True),
    ("(@a U (@b U @a))", "(@b U @a)", True),
    ("(@a M @b)", "(@b U (@a & @b))", True),
    ("(@a W @b)", "(@b R (@a | @b))", True),
    ("!(G(@a))", "F(@a)", False),
    ("(@a -> X(@a))", "G((@a -> X(@a)))", False),
)


def _one_of(rows, at):
    """The column ``at`` of the row that an id picks; formulas get the record's propositions."""
    value = F.element_at(F.array(*(F.lit(r[at]) for r in rows)), (F.col("id") % len(rows) + 1).cast("int"))
    return F.replace(F.replace(value, F.lit("@a"), F.col("a")), F.lit("@b"), F.col("b")) if isinstance(rows[0][at], str) else value


def _sql_one_of(rows, at):
    return f"CASE id % {len(rows)} " + " ".join(f"WHEN {k} THEN {r[at]}" for k, r in enumerate(rows)) + " END"


@query(f"SELECT id, {_sql_one_of(SYNTAX, 1)} AS is_valid, {_sql_one_of(SYNTAX, 2)} AS is_nnf, CAST({_sql_one_of(SYNTAX, 3)} AS INT) AS size FROM dataset")
def r_known_syntax(spark, d):
    own = dataset(spark, d).select("id", _one_of(SYNTAX, 0).alias("f"))
    tokens = lex.tokens(F.col("f"))
    distinct = own.select("f").distinct().select("f", F.coalesce(fm.ltl_is_valid("f"), F.lit(False)).alias("is_valid"), fm.is_nnf(tokens).alias("is_nnf"), lex.size(tokens).alias("size"))
    return own.join(distinct, "f").select("id", "is_valid", "is_nnf", "size")


@query(f"SELECT id, {_sql_one_of(PAIRS, 2)} AS equivalent FROM dataset")
def r_known_equivalence(spark, d):
    own = dataset(spark, d).select("id", _one_of(PAIRS, 0).alias("f"), _one_of(PAIRS, 1).alias("g"))
    distinct = own.select("f", "g").distinct().withColumn("equivalent", fm.ltl_equivalent("f", "g"))
    return own.join(distinct, ["f", "g"]).select("id", "equivalent")
