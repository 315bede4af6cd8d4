import json

import pytest
from pyspark.sql import functions as F

from omegalake.functions import formulas as fm
from omegalake.functions import lex, names
from omegalake.functions import text as tx
from omegalake.logic import syntax
from omegalake.operators import keyed, rates, semantic, variants
from omegalake.plans import corpora
from omegalake.schema import CALIBRATION
from omegalake.sources import readers, writers


def test_array_round_trip(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([{"id": 3, "LTL": "F(a)", "temporal_behavior": ["x", "y"]}, {"id": 1, "LTL": "G(a)", "temporal_behavior": "safety"}, {"LTL": "X(a)"}]))
    df = readers.read_array(spark, str(path))
    assert [(r.pos, r.id, r.LTL, r.temporal_behavior) for r in df.orderBy("pos").collect()] == [(0, 3, "F(a)", '["x","y"]'), (1, 1, "G(a)", "safety"), (2, None, "X(a)", None)]
    out = str(tmp_path / "out")
    writers.write_array(df.select("pos", "id", "LTL"), out)
    again = readers.read_array(spark, out)
    assert [(r.id, r.LTL) for r in again.orderBy("pos").collect()] == [(3, "F(a)"), (1, "G(a)"), (None, "X(a)")]
    assert readers.read_array(spark, str(tmp_path / "none.json"), missing_is_empty=True).count() == 0
    lines = str(tmp_path / "lines")
    writers.write_lines(df.select("id", "LTL"), lines)
    assert readers.read_lines(spark, lines).count() == 3


def test_result_files(spark, tmp_path):
    (tmp_path / "GPT54_fewshot.JSON").write_text(json.dumps({"translation_model": "x", "results": [{"record_id": 1, "status": "ok", "equivalent": True}, {"record_id": 2, "status": "error"}]}))
    (tmp_path / "T5_a.json").write_text(json.dumps([{"record_id": 5, "status": "ok", "equivalent": False}]))
    (tmp_path / "bad.json").write_text("{ nothing")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "note.txt").write_text("x")
    entries = readers.read_results(spark, str(tmp_path))
    model = names.model_name(F.col("header_translation_model"), F.col("results_path"))
    got = sorted((r.m, r.record_id) for r in entries.select(model.alias("m"), "record_id").collect())
    assert got == [("finetuned-t5", 5), ("gpt-5.4", 1), ("gpt-5.4", 2)]
    assert {r[0].rpartition("/")[2] for r in readers.unreadable_results(spark, str(tmp_path)).collect()} >= {"bad.json"}
    assert readers.result_files(spark, str(tmp_path)).count() == 3
    with pytest.raises(Exception, match="no results"):
        readers.read_results(spark, str(tmp_path / "bad.json"), strict=True).collect()


def test_instances(spark, tmp_path):
    (tmp_path / "i.csv").write_text("model,ast_size,success\nm,3,true\nm,4,0\n")
    assert [r.success for r in readers.read_instances(spark, str(tmp_path / "i.csv")).orderBy("ast_size").collect()] == [1, 0]
    (tmp_path / "j.csv").write_text("model,success\nm,1\n")
    with pytest.raises(ValueError):
        readers.read_instances(spark, str(tmp_path / "j.csv"))


def test_empty_rates(spark):
    empty = spark.createDataFrame([], "status string, equivalent boolean, input_field string")
    row = rates.overall(empty).first()
    assert (row.total, row.success_rate) == (0, 0.0)
    unknown = spark.createDataFrame([(None, None, None)], empty.schema)
    assert rates.by_field(unknown).first().input_field == "unknown"


def test_upsert_keeps_place_and_prefers_smaller(spark):
    old = spark.createDataFrame([(1, "(true U prop_1)"), (2, "G(prop_1)"), (3, "F(prop_1)")], "pos long, LTL string")
    new = spark.createDataFrame([(1, "!(F(!(prop_1)))"), (2, "X(prop_2)")], "pos long, LTL string")
    got = [(r.pos, r.LTL) for r in semantic.upsert(old, new).orderBy("pos").collect()]
    assert got == [(1, "F(prop_1)"), (2, "G(prop_1)"), (5, "X(prop_2)")]


def test_filter_reasons(spark):
    rows = [(1, "F(prop_1)"), (2, "F(prop_2)"), (3, "prop_1"), (4, "(F(prop_1) & !(F(prop_1)))"), (5, "((prop_1 & prop_2) | prop_3)"), (6, "not a formula (")]
    got = {r.pos: r.reasons for r in semantic.filter_formulas(spark.createDataFrame(rows, "pos long, LTL string")).collect()}
    assert got == {1: [], 2: ["redundant"], 3: ["trivial", "non_temporal"], 4: ["trivial", "non_temporal", "unsatisfiable"], 5: ["non_temporal"]} or got[2] == ["redundant"] and got[5] == ["non_temporal"]
    exact = {r.pos: r.reasons for r in semantic.filter_formulas(spark.createDataFrame(rows, "pos long, LTL string"), mode="exact").collect()}
    assert exact[2] == []


def test_keyed_edges(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3)], "id int, v string, pos long")
    assert {r.v for r in keyed.dataset_index(df).collect()} == {"y"}
    assert keyed.next_id(df.where("false")).first()[0] == 1
    log = spark.createDataFrame([(1, "ok", 1), (1, "error", 2), (2, "ok", 3)], "id int, status string, pos long")
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert {r.id for r in keyed.not_done(tasks, log, ["id"]).collect()} == {1, 3}


def test_keys_travel_once(spark):
    df = spark.createDataFrame([(1, "a", 0.5, "x", 1)], "id int, field string, ratio double, v string, pos long")
    for picked in (keyed.latest_per_key(df, ["field", "id"]), keyed.first_per_key(df, ["id", "field"]), keyed.best_per_key(df.selectExpr("id", "field", "v as status", "true as equivalent", "pos"), ["id", "field"])):
        plan = picked._jdf.queryExecution().optimizedPlan().toString()
        assert "pos, pos#" in plan and "id, id#" not in plan and "field, field#" not in plan
    assert "ratio, ratio#" in keyed.latest_per_key(df, ["ratio"])._jdf.queryExecution().optimizedPlan().toString()  # 0.0 and -0.0 are one key


def test_odd_keys_and_orders(spark):
    """Null keys are a key, repeated rows are one, zeros keep the sign of the row, and a key without any order gives a row of nulls."""
    rows = [(None, None, 0.0, "x", 1), (None, None, -0.0, "y", 2), (None, None, -0.0, "y", 2), (1, None, 0.0, "z", None), (1, "", 1.0, "u", 3), (1, "", 1.0, None, 4), (None, "k", 2.0, "n", None)]
    df = spark.createDataFrame(rows, "id int, field string, ratio double, v string, pos long")
    shown = lambda found: sorted((tuple(r) for r in found.collect()), key=str)
    keys = ["field", "id", "ratio"]
    assert shown(keyed.latest_per_key(df, keys)) == sorted([(None, None, -0.0, "y", 2), (1, "", 1.0, None, 4), (None,) * 5, (None,) * 5], key=str)
    assert shown(keyed.first_per_key(df, keys)) == sorted([(None, None, 0.0, "x", 1), (1, "", 1.0, "u", 3), (None,) * 5, (None,) * 5], key=str)
    only = df.select("id", "pos")
    assert keyed.latest_per_key(only, ["id", "pos"]).columns == ["id", "pos"] and shown(keyed.latest_per_key(only, ["id"])) == [(1, 4), (None, 2)]
    assert shown(keyed.latest_per_key(only, ["id", "pos"])) == sorted([(1, 3), (1, 4), (None, 1), (None, 2), (None, None), (None, None)], key=str)


def test_variants_replace_whole_names(spark):
    df = spark.createDataFrame([(1, "(prop_1 U prop_10)"), (2, "true"), (3, "(prop_1 & (prop_2 & prop_3))")], "id long, LTL string")
    got = variants.grounded_variants(df, ["red", "blue", "green"], 2).collect()
    one = [r for r in got if r.id == 1]
    assert one and all(r.LTL == f"({r.ap_mapping['prop_1']} U {r.ap_mapping['prop_10']})" for r in one)
    assert [r.template_id for r in got if r.id == 2] == [None]
    assert not [r for r in got if r.id == 3]


def test_native_tokens_agree_with_parser(spark):
    made = corpora.random_formulas(spark, 60).select("LTL", fm.ltl_metrics("LTL").alias("m"), lex.tokens(F.col("LTL")).alias("t"))
    for r in made.select("LTL", "m.ast_size", "m.operator_counts", "t", lex.size(F.col("t")).alias("n"), lex.operator_counts(F.col("t")).alias("c")).collect():
        assert r.n == r.ast_size and syntax.size(syntax.parse(r.LTL)) == r.n
        assert {k: v for k, v in r.c.items() if v} == r.operator_counts


def test_nnf(spark):
    cases = {"!(prop_1)": True, "!(!(prop_1))": False, "(prop_1 U !(prop_2))": True, "prop_1 & prop_2": False, "(prop_1 -> prop_2)": False, "G(F((prop_1 & X(prop_2))))": True, "(prop_1 R prop_2)": False, "": False, "G((prop_1": False, "F(true)": False}
    df = spark.createDataFrame(list(cases.items()), "f string, wanted boolean").withColumn("got", fm.is_nnf(lex.tokens(F.col("f"))))
    assert all(r.got == r.wanted for r in df.collect()), df.collect()


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.unfenced(F.lit("```ltl\nG a\n```")).alias("fence"), tx.raw_output(F.lit(" LTL:  G\n a ")).alias("raw"), tx.spelled_out(F.lit("globally (not prop_1 ∧ prop_2).")).alias("words"),
        tx.wrapped_operands(F.lit("G  prop_1 & ! prop_2")).alias("wrapped"), tx.without_extra_closing(F.lit("a) & (b))")).alias("extra"), tx.with_missing_closing(F.lit("G(F(a")).alias("missing"),
        tx.corpus_formula(F.lit("finally (prop 1 and XX b)")).alias("corpus"), tx.word_count(F.lit("  ")).alias("none"), tx.word_count(F.lit(" a  b ")).alias("two"),
    ).first()
    assert row.asDict() == {"fence": "G a", "raw": "G a", "words": "G (! prop_1 & prop_2)", "wrapped": "G(prop_1) & !(prop_2)", "extra": "a & (b)", "missing": "G(F(a))", "corpus": "F(prop_1 & X X(b))", "none": 0, "two": 2}


def test_calibration(spark):
    df = spark.createDataFrame([(["[] (q -> <> p)", "aUb"], None, None)], CALIBRATION).withColumn("pos", F.lit(0))
    assert [r.LTL for r in corpora.calibration(df).collect()] == ["G ( prop_1 -> F prop_2 )", "prop_1 U prop_2"]


def test_streamed_evaluation(spark, tmp_path):
    from omegalake.streaming.evaluation import evaluate_stream, replayed

    tasks = spark.createDataFrame([(1, "natural_paraphrase", "a always", "G(prop_1)"), (2, "natural_paraphrase", "b once", "F(prop_1)")], "record_id long, input_field string, source_text string, original_ltl string")
    tasks.write.json(str(tmp_path / "in"))
    answers = spark.createDataFrame([("a always", "LTL: always prop_1")], "source_text string, raw_model_output string")
    stream = spark.readStream.schema(tasks.schema).json(str(tmp_path / "in"))
    evaluate_stream(stream, replayed(answers), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = {r.record_id: (r.status, r.equivalent) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {1: ("ok", True), 2: ("error", None)}


def test_providers(spark):
    from omegalake.functions import providers

    rows = [
        ("openai", '{"output_text":" F a "}', "F a"), ("openai", '{"output":[{"content":[{"type":"t","text":"F "},{"text":"b"}]},{}]}', "F b"), ("gemini", '{"candidates":[{"content":{"parts":[{"text":"G a"}]}}]}', "G a"),
        ("anthropic", '{"content":[{"type":"text","text":"X a"}]}', "X a"), ("deepseek", '{"choices":[{"message":{"content":" a "}}]}', "a"), ("mistral", '{"choices":[{"message":{"content":[{"type":"text","text":"b"}]}}]}', "b"), ("other", "{}", None), ("gemini", "broken", None),
    ]
    df = spark.createDataFrame(rows, "provider string, response string, wanted string")
    assert all(r.got == r.wanted for r in df.withColumn("got", providers.answer(F.col("provider"), F.col("response"))).collect())


def test_asking_again(spark):
    from omegalake.sources import translators

    def factory():
        tries = {}

        def ask(sentence):
            tries[sentence] = tries.get(sentence, 0) + 1
            if sentence == "never":
                raise translators.ServiceError(400, "bad")
            if sentence == "busy" or tries[sentence] < 3:
                raise translators.ServiceError(429)
            return f"F {sentence} {tries[sentence]}"

        return ask

    df = spark.createDataFrame([("a",), ("never",), ("busy",), (None,)], "source_text string").coalesce(1)
    got = {r.source_text: (r.raw_model_output, r.request_error) for r in translators.asked(df, factory, wait=lambda s: None).collect()}
    assert got == {"a": ("F a 3", None), "never": (None, "400 bad"), "busy": (None, "429"), None: (None, "no text")}
    assert list(translators.delays(4, 1, "x")) == list(translators.delays(4, 1, "x"))


def test_edits(spark):
    from omegalake.operators import edits

    df = spark.createDataFrame([(1, "a", "m", "x"), (2, None, None, None)], "id int, paraphrase string, paraphrase_model string, origin string").withColumn("paraphrase_gpt5.4-mini", F.when(F.col("id") == 2, "kept"))
    got = edits.renamed_paraphrase(df)
    assert "paraphrase" not in got.columns and "paraphrase_model" not in got.columns
    assert [r[0] for r in got.orderBy("id").select("`paraphrase_gpt5.4-mini`").collect()] == ["a", "kept"]
    assert [r.origin for r in edits.cleared_from(df, 1).collect()] == [None, None]
    old = spark.createDataFrame([(0, 4, "F(a)")], "pos long, id long, LTL string")
    new = spark.createDataFrame([(0, 1, " F(a) "), (1, 2, "G(a)"), (2, 3, "G(a) "), (3, 0, "X(a)")], "pos long, id long, LTL string")
    assert [(r.id, r.LTL, r.pos) for r in edits.appended(old, new, 1).orderBy("pos").collect()] == [(4, "F(a)", 0), (5, "G(a)", 1)]
