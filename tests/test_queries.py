import pytest
from oracle import compare
from pyspark.sql import functions as F

from omegalake.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_published_summary(spark, sf_dir):
    row = QUERIES["q19_corpus_summary"](spark, sf_dir).first()
    assert (row["total"], row["unique_non_trivial"], row["max_size"], row["max_temporal_depth"], row["unread"]) == (43, 42, 33, 6, 0)


def test_logistic_against_closed_form(spark):
    from omegalake.operators import stats

    # One binary term: the fit gives the groups' log odds.
    df = spark.createDataFrame([(0, 1)] * 30 + [(0, 0)] * 10 + [(1, 1)] * 12 + [(1, 0)] * 24, "x int, y int")
    found = {r["term"]: r for r in stats.logistic_fit(df, ["x"], "y")}
    assert found["(Intercept)"]["coefficient"] == pytest.approx(1.0986122886, abs=1e-6)
    assert found["x"]["coefficient"] == pytest.approx(-0.6931471806 - 1.0986122886, abs=1e-6)
    assert found["x"]["se"] == pytest.approx((1 / 30 + 1 / 10 + 1 / 12 + 1 / 24) ** 0.5, abs=1e-5)
    law = stats.scaling_law(df.selectExpr("'m' as model", "x as ast_size", "y as success")).first()
    assert law["size50"] == pytest.approx(-law["beta0"] / law["beta1"])
    with pytest.raises(ValueError):
        stats.scaling_law(df)


def test_logistic_against_newton(spark, sf_dir):
    """q13 against plain Newton steps over all rows by numpy."""
    import math

    import numpy as np

    from omegalake.plans import queries as q

    own = q._measures(spark, sf_dir).select(*q._NAMES, "outcome").toPandas().astype(float)
    x = own[q._NAMES].to_numpy()
    spread = x.std(axis=0, ddof=1)
    x = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)])
    y, beta = own["outcome"].to_numpy(), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None])
        beta += np.linalg.pinv(h) @ x.T @ (y - p)
    found = QUERIES["q13_logistic_regression"](spark, sf_dir).collect()
    assert [r["term"] for r in found] == ["(Intercept)", *q._NAMES]
    for r, b, e in zip(found, beta, np.sqrt(np.clip(np.diag(np.linalg.pinv(h)), 0, None))):
        assert r["coefficient"] == pytest.approx(b, abs=1e-6) and r["se"] == pytest.approx(e, rel=1e-4, abs=1e-9)
        assert r["p_value"] == (pytest.approx(math.erfc(abs(b / e) / 2**0.5), abs=1e-5) if e > 1e-9 else None)
    assert found[0]["log_likelihood"] == pytest.approx(float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), rel=1e-9)


def test_p_values_against_the_library(spark, sf_dir):
    import math

    from omegalake.operators import stats
    from omegalake.plans import queries as q

    for r in stats.p_values(stats.spearman(q._measures(spark, sf_dir).select(*q._NAMES, "outcome"), q._NAMES, "outcome")).collect():
        assert (r["p_value"] is None) == (r["rho"] is None)
        assert r["rho"] is None or r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / 2**0.5), rel=1e-9)

    xs = [0.0, 0.01, 0.5, 1.0, 1.99, 2.0, 2.01, 3.5, 6.0, 12.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e")).collect()
    assert all(r.e == pytest.approx(math.erfc(r.x), rel=1e-10) for r in got)


def test_normal_form_at_any_depth(spark):
    from pyspark.sql import functions as F

    from omegalake.functions import formulas, lex

    deep = "prop_1"
    for k in range(40):
        deep = f"(X ({deep}))" if k % 2 else f"({deep} & prop_2)"
    rows = [(deep, True), (deep.replace("prop_1", "!(prop_1)", 1), True), (deep.replace("prop_1", "!(X prop_1)", 1), False), ("", False), ("(a", False)]
    df = spark.createDataFrame(rows, "f string, wanted boolean").withColumn("got", formulas.is_nnf(lex.tokens(F.col("f"))))
    assert [r.got for r in df.collect()] == [w for _, w in rows]


def test_files_in_parts(spark, tmp_path):
    """Arrays and result files of few records each; an empty file and one that holds neither form."""
    from omegalake.sources import readers, writers

    rows = [(k, k, None if k == 3 else f"F(prop_{k})", "m" if k % 2 else None) for k in range(7)]
    df = spark.createDataFrame(rows, "pos long, id long, LTL string, translation_model string")
    writers.write_arrays(df.drop("translation_model"), f"file://{tmp_path}/arrays", places=3)
    read = readers.read_array(spark, f"file://{tmp_path}/arrays")
    assert sorted((r.pos, r.id, r.LTL) for r in read.collect()) == sorted((k % 3, k, f) for k, _, f, _ in rows)
    log = df.select("pos", "id", "translation_model", F.col("LTL").alias("predicted_ltl"))
    folder = tmp_path / "results"
    writers.write_results(log, f"file://{folder}", header=("translation_model",), places=3)
    (folder / "empty.JSON").write_text("")
    (folder / "broken.json").write_text('{"no": 1}')
    read = readers.read_results(spark, f"file://{folder}")
    assert sorted((r.id, r.predicted_ltl, r.header_translation_model) for r in read.collect()) == sorted((k, f, m) for k, _, f, m in rows)
    assert readers.result_files(spark, f"file://{folder}").count() == 6
    assert {r[0].rsplit("/", 1)[1] for r in readers.unreadable_results(spark, f"file://{folder}").collect()} >= {"broken.json"}
    with pytest.raises(Exception, match="no results in"):
        readers.read_results(spark, f"file://{folder}", strict=True).collect()


def test_merge_outcomes_over_ranges(spark, monkeypatch):
    """The outcomes are those of taking records one by one, whatever the ranges; equal texts and an empty dataset too."""
    from omegalake.operators import semantic

    old = spark.createDataFrame([(1, "!(!(F(prop_1)))"), (2, "G(prop_1)")], "pos long, LTL string")
    texts = ["(true U prop_1)", "F(prop_1)", "F(prop_1)", "X(prop_1)", "!(!(X(prop_1)))", "G(prop_1)", "X(prop_1)"]
    new = spark.createDataFrame(list(enumerate(texts, 1)), "pos long, LTL string")
    for places in (1, 2, 10_000):
        monkeypatch.setattr(semantic, "ORDERED", places)
        found = [r.outcome for r in semantic.merge_outcomes(old, new).orderBy("pos").collect()]
        assert found == ["replaced", "replaced", "skipped", "inserted", "skipped", "skipped", "skipped"]
    alone = [r.outcome for r in semantic.merge_outcomes(old.where("false"), new).orderBy("pos").collect()]
    assert alone == ["inserted", "replaced", "skipped", "inserted", "skipped", "inserted", "skipped"]


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    from omegalake.operators import keyed

    df = spark.createDataFrame([(k, f" f{k % 3}") for k in range(7)], "pos long, LTL string")
    for c in ("part", "own", "row", "value", "whole", "shift", "key", "at", "_key", "_part", "_n", "_p"):
        df = df.withColumn(c, F.lit(5))
    total = keyed.running_total(df, ["pos"], F.col("value"), "total")
    assert [r.total for r in total.orderBy("pos").collect()] == [5 * (k + 1) for k in range(7)]
    assert sorted(r.id for r in keyed.sequential_ids(df, ["pos"]).collect()) == list(range(1, 8))
    fresh = keyed.append_new(df.where("pos = 0"), df)
    assert fresh.columns == df.columns and sorted(r.pos for r in fresh.collect()) == [1, 2]

    from omegalake.operators import semantic

    df = spark.createDataFrame([(1, "F(prop_1)"), (2, None), (3, "G("), (4, "F(prop_2)"), (5, "F(prop_1)")], "pos long, LTL string")
    for c in ("m", "_m", "formula", "own", "first", "selected", "row", "key", "at", "reasons"):
        df = df.withColumn(c, F.lit(5))
    found = semantic.filter_formulas(df)
    assert set(found.columns) == {*df.columns, "accepted_form"} and len(found.columns) == len(df.columns) + 1
    assert {(r.pos, tuple(r.reasons), r.own) for r in found.collect()} == {(1, (), 5), (4, ("redundant",), 5), (5, ("redundant",), 5)}


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
