"""What lets the library work on any size: ranges of files, exact draws, joins in time, frames, summaries, stored datasets, streams."""

import collections
import functools
import json
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from omegalake import shared
from omegalake.functions import formulas as fm
from omegalake.functions import lex
from omegalake.logic import syntax
from omegalake.operators import frames, keyed, rates, sketches, temporal, variants
from omegalake.plans import events
from omegalake.plans.queries import QUERIES, _measured
from omegalake.sources import readers, stored, translators, writers
from omegalake.sources.json_ranges import JsonFiles
from omegalake.streaming import best


# Files in ranges.

_BITS = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "漢", "\n", " ", "a", '\\"', "}]", '{"results":[']


def _value(r, depth=0):
    k = r.random()
    text = lambda: "".join(r.choice(_BITS) for _ in range(r.randint(0, 10)))
    if depth > 2 or k < 0.5:
        return r.choice([text(), 1, None, True, 2.5])
    return [_value(r, depth + 1) for _ in range(r.randint(0, 3))] if k < 0.7 else {text(): _value(r, depth + 1) for _ in range(r.randint(0, 3))}


@pytest.mark.parametrize("size", ["64", "100m"])
def test_ranges_cut_anywhere(spark, tmp_path, size):
    r, want = random.Random(3), {}
    for k in range(4):
        records = [{f"k{j}": _value(r, 1) for j in range(r.randint(0, 3))} for _ in range([0, 6, 9, 5][k])]
        body = records if k % 2 else {"a": _value(r, 9), "fields": ["}", '"]'], "results": records, "z": "{"}
        (tmp_path / f"f{k}.json").write_text(json.dumps(body, ensure_ascii=k < 2, indent=[None, 1][k % 2]) + ["", "\n"][k > 1])
        want[f"f{k}.json"] = (records, body)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        files = JsonFiles(spark, f"file://{tmp_path}")
        got = collections.defaultdict(dict)
        for x in files.records().collect():
            got[os.path.basename(x.path)][x.pos] = json.loads(x.text)
        headers = {os.path.basename(x.path): x.text for x in files.headers().collect()}
        outlines = {os.path.basename(x.path): (x.kind, x.whole) for x in files.outlines().collect()}
        ranges = files._chunks.rdd.getNumPartitions()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert size != "64" or ranges > 10
    for name, (records, body) in want.items():
        assert [got[name].get(k) for k in range(len(records))] == records and len(got[name]) == len(records)
        assert outlines[name] == ("object" if isinstance(body, dict) else "array", True)
        if isinstance(body, dict):
            assert json.loads(headers[name]) == {**body, "results": []}


@pytest.mark.parametrize("text", ['[{"id": 1}', '[{"id": 1}, {"id": "', '{"id": 1}', "nothing"])
def test_arrays_that_do_not_end_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="a.json"):
        readers.read_array(spark, f"file://{tmp_path}/a.json")


def test_a_folder_without_a_valid_file_is_an_error(spark, tmp_path):
    for name, text in (("a.json", '{"x": 1}'), ("b.json", '{"results": [{"record_id": 1}')):
        (tmp_path / name).write_text(text)
    with pytest.raises(ValueError, match="no results in"):
        readers.read_results(spark, f"file://{tmp_path}")
    (tmp_path / "c.JSON").write_text('[{"record_id": 5}]')
    assert [r.record_id for r in readers.read_results(spark, f"file://{tmp_path}").collect()] == [5]
    assert sorted(os.path.basename(r[0]) for r in readers.unreadable_results(spark, f"file://{tmp_path}").collect()) == ["a.json", "b.json"]
    assert [os.path.basename(r.path) for r in readers.result_files(spark, f"file://{tmp_path}").collect()] == ["a.json", "b.json", "c.JSON"]


# Exact draws.


@pytest.mark.parametrize("below", [1, 2, 3, 12, 100, 1000])
def test_numbers_are_drawn_once(below):
    for key in (0, 7, 1 << 63):
        assert sorted(variants.drawn_numbers(key, below)) == list(range(below))


def test_numbers_beyond_all_words():
    drawn = variants.drawn_numbers(5, math.perm(60, 40))
    some = [next(drawn) for _ in range(50)]
    assert len(set(some)) == 50 and all(x < math.perm(60, 40) for x in some)


def test_unranking_gives_every_permutation():
    assert len({tuple(variants.unranked(x, 5, 3)) for x in range(60)}) == 60


def test_exactly_as_many_variants_as_there_are(spark):
    own = {0: "true", 1: "prop_1", 2: "(prop_1 U prop_2)", 3: "(prop_3 U (prop_1 U prop_2))", 4: "((prop_1 U prop_2) U (prop_3 U prop_4))"}
    df = spark.range(300).select("id", F.element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), (F.col("id") % 5).cast("int")).alias("LTL"))
    names = ["red", "blue", "green", "pink"]
    for n in (0, 1, 2, 9, 30):
        made = variants.grounded_variants(df, names, n).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(F.to_json("ap_mapping")).alias("d"), F.countDistinct("LTL").alias("f")).collect()
        counts = {r.id: (r.n, r.d, r.f) for r in made}
        for k in range(300):
            want = 1 if k % 5 == 0 else min(n, math.perm(4, k % 5)) if k % 5 < 4 else 0
            assert counts.get(k, (0, 0, 0)) == (want,) * 3


# Joins in time.


def _log(spark, n, users, seed):
    r = random.Random(seed)
    rows = [(k, r.choice([None, *range(users), *[0] * users]), r.choice([None, *range(1_000_000, 1_000_000 + n // 2)])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, user long, s long").select("id", "user", F.timestamp_seconds("s").alias("ts"))


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_join_equals_a_search(spark, strict):
    (left, a), (right, b) = _log(spark, 300, 3, 1), _log(spark, 200, 3, 2)
    got = {r.left.id: r.right and r.right.id for r in temporal.as_of_join(a, b, ["user"], "ts", "ts", "id", strict).collect()}
    assert len(got) == 300
    for k, u, t in left:
        fits = [(s, j) for j, v, s in right if v is not None and v == u and s is not None and t is not None and (s < t if strict else s <= t)]
        assert got[k] == (max(fits)[1] if fits else None)


@pytest.mark.parametrize("low, high", [(-5, 20), (0, 0), (3, 3), (-40, -10)])
def test_interval_join_equals_all_pairs(spark, low, high):
    (left, a), (right, b) = _log(spark, 300, 3, 3), _log(spark, 200, 3, 4)
    got = sorted((r.left.id, r.right.id) for r in temporal.interval_join(a, b, ["user"], "ts", "ts", low, high).collect())
    assert got == sorted((k, j) for k, u, t in left for j, v, s in right if None not in (u, v, t, s) and u == v and low <= s - t <= high)
    with pytest.raises(ValueError):
        temporal.interval_join(a, b, ["user"], "ts", "ts", 2, 1)


def test_frames_look_beyond_their_block(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    columns = {"back": lambda w: F.lag("v", 7).over(w), "ahead": lambda w: F.lead("v", 4).over(w), "sum": lambda w: F.sum("v").over(w.rowsBetween(-7, 4))}
    rows = sorted(frames.framed(df, ["k"], columns, 7, 4, block=10).collect())
    v = [r.v for r in rows]
    assert [r.k for r in rows] == list(range(1000))
    for i, r in enumerate(rows):
        assert (r.back, r.ahead, r["sum"]) == (v[i - 7] if i > 6 else None, v[i + 4] if i < 996 else None, sum(v[max(0, i - 7) : i + 5]))


# Summaries.


@pytest.mark.parametrize("capacity", [30, 200, 5000])
def test_heavy_hitters_are_exact(spark, capacity):
    r = random.Random(1)
    values = [None] * 50 + [f"v{int(r.paretovariate(0.7)) % 3000}" for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    want = sorted(collections.Counter(v for v in values if v).items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [tuple(r) for r in sketches.heavy_hitters(df, F.col("v"), 20, capacity).collect()] == want
    assert sketches.heavy_hitters(df.where("false"), F.col("v"), 20, capacity).count() == 0


def test_states_of_days_merge_to_any_rollup(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 7000).alias("who"), (F.col("id") / 20_000).alias("x"))
    states = sketches.rollup_states(df, ["a", "b"], "who", "x", F.col("id") % 2 == 0 if "id" in df.columns else F.col("who") % 2 == 0, (F.col("who") % 4).cast("int"))
    assert states.count() == 60
    rolled = {(r.a, r.b, r.level): r for r in sketches.rolled_up(states, ["a", "b"]).collect()}
    assert len(rolled) == 15 + 3 + 1 and rolled[None, None, 0].total == 20_000
    assert abs(rolled[None, None, 0].n_distinct - 7000) < 0.06 * 7000 and abs(rolled[None, None, 0].p50 - 0.5) < 0.03
    assert {rolled[a, None, 1].total for a in range(3)} == {6666, 6667}


# A stored dataset.


def test_batches_merge_as_one(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    rows = [(k, r.choice([None, *"abcdefghijklmnop"]), r.randint(0, 5), f"text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "pos long, key string, cost int, text string")
    batches = [df.where(f"pos >= {a} and pos < {b}") for a, b in ((0, 70), (70, 130), (130, 200))]
    whole, parts = stored.StoredDataset(spark, f"file://{tmp_path}/whole", 8), stored.StoredDataset(spark, f"file://{tmp_path}/parts", 8)
    assert parts.read() is None
    whole.merge(df, F.col("key"), F.col("cost"))
    for k, b in enumerate(batches):
        parts.merge(b.withColumn("pos", F.col("pos") - [0, 70, 130][k]), F.col("key"), F.col("cost"))
    kept = {}
    for _, key, cost, text in rows:
        if key and (key not in kept or cost < kept[key][0]):
            kept[key] = (cost, text)
    for d in (whole, parts):
        assert {x.key: (x.cost, x.text) for x in d.read().collect()} == kept
    assert [x.key for x in whole.read().orderBy("place").collect()] == [x.key for x in parts.read().orderBy("place").collect()]
    # A batch touches its buckets only; one that stops before the manifest leaves everything as it was.
    before = parts.manifest()
    one = spark.createDataFrame([(0, "a", -1, "new")], "pos long, key string, cost int, text string")
    with monkeypatch.context() as m:
        m.setattr(parts, "_commit", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            parts.merge(one, F.col("key"), F.col("cost"))
    assert parts.manifest() == before and {x.key: x.text for x in parts.read().collect()} == {k: v[1] for k, v in kept.items()}
    touched = parts.merge(one, F.col("key"), F.col("cost"))
    after = parts.manifest()
    assert len(touched) == 1 and {b for b in after["buckets"] if after["buckets"][b] != before["buckets"][b]} == {str(touched[0])}
    assert {x.text for x in parts.read().where("key = 'a'").collect()} == {"new"}
    with pytest.raises(RuntimeError):
        parts._commit(after)


# The shared folder, logs and services.


def test_kept_frames_are_released(spark, monkeypatch):
    monkeypatch.setattr(shared, "_staged", [])
    one = shared.staged(spark.range(5), "one")
    place = shared._staged[0][1].removeprefix("file://")
    assert one.count() == 5 and os.path.exists(place)
    shared.release()
    assert not os.path.exists(place) and not shared._staged


def test_a_replayed_batch_counts_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    rows = [spark.createDataFrame([(b * 10 + k, "ok" if k else "error", k > 1) for k in range(4)], "id long, status string, equivalent boolean") for b in range(3)]
    for b in (0, 1, 1, 2, 2):
        writers.write_batch(rows[b], log, "q", b)
    assert sorted(r.id for r in writers.read_batches(spark, log).collect()) == sorted(b * 10 + k for b in range(3) for k in range(4))
    assert sorted((r.batch, r.total, r.ok, r.success) for r in writers.running_totals(spark, log).collect()) == [(0, 4, 3, 2), (1, 8, 6, 4), (2, 12, 9, 6)]


def test_many_requests_are_in_flight(spark):
    def service():
        def ask(sentence):
            time.sleep(0.05)
            return sentence.upper()

        return ask

    tasks = spark.range(400).select("id", F.concat(F.lit("q"), "id").alias("source_text")).repartition(4)
    tasks.count()
    began = time.time()
    got = translators.asked(tasks, service, in_flight=50).collect()
    took = time.time() - began
    assert took < 400 * 0.05 / 4 and all(r.raw_model_output == f"Q{r.id}" for r in got) and len(got) == 400


def test_retry_after_and_rate():
    now, waits = [0.0], []

    def wait(seconds):
        waits.append(seconds)
        now[0] += seconds

    bucket = translators.TokenBucket(2.0, 3, lambda: now[0], wait)
    for _ in range(7):
        bucket.take()
    assert waits == [0.5, 0.5, 0.5, 0.5]


def test_a_service_says_how_long_to_wait(spark):
    def service():
        asked = []

        def ask(sentence):
            asked.append(sentence)
            if len(asked) == 1:
                raise translators.ServiceError(429, "busy", retry_after=0.01)
            return "yes"

        return ask

    def wait(seconds):
        if seconds != 0.01:
            raise AssertionError(seconds)

    df = spark.createDataFrame([("a",)], "source_text string").coalesce(1)
    assert translators.asked(df, service, wait=wait).first().raw_model_output == "yes"


# The best entries of a stream.


@pytest.mark.parametrize("late", [False, True])
def test_best_entries_of_a_stream(spark, tmp_path, late):
    """Equal to the best entries of the table; no row goes through Python unless entries can be late."""
    r = random.Random(5)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([None, False, True]), r.choice([None, "ok", "error"]), k) for k in range(400)]
    schema = "key string, equivalent boolean, status string, pos long"
    log = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    stream = events._streamed(spark, log, "best-test")
    name, provider = best.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        out = best.best_entries(stream, ["key"], **({"time": "at", "watermark": "1 day"} if late else {}))
        write = functools.partial(events._written, str(tmp_path / "out"))
        query = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) == events._BATCHES and sum(p.numInputRows for p in progress) == 400
    assert {o.operatorName for p in progress for o in p.stateOperators} == {"transformWithStateInPySparkExec" if late else "stateStoreSave"}
    columns = ["key", "equivalent", "status", "pos"]
    got = keyed.latest_per_key(spark.read.parquet(str(tmp_path / "out")), ["key"], "batch").select(*columns).collect()
    want = keyed.best_per_key(log, ["key"]).select(*columns).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 4


# Formulas of any depth.


def _formula(r, d):
    k = r.random()
    if d == 0 or k < 0.25:
        return r.choice(["prop_1", "prop_2", "true"])
    if k < 0.5:
        return r.choice("!XFG") + " " + _formula(r, d - 1)
    if k < 0.65:
        return "(" + _formula(r, d - 1) + ")"
    return _formula(r, d - 1) + " " + r.choice(["U", "W", "R", "M", "&", "|", "->", "<->"]) + " " + _formula(r, d - 1)


def test_native_measures_equal_the_parser(spark):
    r = random.Random(1)
    tokens = ["(", ")", "!", "X", "F", "G", "U", "W", "R", "M", "&", "|", "->", "<->", "prop_1", "a", " ", "true", "Foo", "_", "é"]
    texts = [_formula(r, 5) for _ in range(700)] + [r.choice(["", " "]).join(r.choice(tokens) for _ in range(r.randint(0, 8))) for _ in range(900)]
    got = {x.t: x.m and tuple(x.m) for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", lex.measures(F.col("t")).alias("m")).collect()}
    for t in texts:
        try:
            f = syntax.parse(t)
            assert got[t] == (syntax.size(f), syntax.depth(f), syntax.temporal_depth(f)), t
        except ValueError:
            assert got[t] is None, t


def test_native_measures_of_deep_formulas(spark):
    rows = [("F(" * n + "prop_1" + ")" * n,) for n in (1000, 100_000)] + [(None,), ("",)]
    assert [x.m and tuple(x.m) for x in spark.createDataFrame(rows, "t string").select(lex.measures(F.col("t")).alias("m")).collect()] == [(1001, 1000, 1000), None, None, None]


@pytest.mark.parametrize("name", ["q09_success_by_size_nnf", "q15_field_histograms", "q21_simplifiable_report"])
def test_filters_do_not_judge_each_record(spark, sf_dir, name):
    """A filter on what is found once for each distinct formula is not moved to before the grouping."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not [f for f in filters if "aggregate(" in f or "pythonUDF" in f]


def test_success_by_depth_measures_after_the_grouping(spark, sf_dir):
    plan = QUERIES["q05_success_by_depth"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    judging = [k for k, line in enumerate(plan) if "Filter " in line and "aggregate(" in line]
    assert judging and all(plan[k + 1].strip(" :+-").startswith("Aggregate [") for k in judging)


@pytest.mark.parametrize("filtered", [False, True])
def test_depths_of_odd_records(spark, filtered):
    """Formulas that are null, or not well formed, have no depth, and repeated ids count again."""
    formulas = spark.createDataFrame([(1, "F(a)"), (1, "F(a)"), (2, "G(F(a))"), (3, None), (4, "F("), (5, ""), (None, "F(a)"), (6, "F(a)")], "id long, LTL string")
    assert sorted(((r.id, r.m and r.m.temporal_depth) for r in _measured(formulas, filtered).collect()), key=str) == sorted([(1, 1), (1, 1), (2, 2), (4, None), (5, None), (None, 1), (6, 1)], key=str)
    entries = spark.createDataFrame([(k, "ok", True) for k in (1, 1, 2, 3, 4, 5, 7, None)] + [(6, None, None)], "record_id long, status string, equivalent boolean")
    found = rates.by_bucket(entries, _measured(formulas, filtered), F.col("m.temporal_depth"), "depth")
    assert sorted((r.depth, r.total, r.success) for r in found.collect()) == [(1, 5, 4), (2, 1, 1)]
    assert _measured(formulas.where("false"), filtered).count() == 0


@pytest.mark.parametrize("levels", [1000, 100_000])
def test_deep_formulas_do_not_stop_a_job(spark, levels):
    df = spark.createDataFrame([("F(" * levels + "prop_1" + ")" * levels,), ("G(prop_1)",)], "LTL string")
    found = df.select(fm.ltl_metrics("LTL").alias("m"), fm.ltl_is_valid("LTL").alias("v")).collect()
    assert [r.m.parse_error for r in found] == [True, False] and found[1].v and not found[0].v
