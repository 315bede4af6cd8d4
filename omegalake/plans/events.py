"""Queries over the event log: joins in time, rollups with sketches, frames, frequent values, a stored dataset and streams."""

from __future__ import annotations

import functools
import math
import threading

from pyspark.sql import functions as F

from ..functions import lex
from ..operators import frames, keyed, rates, sketches, temporal
from ..shared import fresh_path
from ..sources import stored, translators, writers
from ..streaming import best
from .benchmark import case, dataset, results
from .registry import query

_OK = "coalesce(status = 'ok', false) AND coalesce(equivalent, false)"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


# Joins in time.


@query("""SELECT e.event_id, p.purchase, CAST(epoch_us(e.ts) - epoch_us(p.ts) AS BIGINT) AS micros FROM events e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts > p.ts""")
def r_last_purchase_before(spark, d):
    events = _events(spark, d)
    joined = temporal.as_of_join(events.select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), ["user_id"], "ts", "ts", "event_id", strict=True)
    return joined.select("left.event_id", F.col("right.event_id").alias("purchase"), (F.unix_micros("left.ts") - F.unix_micros("right.ts")).alias("micros"))


@query("""SELECT v.event_id, p.event_id AS purchase FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts - INTERVAL 6 HOUR AND v.ts + INTERVAL 48 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def r_purchases_around_views(spark, d):
    events = _events(spark, d).select("event_id", "user_id", "ts", "event_type")
    joined = temporal.interval_join(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", -6 * 3600, 48 * 3600)
    return joined.select("left.event_id", F.col("right.event_id").alias("purchase"))


# Frames over the whole log, rollups, frequent values.


@query(f"""SELECT pos, lag(pos, 3) OVER w AS third_before, lead(status) OVER w AS next_status, round(avg(({_OK})::INT) OVER (ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS moving_success,
  count(*) OVER (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around FROM results WINDOW w AS (ORDER BY pos)""")
def r_moving_frames(spark, d):
    log = results(spark, d).select("pos", "status", rates.success().cast("int").alias("s"))
    columns = {
        "third_before": lambda w: F.lag("pos", 3).over(w),
        "next_status": lambda w: F.lead("status").over(w),
        "moving_success": lambda w: F.round(F.avg("s").over(w.rowsBetween(-99, 0)), 9),
        "around": lambda w: F.count("*").over(w.rowsBetween(-5, 5)),
    }
    return frames.framed(log, ["pos"], columns, before=99, after=5, block=20_000).drop("status", "s")


# Sketches are held against exact figures: distinct records within 6 % (five standard errors), medians within 5 % of the ranks, 20 % where there are fewer than 100 rows.
@query(f"""SELECT model, prompt_setting, input_field, CAST(3 - bit_count(CAST(grouping(model, prompt_setting, input_field) AS INT)) AS INT) AS level, count(*) AS total, count(*) FILTER ({_OK}) AS success, true AS distinct_within, true AS median_within
FROM results GROUP BY ROLLUP (model, prompt_setting, input_field)""")
def r_rollup_sketches(spark, d):
    dimensions = ["model", "prompt_setting", "input_field"]
    log = results(spark, d)
    path = fresh_path(spark, "rollup-states")
    # A state table for each of seven days; any of them can be made again or merged alone.
    sketches.rollup_states(log, dimensions, "record_id", "value", rates.success(), (F.col("pos") % 7).cast("int")).write.partitionBy("day").parquet(path)
    merged = sketches.rolled_up(spark.read.parquet(path), dimensions, (0.5,))
    exact = log.rollup(*dimensions).agg(F.grouping_id().alias("g"), F.countDistinct("record_id").alias("d"), F.percentile("value", F.array(*map(F.lit, (0.3, 0.45, 0.55, 0.7)))).alias("p"))
    exact = exact.withColumn("level", (F.lit(3) - F.bit_count("g")).cast("int"))
    on = [merged[c].eqNullSafe(exact[c]) for c in (*dimensions, "level")]
    near = F.abs(merged["n_distinct"] - exact["d"]) <= 0.06 * exact["d"] + 1
    # A sketch gives a value of the data, so in small groups a rank is off by a whole row.
    few = merged["total"] < 100
    median = merged["p50"].isNull() | merged["p50"].between(F.get(exact["p"], F.when(few, 0).otherwise(1)), F.get(exact["p"], F.when(few, 3).otherwise(2)))
    return merged.join(exact, on).select(*(merged[c] for c in (*dimensions, "level", "total", "success")), near.alias("distinct_within"), median.alias("median_within"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def r_frequent_parts(spark, d):
    return sketches.heavy_hitters(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_partkey"), 20, capacity=1000)


# A stored dataset.


@query(f"""SELECT dense_rank() OVER (ORDER BY first) AS place, id, LTL FROM (SELECT *, min(shown) OVER (PARTITION BY t) AS first, row_number() OVER (PARTITION BY t ORDER BY length(LTL), LTL, shown) AS k FROM
  (SELECT id, t, {case('ltl')} AS LTL, row_number() OVER (ORDER BY id % 3, pos) AS shown FROM dataset)) WHERE k = 1""")
def r_stored_merge(spark, d):
    own = dataset(spark, d).select("pos", "id", "LTL")
    target = stored.StoredDataset(spark, fresh_path(spark, "stored"), buckets=16)
    tokens = lex.tokens(F.col("LTL"))
    for k in range(3):
        target.merge(own.where(F.col("id") % 3 == k), lex.canonical(tokens), F.struct(F.length("LTL"), F.col("LTL")))
    return keyed.sequential_ids(target.read().select("place", "id", "LTL"), ["place"], "number").select(F.col("number").alias("place"), "id", "LTL")


# Requests in flight.


@query("""SELECT id AS record_id, CASE WHEN id % 4 < 2 THEN concat('LTL: say ', id, CASE id % 4 WHEN 0 THEN ' fine' ELSE ' busy' END) END AS raw_model_output,
  CASE id % 4 WHEN 2 THEN '400 refused' WHEN 3 THEN '503 down' END AS request_error FROM dataset""")
def r_asked_in_flight(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("fine", "busy", "refused", "down"))), (F.col("id") % 4 + 1).cast("int"))
    tasks = dataset(spark, d).select(F.col("id").alias("record_id"), F.concat(F.lit("say "), F.col("id").cast("string"), F.lit(" "), kind).alias("source_text"))

    def service():
        """Answers; a busy one only at the third time of asking."""
        times, lock = {}, threading.Lock()

        def ask(sentence):
            with lock:
                times[sentence] = times.get(sentence, 0) + 1
            if sentence.endswith("refused"):
                raise translators.ServiceError(400, "refused")
            if sentence.endswith("down") or (sentence.endswith("busy") and times[sentence] < 3):
                raise translators.ServiceError(503, "down", retry_after=0.0)
            return "LTL: " + sentence

        return ask

    return translators.asked(tasks, service, wait=lambda seconds: None, in_flight=8).select("record_id", "raw_model_output", "request_error")


# Streams.

_BATCHES = 4


def _streamed(spark, log, label):
    """The log as a stream of files, in an order that is not its own; a batch has about a file for each core."""
    path = fresh_path(spark, label)
    log.repartition(_BATCHES * spark.sparkContext.defaultParallelism, F.xxhash64("pos")).write.parquet(path)
    # However many files were written, they make no more batches than that.
    files = len(spark.read.schema(log.schema).parquet(path).inputFiles())
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", max(1, math.ceil(files / _BATCHES))).parquet(path)


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER ({_OK}) AS success, count(*) AS entries, count(DISTINCT pos) AS different FROM results")
def r_exactly_once_log(spark, d):
    own = results(spark, d).select("pos", "record_id", "input_field", "model", "status", "equivalent")
    log, checkpoint = fresh_path(spark, "batch-log"), fresh_path(spark, "log-checkpoint")

    def batch(df, number):
        writers.write_batch(df, log, "evaluation", number)
        if number == 1:  # as after a crash between the batch and its commit
            writers.write_batch(df, log, "evaluation", number)

    _streamed(spark, own, "log-stream").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    totals = writers.running_totals(spark, log).groupBy().agg(F.max_by(F.struct("total", "ok", "success"), "batch").alias("t")).select("t.*")
    return totals.crossJoin(writers.read_batches(spark, log).agg(F.count("*").alias("entries"), F.countDistinct("pos").alias("different")))


@query("""SELECT pos, record_id, input_field, model, status, equivalent FROM (SELECT *, row_number() OVER (PARTITION BY record_id, input_field, model ORDER BY coalesce(equivalent, false) DESC, (status = 'ok') DESC, pos DESC) AS k FROM results) WHERE k = 1""")
def r_best_entries_stream(spark, d):
    own = results(spark, d).select("pos", "record_id", "input_field", "model", "status", "equivalent")
    out, checkpoint = fresh_path(spark, "best-entries"), fresh_path(spark, "best-checkpoint")
    keys = ["record_id", "input_field", "model"]
    name, provider = best.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        write = functools.partial(_written, out)
        best.best_entries(_streamed(spark, own, "best-stream"), keys).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    # The state's last word on each key.
    return keyed.latest_per_key(spark.read.parquet(out), keys, "batch").select("pos", *keys, "status", "equivalent")


def _written(out, df, number):
    df.write.mode("overwrite").parquet(f"{out}/batch={number}")
