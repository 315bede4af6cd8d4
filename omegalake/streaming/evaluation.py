"""Evaluation of translations as a stream: sentences come in, checked entries are logged in batches, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.formulas import ltl_equivalent, ltl_is_valid
from ..shared import staged
from ..sources.writers import write_batch

Translator = Callable[[Column], Column]


def replayed(answers: DataFrame, text: str = "source_text", answer: str = "raw_model_output") -> Callable[[DataFrame], DataFrame]:
    """A translator that looks answers up in a table of earlier ones."""

    def translate(tasks: DataFrame) -> DataFrame:
        known = answers.groupBy(text).agg(F.max(answer).alias("raw_model_output"))
        return tasks.join(known, text, "left")

    return translate


def entries(tasks: DataFrame, translate: Callable[[DataFrame], DataFrame], model: str = "replay", provider: str = "offline", setting: str = "zeroshot") -> DataFrame:
    """Result entries of (record_id, input_field, source_text, original_ltl): translated, cleaned and checked.

    An answer that is missing, doesn't parse or can't be decided makes an entry with status error. Each distinct pair of
    answer and formula is checked once.
    """
    # Kept, so that no answer is asked for twice.
    said = staged(translate(tasks).withColumn("predicted_ltl", tx.wrapped_operands(tx.spelled_out(F.col("raw_model_output")))), "answers")
    pairs = said.select(F.col("predicted_ltl").alias("_p"), F.col("original_ltl").alias("_o")).distinct()
    checked = pairs.withColumn("_valid", F.coalesce(ltl_is_valid("_p"), F.lit(False))).withColumn("equivalent", ltl_equivalent("_p", "_o"))
    judged = said.join(checked, F.col("predicted_ltl").eqNullSafe(F.col("_p")) & F.col("original_ltl").eqNullSafe(F.col("_o")))
    good = F.col("_valid") & F.col("equivalent").isNotNull()
    error = F.when(F.col("raw_model_output").isNull(), "no answer").when(~F.col("_valid"), "not a formula").otherwise("undecided")
    return judged.select(
        "record_id", "input_field", F.lit(provider).alias("translation_provider"), F.lit(model).alias("translation_model"), F.lit(setting).alias("prompt_setting"),
        "source_text", "original_ltl", F.when(good, F.col("predicted_ltl")).alias("predicted_ltl"), F.when(good, F.col("equivalent")).alias("equivalent"),
        F.when(good, "ok").otherwise("error").alias("status"), F.when(~good, error).alias("error"),
    )


def evaluate_stream(tasks: DataFrame, translate: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, query: str = "evaluation", **labels: str):
    """Starts a query that writes the entries of each batch of a streaming frame of tasks to the log, each entry once.

    A batch is a partition (query, batch number) of the log; one that is replayed after a crash overwrites what it
    left. ``writers.read_batches`` reads the log and ``writers.running_totals`` the accuracy after each batch. One checkpoint
    and one name go together: another query writes under another name.
    """

    def batch(df: DataFrame, number: int) -> None:
        write_batch(entries(df, translate, **labels), log, query, number)

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
