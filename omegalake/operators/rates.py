"""Success rates: predicates, overall and by field, by bucket, matrix, error bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def ok() -> Column:
    return F.coalesce(F.col("status") == "ok", F.lit(False))


def equivalent() -> Column:
    return F.coalesce(F.col("equivalent"), F.lit(False))


def success() -> Column:
    return ok() & equivalent()


def _counts(ignore_errors: Column) -> list[Column]:
    error = F.coalesce(F.col("status") == "error", F.lit(False))
    return [
        F.count("*").alias("total"),
        F.count_if(~(ignore_errors & error)).alias("effective_total"),
        F.count_if(ok()).alias("ok"),
        F.count_if(equivalent()).alias("equivalent"),
        F.count_if(success()).alias("success"),
        F.count_if(error).alias("error"),
    ]


def _rate(over: str) -> Column:
    return F.coalesce(F.try_divide(F.col("success").cast("double"), F.col(over)), F.lit(0.0)).alias("success_rate")


def overall(entries: DataFrame, by: list[str] | None = None, ignore_errors: Column | None = None) -> DataFrame:
    """total, effective_total, ok, equivalent, success, error and success_rate, of all rows or of each group."""
    counted = entries.groupBy(*(by or [])).agg(*_counts(F.lit(False) if ignore_errors is None else ignore_errors))
    return counted.withColumn("success_rate", _rate("effective_total"))


def by_field(entries: DataFrame, ignore_errors: Column | None = None) -> DataFrame:
    named = entries.withColumn("input_field", F.coalesce("input_field", F.lit("unknown")))
    return overall(named, ["input_field"], ignore_errors)


#: Ranges that published panels show, of formula sizes and of automaton sizes.
SIZES, AUTOMATON_SIZES = (1, 34), (None, 50)


def by_bucket(entries: DataFrame, dataset: DataFrame, bucket: Column, name: str, by: tuple[str, ...] = (), ignore_errors: Column | None = None, between: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Success by a measure of the record that each entry is about; entries without record or measure left out.

    between: the least and the greatest measure that is wanted (SIZES, AUTOMATON_SIZES), None for no bound; records beyond are left out before the
    join. Entries are counted by record before the join, so that it carries one row for each record and group.
    """
    error = F.coalesce(F.col("status") == "error", F.lit(False))
    kept = entries if ignore_errors is None else entries.where(~(ignore_errors & error))
    per_record = kept.groupBy("record_id", *by).agg(F.count("*").alias("_n"), F.count_if(success()).alias("_s"))
    measured = dataset.select(F.col("id").alias("record_id"), bucket.alias(name)).where(F.col(name).isNotNull())
    low, high = between
    measured = measured if low is None else measured.where(F.col(name) >= low)
    measured = measured if high is None else measured.where(F.col(name) <= high)
    found = per_record.join(measured, "record_id").groupBy(*by, name).agg(F.sum("_n").alias("total"), F.sum("_s").alias("success"))
    return found.withColumn("success_rate", _rate("total"))


def with_band(rates: DataFrame) -> DataFrame:
    """Adds the binomial standard error and the band of one error, kept within 0 and 1."""
    p, n = F.col("success_rate"), F.col("total")
    error = F.when(n > 0, F.sqrt(p * (1 - p) / n)).otherwise(0.0)
    return rates.withColumn("standard_error", error).withColumn("low", F.greatest(F.lit(0.0), p - error)).withColumn("high", F.least(F.lit(1.0), p + error))


def matrix(entries: DataFrame, models: list[str], by: str = "input_field") -> DataFrame:
    """A row for each field, a column for each model: success over all entries."""
    rate = F.round(F.avg(success().cast("double")), 9)
    return entries.groupBy(by).pivot("model", models).agg(rate)
