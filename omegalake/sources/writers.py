"""Frames as benchmark files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines, the form that scales; missing values are left out of the records."""
    df.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", True).json(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_array(df: DataFrame, path: str, pos: str = "pos") -> None:
    """One pretty JSON array in order of ``pos``, for readers that need that shape.

    All records meet in one task, as the shape demands; use ``write_lines`` for large tables.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != pos))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), row.alias("r")))), lambda x: x["r"])
    df.agg(F.to_json(listed, {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _in_files(df: DataFrame, header: tuple[str, ...], pos: str, places: int) -> DataFrame:
    """A row for each file to be: the header's columns and ``results``, the records in order of ``pos``."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (*header, pos)))
    placed = df.select(*header, F.floor(F.col(pos) / places).alias("file"), F.struct(F.col(pos).alias("at"), row.alias("record")).alias("placed"))
    listed = F.transform(F.sort_array(F.collect_list("placed")), lambda p: p["record"])
    return placed.groupBy(*header, "file").agg(listed.alias("results")).drop("file")


def write_results(df: DataFrame, path: str, header: tuple[str, ...] = ("translation_model", "prompt_setting"), pos: str = "pos", places: int = 10_000) -> None:
    """Result files: each an object with a header and ``results``, for at most ``places`` numbers ``pos`` (which differ from row to row)."""
    _in_files(df, header, pos, places).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_arrays(df: DataFrame, path: str, pos: str = "pos", places: int = 10_000) -> None:
    """Files with one JSON array each, for at most ``places`` numbers ``pos`` (which differ from row to row)."""
    listed = _in_files(df, (), pos, places).select(F.to_json("results").alias("value"))
    listed.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def append_log(df: DataFrame, path: str, by: tuple[str, ...] = ("translation_model",)) -> None:
    """Appends entries; a run that stops keeps what was written before, and ``keyed.not_done`` finds the rest."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def write_batch(df: DataFrame, log: str, query: str, batch: int) -> None:
    """A batch of a stream as a partition of the log that a replay overwrites, with the running totals up to it.

    Entries need ``status`` and ``equivalent``. Totals are those of the batch before and this one's, in a file of the same
    partition, so a replayed batch counts once, too.
    """
    spark = df.sparkSession
    place = f"{log}/query={query}/batch={batch}"
    df.write.mode("overwrite").parquet(place)
    own = spark.read.schema(df.schema).parquet(place).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if((F.col("status") == "ok") & F.coalesce("equivalent", F.lit(False))).alias("success")
    )
    kind = "total long, ok long, success long"
    if batch:
        own = own.unionByName(spark.read.schema(kind).parquet(f"{log}/_totals/query={query}/batch={batch - 1}"))
    own.agg(*(F.sum(c).alias(c) for c in ("total", "ok", "success"))).coalesce(1).write.mode("overwrite").parquet(f"{log}/_totals/query={query}/batch={batch}")


def read_batches(spark: SparkSession, log: str) -> DataFrame:
    """All entries of such a log, with ``query`` and ``batch``."""
    return spark.read.parquet(log)


def running_totals(spark: SparkSession, log: str) -> DataFrame:
    """(query, batch, total, ok, success, success_rate) up to and with each batch."""
    return spark.read.parquet(f"{log}/_totals").withColumn("success_rate", F.try_divide("success", "total"))
