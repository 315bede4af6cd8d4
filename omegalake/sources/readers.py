"""Benchmark files as frames. File order becomes the column ``pos``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENTRY, ENVELOPE, FORMULA, INSTANCE
from ..shared import staged
from .json_ranges import JsonFiles


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_array(spark: SparkSession, path: str, schema: T.StructType = FORMULA, missing_is_empty: bool = False) -> DataFrame:
    """Records of a file (or files) that holds one JSON array, with their place in it.

    A file is read in ranges by many tasks (``json_ranges``). One that is no array, or does not end as one, is an
    error; an empty one has no records.
    """
    if missing_is_empty and not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.LongType()), *schema.fields]))
    files = JsonFiles(spark, path)
    if broken := files.outlines().where("kind != 'array' or not whole").select("path").head(3):
        raise ValueError(f"no JSON array: {', '.join(r.path for r in broken)}")
    return files.records().select("pos", F.from_json("text", schema).alias("r")).select("pos", "r.*")


def read_lines(spark: SparkSession, path: str, schema: T.StructType = FORMULA) -> DataFrame:
    """Records of JSON lines, the form that scales; broken lines are left out."""
    read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return read.select(F.monotonically_increasing_id().alias("pos"), "*")


#: Headers are broadcast up to this number of files.
BROADCAST_HEADERS = 100_000
_JSON = "*.[jJ][sS][oO][nN]"


def _outlined(files: JsonFiles) -> DataFrame:
    """(results_path, header, good) of each file that isn't empty; good: a whole array, or a whole object with results."""
    headers = files.headers().select("path", F.from_json("text", ENVELOPE).alias("header"))
    read = files.outlines().join(headers, "path", "left")
    good = F.col("whole") & ((F.col("kind") == "array") | (F.col("kind") == "object") & F.col("header.results").isNotNull())
    return read.select(F.col("path").alias("results_path"), F.when(F.col("kind") == "object", F.col("header")).alias("header"), F.coalesce(good, F.lit(False)).alias("good"))


def read_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Entries of result files (a file, a folder or a pattern), with header and file name.

    A file holds an object with a header and ``results``, or a bare array of entries, and is read in ranges by many tasks.
    Files that hold neither are left out; their names are in ``unreadable_results``. It is an error if no file
    that isn't empty can be read, or, if strict, if any can't.
    """
    files = JsonFiles(spark, path, _JSON)
    outlined = staged(_outlined(files), "result-headers")
    bad = outlined.where("not good").select("results_path").head(3)
    if bad and (strict or not outlined.where("good").head(1)):
        raise ValueError(f"no results in {', '.join(r.results_path for r in bad)}")
    fields = [f.name for f in ENVELOPE.fields if f.name != "results"]
    good = outlined.where("good").select("results_path", *(F.col(f"header.{f}").alias(f"header_{f}") for f in fields))
    good = F.broadcast(good) if outlined.count() <= BROADCAST_HEADERS else good
    entries = files.records().select(F.col("path").alias("results_path"), "pos", F.from_json("text", ENTRY).alias("e"))
    return entries.join(good, "results_path").select("results_path", *(f"header_{f}" for f in fields), "pos", "e.*")


def unreadable_results(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files, but for empty ones, that ``read_results`` leaves out."""
    return _outlined(JsonFiles(spark, path, _JSON)).where("not good").select("results_path")


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Non-empty .json files of a folder by path, whatever the case of the ending. Only the listing is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", _JSON).load(folder)
    return listed.where("length > 0").select("path", "length").orderBy("path")


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instance-level outcomes from CSV; fails if model, ast_size or success is not in the header."""
    header = spark.read.option("header", True).csv(path)
    if missing := {"model", "ast_size", "success"} - set(header.columns):
        raise ValueError(f"{path} has no {sorted(missing)}")
    kinds = {f.name: f.dataType for f in INSTANCE.fields}
    typed = header.select(*(F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in header.columns))
    return typed.withColumn("success", F.lower("success").isin("1", "true", "1.0").cast("int"))
