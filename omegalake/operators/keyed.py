"""Operators on keys and order: latest, best and first rows, ids, anti-append, unpivot, pairs.

Nothing here relies on the order of rows; order comes in as a column (``pos``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import staged


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


#: Types (and plain strings) whose equal values look alike. Numbers with a sign of zero, and strings compared by a collation, do not.
_ALIKE = (T.IntegralType, T.BooleanType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _pick(df: DataFrame, keys: list[str], best: Callable[[Column, Column], Column], order: Column) -> DataFrame:
    """Partial aggregation on both sides of the shuffle: a hot key costs each task one row.

    Keys whose equal values look alike are read from the group, so that they travel once and not again within the row.
    """
    alike = {f.name for f in df.schema if f.name in keys and (isinstance(f.dataType, _ALIKE) or f.dataType == T.StringType())}
    others = [c for c in df.columns if c not in alike] or df.columns
    picked = df.groupBy(*keys).agg(best(F.struct(*(F.col(f"`{c}`") for c in others)), order).alias("_row"))
    # Where no row has an order none is picked, and its keys are null like the rest.
    return picked.select(*(F.when(F.col("_row").isNotNull(), F.col(f"`{c}`")).alias(c) if c in alike else F.col(f"_row.`{c}`") for c in df.columns))


def latest_per_key(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return _pick(df, keys, F.max_by, F.col(pos))


def first_per_key(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return _pick(df, keys, F.min_by, F.col(pos))


def best_per_key(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Equivalent before ok before later rows."""
    merit = F.struct(F.coalesce("equivalent", F.lit(False)), F.coalesce(F.col("status") == "ok", F.lit(False)), F.col(pos))
    return _pick(df, keys, F.max_by, merit)


def dataset_index(df: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """The last row of each id; rows without a whole-number id left out."""
    return latest_per_key(df.where(F.expr(f"try_cast(`{key}` as bigint) is not null")), [key], pos)


def next_id(df: DataFrame, key: str = "id") -> DataFrame:
    """(next_id): one more than the largest whole-number id, 1 for none."""
    return df.agg((F.coalesce(F.max(F.expr(f"try_cast(`{key}` as bigint)")), F.lit(0)) + 1).alias("next_id"))


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each, in this order (a total order).

    Ranges of rows are summed apart and shifted by what lies before them, so no task sees all rows.
    """
    # The rows travel in one column, so that no name of theirs meets one of these.
    by = [F.col(f"row.`{c}`") for c in order]
    ranged = df.select(_row(df).alias("row"), value.alias("value")).repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    own = F.sum("value").over(Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = ranged.groupBy("part").agg(F.sum("value").alias("whole")).select("part", F.coalesce(before, F.lit(0)).alias("shift"))
    summed = ranged.withColumn("own", own).join(shifts, "part")
    return summed.select("row.*", (F.col("own") + F.col("shift")).alias(name))


def sequential_ids(df: DataFrame, order: list[str], name: str = "id", base: int = 0) -> DataFrame:
    """Numbers rows from base + 1 in this order; a column of that name is replaced."""
    numbered = running_total(df.select(_row(df).alias("row"), *(F.col(f"`{c}`").alias(f"by{k}") for k, c in enumerate(order))), [f"by{k}" for k in range(len(order))], F.lit(1), "number")
    return numbered.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c != name), (F.col("number") + base).alias(name))


def append_new(existing: DataFrame, new: DataFrame, text: str = "LTL", pos: str = "pos") -> DataFrame:
    """Rows of ``new`` whose trimmed text is in neither ``existing`` nor an earlier new row."""
    keyed = new.select(_row(new).alias("row"), F.trim(text).alias("key"), F.col(pos).alias("at")).where("key != ''")
    fresh = keyed.join(existing.select(F.trim(text).alias("key")).distinct(), "key", "left_anti")
    return fresh.groupBy("key").agg(F.min_by("row", "at").alias("row")).select("row.*")


def not_done(tasks: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose latest entry in the log is not ok."""
    done = latest_per_key(log, keys).where("status = 'ok'").select(*keys).distinct()
    return tasks.join(done, keys, "left_anti")


def unpivoted(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """A row for each record and field that is there and not blank: ids, input_field, source_text."""
    texts = [F.struct(F.lit(f).alias("input_field"), F.col(f"`{f}`").cast("string").alias("source_text")) for f in fields if f in df.columns]
    return df.select(*ids, F.explode(F.array(*texts)).alias("_t")).select(*ids, "_t.*").where(F.trim("source_text") != "")


def simplifiable_pairs(df: DataFrame) -> DataFrame:
    """Two rows for each record whose simplified form differs: the original and the simplified formula."""
    from ..functions import text as tx

    pair = F.array(
        F.struct(F.concat(F.col("id").cast("string"), F.lit("_original")).alias("pair_id"), F.col("id").alias("original_record_id"), F.lit("original").alias("variant"), F.col("LTL").alias("LTL"), F.col("simplified_formula").alias("paired_formula")),
        F.struct(F.concat(F.col("id").cast("string"), F.lit("_simplified")).alias("pair_id"), F.col("id").alias("original_record_id"), F.lit("simplified").alias("variant"), F.col("simplified_formula").alias("LTL"), F.col("LTL").alias("paired_formula")),
    )
    return df.where(tx.has_different_simplified(F.col("LTL"), F.col("simplified_formula"))).select(F.explode(pair).alias("p")).select("p.*")
