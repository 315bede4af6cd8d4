"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import arrow_rows, fresh_path, shared_dir, staged

__all__ = ["arrow_rows", "fresh_path", "heavy_parted", "in_blocks", "joined_by_count", "shared_dir", "staged", "table", "unused"]

#: A key is hot if it has over HOT_ROWS rows and over one HOT_KEYS-th of all, so there are fewer than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 20_000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """The name, or the first longer one that no column bears."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def joined_by_count(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each and in ``n`` the number of ``left``'s rows with it.

    rows: all of ``left``'s. Rows of hot keys meet the few that these are where they lie, so none
    of them goes to one task; the others are shuffled. ``n`` is not returned.
    """
    hot = max(HOT_ROWS, rows // HOT_KEYS)
    if rows <= hot:
        return left.join(right.drop("n"), key)
    few = F.broadcast(right.where(F.col("n") > hot).drop("n"))
    others = left.join(few.select(key), key, "left_anti").join(right.where(F.col("n") <= hot).drop("n"), key)
    return left.join(few, key).unionByName(others)


#: Rows of a key come in blocks: each row weighs ROW_WEIGHT and its bytes, a block's rows BLOCK_WEIGHT or one row more.
BLOCK_WEIGHT, ROW_WEIGHT = 1 << 24, 1 << 12
#: So many heavy keys at most are broadcast (8 MB); more are joined by a shuffle.
HEAVY_KEYS = 1_000_000


def heavy_parted(rows: DataFrame, key: str, weight: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys whose rows weigh ``most`` together or less, rows of all other keys or None if there are none)."""
    heavy = staged(rows.groupBy(F.col(key).alias("_heavy")).agg(F.sum(weight).alias("_weight")).where(F.col("_weight") > most).select("_heavy"), "heavy-keys")
    n = heavy.count()
    if not n:
        return rows, None
    few = F.broadcast(heavy) if n <= HEAVY_KEYS else heavy
    same = rows[key].eqNullSafe(few["_heavy"])
    return rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")


def in_blocks(rows: DataFrame, key: str, order: list[str], weight: Column, most: int) -> DataFrame:
    """Adds ``position``, a row's number in its key from 0 in this order, and ``block``, from 0, of rows that weigh ``most`` or one row more.

    Ranges of (key, order) rather than whole keys are ranked, so that one key may hold any share of the
    rows; equal rows are told apart by a number, so that ranges part them too.
    """
    numbered = staged(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_weight", weight), "numbered-rows")
    ranged = staged(numbered.repartitionByRange(key, *order, "_row").withColumn("_part", F.spark_partition_id()), "ranged-rows")
    within = Window.partitionBy(key, "_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"), F.sum("_weight").alias("_w"))
    bases = sums.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"))
    own = ranged.withColumn("_own_n", F.coalesce(F.count("*").over(within), F.lit(0))).withColumn("_own_w", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    found = own.join(bases, own[key].eqNullSafe(bases["_key"]) & (own["_part"] == bases["_of"]))
    return found.select(*rows.columns, (F.col("_n") + F.col("_own_n")).alias("position"), F.floor((F.col("_w") + F.col("_own_w")) / most).cast("long").alias("block"))
