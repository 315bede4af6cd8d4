"""As-of and interval joins on keys and time, without cross joins and whatever share of the rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import staged


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _micros(time: str) -> Column:
    """Timestamps without a zone are taken in the session's."""
    return F.unix_micros(F.col(f"`{time}`").cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, low_seconds: float, high_seconds: float) -> DataFrame:
    """(left, right) rows, as structs, of equal keys with right_time - left_time from low to high seconds, both included.

    Time is cut into buckets as wide as the interval; a left row is copied to the two or three that its
    interval reaches, a right row lies in one. The join is on keys and bucket, so a key with very many rows is spread over its
    buckets. Null keys and times join nothing.
    """
    low, high = round(low_seconds * 1e6), round(high_seconds * 1e6)
    if low > high:
        raise ValueError("an interval ends before it begins")
    width = max(1, high - low)
    named = [F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]
    on = [f"k{n}" for n in range(len(keys))] + ["bucket"]
    # Integer division: times in microseconds are beyond what a double tells apart.
    reach = F.sequence(F.expr(f"floor((t + {low}) / {width}D)").cast("long"), F.expr(f"floor((t + {high}) / {width}D)").cast("long"))
    lefts = left.select(_packed(left).alias("left"), *named, _micros(left_time).alias("t")).where("t is not null").withColumn("bucket", F.explode(reach))
    rights = right.select(_packed(right).alias("right"), *named, _micros(right_time).alias("u")).where("u is not null").withColumn("bucket", F.expr(f"floor(u / {width}D)").cast("long"))
    return lefts.join(rights, on).where((F.col("u") - F.col("t")).between(low, high)).select("left", "right")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_order: str, strict: bool = False) -> DataFrame:
    """(left, right) rows, as structs: each left row with the last right row of its keys at or (strict) before its time.

    Both sides are sorted together in ranges of (keys, time); within a range the last right row is carried on by a
    window, and across ranges by one row for each range and key, so no task holds all rows of a key. Of right rows
    of one time the last by ``right_order`` counts. Left rows without one, or with null keys or time, come with null.
    """
    named = [F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]
    on = [f"k{n}" for n in range(len(keys))]
    # At equal times right rows come first, unless only earlier ones count.
    lefts = left.select(*named, _micros(left_time).alias("t"), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(right.schema[right_order].dataType).alias("o"), _packed(left).alias("left"), F.lit(None).cast(right.select(_packed(right)).schema[0].dataType).alias("right"))
    rights = right.select(*named, _micros(right_time).alias("t"), F.lit(1 if strict else 0).alias("side"), F.col(f"`{right_order}`").alias("o"), F.lit(None).cast(left.select(_packed(left)).schema[0].dataType).alias("left"), _packed(right).alias("right"))
    known = F.lit(True)
    for k in [*on, "t"]:
        known = known & F.col(k).isNotNull()
    both = lefts.where(known).unionByName(rights.where(known))
    order = ["t", "side", "o"]
    ranged = staged(both.repartitionByRange(*on, *order).withColumn("part", F.spark_partition_id()), "as-of-ranges")
    carried = F.last("right", ignorenulls=True).over(Window.partitionBy("part", *on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.groupBy("part", *on).agg(F.max_by("right", F.when(F.col("right").isNotNull(), F.struct(*order))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy(*on).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    prior = ends.withColumn("prior", before).where("prior is not null").drop("end")
    matched = ranged.withColumn("own", carried).where("left is not null").join(prior, ["part", *on], "left")
    found = matched.select("left", F.coalesce("own", "prior").alias("right"))
    return found.unionByName(lefts.where(~known).select("left", "right"))
