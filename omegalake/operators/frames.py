"""Lag, lead and moving frames over a whole log in one order, without a partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .keyed import sequential_ids

#: Rows that one task looks at in order, besides the border rows of its neighbours.
BLOCK = 100_000


def framed(df: DataFrame, order: list[str], columns: dict[str, object], before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds columns that look at most ``before`` rows back and ``after`` rows ahead in this order (a total order).

    columns: name -> function of a window (ordered, without frame) that gives a column: ``lambda w: F.lag("x").over(w)`` or
    ``lambda w: F.avg("x").over(w.rowsBetween(-99, 0))``. Rows are numbered by ranges, cut into blocks by number, and each block gets
    copies of the ``before`` and ``after`` rows beyond its borders; a window over each block then sees all that its own rows look at.
    """
    block = max(block, before, after, 1)
    if taken := {"place", "block", "own"} & set(df.columns):
        raise ValueError(f"columns of these names are made here: {sorted(taken)}")
    numbered = sequential_ids(df, order, "place", base=-1)
    of = F.floor(F.col("place") / block).cast("long")
    within = F.col("place") % block
    # To the next block if that looks back on it, to the one before if that looks ahead to it.
    to = F.array_compact(F.array(of, F.when(F.lit(before > 0) & (within >= block - before), of + 1), F.when(F.lit(after > 0) & (within < after) & (of > 0), of - 1)))
    copied = numbered.withColumn("own", of).withColumn("block", F.explode(to))
    by: WindowSpec = Window.partitionBy("block").orderBy("place")
    found: dict[str, Column] = {n: f(by) for n, f in columns.items()}
    return copied.withColumns(found).where(F.col("block") == F.col("own")).drop("block", "own", "place")
