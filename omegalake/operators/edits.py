"""Edits of a formula dataset: columns renamed, dropped or filled, records appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .keyed import append_new, sequential_ids

#: A paraphrase column of older files, its present name, and columns that went with it.
OLD_PARAPHRASE, PARAPHRASE, OLD_EXTRAS = "paraphrase", "paraphrase_gpt5.4-mini", ("paraphrase_model",)
#: Columns that appended records carry over.
CARRIED = ("LTL", "generated_formula", "simplified_formula")


def renamed_paraphrase(df: DataFrame) -> DataFrame:
    """The old paraphrase column under its present name (a value there already stays), its extras dropped."""
    if OLD_PARAPHRASE in df.columns:
        old = F.col(OLD_PARAPHRASE)
        present = F.coalesce(F.col(f"`{PARAPHRASE}`"), old) if PARAPHRASE in df.columns else old
        df = df.withColumn(PARAPHRASE, present).drop(OLD_PARAPHRASE)
    return df.drop(*OLD_EXTRAS)


def cleared_from(df: DataFrame, least_id: int, columns: tuple[str, ...] = ("origin", "source_record_id")) -> DataFrame:
    """The columns emptied in records whose id is ``least_id`` or more."""
    old = F.expr(f"try_cast(id as bigint) < {int(least_id)}")
    return df.withColumns({c: F.when(old, F.col(c)) for c in columns if c in df.columns})


def filled(df: DataFrame, column: str, value: Column, overwrite: bool = False, ids: tuple[int, int] | None = None) -> DataFrame:
    """``column`` set to ``value`` where it is blank (everywhere, with overwrite), within a range of ids."""
    present = tx.blank_to_null(F.col(f"`{column}`").cast("string")).isNotNull() if column in df.columns else F.lit(False)
    due = F.lit(True) if overwrite else ~present
    if ids:
        due = due & F.coalesce(F.expr(f"try_cast(id as bigint) between {int(ids[0])} and {int(ids[1])}"), F.lit(False))
    kept = F.col(f"`{column}`") if column in df.columns else F.lit(None)
    return df.withColumn(column, F.when(due, value).otherwise(kept))


def _with_new_ids(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    last = existing.agg(F.coalesce(F.max(F.expr("try_cast(id as bigint)")), F.lit(0)), F.coalesce(F.max("pos"), F.lit(-1))).first()
    numbered = sequential_ids(new.drop("id"), order, "id", last[0])
    placed = numbered.withColumn("pos", F.col("id") - F.lit(last[0]) + F.lit(last[1]))
    return existing.unionByName(placed.select(*(c for c in placed.columns if c in existing.columns or c in ("origin", "source_record_id"))), allowMissingColumns=True)


def appended(existing: DataFrame, source: DataFrame, least_source_id: int = 0) -> DataFrame:
    """New formulas of another dataset as records with ids of their own."""
    carried = [c for c in CARRIED if c in source.columns]
    new = append_new(existing, source.where(F.expr(f"try_cast(id as bigint) >= {int(least_source_id)}")).select("pos", "id", *carried))
    return _with_new_ids(existing, new, ["pos"])


def with_simplified(existing: DataFrame) -> DataFrame:
    """Every formula with a different simplified form followed, at the end, by that form as a record that names its source."""
    differ = existing.where(tx.has_different_simplified(F.col("LTL"), F.col("simplified_formula")))
    new = differ.select("pos", "id", F.col("simplified_formula").alias("LTL"), F.lit("simplified_from_existing").alias("origin"), F.col("id").alias("source_record_id"))
    return _with_new_ids(existing, new, ["pos"])
