"""Equivalence classes of formulas, upsert by meaning, and batch filters.

Formulas are blocked by their signature (truth on fixed words): equivalent formulas share it. Within a
block every formula is compared with the block's leaders only, round by round: those equivalent to a
leader join its class, the rest choose a new leader. So no block is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formulas import ltl_equivalent, ltl_metrics, ltl_signature
from ..shared import staged


def classes(formulas: DataFrame, text: str = "LTL", pos: str = "pos") -> DataFrame:
    """(formula, class_leader) of every distinct formula: the leader is the earliest equivalent one (exact).

    Formulas that don't parse, or whose comparison is undecided, lead their own class.
    """
    distinct = formulas.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("f")).agg(F.min(pos).alias("p"))
    open_ = staged(distinct.withColumn("sig", F.coalesce(ltl_signature("f"), F.concat(F.lit("unread:"), "f"))), "signatures")
    done = None
    while True:
        lead = open_.groupBy("sig").agg(F.min_by("f", F.struct("p", "f")).alias("leader"))
        met = open_.join(lead, "sig")
        same = (F.col("f") == F.col("leader")) | F.coalesce(ltl_equivalent("f", "leader"), F.lit(False))
        judged = staged(met.withColumn("same", same), "judged")
        found = judged.where("same").select("f", "leader")
        done = found if done is None else done.unionByName(found)
        open_ = judged.where("not same").select("f", "p", "sig")
        if open_.isEmpty():
            return done.select(F.col("f").alias("formula"), F.col("leader").alias("class_leader"))


def class_sizes(formulas: DataFrame, text: str = "LTL", pos: str = "pos") -> DataFrame:
    """(class_leader, n_formulas, n_rows), to be ordered by size."""
    rows = formulas.groupBy(F.col(text).alias("formula")).agg(F.count("*").alias("n"))
    return classes(formulas, text, pos).join(rows, "formula").groupBy("class_leader").agg(F.count("*").alias("n_formulas"), F.sum("n").alias("n_rows"))


def _merged(existing: DataFrame, new: DataFrame, text: str, pos: str) -> tuple[DataFrame, int]:
    """Both, new records after all existing ones, and the last place of those."""
    last = existing.agg(F.coalesce(F.max(pos), F.lit(0))).first()[0]
    shifted = new.withColumn(pos, F.col(pos) + F.lit(last))
    return staged(existing.unionByName(shifted, allowMissingColumns=True), "records"), last


def upsert(existing: DataFrame, new: DataFrame, text: str = "LTL", pos: str = "pos") -> DataFrame:
    """One record for each class: at the place of its first record, that with the smallest preference.

    Columns of ``existing``; new records come after all existing ones. Among equal preferences the
    earlier record stays. Records are to be renumbered by ``pos`` afterwards.
    """
    both, _ = _merged(existing, new, text, pos)
    known = classes(both, text, pos)
    known = known.withColumn("_m", ltl_metrics("formula")["preference"])
    grouped = both.join(known, F.col(text) == F.col("formula"))
    row = F.struct(*(F.col(f"`{c}`") for c in both.columns))
    best = grouped.groupBy("class_leader").agg(F.min_by(row, F.struct("_m", pos)).alias("_row"), F.min(pos).alias("_pos"))
    return best.select(*(F.col("_pos").alias(c) if c == pos else F.col(f"_row.`{c}`").alias(c) for c in both.columns))


#: Places of records that one task looks at in order.
ORDERED = 10_000


def merge_outcomes(existing: DataFrame, new: DataFrame, text: str = "LTL", pos: str = "pos") -> DataFrame:
    """(pos, outcome) of each new record with a text, ``upsert`` taking them one after the other.

    inserted: no earlier record means the same; replaced: it is preferred to all earlier ones of its class; else
    skipped. ``pos`` tells new records apart. The least preference before a record is taken over whole ranges of places
    first, so a class that very many records share isn't ordered by one task.
    """
    both, last = _merged(existing, new, text, pos)
    records = both.select(F.col(pos).alias("at"), F.col(text).alias("formula"))
    metrics = records.select("formula").distinct().withColumn("preference", ltl_metrics("formula")["preference"])
    known = classes(both, text, pos).join(metrics, "formula")
    placed = staged(records.join(known, "formula").withColumn("range", F.floor(F.col("at") / ORDERED)), "placed-records")
    within = Window.partitionBy("class_leader", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("class_leader").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("class_leader", "range").agg(F.min("preference").alias("least")).withColumn("before", F.min("least").over(over))
    judged = placed.withColumn("own", F.min("preference").over(within)).join(ranges.drop("least"), ["class_leader", "range"])
    earlier = F.least("own", "before")
    outcome = F.when(earlier.isNull(), "inserted").when(F.col("preference") < earlier, "replaced").otherwise("skipped")
    return judged.where(F.col("at") > last).select((F.col("at") - last).alias(pos), outcome.alias("outcome"))


def filter_formulas(formulas: DataFrame, text: str = "LTL", pos: str = "pos", mode: str = "normalized", temporal: bool = True) -> DataFrame:
    """Adds ``reasons`` (trivial, non_temporal, unsatisfiable, redundant; empty if accepted) and ``accepted_form``.

    mode: what makes formulas redundant, the exact text or the text with canonical names. A formula whose only
    reason is that it is trivial is tried again in its simplified form. A formula is redundant if an
    earlier accepted one has the same key. Each distinct formula is measured once; those that don't parse, and null ones, go.
    """
    # Staged, so that the filter doesn't measure each row's formula.
    distinct = staged(formulas.select(F.col(text).alias("formula")).distinct().withColumn("m", ltl_metrics("formula")), "measured").where("not m.parse_error")
    key = F.col("m.rendered") if mode == "exact" else F.col("m.normalized")
    reasons = F.array_compact(F.array(F.when(F.col("m.is_trivial"), F.lit("trivial")), F.when(F.lit(temporal) & ~F.col("m.is_temporal"), F.lit("non_temporal")), F.when(F.col("m.looks_unsatisfiable"), F.lit("unsatisfiable"))))
    own = distinct.select("formula", key.alias("key"), reasons.alias("own"), F.col("m.selected").alias("selected"), F.col("m.simplified").alias("simplified"))
    again = (F.size("own") == 1) & (F.get("own", F.lit(0)) == "trivial") & ~ltl_metrics("simplified")["is_trivial"]
    judged = staged(own.select("formula", "key", "selected", F.when(again, F.array().cast("array<string>")).otherwise(F.col("own")).alias("own")), "judged-formulas")
    columns = [c for c in formulas.columns if c not in ("reasons", "accepted_form")]
    rows = formulas.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(text).alias("formula"), F.col(pos).alias("at")).join(judged, "formula")
    first = rows.where(F.size("own") == 0).groupBy("key").agg(F.min("at").alias("first"))
    redundant = F.col("first") < F.col("at")
    joined = rows.join(first, "key", "left").withColumn("reasons", F.when(redundant, F.array_append("own", F.lit("redundant"))).otherwise(F.col("own")))
    return joined.select("row.*", "reasons", F.when(F.size("reasons") == 0, F.col("selected")).alias("accepted_form"))
