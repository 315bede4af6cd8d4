"""Rank correlation, logistic regression and scaling laws, by sums that every task adds to."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import staged
from .keyed import running_total


def tied_ranks(df: DataFrame, value: str, name: str, weight: Column | None = None) -> DataFrame:
    """Adds the average rank of equal values: values are counted first (a row counts ``weight`` times), ranks run over distinct values."""
    counts = df.groupBy(F.col(value).alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_times"))
    ranked = running_total(counts, ["_v"], F.col("_times"), "_upto")
    return df.join(ranked.select("_v", (F.col("_upto") - (F.col("_times") - 1) / 2).alias(name)), F.col(value) == F.col("_v")).drop("_v")


#: Cells up to which the values of a measure are ranked by one task; more go by ranges.
RANKED_TOGETHER = 1_000_000


def _ranks(cells: DataFrame, value: str, name: str, many: bool) -> DataFrame:
    """(measure, value, average rank of its rows) of each distinct value of each measure."""
    counts = cells.groupBy("measure", value).agg(F.sum("w").alias("times"))
    if many:
        # Sums over all measures in a row, less what lies before each.
        totals = counts.groupBy("measure").agg(F.sum("times").alias("own"))
        before = F.coalesce(F.sum("own").over(Window.orderBy("measure").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        upto = running_total(counts, ["measure", value], F.col("times"), "upto").join(F.broadcast(totals.select("measure", before.alias("before"))), "measure").withColumn("upto", F.col("upto") - F.col("before"))
    else:
        upto = counts.withColumn("upto", F.sum("times").over(Window.partitionBy("measure").orderBy(value)))
    return upto.select("measure", value, (F.col("upto") - (F.col("times") - 1) / 2).alias(name))


def spearman(df: DataFrame, measures: list[str], outcome: str, weight: str | None = None) -> DataFrame:
    """(measure, n, rho, z) of each measure against the outcome; rho null for fewer than two rows or no variance.

    Rows are read once: each gives a cell (measure, value, outcome) for every measure, cells are counted (a row counts ``weight``
    times), and only they are ranked and summed, all measures together. Ranks are taken from their mean, which is half of the number of
    rows and one, so that sums of any number of rows keep their digits.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures)))
    rows = df.where(F.col(outcome).isNotNull()).select(F.col(outcome).cast("double").alias("y"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w"), pairs.alias("p"))
    cells = staged(rows.select("p.*", "y", "w").where("x is not null").groupBy("measure", "x", "y").agg(F.sum("w").alias("w")), "cells")
    many = cells.count() > RANKED_TOGETHER
    ranked = cells.join(_ranks(cells, "x", "rx", many), ["measure", "x"]).join(_ranks(cells, "y", "ry", many), ["measure", "y"])
    middle = cells.groupBy("measure").agg(((F.sum("w") + 1) / 2).alias("middle"))
    x, y, w = F.col("rx") - F.col("middle"), F.col("ry") - F.col("middle"), F.col("w")
    rho = F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y)))
    found = ranked.join(F.broadcast(middle), "measure").groupBy("measure").agg(F.sum("w").alias("n"), rho.alias("rho"))
    asked = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, measures))).alias("measure"))
    found = asked.join(F.broadcast(found), "measure", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("z", F.when((F.col("n") >= 4) & (F.abs("rho") < 1), F.atanh("rho") * F.sqrt((F.col("n") - 3) / F.lit(1.06))))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: a series of positive terms below 2, a continued fraction beyond."""

    def term(s: Column, n: Column) -> Column:
        nxt = s["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(nxt.alias("term"), (s["sum"] + nxt).alias("sum"))

    start = F.struct(x.alias("term"), x.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, term)["sum"]
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: n / F.lit(2.0) / (x + f))
    scale = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    return F.when(x < 2, 1 - 2 * scale * series).otherwise(scale / (x + fraction))


def p_values(correlations: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of z: null without rho, 0 where z isn't defined otherwise."""
    p = erfc(F.abs("z") / F.lit(math.sqrt(2)))
    return correlations.withColumn("p_value", F.when(F.col("rho").isNotNull(), F.coalesce(F.when(F.col("z").isNotNull(), p), F.lit(0.0))))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / sample deviation; 0 where there is none."""
    parts = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_samp)))).first()
    scaled = {c: (F.col(c) - parts[f"mean_{c}"]) / parts[f"dev_{c}"] if parts[f"dev_{c}"] else F.lit(0.0) for c in columns}
    return df.withColumns(scaled)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logistic_fit(df: DataFrame, terms: list[str], outcome: str, by: str | None = None, rounds: int = 100, tolerance: float = 1e-8) -> list[dict]:
    """Iteratively reweighted least squares: a list of {group, term, coefficient, se, z, p_value, odds_ratio, n, log_likelihood}.

    Rows are first summed by distinct terms and outcome; every round is one aggregation of the weighted
    products (a few numbers for each group). Probabilities stay 1e-9 from 0 and 1; singular systems
    use the pseudo-inverse. Groups are few (models): their coefficients are held by the driver.
    """
    group = [by] if by else []
    names = ["(Intercept)", *terms]
    cells = df.groupBy(*group, *terms, outcome).agg(F.count("*").alias("_n")).cache()
    groups = [r[0] for r in cells.select(*group).distinct().collect()] if by else [None]
    beta = {g: np.zeros(len(names)) for g in groups}
    result: dict = {}
    try:
        for _ in range(rounds):
            coefficient = F.lit(None).cast("array<double>")
            for g, b in beta.items():
                value = F.array(*(F.lit(float(x)) for x in b))
                coefficient = value if g is None else F.when(F.col(by) == g, value).otherwise(coefficient)
            x = [F.lit(1.0), *(F.col(t).cast("double") for t in terms)]
            b = F.col("_b")
            eta = sum((x[k] * F.get(b, F.lit(k)) for k in range(1, len(x))), x[0] * F.get(b, F.lit(0)))
            p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), sigmoid(F.col("_eta"))))
            scored = cells.withColumn("_b", coefficient).withColumn("_eta", eta).withColumn("_p", p)
            weight = F.col("_n") * F.col("_p") * (1 - F.col("_p"))
            hessian = [F.sum(weight * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
            score = [F.sum(F.col("_n") * (F.col(outcome).cast("double") - F.col("_p")) * x[i]).alias(f"s{i}") for i in range(len(x))]
            hit = F.col(outcome).cast("double")
            likelihood = F.sum(F.col("_n") * (hit * F.log("_p") + (1 - hit) * F.log(1 - F.col("_p")))).alias("likelihood")
            moved = 0.0
            for r in scored.groupBy(*group).agg(*hessian, *score, F.sum("_n").alias("n"), likelihood).collect():
                g = r[by] if by else None
                h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))])
                inverse = np.linalg.pinv(h)
                step = inverse @ np.array([r[f"s{i}"] for i in range(len(x))])
                beta[g] = beta[g] + step
                moved = max(moved, float(np.abs(step).max()))
                result[g] = (beta[g], np.sqrt(np.clip(np.diag(inverse), 0, None)), r["n"], r["likelihood"])
            if moved < tolerance:
                break
    finally:
        cells.unpersist()
    return [
        {"group": g, "term": t, "coefficient": float(b), "se": float(e), "z": float(b / e) if e else None, "p_value": math.erfc(abs(b / e) / math.sqrt(2)) if e else None, "odds_ratio": float(math.exp(min(700.0, b))), "n": n, "log_likelihood": float(likelihood)}
        for g, (coefficients, errors, n, likelihood) in result.items()
        for t, b, e in zip(names, coefficients, errors)
    ]


def scaling_law(df: DataFrame, model: str = "model", size: str = "ast_size", success: str = "success", setting: tuple[str, str] | None = None) -> DataFrame:
    """(model, beta0, beta1, n, size50): success as a logistic function of size, and the size of even odds.

    setting: a column and the value that rows must have in it.
    """
    missing = {model, size, success, *(setting[:1] if setting else ())} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    df = df.where(F.col(setting[0]) == setting[1]) if setting else df
    fitted = logistic_fit(df.select(model, size, F.col(success).cast("int").alias(success)), [size], success, model)
    rows = {}
    for r in fitted:
        rows.setdefault(r["group"], {"n": r["n"]})["beta0" if r["term"] == "(Intercept)" else "beta1"] = r["coefficient"]
    made = [(g, r["beta0"], r["beta1"], r["n"], -r["beta0"] / r["beta1"] if r["beta1"] else None) for g, r in rows.items()]
    return df.sparkSession.createDataFrame(made, f"{model} string, beta0 double, beta1 double, n long, size50 double")


def predicted_success(laws: DataFrame, sizes: list[int]) -> DataFrame:
    return laws.withColumns({f"p_size_{s}": sigmoid(F.col("beta0") + F.col("beta1") * s) for s in sizes})
