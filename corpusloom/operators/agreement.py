"""Agreement of two raters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_interval, kappa, multinomial_bootstrap, paired_table_bootstrap, share, wilson

CLASSES = (
    "BOTH_UNCERTAIN_SAME_CODE", "BOTH_UNCERTAIN_DIFFERENT_CODE", "ONE_UNCERTAIN", "DIRECT_INCLUDE_EXCLUDE_DISAGREEMENT",
    "AGREED_INCLUDE", "AGREED_EXCLUDE_SAME_CODE", "AGREED_EXCLUDE_DIFFERENT_CODE",
)


def confusion(df: DataFrame, left: str, right: str, labels: Sequence[str]) -> DataFrame:
    """(left_label, right_label, count) for every pair of labels; pairs of other labels aren't counted."""
    one = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "left_label string, right_label string")
    seen = df.groupBy(F.col(left).cast("string").alias("left_label"), F.col(right).cast("string").alias("right_label")).agg(F.count("*").alias("n"))
    return one.join(seen, ["left_label", "right_label"], "left").select("left_label", "right_label", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def agreement(df: DataFrame, left: str, right: str, certain: bool = False) -> DataFrame:
    """One row: n, agreed, raw_agreement, kappa, lower, upper (score interval of raw agreement).

    Kappa is null where chance agreement is certain; with ``certain`` it is 1 there if all agree. One aggregate by
    pair of labels, then sums over that small table.
    """
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).agg(F.count("*").alias("c"))
    total = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("agreed"))
    side = lambda c, n: pairs.groupBy(F.col(c).alias("label")).agg(F.sum("c").alias(n))
    chance = side("a", "x").join(side("b", "y"), "label").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    got = total.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.col("agreed") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    sure = F.abs(1 - pe) < (1e-9 if certain else 1e-15)
    k = F.when(sure, F.when(F.lit(certain) & (F.abs(1 - po) < 1e-9), F.lit(1.0))).otherwise((po - pe) / (1 - pe))
    return got.select(F.col("n").cast("long"), F.col("agreed").cast("long"), po.alias("raw_agreement"), k.alias("kappa"), wilson(F.col("agreed"), F.col("n"))["lower"].alias("lower"), wilson(F.col("agreed"), F.col("n"))["upper"].alias("upper"))


def binary(c: str | Column, yes: str = "INCLUDE", other: str = "NON_INCLUDE") -> Column:
    return F.when((F.col(c) if isinstance(c, str) else c) == yes, F.lit(yes)).otherwise(F.lit(other))


def human_pairs(df: DataFrame, human: str, model: str) -> DataFrame:
    """(left, right) of the two-way form: rows whose human side is UNCERTAIN are left out, model ones are not."""
    return df.filter(F.col(human) != "UNCERTAIN").select(binary(human).alias("left"), binary(model).alias("right"))


def matrix(df: DataFrame, left: str, right: str, labels: Sequence[str]) -> np.ndarray:
    """Confusion matrix on the driver: as many cells as pairs of labels."""
    at = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)), np.int64)
    for r in confusion(df, left, right, labels).collect():
        out[at[r["left_label"]], at[r["right_label"]]] = r["count"]
    return out


def kappa_interval(df: DataFrame, left: str, right: str, labels: Sequence[str], paired: bool = True, replicates: int = 10_000, seed: int = 2026081306) -> DataFrame:
    """One row (n, raw_agreement, kappa, lower, upper, replicates, seed, unit) with a percentile bootstrap interval.

    paired draws records, for which only the number of records in each cell matters: they are laid out cell by cell, and drawn
    in chunks at any size. Otherwise tables are drawn. Null bounds: over 5 % of the replicates had no kappa.
    """
    m = matrix(df, left, right, labels)
    n = int(m.sum())
    raw, value = kappa(m) if n else (None, None)
    bounds = None
    if n:
        bounds = (paired_table_bootstrap if paired else multinomial_bootstrap)(m, replicates, seed)
    lo, hi = bounds or (None, None)
    row = (n, raw, value, lo, hi, replicates, seed, "paired record" if paired else "table cell")
    return df.sparkSession.createDataFrame([row], "n long, raw_agreement double, kappa double, lower double, upper double, replicates int, seed long, unit string")


def proportions(df: DataFrame, count: str, n: str) -> DataFrame:
    """df with proportion and its exact interval (lower, upper); null where n = 0."""
    ci = exact_interval(F.col(count).cast("long"), F.col(n).cast("long"))
    return df.withColumn("__ci", ci).withColumns({"proportion": F.when(F.col(n) > 0, F.col(count) / F.col(n)), "lower": F.col("__ci.lower"), "upper": F.col("__ci.upper")}).drop("__ci")


def pair_class(a: str, b: str, code_a: str, code_b: str) -> Column:
    """One of CLASSES for two decisions and their codes."""
    u = lambda c: F.col(c) == "UNCERTAIN"
    same = F.col(code_a) == F.col(code_b)
    return (
        F.when(u(a) & u(b), F.when(same, CLASSES[0]).otherwise(CLASSES[1]))
        .when(u(a) | u(b), CLASSES[2])
        .when(F.col(a) != F.col(b), CLASSES[3])
        .when(F.col(a) == "INCLUDE", CLASSES[4])
        .otherwise(F.when(same, CLASSES[5]).otherwise(CLASSES[6]))
    )


def compare_reviews(master: DataFrame, one: DataFrame, two: DataFrame, key: str, criteria: Sequence[str]) -> DataFrame:
    """Master joined with both reviews (prefixed reviewer_A_, reviewer_B_), their class, flags, differing criteria and need of adjudication."""
    side = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}{c}") for c in df.columns if c != key))
    a, b = "reviewer_A_", "reviewer_B_"
    got = master.select(key).join(side(one, a), key).join(side(two, b), key)
    cls = pair_class(f"{a}decision", f"{b}decision", f"{a}primary_code", f"{b}primary_code")
    differ = F.filter(F.array(*(F.when(F.col(a + c) != F.col(b + c), F.lit(c)) for c in criteria)), lambda x: x.isNotNull())
    got = got.withColumns({"comparison_class": cls, "differing_criteria": differ, "uncertain_present": (F.col(f"{a}decision") == "UNCERTAIN") | (F.col(f"{b}decision") == "UNCERTAIN")})
    return got.withColumns({
        "direct_include_exclude_disagreement": F.col("comparison_class") == CLASSES[3],
        "code_disagreement": F.col("comparison_class").isin(CLASSES[1], CLASSES[6]),
        "needs_adjudication": ~F.col("comparison_class").isin(CLASSES[4], CLASSES[5]),
    })


def discrepancies(comparisons: DataFrame, humans: DataFrame, key: str) -> DataFrame:
    """Keys of agreed rows that a human saw otherwise: undecided, decided otherwise, or excluded for another reason.

    humans: key, human_decision, human_primary_code; rows that reviewers disagreed on are adjudicated anyway.
    """
    seen = comparisons.filter(~F.col("needs_adjudication")).join(humans.select(key, "human_decision", "human_primary_code"), key)
    model = F.col("reviewer_A_decision")
    otherwise = (F.col("human_decision") == "UNCERTAIN") | (F.col("human_decision") != model) | ((model == "EXCLUDE") & (F.col("human_primary_code") != F.col("reviewer_A_primary_code")))
    return seen.filter(otherwise).select(key)


def resolve(comparisons: DataFrame, adjudications: DataFrame, key: str, humans: DataFrame | None = None) -> DataFrame:
    """Final decision and code: the adjudicated ones, else the agreed ones; lacking ones are an error.

    decision_basis says which. adjudications: key, decision, primary_code. humans (see discrepancies): what they saw
    otherwise must be adjudicated too.
    """
    adj = adjudications.select(key, F.col("decision").alias("__d"), F.col("primary_code").alias("__c"))
    got = comparisons.join(adj, key, "left")
    if humans is not None:
        got = got.join(discrepancies(comparisons, humans, key).withColumn("__h", F.lit(True)), key, "left").withColumn("needs_adjudication", F.col("needs_adjudication") | F.coalesce("__h", F.lit(False))).drop("__h")
    lacking = F.col("needs_adjudication") & F.col("__d").isNull()
    decision = F.when(lacking, F.raise_error(F.concat(F.lit("not adjudicated: "), F.col(key).cast("string"))).cast("string")).otherwise(F.coalesce("__d", "reviewer_A_decision"))
    return got.withColumns({
        "final_decision": decision, "final_primary_code": F.coalesce("__c", "reviewer_A_primary_code"),
        "decision_basis": F.when(F.col("__d").isNotNull(), "adjudicated").otherwise("agreed"),
    }).drop("__d", "__c")


def compare_rates(df: DataFrame, left: str, right: str) -> DataFrame:
    """n, agreed and percent of two columns, as a table row."""
    return df.agg(F.count("*").alias("n"), F.sum(F.when(F.col(left) == F.col(right), 1).otherwise(0)).cast("long").alias("agreed")).withColumn("percent", share(F.col("agreed"), F.col("n")))
