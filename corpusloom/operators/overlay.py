"""Corrections of single cells, differences of tables, and set operations on rows and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, value) of a table's cells, as text."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(F.col(key), rows.alias("c")).select(key, "c.field", "c.value")


def differences(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, left, right) of cells that differ, nulls being equal; rows that one side lacks have nulls there.

    Rows are joined once and unpivoted after it, so that cells aren't shuffled one by one.
    """
    r = right.select(F.col(key), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("__r"))
    both = left.select(F.col(key), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("__l")).join(r, key, "full")
    each = F.array(*(F.when(~F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"__l.{c}").alias("left"), F.col(f"__r.{c}").alias("right"))) for c in columns))
    return both.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def unexpected(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of differences that aren't allowed, and allowed ones that don't occur (``side`` tells which)."""
    columns = found.columns
    return found.exceptAll(allowed.select(columns)).withColumn("side", F.lit("found")).unionByName(allowed.select(columns).exceptAll(found).withColumn("side", F.lit("allowed")))


def corrected(df: DataFrame, corrections: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with cells replaced; corrections: (key, field, expected_old, new_value).

    A correction whose expected old value isn't there, or of a row or field that isn't, is an error. Several of one row
    are gathered before the join.
    """
    known = F.when(F.col("field").isin(*columns), F.col("field")).otherwise(F.raise_error(F.concat(F.lit("no such field: "), "field")).cast("string"))
    wide = corrections.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(known.alias("f"), F.struct("expected_old", "new_value").alias("v")))).alias("__c"))
    got = df.withColumn("__df", F.lit(True)).join(wide, key, "full")
    there = F.when(F.col("__df").isNull(), F.raise_error(F.concat(F.lit("no such row: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    got = got.filter(there)
    types = dict(df.dtypes)
    out = {}
    for c in columns:
        fix = F.try_element_at(F.col("__c"), F.lit(c))
        stale = ~F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe(F.coalesce(fix["expected_old"], F.lit("")))
        bad = F.raise_error(F.concat(F.lit(f"stale value of {c}: "), F.col(key).cast("string"))).cast(types[c])
        out[c] = F.when(fix.isNull(), F.col(c)).when(stale, bad).otherwise(fix["new_value"].cast(types[c]))
    return got.withColumns(out).select(df.columns)


def precedence(base: DataFrame, over: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with columns taken from another table of the same keys."""
    return base.drop(*(c for c in columns if c in base.columns)).join(over.select(key, *columns), key)


def protected_faults(template: DataFrame, filled: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cells of a filled-in template that had to stay."""
    return differences(template, filled, key, columns)


def merge_faults(before: DataFrame, after: DataFrame, key: str, family: str, columns: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """(key, field, left, right, fault) of what a merge of families changed beyond what it may.

    A merge makes one family of several: records whose family grew or ceased may change the allowed fields, all others
    nothing, and no record may come or go.
    """
    sizes = lambda df, n: df.groupBy(family).agg(F.count("*").alias(n))
    own = lambda df, n: df.select(key, family).join(sizes(df, n), family).select(key, n)
    both = own(before, "__b").join(own(after, "__a"), key, "full")
    touched = both.select(key, (F.col("__a") > F.col("__b")).alias("__grew"), F.col("__b").isNull().alias("__new"), F.col("__a").isNull().alias("__gone"))
    found = differences(before, after, key, columns).join(touched, key, "left")
    fault = F.when(F.col("__new"), "record added").when(F.col("__gone"), "record lost").when(~F.col("__grew"), "record of no merged family").when(~F.col("field").isin(*allowed), "field that must stay")
    return found.withColumn("fault", fault).filter("fault is not null").select(key, "field", "left", "right", "fault")


def order_faults(left: DataFrame, right: DataFrame, key: str, place: str) -> DataFrame:
    """(key, first, second) of keys whose places in two tables differ, or that one lacks."""
    a, b = left.select(key, F.col(place).alias("first")), right.select(key, F.col(place).alias("second"))
    return a.join(b, key, "full").filter("not (first <=> second)")


def one_to_one(left: DataFrame, right: DataFrame, key: str, place: str | None = None) -> DataFrame:
    """Inner join of tables that each have every key of the other once, in the same places if asked; anything else is an error."""
    if place and (first := order_faults(left, right, key, place).first()):
        raise ValueError(f"not in the same order: {first}")
    mark = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    odd = mark(left, "l").join(mark(right, "r"), key, "full").filter("coalesce(l, 0) <> 1 or coalesce(r, 0) <> 1")
    if first := odd.first():
        raise ValueError(f"not one to one: {first}")
    return left.join(right.drop(place) if place else right, key)


def label_edits(df: DataFrame, labels: str, proposed: str, removed: str, added: str, unspecified: str, order: Sequence[str]) -> DataFrame:
    """Label arrays edited: an unspecified label gives way to the proposed ones, then labels are removed and added, in fixed order."""
    from ..functions.text import by_rank

    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c), empty)
    swapped = F.when(F.array_contains(labels, unspecified) & (F.size(some(proposed)) > 0), F.array_union(F.array_except(labels, F.array(F.lit(unspecified))), some(proposed))).otherwise(F.col(labels))
    edited = F.array_distinct(F.array_union(F.array_except(swapped, some(removed)), some(added)))
    return df.withColumn("__e", edited).withColumn(labels, by_rank("__e", order)).drop("__e")


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(key, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key))


def set_faults(one: DataFrame, two: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one of two sets has; ``side`` is first or second."""
    a, b = one.select(*columns).distinct(), two.select(*columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def multiset_faults(one: DataFrame, two: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns..., first, second) of rows that two tables hold a different number of times."""
    n = lambda df, name: df.groupBy(*columns).agg(F.count("*").alias(name))
    return n(one, "first").join(n(two, "second"), list(columns), "full").na.fill(0, ["first", "second"]).filter("first <> second")


def flagged(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean that tells whether its key is among some ids."""
    return df.join(ids.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cohorts(works: DataFrame, members: dict[str, Column]) -> DataFrame:
    """works once for each cohort they belong to, with its name in ``cohort``."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in members.items())), lambda x: x.isNotNull())
    return works.withColumn("cohort", F.explode(names))
