"""Counts with their denominators: labels, years, coverage, top sources, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import share


def _labels(df: DataFrame, values: Sequence[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"label_order int, {name} string")


def multi_response(works: DataFrame, key: str, labels: str, allowed: Sequence[str] | DataFrame | None = None, blank: str | None = None, ids: bool = False, order: str | None = None) -> DataFrame:
    """label, count, denominator, percent: works for each label of an array column, each work once a label.

    allowed: labels that get a row even without a work (a sequence, or a DataFrame with a column ``label``); with them other
    labels are errors. blank: a label for works that have none. ids adds work_ids in the order of ``order`` (or the key).
    Exploded labels are counted by a partial aggregate; only the list of labels is joined.
    """
    base = works.select(F.col(key).alias("__k"), F.array_distinct(F.coalesce(F.col(labels), F.array().cast("array<string>"))).alias("__l"), *([F.col(order).alias("__o")] if order else []))
    if blank is not None:
        base = base.withColumn("__l", F.when(F.size("__l") == 0, F.array(F.lit(blank))).otherwise(F.col("__l")))
    each = base.select("__k", *(["__o"] if order else []), F.explode("__l").alias("label"))
    aggs = [F.count("*").alias("count")]
    if ids:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__o" if order else "__k").alias("o"), F.col("__k").alias("k")))), lambda s: s["k"]).alias("work_ids"))
    counts = each.groupBy("label").agg(*aggs)
    if allowed is not None:
        known = allowed.select("label") if isinstance(allowed, DataFrame) else _labels(works, [*allowed, *([blank] if blank is not None and blank not in allowed else [])], "label").drop("label_order")
        known = known.distinct().withColumn("__known", F.lit(True))
        counts = counts.join(known, "label", "full").withColumn("count", F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("label that isn't allowed: "), "label")).cast("long")).otherwise(F.coalesce("count", F.lit(0)))).drop("__known")
    n = works.agg(F.count("*").alias("denominator"))
    out = counts.crossJoin(F.broadcast(n)).withColumn("percent", share(F.col("count"), F.col("denominator")))  # one row
    return out.select("label", F.col("count").cast("long"), "denominator", "percent", *(["work_ids"] if ids else []))


def single_response(df: DataFrame, column: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """label, count, denominator and percent of a column's values; allowed ones that don't occur have 0."""
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count"))
    if allowed is not None:
        counts = _labels(df, allowed, "label").drop("label_order").join(counts, "label", "full").withColumn("count", F.coalesce("count", F.lit(0)))
    n = df.agg(F.count("*").alias("denominator"))
    return counts.crossJoin(F.broadcast(n)).withColumn("percent", share(F.col("count"), F.col("denominator")))


def yearly(df: DataFrame, year: Column, first: int, last: int, partial: int | None = None) -> DataFrame:
    """label, count, denominator, percent, partial: one row for every year of a range, and one for missing years.

    A year outside the range is an error. ``partial`` flags a year whose data aren't complete.
    """
    checked = F.when(year.isNull() | year.between(first, last), year).otherwise(F.raise_error(F.concat(F.lit("year out of range: "), year.cast("string"))).cast("int"))
    counts = df.select(F.coalesce(checked.cast("string"), F.lit("Missing")).alias("label")).groupBy("label").agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("string").alias("label")).union(df.sparkSession.createDataFrame([("Missing",)], "label string"))
    n = df.agg(F.count("*").alias("denominator"))
    out = spine.join(counts, "label", "left").crossJoin(F.broadcast(n))
    return out.select("label", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "denominator", share(F.coalesce("count", F.lit(0)), F.col("denominator")).alias("percent"), (F.col("label") == str(partial)).alias("partial"))


def labelled_only(works: DataFrame, labels: str, ignored: Sequence[str] = ()) -> DataFrame:
    """label, count, denominator, percent among works that have some label besides the ignored ones."""
    own = F.array_except(F.array_distinct(F.coalesce(F.col(labels), F.array().cast("array<string>"))), F.array(*(F.lit(x) for x in ignored)).cast("array<string>"))
    kept = works.select(own.alias("l")).filter(F.size("l") > 0)
    n = kept.agg(F.count("*").alias("denominator"))
    counts = kept.select(F.explode("l").alias("label")).groupBy("label").agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(n)).withColumn("percent", share(F.col("count"), F.col("denominator")))


def coverage(df: DataFrame, present: dict[str, Column]) -> DataFrame:
    """measure, present, missing, denominator: for each measure the rows that have it; read in one pass."""
    sums = df.agg(F.count("*").alias("n"), *(F.sum(F.when(c, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(present.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("long").alias("present")) for i, m in enumerate(present))))
    return sums.select("n", rows.alias("r")).select("r.measure", "r.present", (F.col("n") - F.col("r.present")).alias("missing"), F.col("n").alias("denominator"))


def top_and_rest(counts: DataFrame, label: str, count: str, k: int, rest: str = "Other") -> DataFrame:
    """label, count, position: the k largest (ties: label), and all others as one row at the end.

    The largest come by a bounded sort; nothing is ranked as a whole.
    """
    top = counts.orderBy(F.desc(count), label).limit(k).select(F.col(label).alias("label"), F.col(count).cast("long").alias("count"))
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("count"), "label")))
    sums = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("all")).crossJoin(top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("of_top"), F.count("*").alias("n")))
    other = sums.select(F.lit(rest).alias("label"), (F.col("all") - F.col("of_top")).cast("long").alias("count"), (F.col("n") + 1).cast("int").alias("position"))
    return placed.unionByName(other)


def distribution(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, sum, mean, median, q1, q3, min, max and zero_count of values that aren't null, for each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), q.alias("q"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.when(value == 0, 1).otherwise(0)).cast("long").alias("zero_count"))
    return got.select(*by, "n", "sum", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "min", "max", "zero_count")


def distribution_of_years(df: DataFrame, value: Column, year: Column, first: int, last: int) -> DataFrame:
    """distribution for every year of a range, those without a value included, with the year's rows (works) and covered = n."""
    each = df.select(year.alias("year"), value.alias("__v"))
    got = distribution(each, F.col("__v"), ["year"])
    works = each.groupBy("year").agg(F.count("*").alias("works"))
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    out = spine.join(got, "year", "left").join(works, "year", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "works", "zero_count")}
    return out.withColumns(zero).withColumn("covered", F.col("n"))


def conditional_counts(df: DataFrame, label: str, conditions: dict[str, Column]) -> DataFrame:
    """For each label one count for each condition."""
    return df.groupBy(label).agg(*(F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in conditions.items()))


def subtotals(df: DataFrame, group: str, part: str, measures: dict[str, Column], whole: str = "ALL") -> DataFrame:
    """Rows for each (group, part) and each group as a whole."""
    got = df.rollup(group, part).agg(F.grouping_id().alias("__g"), *(c.alias(n) for n, c in measures.items())).filter("__g < 3")
    return got.withColumn(part, F.when(F.col("__g") == 1, F.lit(whole)).otherwise(F.col(part).cast("string"))).drop("__g")


def count_changes(before: DataFrame, after: DataFrame, label: str = "label", count: str = "count") -> DataFrame:
    """label, before, after, change of two tables of counts."""
    b, a = before.select(label, F.col(count).alias("before")), after.select(label, F.col(count).alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return b.join(a, label, "full").select(label, zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("change"))


def folded_frequency(df: DataFrame, key: str, items: str, order: str) -> DataFrame:
    """Frequencies of labels that differ in case or underscores only: folded, label (first spelling by order), count."""
    each = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.posexplode(items).alias("p", "x")).withColumn("folded", F.lower(F.regexp_replace(F.trim("x"), r"[\s_]+", " ")))
    return each.groupBy("folded").agg(F.min_by("x", F.struct("o", "p")).alias("label"), F.count_distinct("k").alias("count"))


def folded_with_missing(df: DataFrame, key: str, items: str, order: str, missing: str = "Missing") -> DataFrame:
    """folded_frequency, and a row for works without any item (folded null), with all works as denominator."""
    n = df.agg(F.count("*").alias("denominator"), F.coalesce(F.sum(F.when(F.size(F.coalesce(F.col(items), F.array().cast("array<string>"))) == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("__m"))
    blank = n.select(F.lit(None).cast("string").alias("folded"), F.lit(missing).alias("label"), F.col("__m").alias("count"))
    return folded_frequency(df, key, items, order).unionByName(blank).crossJoin(F.broadcast(n.select("denominator")))  # one row


def only_label(df: DataFrame, labels: str, label: str) -> DataFrame:
    """One row (count, denominator): works whose labels are this one and no other."""
    return df.agg(F.sum(F.when(F.array_distinct(labels) == F.array(F.lit(label)), 1).otherwise(0)).cast("long").alias("count"), F.count("*").alias("denominator"))


def flow(stages: dict[str, DataFrame]) -> DataFrame:
    """stage_order, stage, count of named stages of a selection."""
    parts = [df.agg(F.count("*").alias("count")).select(F.lit(i).alias("stage_order"), F.lit(name).alias("stage"), "count") for i, (name, df) in enumerate(stages.items(), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped_labels(counts: DataFrame, key: str, count: str, groups: dict[str, tuple[Sequence[str], Sequence[str]]], rest: str, top: int) -> DataFrame:
    """counts with group, place in the group, and whether a figure shows the label.

    groups: name to fixed keys and to pieces of text that a key, with a space before it, may hold; the first that fits wins, other keys are in
    ``rest``. A figure shows the labels of the named groups and the ``top`` most frequent of the rest (ties by key).
    """
    group = F.coalesce(*(F.when(F.col(key).isin(*fixed) | F.greatest(F.lit(False), *(F.concat(F.lit(" "), F.col(key)).contains(x) for x in pieces), F.lit(False)), n) for n, (fixed, pieces) in groups.items()), F.lit(rest))
    placed = counts.withColumn("group", group).withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc(count), key)))
    return placed.withColumn("shown", (F.col("group") != rest) | (F.col("place") <= top))


def named_coverage(df: DataFrame, labels: str, unspecified: Sequence[str]) -> DataFrame:
    """One row: works with a named label, works without one, and works that hold an unspecified label besides whatever else."""
    un = F.array(*(F.lit(x) for x in unspecified))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    named = F.size(F.array_except(F.coalesce(F.col(labels), F.array().cast("array<string>")), un)) > 0
    return df.agg(n(named).alias("named"), n(~named).alias("not_named"), n(F.coalesce(F.arrays_overlap(labels, un), F.lit(False))).alias("unspecified"), F.count("*").alias("denominator"))
