"""Phrases and concepts in texts, their pairs and networks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase_pattern, variant_pattern
from .lineage import cut


def hits(texts: DataFrame, key: str, fields: Sequence[str], dictionary: dict[str, Sequence[str]]) -> DataFrame:
    """(key, label, any_field, in_<field>...) of the labels that occur, from normalised fields.

    ``any_field`` looks at the fields joined by line breaks, over which a phrase may run. Patterns are literals in one
    projection, compiled once for each task, and no row is joined with the dictionary.
    """
    whole = F.concat_ws("\n", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    df = texts.select(F.col(key), *(F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields), whole.alias("__whole"))
    # of a single field the whole is that field, which is searched once
    one = [F.struct(F.lit(label).alias("label"), F.col("__whole").rlike(p).alias("any_field"), *((F.col(f).rlike(p) if len(fields) > 1 else F.lit(True)).alias(f"in_{f}") for f in fields)) for label, p in ((k, phrase_pattern(v)) for k, v in dictionary.items())]
    return df.select(key, F.explode(F.filter(F.array(*one), lambda s: s["any_field"])).alias("h")).select(key, "h.*")


def frequency(found: DataFrame, fields: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """label, works and works by field; labels without a hit have zeros."""
    spine = found.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = found.groupBy("label").agg(F.count("*").alias("works"), *(F.sum(F.col(f"in_{f}").cast("long")).alias(f) for f in fields))
    return spine.join(counts, "label", "left").na.fill(0)


def pairs(found: DataFrame, key: str) -> DataFrame:
    """left, right, count of unordered pairs of labels of a work.

    A work's labels are gathered (at most as many as the dictionary has) and paired in its own row, so that no join is
    needed and no label's works meet in one task.
    """
    sets = found.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("ls"))
    two = F.flatten(F.transform("ls", lambda a, i: F.transform(F.slice("ls", i + 2, F.size("ls")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return sets.select(F.explode(two).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("count")).select("left", "right", "count")


def pair_table(found: DataFrame, key: str, labels: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Every unordered pair of labels with its count, both frequencies and cosine count / sqrt(f1 * f2); null if one is 0.

    The list of pairs is that of the dictionary, not of data.
    """
    found = cut(found.select(key, "label"))  # it is counted by label and by pair: a row for each hit, without the texts
    names = sorted(labels)
    rows = [(a, b) for i, a in enumerate(names) for b in names[i if diagonal else i + 1 :]]
    spine = found.sparkSession.createDataFrame(rows, "left string, right string")
    single = found.select(key, "label").distinct().groupBy("label").agg(F.count("*").alias("f"))
    counted = pairs(found, key)
    if diagonal:
        counted = counted.unionByName(single.select(F.col("label").alias("left"), F.col("label").alias("right"), F.col("f").alias("count")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = spine.join(counted, ["left", "right"], "left").join(single.select(F.col("label").alias("left"), F.col("f").alias("left_works")), "left", "left")
    got = got.join(single.select(F.col("label").alias("right"), F.col("f").alias("right_works")), "right", "left")
    a, b, c = zero(F.col("left_works")), zero(F.col("right_works")), zero(F.col("count"))
    return got.select("left", "right", c.alias("count"), a.alias("left_works"), b.alias("right_works"), F.when((a > 0) & (b > 0), c / F.sqrt(a.cast("double") * b)).alias("cosine"))


def network(table: DataFrame, least_works: int, k: int, excluded: Sequence[str] = (), least_labels: int = 0) -> DataFrame:
    """The k most frequent pairs of labels that both have enough works and aren't excluded; none if too few labels qualify."""
    ok = table.filter((F.col("left_works") >= least_works) & (F.col("right_works") >= least_works) & (F.col("count") > 0) & ~F.col("left").isin(*excluded) & ~F.col("right").isin(*excluded))
    if least_labels:
        many = ok.select(F.explode(F.array("left", "right")).alias("l")).agg(F.count_distinct("l").alias("n"))
        ok = ok.crossJoin(F.broadcast(many)).filter(F.col("n") >= least_labels).drop("n")
    return ok.orderBy(F.desc("count"), "left", "right").limit(k)


def nodes(edges: DataFrame) -> DataFrame:
    """label, works, degree, strength of an edge table's labels."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("left").alias("label"), F.col("left_works").alias("works"), "count"), F.struct(F.col("right").alias("label"), F.col("right_works").alias("works"), "count"))).alias("e"))
    return ends.groupBy("e.label", "e.works").agg(F.count("*").alias("degree"), F.sum("e.count").alias("strength")).select("label", "works", "degree", "strength")


def indicators(found: DataFrame, works: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """One row for each work with a 0 or 1 for each label."""
    got = found.groupBy(key).agg(*(F.max((F.col("label") == x).cast("int")).alias(x) for x in labels))
    return works.select(key).join(got, key, "left").na.fill(0, list(labels))


def concepts(texts: DataFrame, key: str, fields: Sequence[str], thesaurus: dict[str, Sequence[str]]) -> DataFrame:
    """(key, concept, variants, in_<field>...): concepts of a thesaurus in normalised fields, with the variants that matched."""
    df = texts.select(key, *(F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields))
    # the variants found in a field are a column of their own, so that each pattern reads a field once
    found = lambda f, vs: F.filter(F.array(*(F.when(F.col(f).rlike(variant_pattern(v)), F.lit(v)) for v in vs)), lambda x: x.isNotNull())
    seen = df.select(key, *(found(f, vs).alias(f"__{i}_{f}") for i, vs in enumerate(thesaurus.values()) for f in fields))

    def one(i: int, concept: str) -> Column:
        variants = F.array_sort(F.array_distinct(F.concat(*(F.col(f"__{i}_{f}") for f in fields))))
        return F.struct(F.lit(concept).alias("concept"), variants.alias("variants"), *((F.size(f"__{i}_{f}") > 0).alias(f"in_{f}") for f in fields))

    return seen.select(key, F.explode(F.filter(F.array(*(one(i, c) for i, c in enumerate(thesaurus))), lambda s: F.size(s["variants"]) > 0)).alias("h")).select(key, "h.*")


def strongest(edges: DataFrame, weight: str, count: str, k: int = 6, always: int = 8) -> DataFrame:
    """Edges among the k strongest of one of their ends, or with a count of at least ``always``."""
    both = edges.select("left", "right", weight, count, F.explode(F.array("left", "right")).alias("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(weight), F.desc(count), "left", "right"))
    return both.withColumn("__r", place).filter((F.col("__r") <= k) | (F.col(count) >= always)).select("left", "right", weight, count).distinct()


def frequent(counts: DataFrame, count: str, least: int | None = None, head: int | None = None, order: Sequence[str] = ("label",)) -> DataFrame:
    """Labels with at least ``least`` works (ties all stay), or the first ``head`` by count and ``order``."""
    return counts.filter(F.col(count) >= least) if least is not None else counts.orderBy(F.desc(count), *order).limit(head)
