"""Reproducible samples by hash rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def hash_rank(seed: str, pool: str | Column, key: str) -> Column:
    pool = F.lit(pool) if isinstance(pool, str) else pool
    return F.sha2(F.concat(F.lit(f"{seed}-"), pool, F.lit("|"), F.col(key).cast("string")), 256)


def ranked_pools(rows: DataFrame, seed: str, pool: str, key: str) -> DataFrame:
    """rows with pool_hash and pool_rank; ties by key. The same for any partitioning."""
    h = rows.withColumn("pool_hash", hash_rank(seed, F.col(pool), key))
    return h.withColumn("pool_rank", F.row_number().over(Window.partitionBy(pool).orderBy("pool_hash", key)))


def sample(rows: DataFrame, seed: str, pool: str, key: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each pool by hash rank. Spark keeps only so many of a pool in each task before it shuffles."""
    return ranked_pools(rows, seed, pool, key).filter(F.col("pool_rank") <= quota)


def expansion(ranked: DataFrame, selected: DataFrame, key: str, target: int) -> DataFrame:
    """Rows of complete rankings next in line up to ``target`` that weren't selected."""
    return ranked.filter(F.col("pool_rank") <= target).join(selected.select(key), key, "left_anti")


def blinded(rows: DataFrame, seed: str, key: str, prefix: str = "H") -> DataFrame:
    """rows in a seeded order with ids H001, H002 and so on. For samples, whose size is a quota."""
    h = F.sha2(F.concat(F.lit(f"{seed}-ORDER|"), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.orderBy(h, key))
    return rows.withColumn("audit_order", place).withColumn("audit_id", F.concat(F.lit(prefix), F.lpad(F.col("audit_order").cast("string"), 3, "0")))


def batches(rows: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    """rows with row_number and batch (from 1), by a global order.

    Rows are dealt out by ranges and numbered in each; the number of rows before a range is added, so that no task sees all
    rows. Ranges are made from a sample, which another run of the same plan may draw otherwise: the numbered rows are
    stored once, and both the rows and the ranges' sizes are read from there.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the number of a row within its partition in the low 33 bits, that of the partition above
    own = cut(dealt.withColumn("__id", F.monotonically_increasing_id()))
    own = own.withColumns({"__p": F.shiftright("__id", 33), "__r": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    sizes = own.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    at = (F.col("__b") + F.col("__r") + 1).cast("long")
    got = own.join(F.broadcast(before), "__p").withColumn("row_number", at)  # one row for each partition
    return got.withColumn("batch", (F.floor((F.col("row_number") - 1) / size) + 1).cast("long")).drop("__p", "__r", "__b")


def two_pool_quotas(have: tuple[int, int], target: int, base: tuple[int, int]) -> tuple[int, int]:
    """How many to take of two pools: what the bases leave is halved, an odd one for the first; what one lacks the other gives."""
    if sum(have) < target:
        raise ValueError("the pools hold too few records")
    wanted = base[0] - (sum(base) - target) // 2
    first = min(have[0], max(wanted, target - have[1]))
    return first, target - first


def boundary_quotas(have: dict[str, int], base: dict[str, int], target: int) -> dict[str, int]:
    """How many to take of each pool: its quota, then what is lacking from the pool with most left (ties by name)."""
    take = {p: min(q, have.get(p, 0)) for p, q in base.items()}
    while (lacking := target - sum(take.values())) > 0:
        spare = {p: have.get(p, 0) - take[p] for p in base}
        pool = min(spare, key=lambda p: (-spare[p], p))
        if spare[pool] <= 0:
            raise ValueError("the pools hold too few records")
        take[pool] += min(spare[pool], lacking)
    return take


def pool_sizes(rows: DataFrame, pool: str) -> dict[str, int]:
    return {r[0]: r[1] for r in rows.groupBy(pool).count().collect()}


#: Pools of difficult comparisons in the order in which they are drawn from; the last one holds all.
DIFFICULT = {"MISSING": "missing", "UNCERTAIN": "uncertain", "DISAGREE": "disagree", "DIFFICULT_FILL": "true"}


def difficult(rows: DataFrame, seed: str, key: str, target: int = 40) -> DataFrame:
    """(key, component): a sample of difficult comparisons.

    rows: key and booleans missing, uncertain, disagree. First up to a quarter of the target from those without
    abstract, the rest in halves from uncertain and disagreeing ones; what a pool lacks the other gives, and at last any.
    A record is drawn once. One pass ranks all pools; of each only the first 2 * target rows can matter, as
    at most target rows of it have been drawn for other pools.
    """
    of = F.array_compact(F.array(*(F.when(F.expr(f"coalesce({flag}, false)"), F.lit(pool)) for pool, flag in DIFFICULT.items())))
    entered = rows.filter("uncertain or disagree").select(key, F.explode(of).alias("component"))
    first = sample(entered, seed, "component", key, 2 * target)
    queues = {pool: [] for pool in DIFFICULT}
    for r in first.orderBy("component", "pool_rank").collect():
        queues[r["component"]].append(r[key])
    drawn = share_out(queues, target)
    return rows.sparkSession.createDataFrame([(k, p) for k, p in drawn.items()], first.select(key, "component").schema)


def share_out(queues: dict[str, list], target: int) -> dict:
    """Pool for which each key is drawn, from the pools' ranked keys (see difficult)."""
    drawn = dict.fromkeys(queues["MISSING"][: target // 4], "MISSING")
    lacking = target // 4 - len(drawn)
    uncertain, disagree = ([k for k in queues[p] if k not in drawn] for p in ("UNCERTAIN", "DISAGREE"))
    half = (target - target // 4) // 2 + -(-lacking // 2)
    other = target - len(drawn) - half
    # what is in both pools counts as uncertain as far as that half goes
    chosen = uncertain[:half]
    left = [k for k in disagree if k not in set(chosen)]
    more = left[: other + half - len(chosen)]
    spare = [k for k in uncertain[half:] if k not in set(more)][: max(0, other - len(more))]
    drawn |= dict.fromkeys(chosen, "UNCERTAIN") | dict.fromkeys(more, "DISAGREE") | dict.fromkeys(spare, "UNCERTAIN")
    filling = [k for k in queues["DIFFICULT_FILL"] if k not in drawn][: target - len(drawn)]
    return drawn | dict.fromkeys(filling, "DIFFICULT_FILL")


# What a confirmed error in a group of the audit sample leads to: pools to go on with, and up to how many records of each (None: all).
EXPANSIONS = {
    "A_DIFFICULT": (("DIFFICULT_ALL",), None),
    "B_AGREED_INCLUDE": (("AGREED_INCLUDE",), 100),
    "C_AGREED_EXCLUDE": (("MIXED_EXCLUDE", "SAME_EXCLUDE"), 50),
}
BOUNDARY_TARGET = 50


def expansion_triggers(audited: DataFrame) -> DataFrame:
    """(pool, target, errors): pools that the audit must go on with; target null: the whole pool.

    audited: sample_group, sample_component, confirmed_error, second_review, second_decision. A confirmed error of a group
    opens its pools; a boundary pool opens if a second reviewer keeps a record or can't decide.
    """
    rules = audited.sparkSession.createDataFrame([(g, pool, n) for g, (pools, n) in EXPANSIONS.items() for pool in pools], "sample_group string, pool string, target int")
    errors = audited.filter("confirmed_error").groupBy("sample_group").agg(F.count("*").alias("errors"))
    kept = audited.filter(F.col("sample_component").startswith("BOUNDARY_") & F.col("second_review") & F.col("second_decision").isin("INCLUDE", "UNCERTAIN"))
    boundary = kept.groupBy(F.col("sample_component").alias("pool")).agg(F.lit(BOUNDARY_TARGET).alias("target"), F.count("*").alias("errors"))
    return rules.join(errors, "sample_group").select("pool", "target", "errors").unionByName(boundary)


def audit_expansion(ranked: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """(pool, key, pool_rank, complete): records that the triggers add, by rank; complete tells whether the pool has as many as its target.

    ranked: pool, key, pool_rank (complete rankings).
    """
    opened = expansion_triggers(audited).withColumnRenamed("pool", "__pool")
    sizes = ranked.groupBy(F.col("pool").alias("__of")).agg(F.count("*").alias("__size"))
    reach = opened.join(sizes, opened["__pool"] == sizes["__of"]).select("__pool", "target", (F.col("target").isNull() | (F.col("__size") >= F.col("target"))).alias("complete"))
    got = ranked.join(F.broadcast(reach), F.col("pool") == F.col("__pool")).filter(F.col("target").isNull() | (F.col("pool_rank") <= F.col("target")))  # a row for each pool
    return got.join(audited.select(key), key, "left_anti").select("pool", key, "pool_rank", "complete")
