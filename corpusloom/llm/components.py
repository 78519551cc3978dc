"""Connected components of a distributed graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: So many edges are contracted by one task; more take distributed steps.
TASK_EDGES = 1 << 18


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (a, b), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours. edges: (u, v), u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "least")
    return both.join(least, both["u"] == least["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "least")
    moved = edges.join(least, edges["u"] == least["n"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u > v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of some edge reaches. edges: two columns of numbers, any order.

    At most TASK_EDGES different edges are contracted by one task, whose memory that bounds. More take steps on tables: they go on until an edge set repeats, which the sum of hashes of its distinct edges tells; each is written to
    shared storage. Loops and repeated edges do no harm. Nulls aren't linked. The number of steps grows with the
    logarithm of a component's diameter.
    """
    a, b = edges.columns
    cur = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(cur)
    if seen[0] <= TASK_EDGES:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(frames)
            if parts:
                whole = pd.concat(parts)
                yield pd.DataFrame(dict(zip(("node", "root"), contract(whole["u"].to_numpy(), whole["v"].to_numpy()))))

        return cur.coalesce(1).mapInPandas(run, "node long, root long")
    while seen[0]:
        cur = stored(_small_star(stored(_large_star(cur).distinct(), "large")).distinct(), "small")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
