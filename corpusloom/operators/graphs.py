"""Graphs: connected components on tables, and layouts of the small networks that figures show."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def connected(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, component): smallest node that a node reaches.

    Labels jump: every round a node takes the smallest label around it, and then that label's own label, so that rounds
    grow with the logarithm of a component's width. Aggregates are partial, and joins may split frequent nodes.
    """
    e = cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).union(edges.select(right, left)).filter("a is not null and b is not null").distinct())
    labels = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        around = e.join(labels, e["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "n")
        near = labels.join(around, labels["node"] == around["n"]).select("node", "component", F.least("component", "m").alias("now"))
        up = labels.select(F.col("node").alias("n2"), F.col("component").alias("jump"))
        step = near.join(up, near["now"] == up["n2"], "left").select("node", "component", F.least("now", "jump").alias("now"))
        step = cut(step)
        if step.filter("now <> component").isEmpty():
            return labels
        labels = step.select("node", F.col("now").alias("component"))


def largest_component(components: DataFrame, head: int) -> DataFrame:
    """The first nodes of the component with most nodes (ties: smaller name)."""
    size = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(size), "component").orderBy("node").limit(head).select("node", "component")  # one row


def spring_layout(nodes: Sequence[str], edges: Sequence[tuple[str, str, float]], seed: int, rounds: int = 200) -> dict[str, tuple[float, float]]:
    """Force-directed places of a small network, for figures."""
    n = len(nodes)
    at = {x: i for i, x in enumerate(nodes)}
    pos = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    k, heat = 1 / math.sqrt(max(n, 1)), 0.1
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[at[a], at[b]] = w[at[b], at[a]] = x
    top = w.max() or 1.0
    for _ in range(rounds):
        d = pos[:, None] - pos[None]
        r = np.maximum(np.linalg.norm(d, axis=2), 1e-3)
        push = (d / r[..., None] * (k * k / r)[..., None]).sum(1)
        pull = (d / r[..., None] * (r * r / k * w / top)[..., None]).sum(1)
        move = push - pull
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        pos += move / size * np.minimum(size, heat)
        heat *= 0.98
    return {x: (float(pos[i, 0]), float(pos[i, 1])) for x, i in at.items()}


def _crossed(orders: np.ndarray, chords: np.ndarray) -> np.ndarray:
    """Crossings of straight chords for each order. orders: (orders, places) of node numbers; chords: (edges, 2) of node numbers."""
    place = np.argsort(orders, axis=1)
    out = np.empty(len(orders), np.int64)
    most = max(1, (1 << 24) // max(1, len(chords)) ** 2)
    for at in range(0, len(orders), most):
        ends = np.sort(place[at : at + most][:, chords], axis=2)
        lo, hi = ends[..., 0], ends[..., 1]
        # chords cross if exactly one of them starts inside the other and ends outside
        starts_inside = (lo[:, :, None] < lo[:, None, :]) & (lo[:, None, :] < hi[:, :, None])
        out[at : at + most] = (starts_inside & (hi[:, :, None] < hi[:, None, :])).sum((1, 2))
    return out


def crossings(order: Sequence[str], edges: Sequence[tuple[str, str]]) -> int:
    """Crossings of straight chords between places on a circle."""
    at = {x: i for i, x in enumerate(order)}
    return int(_crossed(np.arange(len(at))[None], np.array([(at[a], at[b]) for a, b in edges], int).reshape(-1, 2))[0])


#: Fixed value: seed of the shuffled starts.
CIRCLE_SEED = 2026081702


def circular_order(edges: Sequence[tuple[str, str, int]], starts: int = 64, seed: int = CIRCLE_SEED) -> tuple[list[str], int]:
    """Order of a small network's nodes on a circle with few crossings, and their number.

    From the alphabetical order, the order by weighted degree and shuffled ones, the best of all swaps of two nodes is
    made as long as it helps. Nodes are numbered by the alphabet, so that an order is a row of numbers; all swaps of an
    order are rows of one matrix, whose crossings are counted together, and ties go to the smallest row.
    """
    names = sorted({x for a, b, _ in edges for x in (a, b)}, key=str.casefold)
    number = {x: i for i, x in enumerate(names)}
    chords = np.array([(number[a], number[b]) for a, b, _ in edges], int).reshape(-1, 2)
    degree = np.bincount(chords.ravel(), np.repeat([c for _, _, c in edges], 2), len(names))
    rng = random.Random(seed)
    rows = [np.arange(len(names)), np.argsort(-degree, kind="stable")]
    for _ in range(starts):
        rng.shuffle(mixed := list(range(len(names))))
        rows.append(np.array(mixed, int))
    i, j = np.triu_indices(len(names), 1)
    smallest = lambda costs, orders: int(np.lexsort((*orders.T[::-1], costs))[0])
    ends = []
    for row in rows:
        cost, better = int(_crossed(row[None], chords)[0]), len(i) > 0
        while better:
            swapped = np.repeat(row[None], len(i), axis=0)
            each = np.arange(len(i))
            swapped[each, i], swapped[each, j] = row[j], row[i]
            costs = _crossed(swapped, chords)
            k = smallest(costs, swapped)
            if better := costs[k] < cost:
                cost, row = int(costs[k]), swapped[k]
        ends.append((cost, row))
    best = smallest(np.array([c for c, _ in ends]), np.array([r for _, r in ends]))
    return [names[x] for x in ends[best][1]], ends[best][0]


def triangle(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Lower triangle with its diagonal of a complete pair table (see pair_table), rows and columns in a given order."""
    place = F.create_map(*(F.lit(x) for i, o in enumerate(order) for x in (o, i)))
    got = table.withColumns({"i": F.try_element_at(place, F.col("left")), "j": F.try_element_at(place, F.col("right"))}).filter("i is not null and j is not null")
    swap = F.col("i") < F.col("j")
    return got.select(F.when(swap, F.col("right")).otherwise(F.col("left")).alias("row"), F.when(swap, F.col("left")).otherwise(F.col("right")).alias("column"), "count", F.round("cosine", 8).alias("cosine"), F.greatest("i", "j").alias("row_place"), F.least("i", "j").alias("column_place"))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
