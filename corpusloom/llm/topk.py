"""Exact top-k by inner product: columnar branch-and-bound over integer vectors.

Candidates lie in vertical layout, one row for each dimension, those dimensions first that hold most of their mass. Scores grow
block of dimensions by block of dimensions; what is left of a score is at most the product of the remaining lengths of
both vectors. A candidate whose partial score plus that bound stays under the k-th best score that a query has so far is
dropped for that query. While most pairs live, a block is one matrix product; once fewer do, the survivors of each query
are moved together and only they go on. Candidates come longest first in slices, so that the first ones give
high thresholds, and a query is through with a block of candidates when the longest that are left can't reach its threshold.

Work is a grid: blocks of queries by blocks of candidates, each of bounded size, dealt out by their pair of numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import executor_cores, stored, table

#: Rows of a block of queries or candidates. A row is sent once for each block of the other side.
QUERY_ROWS = 4096
CANDIDATE_ROWS = 32768
#: Dimensions added at once, queries and candidates whose partial scores are held at once, and candidates of the first slice.
STEP = 8
BATCH, SLICE, FIRST = 64, 4096, 512
#: Survivors of a query are moved together once they are fewer than this share.
COMPACT = 0.4


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Kind in which all inner products are exact: float32 below 2**24, float64 below 2**52, else Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**52 else object


def _lengths(rows: np.ndarray, cuts: list[int]) -> np.ndarray:
    """(rows, cuts): length of what each row has from each cut on."""
    squares = rows.astype(np.float64) ** 2
    return np.sqrt(np.stack([squares[:, c:].sum(1) for c in cuts], 1))


def block_top(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, told: Counter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates of one block: (place of the query, ids, scores).

    Order: higher score, then smaller id; a query's own id takes no part. Bounds are kept loose by more than the
    rounding of square roots. told: gets numbers of pairs, of those that went on after each block of dimensions, and of those that a
    length alone ruled out.
    """
    kind, told = _exact(q, x), Counter() if told is None else told
    near = np.float32 if kind is np.float32 else np.float64
    dims = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
    cuts = [*range(0, len(dims), STEP), len(dims)]
    x, q = x[:, dims], q[:, dims]
    rest_x, rest_q = _lengths(x, cuts), _lengths(q, cuts).astype(near)
    longest = np.argsort(-rest_x[:, 0], kind="stable")
    x_ids, rest_x, q = x_ids[longest], np.ascontiguousarray(rest_x[longest].T.astype(near)), q.astype(kind)
    columns = np.ascontiguousarray(x[longest].T.astype(kind))
    starts = [*range(0, min(FIRST, len(x)), FIRST), *range(FIRST, len(x), SLICE)]
    for at in range(0, len(q), BATCH):
        qs, own, rq = q[at : at + BATCH], q_ids[at : at + BATCH], rest_q[at : at + BATCH]
        floor = np.full(len(qs), -np.inf, near)
        ids, scores = [np.zeros(0, np.int64)] * len(qs), [np.zeros(0, kind)] * len(qs)
        for begin, end in zip(starts, [*starts[1:], len(x)]):
            rx, held, names = rest_x[:, begin:end], columns[:, begin:end], x_ids[begin:end]
            low = floor - 1 - near(1e-6) * rq[:, 0] * rx[0].max()
            open_ = np.flatnonzero(rq[:, 0] * rx[0, 0] >= low)
            told["pairs"] += len(qs) * len(names)
            told["by length"] += (len(qs) - len(open_)) * len(names)
            if not len(open_):
                continue
            # while most pairs live, all scores of the open queries; then each query's survivors
            part, live, done = np.zeros((len(open_), len(names)), kind), None, 0
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
                part += qs[open_, a:b] @ held[a:b]
                done = i
                if i > 1 and np.isfinite(low[open_]).all():
                    live = part.astype(near, copy=False) + rq[open_, i, None] * rx[i] >= low[open_, None]
                    told[f"after {b}"] += (alive := int(np.count_nonzero(live)))
                    if alive < COMPACT * live.size:
                        told["compacted"] += len(open_)
                        break
            for j, r in enumerate(open_.tolist()):
                at_, p = (np.arange(len(names)), part[j]) if live is None else ((c := np.flatnonzero(live[j])), part[j, c])
                for i in range(done + 1, len(cuts)):
                    if not len(at_):
                        break
                    a, b = cuts[i - 1], cuts[i]
                    p = p + qs[r, a:b] @ held[a:b].take(at_, axis=1)
                    keep = p.astype(near, copy=False) + rq[r, i] * rx[i].take(at_) >= low[r]
                    told[f"after {b}"] += (alive := int(np.count_nonzero(keep)))
                    if alive < len(at_):
                        at_, p = at_[keep], p[keep]
                found = names[at_]
                other = found != own[r]
                found, p = np.concatenate([ids[r], found[other]]), np.concatenate([scores[r], p[other]])
                if kind is not object and len(p) > 4 * k:
                    best = p >= np.partition(p, -k)[-k]
                    found, p = found[best], p[best]
                order = np.lexsort((found, [-x for x in p] if kind is object else -p))[:k]
                ids[r], scores[r] = found[order], p[order]
                if len(order) == k:
                    floor[r] = scores[r][-1]
        for i in range(len(qs)):
            yield at + i, ids[i], scores[i]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "vector", query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products among vectors, its own id apart.

    vectors and queries have a long id and an array of longs; scores must lie within 63 bits. Ties go to the smaller id.
    Rows whose id or vector is null or whose vector holds a null take no part; a query meets the vectors of its own
    length only, and has no rows if there are none. An id that occurs twice is two candidates (or queries) with that id.
    Other columns are passed over; empty tables give an empty table.
    """
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v")).filter("id is not null and v is not null and not exists(v, x -> x is null)")
    x, q = pick(vectors), pick(queries)
    sizes = x.agg(F.count("*")).crossJoin(q.agg(F.count("*"))).first()
    nx, nq = (max(1, -(-n // m)) for n, m in zip(sizes, (candidate_rows, query_rows)))
    # few blocks are made smaller, so that every core has one
    nq = max(nq, min(-(-executor_cores(vectors.sparkSession) // nx), -(-sizes[1] // BATCH)))
    grid = lambda n: F.explode(F.array(*(F.lit(i) for i in range(n)))) if n <= 64 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    # copies of a row go to different blocks by their place; blocks are only a way to deal work out
    xs = x.withColumn("bx", spread(nx)).withColumn("bq", grid(nq)).select("bq", "bx", F.lit(False).alias("is_q"), "id", "v")
    qs = q.withColumn("bq", spread(nq)).withColumn("bx", grid(nx)).select("bq", "bx", F.lit(True).alias("is_q"), "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for _, same in pdf.groupby(pdf["v"].map(len)):
            query, cand = same[same["is_q"]], same[~same["is_q"]]
            if query.empty or cand.empty:
                continue
            stack = lambda d: np.array(d["v"].tolist(), np.int64).reshape(len(d), -1)
            ids = query["id"].to_numpy()
            for place, who, score in block_top(ids, stack(query), cand["id"].to_numpy(), stack(cand), k):
                out.append(pd.DataFrame({"query_id": ids[place], "vec_id": who, "score": score.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    found = xs.unionByName(qs).groupBy("bq", "bx").applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = stored(e.filter(whole).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64)).alias("vector")), "vectors")
    return top_k(ints, ints.filter("vec_id % 20 = 0"), 20)


ORACLE = {
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
