"""Packing into length buckets that waste as little padding as possible.

Lengths are counted over all documents into one histogram with an entry for each length up to the longest sequence.
Dynamic programming over it finds the bucket boundaries with the least padding. In each bucket sequences are numbered
and put into batches of as many as its padded length allows within the token budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .pieces import model
from .wordstore import blocks

#: Rows that are numbered together by one task.
GROUP_ROWS = 4096


def token_lengths(documents: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """documents without the text, with ``n_tokens``: its pieces, and begin and end (a null text is empty)."""
    rest = dropped(documents, "n_tokens", text)
    names = rest.columns
    df = documents.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for whole in batches:
            for b in blocks(whole, whole.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.counts(b.column(b.num_columns - 1)) + 2)], names=[*names, "n_tokens"])

    return df.mapInArrow(run, schema)


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding (of equal ones those found first from below).

    best[j] after k rounds: least padding of the first j lengths in k buckets. Closing a bucket at length j that opens
    after i pads its count times length j, less its tokens, both from running sums.
    """
    order = np.argsort(lengths)
    size, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return []
    many, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * size))
    never = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, never)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, never), np.zeros(n + 1, np.int64)
        new[0] = 0
        for lo in range(1, n + 1, 128):
            j = np.arange(lo, min(n + 1, lo + 128))
            i = np.arange(j[-1])
            cost = best[None, i] + size[j - 1, None] * (many[j, None] - many[None, i]) - (tokens[j, None] - tokens[None, i])
            cost[i[None, :] >= j[:, None]] = never
            choice[j] = cost.argmin(1)
            new[j] = cost[np.arange(len(j)), choice[j]]
        back.append(choice)
        best = new
    ends, j = [], n
    for choice in reversed(back):
        if not j:
            break
        ends.append(int(size[j - 1]))
        j = int(choice[j])
    return sorted(ends)


def pack(sequences: DataFrame, buckets: int = 16, budget: int = 32768, longest: int = 4096, length: str = "n_tokens", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """sequences with chunk, start, n_tokens, bucket, padded, batch and slot.

    A sequence longer than ``longest`` is cut into chunks of that length and a rest, each a row with its place
    ``start``; lengths that are null or under 1 count as 1. bucket: from 0; padded: the bucket's boundary; batch: number
    in the bucket, of budget // padded rows each but the last; slot: place in the batch. Rows are numbered by a hash of ``order``, then ``order``
    itself; nulls and repeated rows are rows like others, and where very many share one ``order`` they are numbered in parts. Columns of these names are replaced; an empty table gives
    an empty table. Only the histogram, of at most ``longest`` rows, comes to the driver.
    """
    if budget < longest:
        raise ValueError("a batch must hold the longest sequence")
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1))
    rest = dropped(sequences.withColumn("__n", n), "chunk", "start", "bucket", "padded", "batch", "slot", length)
    cut = rest.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / longest).cast("long"))))
    cut = cut.withColumns({"start": F.col("chunk") * longest, length: F.least(F.lit(longest).cast("long"), F.col("__n") - F.col("chunk") * longest)}).drop("__n")
    names = cut.columns
    rows = stored(cut.withColumn("__mix", F.monotonically_increasing_id()), "lengths")
    histogram = rows.groupBy(length).count().collect()
    ends = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    total = sum(r[1] for r in histogram)
    bound = F.array(*(F.lit(e).cast("long") for e in ends)) if ends else F.array().cast("array<long>")
    salts = max(64, -(-total // GROUP_ROWS))
    rows = rows.withColumn("bucket", F.size(F.filter(bound, lambda b: b < F.col(length)))).withColumn("padded", F.get(bound, F.col("bucket")))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*order, "chunk"), F.lit(salts)))
    # rows that share what they are ordered by share a group; one that is too large is dealt out by the rows' places
    hot = rows.groupBy("bucket", "__salt").count().filter(F.col("count") > 4 * GROUP_ROWS)
    hot = hot.select(F.col("bucket").alias("__hb"), F.col("__salt").alias("__hs"), F.ceil(F.col("count") / GROUP_ROWS).alias("__parts"))
    if hot.isEmpty():
        rows = rows.withColumn("__sub", F.lit(0).cast("long"))
    else:
        joined = rows.join(hot, (F.col("bucket") == F.col("__hb")) & (F.col("__salt") == F.col("__hs")), "left")
        rows = joined.withColumn("__sub", F.coalesce(F.pmod(F.xxhash64("__mix"), F.col("__parts")), F.lit(0).cast("long"))).drop("__hb", "__hs", "__parts")
    sizes = rows.groupBy("bucket", "__salt", "__sub").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("__salt", "__sub")) - F.col("count")
    offsets = sizes.select("bucket", "__salt", "__sub", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("bucket", "__salt", "__sub").orderBy(*order, "chunk", length)) - 1
    numbered = rows.withColumn("__own", own).join(offsets, ["bucket", "__salt", "__sub"])
    place, capacity = F.col("__before") + F.col("__own"), F.floor(F.lit(budget) / F.col("padded")).cast("long")
    out = numbered.withColumn("__at", place).withColumns({"batch": F.floor(F.col("__at") / capacity).cast("long"), "slot": F.pmod("__at", capacity).cast("long")})
    return out.select(*(f"`{c}`" for c in names), "bucket", "padded", "batch", "slot")


def op1_packing(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_lengths(docs, model_path or public_tokenizers.path("piece_bpe_32k.model")))


ORACLE: dict[str, str] = {}
