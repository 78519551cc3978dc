"""SimHash near-duplicates with a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint of its word shingles. Copies share one fingerprint, and only different
fingerprints are searched. In an index fingerprints are sorted by Gray rank, in which neighbours share most bits. Runs
of neighbours become nodes, runs of nodes upper nodes; a node keeps the bits that all below it share, and a lower
node only the shared bits that its parent doesn't have. A search adds up differing bits from the top and leaves a node,
with all below it, once they are over three, or once all below it are known to be linked with what is sought.

Fingerprints that differ in at most three bits agree in at least one of four 16-bit blocks. Each goes to four buckets by
the first bits of a block, of which only so many are used that a bucket holds some thousands, whose index does the rest.
A bucket with too many rows is dealt out again by the blocks of what is left of the fingerprint.

Texts of a given similarity of their shingles differ in more bits than blocks can find. For them fingerprints have 256 bits,
the share of differing bits tells the angle between two texts, and each fingerprint goes to buckets by samples of its bits, so many that
two texts of that similarity meet in one with a probability of 0.95. In a bucket they are sorted by Gray rank and compared in full.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .components import components
from .wordstore import blocks

BITS, DISTANCE = 64, 3
#: Leaf runs and runs of the level above.
FANOUT = 16
#: Buckets hold between a quarter and half as many rows in the mean; one over so many is dealt out again.
BUCKET_ROWS = 16384
#: Places of (query, node) pairs that are looked at together.
FRONTIER = 1 << 16


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, A-Z lower-cased; of the whole sequence if it is shorter."""
    import xxhash

    ws = text.encode("utf-8", "replace").lower().split()
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), 42)] if ws else [], np.uint64)
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h, view = xxhash.xxh64_intdigest, memoryview(line)
    return np.fromiter((h(view[a:b], 42) for a, b in zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1 :].tolist())), np.uint64, len(ws) - words + 1)


def fingerprint(text: str, words: int = 3) -> int:
    """Majority of the bits of the hashes of all word shingles; no words: zero."""
    return int(majority(shingle_hashes(text, words)))


def majority(hashes: np.ndarray) -> np.uint64:
    """Bits set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 << 8):
        part = hashes[at : at + (255 << 8)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # 255 rows at most add up in a byte
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(documents: DataFrame, text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """documents without the text, with its fingerprint in ``out`` (long: the bits of the unsigned number)."""
    rest = dropped(documents, out, text)
    names = rest.columns
    df = documents.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, whole.num_columns - 1):
                fps = np.fromiter((fingerprint(t, words) for t in b.column(b.num_columns - 1).to_pylist()), np.uint64, b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*names, out])

    return df.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in Gray-code order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each place is linked with, after links (i, j) came to those that ``root`` has."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


class GrayIndex:
    """Index of fingerprints given bucket by bucket (``bucket`` ascending, Gray rank ascending in each).

    ``told`` counts by level, the rows being level -1: (query, node) pairs looked at, left for their differing bits, and
    left because they are linked.
    """

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        self.fps, self.told = fps, Counter()
        n = len(fps)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
        self.bucket_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        # levels from the rows up: (first place below, patterns of shared bits, masks of shared bits)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts, low, high, owner = np.arange(n), fps, fps, self.bucket_of
        while True:
            head = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            at = np.arange(len(owner)) - np.maximum.accumulate(np.where(head, np.arange(len(owner)), 0)) if len(owner) else np.zeros(0, np.int64)
            cut = np.flatnonzero(head | (at % FANOUT == 0))
            low = np.bitwise_and.reduceat(low, cut) if len(cut) else low
            high = np.bitwise_or.reduceat(high, cut) if len(cut) else high
            owner = owner[cut]
            self.levels.append((np.append(cut, len(starts)), low, ~(low ^ high)))
            starts = cut
            if len(cut) == len(np.unique(owner)):
                break

    def pairs(self, most: int = DISTANCE, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of fingerprints of one bucket that differ in at most ``most`` bits."""
        for q in self._queries(frontier):
            yield from self._search(q, most, frontier, None)

    def linked(self, most: int = DISTANCE, frontier: int = FRONTIER) -> np.ndarray:
        """Smallest place that each place is linked with over such pairs, directly or over others."""
        n = len(self.fps)
        root = np.arange(n)
        for step in range(1, min(n, 4)):  # neighbours first: what they link needn't be compared again
            i = np.flatnonzero((self.bucket_of[step:] == self.bucket_of[:-step]) & (np.bitwise_count(self.fps[step:] ^ self.fps[:-step]) <= most))
            root = join_roots(root, i, i + step)
        for q in self._queries(frontier):
            of, roots = [], (root, root)
            for below, _, _ in self.levels:
                roots = tuple(f.reduceat(x, below[:-1]) for f, x in zip((np.minimum, np.maximum), roots))
                of.append(np.where(roots[0] == roots[1], roots[0], -1))
            found = list(self._search(q, most, frontier, (root, of)))
            for i, j in found:
                root = join_roots(root, i, j)
        return root

    def _queries(self, frontier: int) -> Iterator[np.ndarray]:
        for at in range(0, len(self.fps), frontier):
            yield np.arange(at, min(len(self.fps), at + frontier))

    def _search(self, q: np.ndarray, most: int, frontier: int, known: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # the top has one node for each bucket, so that a row starts at its bucket's node
        yield from self._descend(len(self.levels) - 1, q, self.bucket_of[q], np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64), most, frontier, known)

    def _descend(self, level: int, q: np.ndarray, node: np.ndarray, lost: np.ndarray, seen: np.ndarray, most: int, frontier: int, known: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """seen: bits already compared above, for each (query, node); known: roots of rows, and of nodes below which all have one."""
        below, pattern, mask = self.levels[level]
        lost = lost + np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node] & ~seen).astype(np.uint8)
        ok = lost <= most
        self.told["looked", level] += len(q)
        self.told["cut", level] += len(q) - int(ok.sum())
        if known is not None:
            apart = known[1][level][node] != known[0][q]
            self.told["linked", level] += int((ok & ~apart).sum())
            ok &= apart
        q, node, lost = q[ok], node[ok], lost[ok]
        seen = seen[ok] | mask[node]
        counts = below[node + 1] - below[node]
        ends = np.cumsum(counts)
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + frontier, "right")))
            c = counts[at:to]
            rep = np.repeat(np.arange(at, to), c)
            child = below[node[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c)
            if level == 0:
                more = lost[rep] + np.bitwise_count((self.fps[q[rep]] ^ self.fps[child]) & ~seen[rep])
                hit = (more <= most) & (q[rep] < child)
                self.told["looked", -1] += len(rep)
                if hit.any():
                    yield q[rep][hit], child[hit]
            else:
                yield from self._descend(level - 1, q[rep], child, lost[rep], seen[rep], most, frontier, known)
            at = to


def routes(distinct: DataFrame) -> DataFrame:
    """Rows (bucket, fp): every fingerprint once for each of its four blocks, or all in one bucket if they are few.

    A bucket is told by the first bits of a block, of which there are more for more fingerprints. Buckets over
    BUCKET_ROWS rows are dealt out again, up to three times: four rows each, by the value of a quarter of
    the bits that the bucket's rows don't share yet. As at most three bits differ in those too, no link is lost. After the last
    round a bucket's rows agree in over 30 bits, which bounds them by the number of patterns of the others.
    """
    n = distinct.count()
    used = min(16, max(0, math.ceil(math.log2(max(1, n) / BUCKET_ROWS)) + 1)) if n > BUCKET_ROWS else 0
    if not used:
        return distinct.select(F.lit("").alias("bucket"), "fp")
    cur, total = distinct.select("fp", F.lit("").alias("bucket"), F.col("fp").alias("left")), BITS
    out = None
    for round_ in range(4):
        parts, low = [], 0
        quarter = [total // 4 + (j < total % 4) for j in range(4)]
        for j, width in enumerate(quarter):
            w = min(width, used) if round_ == 0 else width
            bits = lambda c, a, k: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << k) - 1)) if a else c.bitwiseAND(F.lit((1 << k) - 1))
            value = bits(F.col("left"), low, w)
            above = bits(F.col("left"), low + w, total - low - w) if low + w < total else F.lit(0).cast("long")
            under = bits(F.col("left"), 0, low) if low else F.lit(0).cast("long")
            rest = F.shiftleft(above, low).bitwiseOR(under)
            parts.append(F.struct(F.concat(F.col("bucket"), F.lit(f"{'abcd'[j]}"), F.hex(value)).alias("bucket"), rest.alias("left")))
            low += width
        # the number of bits left is that of the smallest part taken; a larger part's bits are all there still
        dealt = cur.select("fp", F.explode(F.array(*parts)).alias("x")).select("fp", "x.bucket", "x.left")
        total -= min(min(quarter), used) if round_ == 0 else min(quarter)
        if round_ == 3:
            return out.unionByName(dealt.select("bucket", "fp"))
        hot = stored(dealt.groupBy("bucket").count().filter(F.col("count") > BUCKET_ROWS).select(F.col("bucket").alias("hot")), "hot")
        if hot.isEmpty():
            plain = dealt.select("bucket", "fp")
            return plain if out is None else out.unionByName(plain)
        marked = stored(dealt.join(hot, dealt["bucket"] == hot["hot"], "left"), "dealt")
        plain = marked.filter("hot is null").select("bucket", "fp")
        out = plain if out is None else out.unionByName(plain)
        cur = marked.filter("hot is not null").select("fp", "bucket", "left")
    return out


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows (a, b): for each bucket, links that join its fingerprints as all pairs within the distance do."""
    if distance > 3:
        raise ValueError("four blocks find differences of three bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search(t: pa.Table) -> pa.RecordBatch:
            fps = t["fp"].combine_chunks().to_numpy().view(np.uint64)
            bucket = t["bucket"].combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((gray_rank(fps), bucket))
            fps, bucket = fps[order], bucket[order]
            root = GrayIndex(bucket, fps).linked(distance)
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fps[far].view(np.int64)), pa.array(fps[root[far]].view(np.int64))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            # whole buckets are searched; the last one may go on in the next batch
            names = b.column(0)
            begin = pc.index(names, names[-1]).as_py()
            if begin == 0 and held and held[-1].column(0)[-1] == names[0]:
                held.append(b)
                continue
            if held or begin:
                parts = [*held, b.slice(0, begin)]
                yield search(pa.Table.from_batches(parts))
            held = [b.slice(begin)]
        if held:
            yield search(pa.Table.from_batches(held))

    sorted_rows = routes(distinct).repartition("bucket").sortWithinPartitions("bucket")
    return sorted_rows.select("bucket", "fp").mapInArrow(run, "a long, b long")


# -- by similarity -------------------------------------------------------------------------------------------------

#: Words of 64 bits of a wide fingerprint, and the chance that two texts of the asked similarity meet in no bucket.
WIDE, MISSED = 4, 0.05


def wide_fingerprint(text: str, words: int = 5) -> list[int]:
    """Majorities of WIDE hashes of every word shingle, the others made from the first by mixing; no words: zeros."""
    h, out = shingle_hashes(text, words), []
    for k in range(WIDE):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if k:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out.append(int(majority(x)))
    return out


def differing(similarity: float) -> tuple[float, int]:
    """Expected share of bits in which texts of that Jaccard similarity differ, and how many bits may differ: one deviation more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = BITS * WIDE
    return share, int(n * share + math.sqrt(n * share * (1 - share)))


def _similar_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b) of ids of wide fingerprints (id, f0, f1, ...): links that join what is similar in each bucket."""
    n = max(2, distinct.count())
    share, most = differing(similarity)
    width = min(30, max(8, math.ceil(math.log2(n))))
    bands = math.ceil(math.log(MISSED) / math.log1p(-((1 - share) ** width)))
    rng = np.random.default_rng(42)
    samples = np.stack([rng.choice(BITS * WIDE, width, replace=False) for _ in range(bands)])
    names = [f"f{k}" for k in range(WIDE)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows = np.stack([b.column(k + 1).to_numpy() for k in range(WIDE)], 1).astype("<i8")
                bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
                value = (bits[:, samples].astype(np.int64) @ power) + (np.arange(bands) << 32)
                rep = np.repeat(np.arange(len(rows)), bands)
                yield pa.RecordBatch.from_arrays([pa.array(value.reshape(-1)), b.column(0).take(pa.array(rep)), *(pa.array(rows[rep, k]) for k in range(WIDE))], names=["bucket", "id", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(t: pa.Table) -> pa.RecordBatch:
            col = lambda c: t[c].combine_chunks().to_numpy()
            bucket, ids = col("bucket"), col("id")
            fps = np.stack([col(c).view(np.uint64) for c in names])
            order = np.lexsort((gray_rank(fps[0]), bucket))
            bucket, ids, fps = bucket[order], ids[order], np.ascontiguousarray(fps[:, order])
            root, i = np.arange(len(ids)), np.arange(len(ids))
            for step in range(1, len(ids)):
                # rows whose bucket reaches so far; what is linked already isn't compared
                i = i[i + step < len(ids)]
                i = i[bucket[i] == bucket[i + step]]
                if not len(i):
                    break
                open_ = i[root[i] != root[i + step]]
                near = sum(np.bitwise_count(fps[k, open_] ^ fps[k, open_ + step]).astype(np.int64) for k in range(WIDE)) <= most
                root = join_roots(root, open_[near], open_[near] + step)
                if step & (step - 1) == 0:  # buckets of which all is linked are through
                    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    whole = np.repeat(np.maximum.reduceat(root, first) == np.minimum.reduceat(root, first), np.diff(np.append(first, len(ids))))
                    i = i[~whole[i]]
            far = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            # whole buckets are searched; the last one may go on in the next batch
            keys = b.column(0)
            begin = pc.index(keys, keys[-1]).as_py()
            if begin == 0 and held and held[-1].column(0)[-1] == keys[0]:
                held.append(b)
                continue
            if held or begin:
                yield linked(pa.Table.from_batches([*held, b.slice(0, begin)]))
            held = [b.slice(begin)]
        if held:
            yield linked(pa.Table.from_batches(held))

    schema = "bucket long, id long, " + ", ".join(f"{c} long" for c in names)
    dealt = distinct.select("id", *names).mapInArrow(deal, schema).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def similar_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents without the text, with component_id: the smallest doc_id that a document reaches over links.

    Two texts are linked if their wide fingerprints differ in so few bits as texts whose shingles have that Jaccard
    similarity do (one deviation more), and meet in a bucket, which at that similarity they do with a probability of 0.95 and the more often the
    more alike they are; equal texts always are. A null or empty text, or one of white space, is linked with its likes.
    component_id is null if none of a component has an id. Repeated rows stay; a column component_id is replaced;
    an empty table gives an empty table.
    """
    names = [f"f{k}" for k in range(WIDE)]
    rest = dropped(documents, "component_id", "__wide", "__wid", "__head", text)
    src = rest.columns
    df = documents.select(*(F.col(f"`{c}`") for c in src), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "__wide binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, whole.num_columns - 1):
                made = [np.array(wide_fingerprint(t, words), "<u8").tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=[*src, "__wide"])

    fps = stored(df.mapInArrow(run, schema), "wide")
    distinct = fps.groupBy(F.col("__wide").alias("w")).agg(F.min(F.col(f"`{doc_id}`")).alias("least"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(WIDE))], names=["id", *names])

    wide = distinct.select("id", "w").mapInArrow(split, "id long, " + ", ".join(f"{c} long" for c in names))
    joined = components(_similar_links(wide, similarity))
    classes = distinct.join(joined, distinct["id"] == joined["node"], "left").select("w", F.coalesce("root", "id").alias("root"), "least")
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(classes.select(F.col("w").alias("__wid"), F.col("root").alias("r")).join(heads, F.col("r") == F.col("root")).select("__wid", F.col("component_id").alias("__head")), "classes")
    out = fps.join(named, F.col("__wide") == F.col("__wid"))
    return out.select(*(F.col(f"`{c}`") for c in src), F.col("__head").alias("component_id"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """documents without the text, with fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that a document reaches over links of fingerprints that differ in at most
    ``distance`` (three at most) bits, its own included; null if none of them has an id. A null or empty text, or one of white space, has the
    fingerprint zero, which is linked like any other. Repeated rows stay and share a component; columns of these names
    are replaced; an empty table gives an empty table.
    """
    fps = stored(fingerprints(dropped(documents, "fingerprint", "component_id", "__fp"), text, words, "__fp"), "fingerprints")
    smallest = stored(fps.groupBy(F.col("__fp").alias("fp")).agg(F.min(doc_id).alias("least")), "distinct")
    joined = components(links(smallest.select("fp"), distance))
    classes = smallest.join(joined, smallest["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(classes.select("fp", "root").join(heads, "root").select(F.col("fp").alias("__of"), "component_id"), "classes")
    # unsigned 64 bits as hex: hex() of a negative long is its two's complement
    out = fps.join(named, F.col("__fp") == F.col("__of")).withColumn("fingerprint", F.lower(F.lpad(F.hex("__fp"), 16, "0")))
    return out.drop("__fp", "__of")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


ORACLE: dict[str, str] = {}
