"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

The model gives each id a probability in three factors that each sum to one. Frequent ids are classes of their own, the
others share classes, in which an id's share is fixed by its count. Classes lie in groups that are likely after the same
classes. Attention over the ids before gives the probability of the group; the class before, as counted over the
corpus, gives that of the class in its group, and is where the groups' scores start from. A text's probability is the
product over all its ids, the end id included, so that texts of ids sum to one.

Texts are encoded once and stored as ids. Ids and pairs of classes are counted over all training texts, and then every
id of every training text is trained on once: each partition trains a copy of the model on all its windows, and
the changes are averaged by the ids that each copy has seen. This is done twice, first on an eighth of the texts, from
whose average the rest goes on. A small corpus is gone over several times.

Texts are covered by overlapping windows of 2 * STRIDE ids; each window trains or scores its last STRIDE ids with the
ids before them as context, so that every id counts once. Windows run through masked attention in batches.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hand_back, keep_small, stored, table
from .pieces import model
from .wordstore import blocks, gathered

STRIDE = 8
WIDTH = 2 * STRIDE
DIMS = 12
#: Classes of ids, those of them that hold one id, and their groups (a power of two).
CLASSES, SINGLE, GROUPS = 1024, 960, 64
#: Classes that an id counts as when it stands before another, and those of them that hold one id; a text's begin is one more.
BEFORE, BEFORE_SINGLE = 256, 200
#: The most frequent words, so many at most, go to every task. Words of more than LONG bytes are counted by their digest.
SHIPPED, LONG = 1 << 18, 64
#: Rounds of training and the share of texts of the first, in eighths; steps' rates at their begin.
FIRST_EIGHTHS, RATES = 1, (0.02, 0.01)
#: Ids that are mixed and trained on at once, and ids after which a copy's rate has fallen to a quarter.
MIXED_IDS, SLOWER_IDS = 1 << 20, 1 << 22
#: A corpus of fewer ids is gone over several times, so many at most.
LEAST_IDS, PASSES = 1 << 24, 8
#: Windows in a step of training and of scoring, and windows that stay in a row when training mixes them.
STEP, SCORED, ROW = 512, 256, 16
#: Text that a worker encodes at once, and ids that it counts or scores at once, which bound its memory.
ENCODED_BYTES, AT_ONCE = 6 << 20, 1 << 20
#: Scores over this count as this, which keeps exp in its range.
HIGHEST = np.float32(60)


# -- classes -------------------------------------------------------------------------------------------------------


class Classes(NamedTuple):
    of_id: np.ndarray  # class of each id
    share: np.ndarray  # log probability of each id in its class
    before: np.ndarray  # class that each id, and the begin of a text after them, has before another one


class Priors(NamedTuple):
    group: np.ndarray  # of each class
    groups: np.ndarray  # [class before, group]: log probability
    inner: np.ndarray  # [class before, class]: log probability in its group


def buckets(counts: np.ndarray, single: int, most: int) -> np.ndarray:
    """Class of each id: the most frequent stand alone, the others share what is left of ``most`` classes in parts of about equal mass."""
    order = np.argsort(-counts, kind="stable")
    out = np.empty(len(counts), np.int32)
    out[order[:single]] = np.arange(min(single, len(order)))
    rest = order[single:]
    if len(rest):
        n, mass = most - single, np.cumsum(counts[rest] + 0.1)
        out[rest] = single + np.minimum(n - 1, (mass - mass[0]) * n / mass[-1]).astype(np.int32)
    return out


def make_classes(counts: np.ndarray) -> Classes:
    """counts: of each id of the vocabulary."""
    of_id = buckets(counts, SINGLE, CLASSES)
    total = np.bincount(of_id, counts + 0.1)
    return Classes(of_id, np.log((counts + 0.1) / total[of_id]), np.append(buckets(counts, BEFORE_SINGLE, BEFORE), BEFORE).astype(np.int32))


def bisected(rows: np.ndarray, mass: np.ndarray, depth: int) -> np.ndarray:
    """Group of each row: rows are halved by mass along the axis on which they differ most, and the halves again."""
    out = np.zeros(len(rows), np.int32)

    def cut(at: np.ndarray, group: int, left: int) -> None:
        out[at] = group
        if not left or len(at) < 2:
            return
        weight = mass[at] / mass[at].sum()
        y = rows[at] - weight @ rows[at]
        axis = np.linalg.eigh((y * weight[:, None]).T @ y)[1][:, -1]
        order = at[np.argsort(y @ axis, kind="stable")]
        sums = np.cumsum(mass[order])
        k = 1 + int(np.abs(sums[:-1] - sums[-1] / 2).argmin())
        cut(order[:k], group, left - 1)
        cut(order[k:], group + (1 << (left - 1)), left - 1)

    cut(np.arange(len(rows)), 0, depth)
    return out


def make_priors(pairs: np.ndarray) -> Priors:
    """pairs: counts [class before, class]; its last row is the begin of a text."""
    whole = pairs.sum(0) + 0.5
    group = bisected(np.sqrt(pairs / whole).T, whole, GROUPS.bit_length() - 1)
    rows = pairs + 5 * whole / whole.sum()
    rows /= rows.sum(1, keepdims=True)
    member = np.zeros((len(whole), GROUPS))
    member[np.arange(len(whole)), group] = 1
    groups = rows @ member
    with np.errstate(divide="ignore"):
        logs = np.where(groups > 0, np.log(groups), -1e4)  # a group without classes is never chosen
    return Priors(group, logs.astype(np.float32), np.log(rows / groups[:, group]).astype(np.float32))


# -- model ---------------------------------------------------------------------------------------------------------

#: Distance from each scored place of a window to each of its places, and what keeps later places out.
APART = np.clip(np.arange(STRIDE)[:, None] + STRIDE - np.arange(WIDTH)[None, :], 0, WIDTH - 1)
SEEN = np.arange(WIDTH)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE
LATER = np.where(SEEN, 0, -1e4).astype(np.float32)
Weights = dict[str, np.ndarray]


def new_weights(ids: int, seed: int = 42) -> Weights:
    """E: a row for each id and the begin; A: queries, keys and values; R: by distance; U: groups."""
    rng = np.random.default_rng(seed)
    mat = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
    return {"E": mat(ids + 1, DIMS, k=0.3), "A": mat(DIMS, 3 * DIMS, k=0.3), "R": np.zeros(WIDTH, np.float32), "U": mat(DIMS, GROUPS, k=0.01)}


def layout(ids: np.ndarray, ends: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' own places of texts that end at ``ends``: (id before, id or -1), each (windows, STRIDE), and which open a text."""
    sizes = np.diff(ends, prepend=0)
    many = -(-sizes // STRIDE)
    n, first = int(many.sum()), np.cumsum(many) - many
    after = np.full(n * STRIDE, -1, np.int32)
    after[np.arange(len(ids)) + np.repeat(first * STRIDE - (ends - sizes), sizes)] = ids
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[before < 0] = begin
    opens = np.zeros(n, bool)
    opens[first[sizes > 0]] = True
    before.reshape(n, STRIDE)[opens, 0] = begin
    return before.reshape(n, STRIDE), after.reshape(n, STRIDE), opens


def _table(rows: np.ndarray, w: Weights) -> np.ndarray:
    """What depends on the id alone: residual, query, key, value and a one."""
    f = rows @ w["A"]
    f[:, :DIMS] *= np.float32(1 / math.sqrt(DIMS))
    return np.concatenate([rows, f, np.ones((len(f), 1), np.float32)], 1)


def _attend(w: Weights, place: np.ndarray, known: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, ...]:
    """place: rows of ``known`` for each place; gives own rows, queries, keys, values and one, exponents, their sums of values and one."""
    n, width = len(opens), known.shape[1]
    rows = np.empty(((n + 1) * STRIDE, width), np.float32)
    rows[:STRIDE] = 0
    np.take(known, place, axis=0, out=rows[STRIDE:], mode="clip")
    step = rows.strides[0]
    own, d = rows[STRIDE:].reshape(n, STRIDE, width), DIMS
    # a window is the places before its own and its own: neighbours share rows
    windows = np.lib.stride_tricks.as_strided(rows, (n, WIDTH, width), (STRIDE * step, step, rows.itemsize))
    q, k, v = own[:, :, d : 2 * d], windows[:, :, 2 * d : 3 * d], windows[:, :, 3 * d : 4 * d + 1]
    s = q @ k.transpose(0, 2, 1)
    s += w["R"][APART] + LATER
    np.minimum(s, HIGHEST, out=s)
    s[opens, :, :STRIDE] = -1e4
    np.exp(s, out=s)
    return own, q, k, v, s, s @ v


def _own_places(t: np.ndarray) -> np.ndarray:
    """Sums for each place over the window that it is its own in and the next one, whose context it is."""
    out = t[:, STRIDE:].copy()
    out[:-1] += t[1:, :STRIDE]
    return out.reshape(-1, t.shape[2])


def _different(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and the place of each id among them; ids are below ``size``."""
    met = np.zeros(size, bool)
    met[ids] = True
    names = np.flatnonzero(met)
    at = np.empty(size, np.int64)
    at[names] = np.arange(len(names))
    return names, at[ids]


def _exponents(w: Weights, h: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all groups; where they can be over HIGHEST they are cut there."""
    z = np.take(prior, rows, axis=0)
    z += h @ w["U"]
    # no score is over this bound, so that in nearly all steps no pass over them is needed
    if not np.abs(h).max(initial=0) * np.abs(w["U"]).sum(0).max() + prior.max(initial=0) <= HIGHEST:
        np.minimum(z, HIGHEST, out=z)
    return z


def gradients(w: Weights, prior: np.ndarray, of_before: np.ndarray, before: np.ndarray, goal: np.ndarray, opens: np.ndarray) -> tuple[float, Weights, tuple[np.ndarray, np.ndarray]]:
    """Mean loss over the groups ``goal`` (-1 isn't scored), gradients of A, R and U, and rows of E with theirs.

    A window's context is the window before it, unless it opens.
    """
    d, n = DIMS, len(before)
    ids = before.reshape(-1)
    names, place = _different(ids, len(w["E"]))
    own, q, k, v, s, m = _attend(w, place, _table(w["E"][names], w), opens)
    part = 1 / m[:, :, d:]
    m = m[:, :, :d] * part
    s *= part
    # groups are scored at the places that have one
    want = goal.reshape(-1)
    ok = np.flatnonzero(want >= 0)
    want = want[ok]
    h = np.take((m + own[:, :, :d]).reshape(-1, d), ok, axis=0)
    z = _exponents(w, h, prior, of_before[ids[ok]])
    np.exp(z, out=z)
    share = 1 / max(1, len(ok))
    # sums of exponents, and their sums of U's columns, in one product
    sums = z @ np.concatenate([w["U"].T, np.ones((z.shape[1], 1), z.dtype)], 1)
    total = sums[:, d]
    flat, at = z.reshape(-1), np.arange(len(want)) * z.shape[1] + want
    loss = -float(np.log(flat[at] / total + 1e-30).sum()) * share
    scale = share / total[:, None]
    flat[at] -= total
    g = {"U": (h * scale).T @ z}
    dm = np.zeros((n * STRIDE, d), z.dtype)
    dm[ok] = sums[:, :d] * scale - np.take(w["U"].T * share, want, axis=0)
    dm = dm.reshape(n, STRIDE, d)
    da = dm @ v[:, :, :d].transpose(0, 2, 1)
    da -= np.einsum("nij,nij->ni", dm, m)[:, :, None]
    da *= s
    g["R"] = np.bincount(APART.ravel(), (da.sum(0) * SEEN).ravel(), WIDTH).astype(da.dtype)
    dq = (da @ k).reshape(-1, d)
    dk, dv = (_own_places(t) for t in (da.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ dm))
    x = own.reshape(n * STRIDE, -1)[:, :d].T
    g["A"] = np.concatenate([x @ dq / np.sqrt(np.float32(d)), x @ dk, x @ dv], 1)
    back = [y @ a.T for y, a in zip((dq, dk, dv), np.split(w["A"], 3, axis=1))]
    back[0] /= np.sqrt(np.float32(d))
    row = dm.reshape(-1, d)
    for y in back:
        row += y
    # rows of one id are summed last, when they are narrow
    return loss, g, (names, np.stack([np.bincount(place, y, len(names)) for y in row.T], 1).astype(row.dtype))


class Adam:
    """Steps on all weights but E, of which only rows that occur move."""

    def __init__(self, w: Weights):
        self.w, self.t = w, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: Weights, rows: np.ndarray, row_g: np.ndarray, rate: float) -> None:
        self.t += 1
        for k, at, x in [*((k, None, x) for k, x in g.items()), ("E", rows, row_g)]:
            m, v = (a[k] if at is None else np.take(a[k], at, axis=0) for a in (self.m, self.v))
            m *= 0.9
            m += 0.1 * x
            v *= 0.999
            v += 0.001 * x * x
            by = np.sqrt(v / (1 - 0.999**self.t))
            by += 1e-8
            np.divide(m, by, out=by)
            by *= rate / (1 - 0.9**self.t)
            if at is None:
                self.w[k] -= by
            else:
                self.m[k][at], self.v[k][at] = m, v
                self.w[k][at] -= by


class Trained(NamedTuple):
    model_path: str
    classes: Classes
    priors: Priors
    weights: Weights


def score_ids(t: Trained, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log probability of each id given those before it in its text; ends: where each text ends."""
    before, after, opens = layout(ids, ends, len(t.classes.of_id))
    w, of_before, group = t.weights, t.classes.before, t.priors.group[t.classes.of_id]
    known, ones = _table(w["E"], w), np.ones(GROUPS, np.float32)
    out = np.zeros(after.size)
    goal = group[np.maximum(after, 0)].reshape(-1)
    for at in range(0, len(before), SCORED):
        # the window before the first one is its context
        lead = min(at, 1)
        mine, place = slice(at, at + SCORED), before[at - lead : at + SCORED].reshape(-1)
        own, _, _, _, _, m = _attend(w, place, known, opens[at - lead : at + SCORED])
        h = m[lead:, :, :DIMS] / m[lead:, :, DIMS:]
        h += own[lead:, :, :DIMS]
        z = _exponents(w, h.reshape(-1, DIMS), t.priors.groups, of_before[place[lead * STRIDE :]])
        n = len(z)
        won = z.reshape(-1)[np.arange(n) * GROUPS + goal[at * STRIDE : at * STRIDE + n]].astype(np.float64)
        np.exp(z, out=z)
        out[at * STRIDE : at * STRIDE + n] = won - np.log(z @ ones)
    full = after.reshape(-1) >= 0
    return out[full] + t.priors.inner[of_before[before.reshape(-1)[full]], t.classes.of_id[ids]] + t.classes.share[ids]


def fit(t: Trained, texts: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, seed: int, passes: int = 1) -> tuple[int, Weights]:
    """Number of ids, and weights after training on all of them; texts: pieces of a partition, as ids and where texts end."""
    keep_small()
    w = {k: x.copy() for k, x in t.weights.items()}
    adam, rng, seen = Adam(w), np.random.default_rng(seed), 0
    begin, group = len(t.classes.of_id), t.priors.group[t.classes.of_id].astype(np.int16)

    def go(parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal seen
        shift = np.cumsum([0, *(len(i) for i, _ in parts)])
        ids = np.concatenate([i for i, _ in parts])
        before, after, opens = layout(ids, np.concatenate([e + a for (_, e), a in zip(parts, shift)]), begin)
        goal = np.where(after >= 0, group[np.maximum(after, 0)], np.int16(-1))
        n = len(before)
        for _ in range(passes):
            starts = rng.permutation(-(-n // ROW)) * ROW
            for at in range(0, len(starts), STEP // ROW):
                # rows of windows, each behind the one that is its context
                spot = starts[at : at + STEP // ROW, None] + np.arange(-1, ROW)
                inside = np.clip(spot, 0, n - 1)
                now = goal[inside]
                now[:, 0] = -1
                now[spot >= n] = -1
                new = opens[inside]
                new[:, 0] = True
                _, g, (names, rows) = gradients(w, t.priors.groups, t.classes.before, before[inside].reshape(-1, STRIDE), now.reshape(-1, STRIDE), new.reshape(-1))
                adam.step(g, names, rows, rate / (1 + 3 * seen / SLOWER_IDS))
                seen += STEP * STRIDE

    held, size, total = [], 0, 0
    for ids, ends in texts:
        held.append((ids, ends))
        size, total = size + len(ids), total + len(ids)
        if size >= MIXED_IDS:
            go(held)
            held, size = [], 0
    if size:
        go(held)
    return total, w


# -- texts ---------------------------------------------------------------------------------------------------------


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lists of words, A-Z lower-cased; white space is the six ASCII characters."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.values, lists.offsets.to_numpy()
    flat = flat.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(before[offsets - offsets[0]], pa.int32()), flat.filter(full))


def held_out(doc_id: int | None) -> bool:
    """CRC-32 of the id as text, modulo 10, is 0 (a null id: of the empty text, whose CRC is 0)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _docs(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def keyed(words: pa.Array) -> pa.Array:
    """Words, long ones as a space, which no word has, and their SHA-256."""
    many = pc.fill_null(pc.greater(pc.binary_length(words), LONG), False).to_numpy(zero_copy_only=False)
    if not many.any():
        return words
    return pa.array([" " + hashlib.sha256(w.encode()).hexdigest() if k else w for w, k in zip(words.to_pylist(), many.tolist())], pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (w, c) over the training documents; the empty word stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, 1):
                train = pa.array([not held_out(d) for d in b.column(0).to_pylist()])
                texts = b.column(1).filter(train)
                got = pc.value_counts(split_words(texts).values)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([keyed(got.field(0)), pa.array([""])]), pa.concat_arrays([got.field(1), pa.array([len(texts)], pa.int64())])], names=["w", "c"])

    return docs.mapInArrow(run, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")).filter("c > 0")


def frequent_words(counts: DataFrame, shipped: int) -> tuple[int, int, DataFrame]:
    """Number of tokens and of words, and the most frequent words, as many as are at most ``shipped`` without parting equal counts.

    Any other word makes up less than one in ``shipped`` of the tokens.
    """
    kinds = counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).toArrow()
    c, k = kinds["c"].to_numpy(), kinds["k"].to_numpy()
    sent = int(np.searchsorted(np.cumsum(k), shipped, "right"))
    least = int(c[sent - 1]) if sent else int(c.max(initial=0)) + 1
    return int((c * k).sum()), int(k.sum()), counts.filter(F.col("c") >= least)


def listed_places(words: pa.Array, listed: pa.Array) -> np.ndarray:
    """Place of each word in a list, or -1; both hold a word once. The shorter of both is hashed."""
    if len(listed) <= len(words):
        return pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy(zero_copy_only=False)
    place = pc.fill_null(pc.index_in(listed, value_set=words), -1).to_numpy(zero_copy_only=False)
    out, met = np.full(len(words), -1, np.int32), np.flatnonzero(place >= 0)
    out[place[met]] = met
    return out


def id_kind(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of an array, which end at ``ends``, as binary values."""
    cuts = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def listing(often: DataFrame, model_path: str) -> pa.Table:
    """Rows (w, log, ids) of frequent words: log10(count + 0.1), and the word's ids, none where w is a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        kind = id_kind(len(m.widths))
        for b in batches:
            spelt = [w for w in b.column(0).to_numpy(zero_copy_only=False).tolist() if not w.startswith(" ")]
            ids, ends, sizes = m.bare.encode_coded(spelt, np.arange(len(spelt)))
            every = np.zeros(b.num_rows, np.int64)
            every[pc.invert(pc.starts_with(b.column(0), " ")).to_numpy(zero_copy_only=False)] = sizes
            yield pa.RecordBatch.from_arrays([b.column(0), pc.log10(pc.add(pc.cast(b.column(1), pa.float64()), 0.1)), binaries(ids.astype(kind), np.cumsum(every))], names=["w", "log", "ids"])
            m.bare.clear()
        hand_back()

    return often.select("w", "c").mapInArrow(run, "w string, log double, ids binary").toArrow().combine_chunks()


def encoded(docs: DataFrame, often: pa.Table, model_path: str) -> DataFrame:
    """One row for each text, with its ids, and rows (row, held_out, w) for its words that aren't listed in ``often``.

    known and base are of the words that are: how many, and the sum of log10(count + 0.1).
    """
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, next_row = model(model_path), TaskContext.get().partitionId() << 40
        listed, logs, listed_ids = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in sent.value.columns)
        logs = np.append(logs.to_numpy(), 0.0)
        close = pc.index(listed, "").as_py()
        kind = id_kind(len(m.widths))
        pool = np.concatenate([np.zeros(0, kind), *(x for x, _, _ in ids_of(listed_ids, kind, 1 << 62))]).astype(np.uint32)
        sizes = pc.binary_length(listed_ids).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
        starts = np.cumsum(sizes) - sizes
        for whole in batches:
            for b in blocks(whole, 1, ENCODED_BYTES):
                n = b.num_rows
                lists = split_words(b.column(1))
                offsets = lists.offsets.to_numpy().astype(np.int64)
                coded = lists.values.dictionary_encode()
                codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
                known = keyed(names)
                spot = listed_places(known, listed)
                # ids of words that are listed are there, others' come from the store
                begin, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                there = np.flatnonzero(spot >= 0)
                begin[there], size[there] = starts[spot[there]], sizes[spot[there]]
                new = np.flatnonzero(size == 0)
                more, ends, size[new] = m.bare.encode_coded(names.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist(), np.arange(len(new)))
                begin[new] = len(pool) + ends - size[new]
                ids, stops = gathered(np.concatenate([pool, more]), begin[codes], size[codes])
                stops = stops[offsets]
                # the end of a text is a word like others, at the place of the empty word
                at = np.insert(spot[codes], offsets[1:], close)
                words = np.diff(offsets) + 1
                last = np.cumsum(words)
                each = lambda x: np.add.reduceat(x, last - words)
                row, held = next_row + np.arange(n), np.array([held_out(d) for d in b.column(0).to_pylist()], bool)
                next_row += n
                ended = np.insert(ids, stops[1:], m.end).astype(kind)
                binary = binaries(ended, (stops + np.arange(n + 1))[1:])
                none = lambda k, kind: pa.nulls(k, kind)
                yield pa.RecordBatch.from_pydict({"row": row, "doc_id": b.column(0), "held_out": pa.array(held), "n_tokens": words, "known": each((at >= 0).astype(np.int64)), "base": each(np.where(at >= 0, logs[at], 0.0)), "ids": binary, "w": none(n, pa.string())})
                rare = np.flatnonzero(at < 0)
                if k := len(rare):
                    spelt = pa.concat_arrays([known, pa.array([""])]).take(pa.array(np.insert(codes, offsets[1:], len(names))[rare]))
                    yield pa.RecordBatch.from_pydict({"row": np.repeat(row, words)[rare], "doc_id": none(k, pa.int64()), "held_out": pa.array(np.repeat(held, words)[rare]), "n_tokens": none(k, pa.int64()), "known": none(k, pa.int64()), "base": none(k, pa.float64()), "ids": none(k, pa.binary()), "w": spelt})
        m.bare.clear()
        hand_back()

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, ids binary, w string")


def ids_of(column: pa.Array, kind: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Ids of stored texts, where each text ends among them, and which rows they are; at most about ``most`` ids together."""
    raw = pc.binary_join_element_wise(column, pa.scalar(b""), pa.scalar(b"")) if column.null_count else column
    cuts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[cuts[0] : cuts[-1]].view(kind)
    ends = (cuts[1:] - cuts[0]) // size
    at = 0
    while at < len(ends):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield flat[base : ends[to - 1]].astype(np.int32), ends[at:to] - base, slice(at, to)
        at = to


def _summed(df: DataFrame, vectors, size: int) -> np.ndarray:
    """Sum over all rows of the whole numbers that ``vectors`` adds to an array of ``size`` for the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        vectors(batches, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    got = df.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out


def train(texts: DataFrame, model_path: str, ids: int) -> Trained:
    """texts: row, ids (of the training texts), read from storage as often as needed; ids: size of the vocabulary."""
    spark, kind = texts.sparkSession, id_kind(ids)
    column = texts.select("ids")

    def count(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for b in batches:
            for x, _, _ in ids_of(b.column(0), kind, AT_ONCE):
                total += np.bincount(x, minlength=ids)

    seen = _summed(column, count, ids).astype(np.float64)
    classes, passes = make_classes(seen), int(min(PASSES, max(1, -(-LEAST_IDS // max(1, seen.sum())))))
    across = int(classes.of_id.max()) + 1

    def pair(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for b in batches:
            for x, ends, _ in ids_of(b.column(0), kind, AT_ONCE):
                before = np.empty(len(x), np.int64)
                before[1:] = classes.before[x[:-1]]
                before[np.concatenate([[0], ends[:-1]])] = BEFORE
                total += np.bincount(before * across + classes.of_id[x], minlength=len(total))

    priors = make_priors(_summed(column, pair, (BEFORE + 1) * across).reshape(BEFORE + 1, across).astype(np.float64))
    t = Trained(model_path, classes, priors, new_weights(ids))
    first = F.pmod(F.xxhash64("row"), F.lit(8)) < FIRST_EIGHTHS
    shapes = {k: x.shape for k, x in t.weights.items()}
    starts = dict(zip(shapes, np.cumsum([0, *(x.size for x in t.weights.values())])))
    for r, rate in enumerate(RATES):
        sent = spark.sparkContext.broadcast(pickle.dumps(t))

        def run(batches: Iterator[pa.RecordBatch], rate: float = rate, sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = pickle.loads(sent.value)
            n, w = fit(own, (x[:2] for b in batches for x in ids_of(b.column(0), kind, MIXED_IDS)), rate, TaskContext.get().partitionId(), passes)
            hand_back()
            if n:
                moved = [(starts[k] + at, (x.ravel()[at].astype(np.float64) - own.weights[k].ravel()[at])) for k, x in w.items() if len(at := np.flatnonzero(x.ravel() != own.weights[k].ravel()))]
                # whole numbers, so that no order of adding makes a difference; place -1 has the ids seen
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.decimal128(38, 0))], names=["i", "x"])
                for at, x in moved:
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([int(v) * n for v in np.rint(x * 2.0**40)], pa.decimal128(38, 0))], names=["i", "x"])

        got = texts.filter(first if r == 0 else ~first).select("ids")
        sums = got.mapInArrow(run, "i long, x decimal(38,0)").groupBy("i").agg(F.sum("x").cast("double").alias("x")).toArrow()
        sent.unpersist()
        at, x = sums["i"].to_numpy(), sums["x"].to_numpy()
        if len(at):
            flat = np.concatenate([w.ravel() for w in t.weights.values()]).astype(np.float64)
            flat[at[at >= 0]] += x[at >= 0] / 2.0**40 / x[at < 0][0]
            t = t._replace(weights={k: flat[starts[k] : starts[k] + math.prod(shapes[k])].reshape(shapes[k]).astype(np.float32) for k in shapes})
    return t


def score_documents(documents: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", shipped: int = SHIPPED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_ids, one row for each row of documents.

    n_tokens: words and one end; n_known: those that occur in training documents (ids whose CRC-32 modulo 10 isn't 0).
    base_score: log10 probability by smoothed word counts; score: the model's log10 probability of the text's n_ids
    subword ids, with the end. Texts that differ in white space, the case of A-Z or a word mark (U+2581) alone have the same
    ids. A null or empty text is its end alone; a null id counts as held out. Rows that share an id are scored
    apart. Other columns are passed over. An empty table gives an empty table; without training documents the model is
    its random start. All but the ``shipped`` most frequent words are counted by a window over their places, in which
    none makes up one in ``shipped`` of the training tokens.
    """
    spark = documents.sparkSession
    docs = _docs(documents, doc_id, text)
    counts = stored(word_counts(docs), "wordcounts")
    n, v, often = frequent_words(counts, shipped)
    made = stored(encoded(docs, listing(often, model_path), model_path), "encoded")
    texts = made.filter("w is null").drop("w")
    ids = len(model(model_path).widths)
    kind = id_kind(ids)
    sent = spark.sparkContext.broadcast(pickle.dumps(train(texts.filter("not held_out").select("row", "ids"), model_path, ids)))
    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pickle.loads(sent.value)
        keep_small()
        for b in batches:
            for x, ends, rows in ids_of(b.column(len(kept)), kind, AT_ONCE):
                sizes = np.diff(ends, prepend=0)
                score = np.add.reduceat(score_ids(t, x, ends), ends - sizes) / math.log(10)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(rows.start, rows.stop - rows.start) for i in range(len(kept))), pa.array(sizes), pa.array(score)], names=[*kept, "n_ids", "score"])

    heads = texts.select(*kept, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_ids long, score double")
    # every place of such a word is here, so that its training count is that of its rows
    rare = made.filter("w is not null").select(F.col("row").alias("r"), "w", F.when(F.col("held_out"), 0).otherwise(1).alias("t"))
    counted = rare.withColumn("c", F.sum("t").over(Window.partitionBy("w")))
    sums = counted.groupBy("r").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("b"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("k"))
    out = heads.join(sums, heads["row"] == sums["r"], "left")
    whole = math.log10(n + 0.1 * (v + 1))
    plus = lambda a, x: F.col(a) + F.coalesce(x, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (plus("base", "b") - F.col("n_tokens") * whole).alias("base_score"), "score", "n_ids")


def op3_lm_scores(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path or public_tokenizers.path("piece_bpe_32k.model"))


ORACLE: dict[str, str] = {}
