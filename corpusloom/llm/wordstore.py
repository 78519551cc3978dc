"""Token ids of many texts at once, from a store of the ids of words that a worker has already encoded.

Words of a block of texts are made codes by Arrow's dictionary encoding, so that Python sees each different word once;
ids come from one pool by a ragged gather.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept for each worker; beyond it the store starts anew, which costs time and changes no result.
KEPT_WORDS = 600_000
#: Text handled at once by a worker.
BLOCK_BYTES = 12 << 20


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a pool one after another, and where they begin and the last one ends."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.repeat(starts - ends[:-1], sizes)
    at += np.arange(ends[-1])
    return pool[at], ends


class WordStore:
    """encode_new: ids of a list of words, each a list of integers."""

    def __init__(self, encode_new: Callable[[list[str]], list[list[int]]], kept: int = KEPT_WORDS):
        self.encode_new, self.most = encode_new, kept
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _places(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(found < 0)
        if not len(lacking):
            return found
        new = words if len(lacking) == len(words) else [words[i] for i in lacking.tolist()]
        if len(self.slots) + len(new) > self.most and self.slots:
            self.clear()
            new, lacking = words, np.arange(len(words))
        at, ids = len(self.slots), self.encode_new(new)
        sizes = np.fromiter(map(len, ids), np.int32, len(new))
        many = int(sizes.sum())
        self.starts, self.sizes = self._grown(self.starts, at + len(new)), self._grown(self.sizes, at + len(new))
        self.pool = self._grown(self.pool, self.used + many)
        ends = self.used + np.cumsum(sizes, dtype=np.int64)
        self.starts[at : at + len(new)], self.sizes[at : at + len(new)] = ends - sizes, sizes
        self.pool[self.used : self.used + many] = np.fromiter(chain.from_iterable(ids), np.uint32, many)
        self.used += many
        self.slots.update(zip(new, range(at, at + len(new))))
        found[lacking] = np.arange(at, at + len(new))
        return found

    def _coded(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word its place and size in the pool; for each text its words' first and last place."""
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        places = self._places(coded.dictionary.to_pylist())
        return self.starts[places][codes], self.sizes[places][codes], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]

    def encode(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as lists of words, one after another, and where each text ends among them."""
        ids, ends, _ = self.encode_words(lists)
        return ids, ends

    def encode_words(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode, and the number of ids of each word."""
        starts, sizes, _, last = self._coded(lists)
        ids, ends = self._gather(starts, sizes)
        return ids, ends[last], sizes

    def encode_coded(self, words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words given as places in a list of different words; where each word ends among them; its number of ids."""
        places = self._places(words)
        sizes = self.sizes[places][codes]
        ids, ends = self._gather(self.starts[places][codes], sizes)
        return ids, ends[1:], sizes

    def _gather(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.pool, starts, sizes)

    def counts(self, lists: pa.ListArray) -> np.ndarray:
        """Number of ids of each text."""
        _, sizes, first, last = self._coded(lists)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return ends[last] - ends[first]


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of one text column; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
