"""Token ids in files: frequency ranks in whole bytes, with the control bytes apart.

A file holds whole documents in order. Its ids are replaced by their rank in the file's own frequency table, so that
frequent ids need one byte; a value's width (1 to 4 bytes) is two bits of a control byte. All control bytes come
first, then all data bytes, so that a reader finds the widths of four values in one table lookup for each control byte
and the values themselves by a gather over a running sum of the widths.

Layout, all integers little-endian: magic ``CLID`` and version (8 bytes), number of documents, ids and table entries
(three unsigned 64-bit), CRC-32 of all that follows (unsigned 64-bit); document ids (signed 64-bit) with a null mask
byte each; ids of each document (unsigned 32-bit); the table, ids by falling frequency (unsigned 32-bit); control
bytes; data bytes.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, table
from .wordstore import WordStore, blocks

MAGIC = b"CLID\x01\0\0\0"
HEAD = struct.Struct("<8sQQQQ")
#: A file is closed after so many ids; one document is never split.
FILE_IDS = 2_000_000
#: Widths of the four values of each control byte.
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling frequency (ties: smaller id first), and each id's rank."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        values, codes = np.flatnonzero(counts), ids
        counts, size = counts[values], len(counts)
    else:
        values, codes, counts = np.unique(ids, return_inverse=True, return_counts=True)
        size = len(values)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(size, np.uint32)
    place[values[order] if codes is ids else order] = np.arange(len(order), dtype=np.uint32)
    return values[order].astype("<u4"), place[codes]


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    widths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = widths - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < widths[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    widths = WIDTHS[control].reshape(-1)[:n]
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(n, np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    for k in range(4):
        more = widths > k
        if not more.any():
            break
        out[more] |= padded[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    listed, ranks = ranked(ids)
    control, data = pack_values(ranks)
    body = b"".join([
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<u4").tobytes(), listed.tobytes(), control, data,
    ])
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), len(listed), zlib.crc32(body)) + body


class Decoded(NamedTuple):
    doc_ids: list[int | None]
    sizes: np.ndarray
    ids: np.ndarray


def decode_file(content: bytes) -> Decoded:
    magic, docs, n, entries, crc = HEAD.unpack_from(content)
    body = memoryview(content)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a whole file of token ids")
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    known, null, sizes, listed = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", entries)
    control = take("u1", -(-n // 4))
    ranks = unpack_values(control, take("u1", len(body) - at), n)
    return Decoded([None if z else d for d, z in zip(known.tolist(), null.tolist())], sizes, listed[ranks] if n else np.zeros(0, "<u4"))


# -- the tokenizer -------------------------------------------------------------------------------------------------


class WordTokenizer:
    """Ids of a tokenizer file whose pre-tokenizer drops white space, so that words are encoded apart from each other.

    For words of ordinary Latin letters, digits and marks the file's normaliser and splitter come down to lower-casing
    and one pattern (checked for each character when the file is loaded); the library's model then gives a piece's ids.
    All other words go through the whole library.
    """

    #: Characters that may take the short way: ASCII and the letters of Latin-1 and Latin Extended-A.
    ORDINARY = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180))]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        normal, split = self.whole.normalizer, self.whole.pre_tokenizer
        self.short: dict[str, list[int]] = {}
        safe = [c for c in self.ORDINARY if normal and split and normal.normalize_str(c) == c.lower() and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1]
        letters = "".join(sorted({c.lower() for c in safe if c.isalpha()}))
        digits = "".join(c for c in safe if c.isdigit())
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}]+")
        self.safe = re.compile("[" + re.escape("".join(safe)) + "]+")
        self.bytes = self._byte_letters()
        probe = ["don't", "We'll'd!?", "Straße,", "x1y22", "été***", "#%&'s", "Ñandú.", "a_b-c", "I'M'T"]
        self.usable = all(self._fast(w) == self._library([w])[0] for w in probe)

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _fast(self, word: str) -> list[int]:
        out: list[int] = []
        for piece in self.split.findall(word.lower()):
            ids = self.short.get(piece)
            if ids is None:
                spelt = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
                ids = [t.id for t in self.model.tokenize(spelt)]
                if len(self.short) > 300_000:
                    self.short.clear()
                self.short[piece] = ids
            out += ids
        return out

    def _library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(words, add_special_tokens=False)]

    def encode_new(self, words: list[str]) -> list[list[int]]:
        # a special token's text is cut out before anything else is done
        odd = [w for w in words if w and not (self.usable and "<|" not in w and self.safe.fullmatch(w))]
        by = dict(zip(odd, self._library(odd))) if odd else {}
        return [by[w] if w in by else self._fast(w) for w in words]


_LOADED: dict[str, tuple[WordTokenizer, WordStore]] = {}


def _tokenizer(path: str) -> WordStore:
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = WordTokenizer(path)
        _LOADED[path] = t, WordStore(t.encode_new)
    return _LOADED[path][1]


# -- writing and reading -------------------------------------------------------------------------------------------


def _put(folder: str, name: str, content: bytes) -> None:
    """A whole file or none: written under another name, then renamed. A task that runs again writes the same bytes."""
    import os
    import uuid

    from pyarrow import fs

    to, base = fs.FileSystem.from_uri(folder)
    to.create_dir(base, recursive=True)
    tmp = f"{base}/_{name}.{uuid.uuid4().hex}"
    with to.open_output_stream(tmp) as f:
        f.write(content)
    if isinstance(to, fs.LocalFileSystem):
        os.replace(tmp, f"{base}/{name}")
    else:
        to.move(tmp, f"{base}/{name}")


def write_ids(documents: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1, file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Writes the ids of all documents to ``folder`` in ascending doc_id order; returns the list of files.

    Documents are dealt out by ranges of (doc_id, hash of the text) and sorted in each range, so that the names
    ``ids-<range>-<part>.clid`` are in the order of the ids. Null ids come first; equal ids by text. A null text is empty
    and has its end id alone; repeated rows are written as often as they occur; an empty table writes no file. The list
    (name, n_docs, n_tokens) is stored itself, and only files that it names count.
    """
    spark = documents.sparkSession
    df = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("h", F.xxhash64("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, part, files = _tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal docs, ids, sizes, held, files
            name = f"ids-{part:07d}-{files:06d}.clid"
            _put(folder, name, encode_file(docs, np.concatenate(sizes), np.concatenate(ids)))
            row = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(docs)], "n_tokens": [held]})
            docs, ids, sizes, held, files = [], [], [], 0, files + 1
            return row

        for whole in batches:
            for b in blocks(whole, 1):
                flat, ends = store.encode(pc.ascii_split_whitespace(b.column(1)))
                own = np.diff(ends, prepend=0)
                if len(tail):
                    flat = np.insert(flat, ends, tail[0])
                    own = own + 1
                    ends = np.cumsum(own)
                names, at = b.column(0).to_pylist(), 0
                while at < len(names):
                    # as many whole documents as the file still takes, one at least
                    before = int(ends[at - 1]) if at else 0
                    to = max(int(np.searchsorted(ends, before + max(0, file_ids - held), "right")), at + (not held))
                    if to > at:
                        docs += names[at:to]
                        sizes.append(own[at:to])
                        ids.append(flat[before : int(ends[to - 1])])
                        held += int(ends[to - 1]) - before
                    if to < len(names) or held >= file_ids:
                        yield close()
                    at = to
        if docs:
            yield close()

    return stored(dealt.mapInArrow(run, "name string, n_docs long, n_tokens long"), "idfiles")


def read_ids(spark: SparkSession, folder: str, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files that the list names.

    start: number of ids of all documents before it. ids_crc32: unsigned CRC-32 of the document's ids as little-endian
    unsigned 32-bit integers. with_ids adds them as binary.
    """
    from pyspark.sql import Window

    # the number of a file's first id: ids of the ranges before its own (one row for each range), and of the files before it there
    full = files.filter("n_docs > 0").withColumn("range", F.regexp_extract("name", r"^ids-(\d+)-", 1))
    sums = full.groupBy("range").agg(F.sum("n_tokens").alias("whole"))
    ranges = sums.select("range", (F.sum("whole").over(Window.orderBy("range")) - F.col("whole")).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("name")) - F.col("n_tokens")
    before = full.withColumn("inside", inside).join(ranges, "range").select("name", (F.col("earlier") + F.col("inside")).alias("base"))
    schema = "name string, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                got = decode_file(content.as_buffer())
                ends = np.cumsum(got.sizes.astype(np.int64))
                flat = memoryview(got.ids.astype("<u4").tobytes())
                starts = ends - got.sizes
                cut = [flat[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]
                columns = {"name": [path.rsplit("/", 1)[-1]] * len(cut), "doc_id": pa.array(got.doc_ids, pa.int64()), "local": starts, "n_tokens": got.sizes.astype(np.int64), "ids_crc32": [zlib.crc32(c) for c in cut]}
                if with_ids:
                    columns["ids"] = pa.array([bytes(c) for c in cut], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    if files.isEmpty():
        return spark.createDataFrame([], schema).select("doc_id", F.col("local").alias("start"), *schema_names(with_ids))
    read = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.clid").load(folder).select("path", "content")
    rows = read.mapInArrow(run, schema)
    return rows.join(before, "name").select("doc_id", (F.col("base") + F.col("local")).alias("start"), *schema_names(with_ids))


def schema_names(with_ids: bool) -> list[str]:
    return ["n_tokens", "ids_crc32", *["ids"] * with_ids]


def op7_id_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "ids")
    files = write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_ids(spark, folder, files)


ORACLE: dict[str, str] = {}
