"""SentencePiece encoding and decoding that keep each piece's span of original bytes.

The normaliser is this module's own: at each place of the text the longest key of the model's compiled character map
that starts there is replaced, or else one character is copied, and for every normalised byte the place of the source
it came from is recorded. Normalised text goes to the library with normalisation switched off, for the merges alone;
the lengths of its pieces, projected through the recorded places, are spans of the original UTF-8 bytes.

Where no piece of the vocabulary goes on with a word mark after another character, no merge crosses from a character
to a word mark, so that words can be encoded one by one and kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table
from .wordstore import WordStore, blocks

MARK = "▁"


def _wire(buf: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """(field, wire type, value, raw bytes) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out, i

    i = 0
    while i < len(buf):
        start = i
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = buf[i : i + n], i + n
        yield key >> 3, kind, value, buf[start:i]


def _field(number: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """A compiled map: a double-array trie over UTF-8 keys whose values are offsets of zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = [], b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.texts = blob[4 + n :]
        self.firsts = {b for b in range(256) if self.units and self._step(self._start(), b)[1]}

    def _start(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> tuple[int, bool, bool]:
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        if unit & 0x800000FF != byte:
            return 0, False, False
        return at ^ self._offset(unit), True, bool(unit >> 8 & 1)

    def longest(self, src: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at a place of src."""
        if not self.units or src[at] not in self.firsts:
            return None
        node, found = self._start(), None
        for i in range(at, len(src)):
            node, ok, leaf = self._step(node, src[i])
            if not ok:
                break
            if leaf:
                found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if not found:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class PieceModel:
    """A model file: its normaliser, its vocabulary and the library's merges and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        spec = {"map": b"", "prefix": 1, "extra": 1, "escape": 1}
        suffix, rest = 0, []
        for field, _, value, raw in _wire(proto):
            if field == 3:
                names = {2: "map", 3: "prefix", 4: "extra", 5: "escape"}
                spec |= {names[f]: v for f, _, v, _ in _wire(value) if f in names}
            elif field == 2:
                suffix = next((v for f, _, v, _ in _wire(value) if f == 24), 0)
                rest.append(raw)
            elif field != 4:  # 4 holds samples that are checked against the normaliser
                rest.append(raw)
        self.map = CharacterMap(spec["map"])
        self.add_prefix, self.trim, self.escape, self.suffix = (bool(x) for x in (spec["prefix"], spec["extra"], spec["escape"], suffix))
        plain = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + plain)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.vocab_size()
        texts = [lib.id_to_piece(i) for i in range(n)]
        # user-defined symbols pass the normaliser untouched
        self.own = sorted((t.encode() for i, t in enumerate(texts) if self._user_defined(proto, i)), key=len, reverse=True)
        self.widths = np.array([1 if lib.is_byte(i) else len(t.encode()) for i, t in enumerate(texts)], np.int64)
        self.opens = np.array([t.startswith(MARK) for t in texts])
        self.unknown = lib.unk_id()
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", t) for t in texts)
        self.plain = not self.map.units and not self.trim and not self.own and not self.suffix and self.escape
        self.store = WordStore(lambda words: self.merges.encode(words, num_threads=1))
        self.bare = WordStore(lambda words: self.merges.encode([MARK + w for w in words], num_threads=1))
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.by_word else re.compile(r"(?s).+")

    _kinds: list[int] | None = None

    def _user_defined(self, proto: bytes, i: int) -> bool:
        if self._kinds is None:
            self._kinds = [next((v for f, _, v, _ in _wire(value) if f == 3), 1) for field, _, value, _ in _wire(proto) if field == 1]
        return self._kinds[i] == 4

    # -- normalisation ---------------------------------------------------------------------------------------------

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its UTF-8 bytes (and its end) the place of the source byte it came from."""
        src = text.encode("utf-8", "replace")
        if not src:
            return "", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(src, np.uint8)
            origin = np.repeat(np.arange(len(src)), np.where(raw == 32, 3, 1))
            head = [0, 0, 0] if self.add_prefix else []
            return MARK * self.add_prefix + text.replace(" ", MARK), np.concatenate([head, origin, [len(src)]]).astype(np.int64)
        return self._normalize_by_map(src)

    def _prefix(self, src: bytes, at: int) -> tuple[bytes, int]:
        for own in self.own:
            if src.startswith(own, at):
                return own, len(own)
        if found := self.map.longest(src, at):
            return found
        b = src[at]
        n = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
        return src[at : at + n], n

    def _normalize_by_map(self, src: bytes) -> tuple[str, np.ndarray]:
        space = MARK.encode() if self.escape else b" "
        out, origin, at = bytearray(), [], 0

        def put(piece: bytes, place: int) -> None:
            out.extend(piece)
            origin.extend([place] * len(piece))

        if self.trim:
            while at < len(src):
                piece, n = self._prefix(src, at)
                if piece != b" ":
                    break
                at += n
            if at == len(src):
                return "", np.full(1, at, np.int64)
        if self.add_prefix and not self.suffix:
            put(space, at)
        after_space = self.trim
        while at < len(src):
            piece, n = self._prefix(src, at)
            if after_space:
                piece = piece.lstrip(b" ")
            for c in piece:
                put(space if c == 32 else bytes([c]), at)
            if piece:
                after_space = piece.endswith(b" ") and self.trim
            at += n
        end = len(src)
        if self.trim:
            while out.endswith(space):
                end = origin[-len(space)]
                del out[-len(space) :]
                del origin[-len(space) :]
        if self.add_prefix and self.suffix:
            put(space, end)
        return out.decode("utf-8", "replace"), np.array([*origin, end], np.int64)

    # -- encoding --------------------------------------------------------------------------------------------------

    def _split(self, texts: pa.Array) -> list[tuple[WordStore, np.ndarray, pa.ListArray]]:
        """The texts as lists of chunks, with the store for them and the places of those texts.

        Normalised text without two word marks in a row is a mark and a word again and again, for which splitting at
        spaces is enough; the rest is cut by a pattern.
        """
        every = np.arange(len(texts))
        odd = np.ones(len(texts), bool)
        if self.plain and self.by_word and self.add_prefix:
            # empty, with a space at either end or two in a row, or with a word mark of its own
            odd = pc.match_substring_regex(texts, f"^$|^ |  | $|{MARK}").to_numpy(zero_copy_only=False)
        out = []
        if not odd.all():
            out.append((self.bare, every[~odd], pc.split_pattern(texts.filter(pa.array(~odd)), " ")))
        if odd.any():
            normal = [self.normal_text(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            out.append((self.store, every[odd], pa.array([self.chunk.findall(n) for n in normal], pa.list_(pa.string()))))
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        out: list = [None] * len(texts)
        for store, places, lists in self._split(texts):
            ids, ends = store.encode(lists)
            for i, x in zip(places.tolist(), np.split(ids, ends[:-1])):
                out[i] = x
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, without begin and end."""
        out = np.zeros(len(texts), np.int64)
        for store, places, lists in self._split(texts):
            out[places] = store.counts(lists)
        return out

    def normal_text(self, text: str) -> str:
        return (MARK * self.add_prefix + text.replace(" ", MARK) if text else "") if self.plain else self.normalize(text)[0]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Begin and end of each piece in the text's UTF-8 bytes: an array of two columns."""
        normal, origin = self.normalize(text)
        widths = self.widths[ids]
        if (ids == self.unknown).any():  # an unknown piece has the width of what it stands for
            pieces = self.merges.encode(normal, return_type="proto").pieces
            widths = np.array([len(p.piece.encode()) if p.id == self.unknown else w for p, w in zip(pieces, widths)], np.int64)
        ends = np.cumsum(widths)
        if len(ends) and ends[-1] != len(origin) - 1:
            raise ValueError("the pieces don't cover the normalised text")
        return np.stack([origin[ends - widths], origin[ends]], 1)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(documents: DataFrame, model_path: str, text: str = "text", rows: int = 128) -> DataFrame:
    """documents without the text, with ids, spans and decoded.

    ids: binary, all ids with begin and end as little-endian unsigned 32-bit integers. spans: binary, for each id but
    begin and end the begin and end of its piece in the text's UTF-8 bytes, 32-bit alike. decoded: string, the library's
    decode of all ids. A null text counts as empty and has begin and end alone. Texts of any length are encoded whole.
    Repeated rows stay; columns named ids, spans or decoded are replaced; an empty table gives an empty table. Rows are
    handed back ``rows`` at a time, which bounds a worker's memory.
    """
    rest = dropped(documents, "ids", "spans", "decoded", text)
    src = rest.columns
    df = documents.select(*(F.col(f"`{c}`") for c in src), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "ids binary, spans binary, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        head, tail = (np.array([x], "<u4") for x in (m.begin, m.end))
        for whole in batches:
            for block in blocks(whole, whole.num_columns - 1):
                encoded = m.encode(block.column(block.num_columns - 1))
                for at in range(0, block.num_rows, rows):
                    b, made = block.slice(at, rows), encoded[at : at + rows]
                    texts = b.column(b.num_columns - 1).to_pylist()
                    ids = [np.concatenate([head, x, tail]) for x in made]
                    spans = [m.spans(t, x).astype("<u4").tobytes() for t, x in zip(texts, made)]
                    back = m.library.decode([x.tolist() for x in ids], num_threads=1)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(spans, pa.binary()), pa.array(back, pa.string())], names=[*src, "ids", "spans", "decoded"])

    return df.mapInArrow(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    got = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path or public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
    )


ORACLE: dict[str, str] = {}
