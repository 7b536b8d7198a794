"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped when read.

Format of a folder: `<part>.bin` holds the ids of consecutive documents, each closed by the end id, as little-endian unsigned
16-bit integers (32-bit where the vocabulary needs it); `<part>.idx` holds n + 1 64-bit offsets counted in ids from the part's
start, then the n document ids; `manifest` has one row per part: file, first document id, documents, ids, and the base,
which is the prefix sum of the ids of all parts before it. Parts hold ascending ranges of document ids.

Byte-level BPE never merges across pre-tokens, so a text is cut into pre-tokens with array operations, each distinct pre-token
goes through the library's BPE model once per worker, and ids are gathered by index; this gives the ids of the library's
encode of the whole text (tested). A text with a code point that the running Python and the library may class differently
(outside assigned blocks below U+0590 and common punctuation), or that holds the content of a token added to the vocabulary, is encoded
whole by the library.

Defined results: null and empty texts are the end id alone; equal document ids stay next to one another, in order of their text; a null id
sorts first and is read back as null; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import shared
from gridloom.llm.textarrays import pieces, span_hashes, utf8

MANIFEST = "file string, first_id long, n_docs long, n_ids long, width int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_NULL_ID = np.iinfo(np.int64).min

#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1 << 20

#: Bytes of text that a worker encodes at a time; a longer text is encoded whole.
PIECE = 1 << 18

# The classes of the tokenizer's published pre-token pattern, and its contractions.
_LETTER, _NUMBER, _SPACE, _OTHER, _ODD = range(5)
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    table = np.full(0x110000, _ODD, np.uint8)
    for c in [*range(0x590), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]:
        kind = unicodedata.category(chr(c))
        if kind != "Cn":
            table[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    table[list(_WHITE)] = _SPACE
    return table


def _spelling() -> np.ndarray:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u2")
    table[own] = own
    rest = [b for b in range(256) if b not in own]
    table[rest] = 256 + np.arange(len(rest))
    return table


def pre_token_starts(cp: np.ndarray, kind: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a pre-token starts; off: offsets of the texts."""
    n = len(cp)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    head = cut[:-1]
    white = kind == _SPACE
    before_white = np.zeros(n, bool)
    before_white[1:] = white[:-1]
    before_white &= ~head
    blank = np.zeros(n, bool)
    blank[1:] = cp[:-1] == 32
    last = np.zeros(n, bool)
    last[:-1] = ~white[1:]
    last &= ~cut[1:]
    start = np.where(white, head | ~before_white | last, head | (~before_white & ~same) | (before_white & ~blank))
    at = np.flatnonzero((cp == 39) & start & ~white)
    if len(at):
        end = off[np.searchsorted(off, at, "right")]
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        length = np.zeros(len(at), np.int64)
        for c in _CONTRACTIONS:
            hit = (length == 0) & (at + len(c) < end)
            for j, x in enumerate(c):
                hit &= pad[at + 1 + j] == ord(x)
            length[hit] = len(c)
        at, length, end = at[length > 0], length[length > 0], end[length > 0]
        start[at + 1] = False
        rest = at + 1 + length
        start[rest[rest < end]] |= kind[rest[rest < end]] == _LETTER
    return start


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values() if x.content]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kinds = _classes()
        self.spelling = _spelling()
        if hasattr(self.tok.model, "_resize_cache"):  # each pre-token comes here once, so the model's own memory only costs time
            self.tok.model._resize_cache(0)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, keys: np.ndarray, tokens: list[str]) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        tokenize = self.tok.model.tokenize
        made = [[y.id for y in tokenize(x)] for x in tokens]
        size = np.fromiter(map(len, made), np.int64, len(made))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), np.uint32, int(size.sum()))])
        into = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.at, self.size = np.insert(self.keys, into, keys), np.insert(self.at, into, at), np.insert(self.size, into, size)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key among the known ones, and whether it is one."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the offsets of the texts in them."""
        text = buf.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        pos = heads[off]
        n = len(off) - 1
        kind = self.kinds[cp]
        if len(cp) != pos[-1] or (kind == _ODD).any() or any(x in text for x in self.added):
            if n == 1:
                ids = self.whole(text)
                return ids, np.array([0, len(ids)])
            parts = [self.encode(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]])) for i in range(n)]
            return np.concatenate([x[0] for x in parts]), np.concatenate([[0], np.cumsum([len(x[0]) for x in parts])])
        starts = np.flatnonzero(pre_token_starts(cp, kind, pos)) if len(cp) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        distinct, first, inverse = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        _, known = self.find(distinct)
        if not known.all():
            if len(self.keys) + len(distinct) > REMEMBERED:
                self.forget()
                known[:] = False
            new = first[~known]
            spelled = self.spelling[buf].tobytes().decode("utf-16-le")
            byte = np.append(np.flatnonzero(heads[1:] > heads[:-1]), len(buf))
            self.learn(distinct[~known], [spelled[a:b] for a, b in zip(byte[starts[new]].tolist(), byte[ends[new]].tolist(), strict=True)])
        where, _ = self.find(distinct)
        size, at = self.size[where][inverse], self.at[where][inverse]
        made = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - made[:-1], size) + np.arange(made[-1])]
        return ids, made[np.searchsorted(starts, pos)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, off[1:], end_id), off + np.arange(len(off))


def _encoded(batches: Iterator[pa.RecordBatch], coder: Encoder, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, their numbers of ids and all their ids, some texts at a time."""
    for batch in batches:
        docs = batch.column(0).fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False).astype("<i8")
        buf, off = utf8(batch.column(1))
        for i, j in pieces(off, PIECE):
            out, at = _with_end(*coder.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i]), end_id)
            yield docs[i:j], np.diff(at), out


def write_token_files(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write df's documents in ascending order of id and return the manifest with each part's base."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, name = encoder(tokenizer), uuid.uuid4().hex
        dtype = np.dtype("<u2" if coder.width == 2 else "<u4")
        doc_ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def encoded():
            for docs, size, out in _encoded(batches, coder, end_id):
                doc_ids.append(docs)
                sizes.append(size)
                yield out.astype(dtype).tobytes()

        parts = encoded()
        head = next(parts, None)
        if head is None:
            return

        def stream():
            yield head
            yield from parts

        shared.write_bytes(f"{folder}/{name}.bin", stream())
        docs, size = np.concatenate(doc_ids), np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype("<i8")
        shared.write_bytes(f"{folder}/{name}.idx", [offsets.tobytes(), docs.tobytes()])
        yield pa.RecordBatch.from_pydict({"file": [name], "first_id": [int(docs[0])], "n_docs": [len(docs)], "n_ids": [int(offsets[-1])], "width": [coder.width]}, schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    # One small row per partition, so the driver can sum them; a part whose task ran twice is listed once.
    with shared.small_batches(spark):
        parts = sorted(rows.mapInArrow(write, MANIFEST).collect(), key=lambda r: r.first_id)
    bases = np.concatenate([[0], np.cumsum([r.n_ids for r in parts], dtype=np.int64)])
    schema = f"{MANIFEST}, base long"
    manifest = [(r.file, r.first_id, r.n_docs, r.n_ids, r.width, int(b)) for r, b in zip(parts, bases, strict=False)]
    spark.createDataFrame(manifest, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.createDataFrame(manifest, schema)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: its id, first place in the whole sequence, number of ids and their checksum."""
    parts = spark.read.parquet(f"{folder}/manifest").collect()  # one row per part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                index = shared.map_bytes(f"{folder}/{p['file']}.idx", "<i8")
                ids = shared.map_bytes(f"{folder}/{p['file']}.bin", "<u2" if p["width"] == 2 else "<u4")
                n = p["n_docs"]
                off, docs = index[: n + 1], index[n + 1 :]
                for i in range(0, n, 10_000):
                    at = np.asarray(off[i : min(n, i + 10_000) + 1])
                    crc = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    doc = np.asarray(docs[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == _NULL_ID), pa.array(at[:-1] + p["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = f"{MANIFEST}, base long"
    if not parts:
        return spark.createDataFrame([], ROWS)
    table = spark.sparkContext.parallelize([tuple(p) for p in parts], len(parts)).toDF(schema)
    return table.mapInArrow(read, ROWS)
