"""Token ids in binary files of patched frame-of-reference blocks.

Documents are ranged by doc_id and tokenised where they are written. A file is a row of records: a group record with the
doc_ids and token counts of some documents, the blocks of their ids, and at the end an index of where blocks start. A
block subtracts its minimum, packs at the width that a percentile of its values needs (the cheapest of PERCENTILES), and
lists what does not fit as exceptions. Each record is one line of Spark's text sink (type, length, bytes, newline), so its
commit protocol guards against lost executors and any store works; files of higher number hold larger doc_ids.

Reading goes group by group, so memory is bounded by GROUP ids or one document. ``read_slice`` finds ids by the index.

The tokenizer is the library; parts of words that come again are kept (up to a size in bytes), and new ones go to its merges. Texts with characters for which that has not been shown equal are given to it whole.

The number of files follows the planner's size of the input (FILE_BYTES of it each), so a file stays far below the 2 GB that
can be read at once; writing fails, and does not leave what can't be read, where one would pass MOST_FILE.

Defined results: null text has the end id alone; null doc_ids come first; equal doc_ids are ordered by a hash of the text;
repeated rows each give their row; an empty table gives no rows; columns but doc_id and text are left out.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MODEL, END_ID = "word_bpe_49k.json", 2
BLOCK, GROUP = 1 << 15, 1 << 19
#: Estimates without statistics are huge, so the number of files has a border.
FILE_BYTES, MOST_FILE, MOST_FILES = 64 << 20, 2_000_000_000, 1 << 20
PERCENTILES = (100, 99, 97, 95, 90)

# letters, digits and others up to U+017F in the tokenizer's own parting of words
_ODD = re.compile("[^\t-\r -~¡-įı-ſ]|<\\|")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿĀ-ſ0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in turn from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Whole texts to ids, as the library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.letters = _byte_letters()
        self.parts = common.Kept(128 << 20)

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def part(self, part: str) -> bytes:
        """ids of a part of a word, from the library's merges at once, past its normaliser and splitter."""
        told = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(told)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if _ODD.search(t) else _PARTS.findall(t.lower()) for t in texts]
        parts = {p for s in split if s for p in s}
        kept = self.parts.of
        fresh = [p for p in parts if p not in kept]
        if self.parts.make_room(sum(map(len, fresh)) * 8 + 160 * len(fresh)):
            fresh = list(parts)
        for p in fresh:
            self.parts.put(p, self.part(p))
        return [self.whole(t) if s is None else b"".join(map(kept.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]


# --- blocks ----------------------------------------------------------------------------------------

_HEAD = struct.Struct("<HBIH")  # ids, width, minimum, exceptions


def _pack(v: np.ndarray, width: int) -> bytes:
    """Values below 2**width, 64 at a time into width words of 64 bits."""
    if width == 0:
        return b""
    rows = np.zeros((-(-len(v) // 64), 64), np.uint64)
    rows.ravel()[: len(v)] = v
    out = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        k, s = divmod(j * width, 64)
        out[:, k] |= rows[:, j] << np.uint64(s)
        if s + width > 64:
            out[:, k + 1] |= rows[:, j] >> np.uint64(64 - s)
    return out.tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint32)
    words = np.frombuffer(data, np.uint64).reshape(-1, width)
    out = np.empty((len(words), 64), np.uint64)
    for j in range(64):
        k, s = divmod(j * width, 64)
        x = words[:, k] >> np.uint64(s)
        if s + width > 64:
            x = x | words[:, k + 1] << np.uint64(64 - s)
        out[:, j] = x
    mask = np.uint64((1 << width) - 1)
    return (out.ravel()[:n] & mask).astype(np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    """One patched frame-of-reference block of at most 65535 ids."""
    low = int(ids.min()) if len(ids) else 0
    v = (ids - np.uint32(low)).astype(np.uint32)
    best = None
    if len(v):
        widths = np.frexp(v.astype(np.float64))[1]  # bits that each value needs
        up_to = np.cumsum(np.bincount(widths, minlength=33))
        for p in PERCENTILES:
            width = int(np.searchsorted(up_to, -(-len(v) * p // 100)))
            over = len(v) - int(up_to[width])
            size = -(-len(v) // 64) * 8 * width + 6 * over
            if best is None or size < best[0]:
                best = (size, width)
    width = best[1] if best else 0
    odd = np.flatnonzero(v >> np.uint32(width) if width < 32 else v[:0])
    fits = v.copy()
    fits[odd] = 0
    return _HEAD.pack(len(v), width, low, len(odd)) + _pack(fits, width) + odd.astype(np.uint16).tobytes() + v[odd].tobytes()


def decode_block(data: bytes) -> np.ndarray:
    n, width, low, k = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = -(-n // 64) * 8 * width
    v = _unpack(data[at : at + size], n, width)
    at += size
    if k:
        v[np.frombuffer(data, np.uint16, k, at)] = np.frombuffer(data[at + 2 * k : at + 6 * k], np.uint32)
    return v + np.uint32(low)


# --- files -----------------------------------------------------------------------------------------


def _record(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data


class FileWriter:
    """Records of one file, in order."""

    def __init__(self):
        self.at = self.ids = 0
        self.starts: list[tuple[int, int]] = []

    def _out(self, kind: bytes, data: bytes) -> bytes:
        r = _record(kind, data)
        self.at += len(r) + 1  # and the newline
        if self.at > MOST_FILE:
            raise ValueError("a token file grows past what can be read at once: write more files")
        return r

    def group(self, doc_ids: list[int | None], tokens: list[bytes]) -> Iterator[bytes]:
        known = np.array([d is not None for d in doc_ids], np.uint8)
        head = struct.pack("<I", len(doc_ids)) + known.tobytes() + np.array([d or 0 for d in doc_ids], np.int64).tobytes() + np.array([len(t) // 4 for t in tokens], np.uint64).tobytes()
        yield self._out(b"G", head)
        ids = np.frombuffer(b"".join(tokens), np.uint32)
        for i in range(0, len(ids), BLOCK):
            self.starts.append((self.at, self.ids + i))
            yield self._out(b"B", encode_block(ids[i : i + BLOCK]))
        self.ids += len(ids)

    def index(self) -> bytes:
        """Byte offset and first id of every block, and at the very end where this record begins."""
        begin = self.at
        return self._out(b"X", np.array(self.starts, np.uint64).tobytes() + struct.pack("<Q", begin))


def records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at + 1)
        yield data[at : at + 1], data[at + 5 : at + 5 + n]
        at += 6 + n


def read_groups(data: bytes) -> Iterator[tuple[list[int | None], list[int], np.ndarray]]:
    """(doc_ids, token counts, ids) of each group of a file."""
    docs, sizes, parts = None, None, []
    for kind, r in records(data):
        if kind == b"B":
            parts.append(decode_block(r))
            continue
        if docs is not None:
            yield docs, sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        docs, parts = None, []
        if kind == b"G":
            (n,) = struct.unpack_from("<I", r)
            known = np.frombuffer(r, np.uint8, n, 4)
            docs = [d if k else None for k, d in zip(known, np.frombuffer(r[4 + n : 4 + 9 * n], np.int64).tolist(), strict=True)]
            sizes = np.frombuffer(r[4 + 9 * n :], np.uint64).astype(np.int64).tolist()
    if docs is not None:
        yield docs, sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_slice(data: bytes, first: int, n: int) -> np.ndarray:
    """n ids of a file from the first-th on, by its index: only the blocks that hold them are decoded."""
    (begin,) = struct.unpack_from("<Q", data, len(data) - 9)
    (size,) = struct.unpack_from("<I", data, begin + 1)
    index = np.frombuffer(data[begin + 5 : begin + 5 + size - 8], np.uint64).reshape(-1, 2).astype(np.int64)
    k = max(0, int(np.searchsorted(index[:, 1], first, side="right")) - 1)
    out, got, skip = [], 0, first - (int(index[k, 1]) if len(index) else 0)
    while got < skip + n and k < len(index):
        at = int(index[k, 0])
        (size,) = struct.unpack_from("<I", data, at + 1)
        out.append(decode_block(data[at + 5 : at + 5 + size]))
        got += len(out[-1])
        k += 1
    return np.concatenate(out)[skip : skip + n] if out else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as token files below path, in ascending doc_id order."""
    spark = docs.sparkSession
    common.prepare(spark)

    def run(batches):
        tok, writer = tokenizer(model), FileWriter()
        end = struct.pack("<I", end_id)
        ids: list[int | None] = []
        tokens: list[bytes] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(writer.group(ids, tokens)), pa.binary())], ["value"])

        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            names = b.column("doc_id").to_pylist()
            for first, last in _portions(texts):
                for d, t in zip(names[first:last], tok.encode(texts[first:last]), strict=True):
                    ids.append(d)
                    tokens.append(t + end)
                    size += len(t) // 4 + 1
                    if size >= GROUP:
                        yield flush()
                        ids, tokens, size = [], [], 0
        if ids:
            yield flush()
        if writer.at:
            yield pa.RecordBatch.from_arrays([pa.array([writer.index()], pa.binary())], ["value"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // FILE_BYTES), MOST_FILES))
    x = x.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    x.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path, lineSep="\n")


def _portions(texts: list[str], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    common.prepare(spark)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part, at = int(re.search(r"part-(\d+)", name)[1]), 0
                for docs, sizes, ids in read_groups(content.as_py()):
                    raw = memoryview(ids.tobytes())
                    off = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                    crc = [zlib.crc32(raw[4 * a : 4 * c]) for a, c in zip(off, off[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array([at + a for a in off[:-1]], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])
                    at += off[-1]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = common.materialise(files.mapInArrow(run, "part bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"), "tokens-read")
    # a row per file: their totals are added up in the order of files
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(base, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise every whole document into files, and read them back."""
    path = f"{common.shared_dir(spark)}/veilmap-tokens-{uuid.uuid4().hex}"
    write_tokens(common.table(spark, sf_dir, "documents"), path, common.tokenizer_path(MODEL))
    return read_documents(spark, path)
