"""What the operators of this subpackage share: shared tables, worker set-up and vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes that part words: space, tab, newline, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="veilmap-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the planner the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilmap-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veilmap_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that materialise wrote and that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.__dict__["_veilmap_path"])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (a cluster ships it with --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def n_words(text) -> F.Column:
    """Words of a text column: runs of anything but space and the bytes 09 to 0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


#: What a worker keeps of words that come again.
KEPT_BYTES = 32 << 20


class Kept:
    """A dictionary of bounded size in bytes; emptied when it is full."""

    def __init__(self, most: int = KEPT_BYTES):
        self.of: dict[str, bytes] = {}
        self.most, self.size = most, 0

    def make_room(self, extra: int) -> bool:
        """Whether what was kept had to go."""
        full = self.size + extra > self.most and bool(self.of)
        if full:
            self.of.clear()
            self.size = 0
        return full

    def put(self, key: str, value: bytes) -> None:
        self.of[key] = value
        self.size += 160 + 4 * len(key) + len(value)


# --- vectorised hashing of words -----------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 of a byte array; span_hash reads any span's hash from them."""
    up, _ = _power_tables(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), the same for equal bytes wherever they stand."""
    _, down = _power_tables(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches again, in batches of about limit bytes of text (a longer text stands alone)."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(upto)) + 1, [b.num_rows]]).tolist()
        for a, c in zip(cuts, cuts[1:], strict=False):
            if c > a:
                yield b.slice(a, c - a)


def blocks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, about limit bytes at a time (a longer text stands alone), with the first one's index."""
    first, out, size = 0, [], 0
    for i, x in enumerate(texts):
        b = (x or "").encode("utf-8", "surrogatepass")
        if out and size + len(b) > limit:
            yield first, out
            first, out, size = i, [], 0
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, out


def split_words(parts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: (prefix sums, word starts, word ends, first word of each text and the total).

    inside says for each byte whether it belongs to a word; a text never shares a word with the next one.
    """
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    start, end = runs(inside[buf])
    ends = np.cumsum([len(p) + 1 for p in parts])
    firsts = np.concatenate([[0], np.searchsorted(start, ends)])
    return prefix_sums(buf), start, end, firsts
