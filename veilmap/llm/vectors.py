"""Blocks of vectors and the search of query blocks against them, for the two searches of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERIES = 2048, 256
FOUND = "query_id bigint, vec_id bigint, score {}"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that hold no null or non-finite component."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def with_blocks(rows: DataFrame, cell: list[str], size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with a block number in their cell, so that about size rows share a block, and (cell, blocks): how many each has.

    rows must be a written table. A cell with many rows gets many blocks; the number comes from a hash of the row.
    """
    n = rows.groupBy(*cell).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias(f"{name}s"))
    return rows.join(n, cell).withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(f"{name}s"))).drop(f"{name}s"), n


def packed(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """One row per keys with its vectors as an array."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("vec_id", "v")).alias(out))


def by_length(v: pa.Array) -> dict[int, np.ndarray]:
    """The vectors of a list column that holds no nulls, by number of components."""
    size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    where = np.repeat(size, size)
    return {int(n): flat[where == n].reshape(-1, n) for n in np.unique(size) if n}


def matrices(items: pa.Array, i: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of row i of a packed column, by number of components."""
    s = items[i].values
    ids, v = s.field("vec_id").to_numpy(zero_copy_only=False), s.field("v")
    size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    where = np.repeat(size, size)
    return {int(n): (ids[size == n], flat[where == n].reshape(-1, n) if n else np.zeros((int((size == 0).sum()), 0), flat.dtype)) for n in np.unique(size)}


#: Found rows that a task keeps before it passes on what is no more than each query's k best.
MOST_FOUND = 1 << 20


def merged(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query among (query_id, vec_id, score) columns."""
    qid, vid, score = (np.concatenate([f[c] for f in found]) for c in range(3))
    order = np.lexsort((vid, -score, qid))
    qid, vid, score = qid[order], vid[order], score[order]
    keep = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[keep], vid[keep], score[keep]


def search(pairs: DataFrame, find: Callable, kind: str, k: int) -> DataFrame:
    """(query_id, vec_id, score) that find gives for each row (queries, items) of pairs; only vectors of one length meet.

    A task merges what its rows give, so what leaves it follows its queries and not the blocks that they met.
    """

    def batch(found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64() if kind == "double" else pa.int64())], ["query_id", "vec_id", "score"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                asked, there = matrices(b.column("queries"), i), matrices(b.column("items"), i)
                more = [b.column(c)[i].as_py() for c in b.schema.names if c not in ("queries", "items")]
                for n in asked.keys() & there.keys():
                    got = find(*asked[n], *there[n], *more)
                    held.append(got)
                    size += len(got[0])
                if size > MOST_FOUND:
                    held = [merged(held, k)]
                    size = len(held[0][0])
                    if size > MOST_FOUND // 2:
                        yield batch(held.pop())
                        size = 0
        if size:
            yield batch(merged(held, k))

    return pairs.mapInArrow(run, FOUND.format(kind))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: query_id, rank, vec_id, score; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added component by component in double precision, so equal vectors score the same anywhere."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j].astype(np.float64) * x[:, j].astype(np.float64)
    return out


def top_of_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k largest inner products in a block, without rows of its own id."""
    s = q.astype(np.float64) @ x.astype(np.float64).T
    s[qid[:, None] == xid[None, :]] = -np.inf
    if s.shape[1] > k:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        slack = 1e-9 * np.maximum(1, np.abs(cut))
        rows, cols = np.nonzero((s >= np.where(np.isfinite(cut), cut - slack, -np.inf)[:, None]) & np.isfinite(s))
    else:
        rows, cols = np.nonzero(np.isfinite(s))
    score = exact_scores(q[rows], x[cols])
    order = np.lexsort((xid[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return qid[rows[keep]], xid[cols[keep]], score[keep]
