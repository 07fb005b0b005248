"""Approximate nearest neighbours by learned partitions.

On a sample of at most SAMPLE vectors (those of smallest hash; a documented bound) the neighbour graph is cut into balanced
parts, a small softmax classifier learns the parts of a vector's neighbours, and queries of the sample that it has not
seen choose how many parts a query must visit for RECALL. There is a part for every PART_ROWS rows of the table, as far as
the sample can tell parts apart. Then every row of the table is indexed in its most probable part, and a query visits its
most probable ones, whose rows are reranked by exact inner product. Queries for which these parts held fewer than k rows
are searched again in all parts.

Vectors of different lengths never meet. Each length with LEAST_SAMPLE rows in the sample has its own classifier; the
vectors of any other length are one part, searched whole.

A part is stored in blocks of about BLOCK rows, so a part with a third of all rows is many blocks; queries are sent to
blocks in blocks. On vectors without clusters many parts must be visited to find 9 of 10 neighbours; the number follows
from the sample and is not a constant.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without id; rows with the query's id are its own; a query row that is repeated is one query, a candidate row that is
repeated is a candidate each time; equal scores go to the smaller vec_id; an empty table gives an empty result; columns but
vec_id and embedding are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SAMPLE, PART_ROWS, RECALL, K, EVERY = 8192, 1024, 0.96, 20, 20
#: Sample rows that a part needs at least, and those from which on a length has a classifier.
PART_SAMPLE, LEAST_SAMPLE = 64, 256


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of largest inner product of each row, without itself."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Parts of about equal size that cut few edges: balanced clusters first, then nodes move to where their neighbours are."""
    n = len(x)
    room = -(-n * 21 // (parts * 20))
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(5):
        s = x @ centre.T
        part, size = np.full(n, -1), np.zeros(parts, np.int64)
        for i in np.argsort(-s.max(axis=1)):
            for p in np.argsort(-s[i]):
                if size[p] < room:
                    part[i] = p
                    size[p] += 1
                    break
        centre = np.stack([x[part == p].mean(axis=0) if size[p] else centre[p] for p in range(parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[graph[i]], minlength=parts)
            votes[size >= room] = -1
            votes[part[i]] += 1
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights that give the share of a vector's neighbours (and its own place) in each part."""
    y = np.zeros((len(x), parts))
    for c in (graph.T if graph.size else []):
        y[np.arange(len(x)), part[c]] += 1
    y[np.arange(len(x)), part] += max(1, graph.shape[1] // 2)
    y /= y.sum(axis=1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) / len(x)
        for i, (a, d) in enumerate(((w, x.T @ g + 1e-5 * w), (b, g.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            a -= 0.3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    return w, b


class Router:
    """The classifier and the number of parts that a query visits."""

    def __init__(self, x: np.ndarray, parts: int, k: int = K, recall: float = RECALL, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        self.norm = float(np.median(np.linalg.norm(x, axis=1))) or 1.0
        x = x / self.norm
        self.dim, n = x.shape[1], len(x)
        self.parts = max(1, min(parts, n // PART_SAMPLE))
        apart = rng.choice(n, min(256, n // 5), replace=False)
        rest = np.setdiff1d(np.arange(n), apart)
        if self.parts == 1 or not len(apart):
            self.w, self.b, self.visit = np.zeros((self.dim, 1)), np.zeros(1), 1
            self.parts = 1
            return
        own = x[rest]
        graph = neighbour_graph(own, 10)
        part = balanced_parts(own, graph, self.parts, rng)
        self.w, self.b = fit_router(own, part, graph, self.parts)
        at = self.route(x[rest] * self.norm, 1)[:, 0]
        s = x[apart] @ own.T
        near = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
        order = self.route(x[apart] * self.norm, self.parts)
        where = np.argsort(order, axis=1)  # the place of each part in a query's order
        need = np.take_along_axis(where, at[near], axis=1)
        share = np.array([(need < m).mean() for m in range(1, self.parts + 1)])
        self.visit = int(np.argmax(share >= recall)) + 1
        self.measured = float(share[self.visit - 1])

    def route(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable parts of each row, best first."""
        z = (x.astype(np.float64) / self.norm) @ self.w + self.b
        return np.argsort(-z, axis=1, kind="stable")[:, :m]


def fit(rows: DataFrame, sample: int = SAMPLE, part_rows: int = PART_ROWS, **settings) -> dict[int, Router]:
    """Routers by vector length, fitted on at most sample rows. rows: a written table of vec_id, v."""
    total = rows.count()
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    out = {}
    for n, x in vectors.by_length(got).items():
        if len(x) >= LEAST_SAMPLE:
            # the length's share of the sample is taken as its share of the table
            out[n] = Router(x, max(1, round(total * len(x) / len(got) / part_rows)), **settings)
    return out


def routed(rows: DataFrame, routers: dict[int, Router], visit: int | None) -> DataFrame:
    """rows (vec_id, v) once for each of their visit most probable parts, with dim and part; None: as many as a query visits."""
    shared = rows.sparkSession.sparkContext.broadcast(routers)

    def run(batches):
        for b in batches:
            size = pc.list_value_length(b.column("v"))
            for n in pc.unique(size).to_pylist():
                own = b.filter(pc.equal(size, n))
                r = shared.value.get(n)
                if r is None:
                    p = np.zeros((own.num_rows, 1), np.int64)
                else:
                    x = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    p = r.route(x, r.visit if visit is None else visit)
                at = pa.array(np.repeat(np.arange(len(p)), p.shape[1]))
                got = own.take(at)
                yield pa.RecordBatch.from_arrays([got.column("vec_id"), got.column("v"), pa.array(np.full(len(at), n), pa.int32()), pa.array(p.ravel(), pa.int32())], ["vec_id", "v", "dim", "part"])

    return rows.mapInArrow(run, f"vec_id bigint, v {rows.schema['v'].dataType.simpleString()}, dim int, part int")


def nearest(rows: DataFrame, is_query, k: int = K, **settings) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found to each row for which is_query holds."""
    spark = rows.sparkSession
    common.prepare(spark)
    x = common.materialise(vectors.usable(rows).where(F.exists("v", lambda a: a != 0)), "ann-rows")
    routers = fit(x, **settings)
    cell = ["dim", "part"]
    index, n = vectors.with_blocks(common.materialise(routed(x, routers, 1), "ann-parts"), cell, vectors.BLOCK, "block")
    items = common.materialise(vectors.packed(index, [*cell, "block"], "items"), "ann-items")
    n = common.materialise(n, "ann-blocks")
    asked = common.materialise(x.where(is_query).dropDuplicates(["vec_id", "v"]), "ann-queries")

    def found(queries: DataFrame, visit: int | None) -> DataFrame:
        blocks, _ = vectors.with_blocks(common.materialise(routed(queries, routers, visit), "ann-sent"), cell, vectors.QUERIES, "qblock")
        sent = vectors.packed(blocks, [*cell, "qblock"], "queries").join(n, cell).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        pairs = sent.join(items, [*cell, "block"]).select("queries", "items")
        return common.materialise(vectors.best(vectors.search(pairs, lambda *a: vectors.top_of_block(*a, k), "double", k), k), "ann-found")

    first = found(asked, None)
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = common.materialise(asked.join(full.hint("merge"), "vec_id", "left_anti"), "ann-short")
    if short.isEmpty():
        return first
    again = found(short, max((r.parts for r in routers.values()), default=1))
    return first.join(short.select(F.col("vec_id").alias("query_id")).distinct().hint("merge"), "query_id", "left_anti").unionByName(again)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found to each row whose vec_id is divisible by 20."""
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
