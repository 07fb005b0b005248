"""Exact top-k inner products by norm buckets.

Rows are grouped by length into buckets (quantiles of length), and buckets into blocks of bounded size. A few blocks of the longest
rows give every query a lower bound of its k-th score. That bound over the query's length is the least length of a row that can
reach it, so a block of queries is joined only with buckets that hold such rows, and nothing else is shipped. In a bucket, the bound
over the product of both lengths is the cosine that a row must reach: above 1 the query skips the bucket; at COORD or more rows are pruned by the feasible range of the
query's largest coordinates; below it, by length alone. Products of what is left are verified in whole numbers.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id; rows
of another length in components are not compared; rows with the query's id are its own; equal scores go to the smaller
vec_id; a query row that is repeated is one query, a candidate row that is repeated is a candidate each time; an empty table
gives an empty result; columns but vec_id and embedding are left out. Scores are exact while they fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

K, EVERY, SCALE, COORD, FOCUS = 5, 50, 256.0, 0.75, 3
MOST_BUCKETS = 1000


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all of x."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def survivors(q: np.ndarray, q_len: float, x: np.ndarray, x_len: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of x that may reach the cosine, by the feasible range of the query's FOCUS largest coordinates."""
    unit = q / q_len
    keep = np.arange(len(x))
    side = np.sqrt(max(0.0, 1 - cosine * cosine))
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        spread = np.sqrt(max(0.0, 1 - unit[f] ** 2)) * side
        c = x[keep, f] / x_len[keep]
        # a cosine of t or more puts the row's coordinate within an angle of arccos t of the query's
        low = unit[f] * cosine - spread if unit[f] > -cosine else -1.0
        high = unit[f] * cosine + spread if unit[f] < cosine else 1.0
        keep = keep[(c >= low - 1e-9) & (c <= high + 1e-9)]
    return keep


def block_topk(qid, q, xid, x, bounds: dict[int, int] | None, k: int):
    """Each query's best k rows of a block that can be among its best; bounds: a lower bound of each query's k-th score."""
    x_len = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-x_len, kind="stable")
    x, xid, x_len = x[order], xid[order], x_len[order]
    least = np.array([bounds.get(int(i), -(1 << 63)) if bounds else -(1 << 63) for i in qid], np.int64)
    theta = least.astype(np.float64)
    longest = x_len[0] if len(x_len) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * longest > 0, theta / (q_len * longest), np.where(theta > 0, np.inf, -np.inf))
    out: list[tuple] = []

    def keep(i: int, at: np.ndarray, s: np.ndarray) -> None:
        ok = (s >= least[i]) & (xid[at] != qid[i])
        at, s = at[ok], s[ok]
        first = np.lexsort((xid[at], -s))[:k]
        out.append((np.full(len(first), qid[i]), xid[at[first]], s[first]))

    dense = []
    for i in np.flatnonzero(local <= 1 + 1e-9):
        if local[i] >= COORD:
            at = survivors(q[i].astype(np.float64), q_len[i], x, np.maximum(x_len, 1e-300), min(1.0, local[i]))
            keep(i, at, products(q[i : i + 1], x[at])[0])
        else:
            dense.append(i)
    if dense:
        need = min((theta[i] / q_len[i] if q_len[i] > 0 else -np.inf) for i in dense)
        n = len(x) if need <= 0 else int(np.searchsorted(-x_len, -need * (1 - 1e-9), side="right"))
        s = products(q[dense], x[:n])
        own = qid[dense][:, None] == xid[None, :n]
        for r, i in enumerate(dense):
            # the query's own rows, however many, leave before the cut
            others = np.flatnonzero(~own[r])
            row = s[r, others]
            if len(row) > 4 * k:
                cut = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= cut)
            else:
                at = np.arange(len(row))
            keep(i, others[at], row[at])
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


def top_products(rows: DataFrame, is_query, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query."""
    spark = rows.sparkSession
    common.prepare(spark)
    whole = vectors.usable(rows).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    whole = whole.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    x = common.materialise(whole, "topk-rows")
    total = x.count()
    n = max(1, min(MOST_BUCKETS, total // (4 * vectors.BLOCK)))
    cuts = x.select(F.percentile_approx("size", F.array(*[F.lit(1 - i / n) for i in range(1, n)]), F.lit(10_000)).alias("c")).first()["c"] if n > 1 else []
    # longest first: the bucket is the number of cuts above the row's length
    bucket = F.lit(0)
    if cuts:
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("size")))
    x = common.materialise(x.select("vec_id", "v", "size", bucket.alias("bucket")), "topk-buckets")
    # a row per bucket, MOST_BUCKETS at most
    longest = x.groupBy("bucket").agg(F.max("size").alias("longest")).orderBy("bucket").collect()
    index, n_blocks = vectors.with_blocks(x.select("vec_id", "v", "bucket"), ["bucket"], vectors.BLOCK, "block")
    items = common.materialise(vectors.packed(index, ["bucket", "block"], "items"), "topk-items")
    asked = x.where(is_query).select("vec_id", "v", "size").dropDuplicates(["vec_id", "v"])
    groups = max(1, -(-asked.count() // vectors.QUERIES))
    asked = common.materialise(asked.withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.lit(groups))), "topk-asked")
    sent = common.materialise(vectors.packed(asked, ["qblock"], "queries"), "topk-queries")
    n_blocks = common.materialise(n_blocks, "topk-blocks")

    def against(blocks: DataFrame, some: int | None) -> DataFrame:
        # blocks: qblock, queries, [bounds,] upto (buckets that its queries need); each meets each block of those buckets once
        cells = blocks.select("qblock", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)).alias("bucket")).join(n_blocks, "bucket")
        cells = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("blocks"), F.lit(some or (1 << 30))).cast("long") - 1))).drop("blocks")
        return cells.join(blocks.drop("upto"), "qblock").join(items, ["bucket", "block"])

    seeds = vectors.best(vectors.search(against(sent.withColumn("upto", F.lit(1)), 2).select("queries", "items"), lambda *a: block_topk(*a, None, k), "bigint", k), k)
    bound = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("b"))
    per = asked.join(bound, "vec_id", "left").withColumn("need", F.when(F.col("size") > 0, F.col("b") / F.col("size")))
    per = per.groupBy("qblock").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("b").isNotNull(), F.struct("vec_id", "b")))).alias("bounds"),
        F.min(F.coalesce("need", F.lit(float("-inf")))).alias("need"),
    )
    reach = F.array(*[F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["longest"]).alias("longest")) for r in longest]) if longest else None
    upto = F.lit(1)
    if longest:
        upto = F.coalesce(F.array_max(F.transform(F.filter(reach, lambda r: r["longest"] * (1 + 1e-9) >= F.col("need")), lambda r: r["bucket"])), F.lit(0)) + 1
    sent = common.materialise(sent.join(per.withColumn("upto", upto).drop("need"), "qblock"), "topk-bounded")
    pairs = against(sent, None).repartition("qblock", "bucket", "block").select("queries", "items", "bounds")
    found = vectors.search(pairs, lambda a, b, c, d, e: block_topk(a, b, c, d, dict(e or []), k), "bigint", k)
    return vectors.best(found, k)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of each row whose vec_id is divisible by 50."""
    return top_products(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.w as double[]), cast(c.w as double[])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
