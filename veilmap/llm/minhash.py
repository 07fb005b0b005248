"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text is the weighted set of its shingles of five lower-case words (fewer words: one shingle of all). A shingle weighs its
count times an inverse document frequency ln(1 + 1 / (share + SMOOTH)), where share is the part of documents that hold it.
Document frequencies are counted over all documents in a hashed table of fixed size: its error is a fixed share of the
corpus (shingles per document / CELLS), so weights mean the same at any size, and what is broadcast does not grow. SMOOTH
keeps copies in groups of any size alike: a shingle of a third of all documents still weighs 0.93 of a rare one, one of all
documents 0.81. What is left of the difference loses no link, as plain similarity (all shingles weigh their counts) links too.

Each document gives BANDS * ROWS consistent samples; parameters (r, c, beta) of a shingle come from a table of 65,536 independent draws
per sample, and beta is rotated by the shingle's own hash. Equal weighted sets are one element from here on. Elements that
share a band are candidates. Every bucket first compares its members with a hub, the member with the most company in all its
buckets. Buckets whose members are then still in different components are closed exactly: their members meet by connected
candidates in pairs of blocks of bounded size, each block pair's similarities are one sparse product over the shingles
that it shares, and only links that join components leave the task. Members of a group's main component are not compared
with each other again, so the work follows those that the hub did not reach. Links are what weighted or plain Jaccard verifies, on
the whole texts; classes are the components.

Defined results: texts without words (null or empty) are in no class but their own; class_id is the smallest doc_id of the
class (null if none has one); rows that repeat are one class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 4
CELLS, SLICE, SMOOTH = 1 << 18, 1 << 14, 4.0
_INSIDE = ~common.BLANK
_Q = np.array([pow(0xD1342543DE82EF95, j, 1 << 64) for j in range(WORDS)], np.uint64)


def shingle_sets(parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes in order, their counts) of each text; texts are lower case already."""
    sums, start, end, firsts = common.split_words(parts, _INSIDE)
    h = common.span_hash(sums, start, end)
    n = len(h)
    roll = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for j in range(WORDS):
        roll += h[j : n - WORDS + 1 + j] * _Q[j]
    roll = common.mix(roll)
    out = []
    for a, b in zip(firsts.tolist(), firsts[1:].tolist(), strict=False):
        if b - a >= WORDS:
            s = roll[a : b - WORDS + 1]
        elif b > a:
            s = common.mix(np.array([(h[a:b] * _Q[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        out.append(np.unique(s, return_counts=True))
    return out


def sets_of(texts: list[str | None]):
    for _, parts in common.blocks([(t or "").lower() for t in texts]):
        yield from shingle_sets(parts)


def idf_table(docs: DataFrame) -> np.ndarray:
    """The weight of each cell of hashed shingles, from all documents."""
    common.prepare(docs.sparkSession)

    def count(batches):
        cells, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            texts = b.column("text").to_pylist()
            n += len(texts)
            for _, parts in common.blocks([(t or "").lower() for t in texts]):
                every = [s for s, _ in shingle_sets(parts)]
                cells += np.bincount((np.concatenate(every) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if n:
            rows = [(i, cells[i * SLICE : (i + 1) * SLICE].tobytes()) for i in range(CELLS // SLICE)] + [(-1, np.array([n]).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "cells"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("slice").to_pylist(), b.column("cells").to_pylist(), strict=True):
                c = np.frombuffer(c, np.int64)
                total[i] = total[i] + c if i in total else c
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["slice", "cells"])

    kind = "slice int, cells binary"
    # a table of fixed size comes to the driver, whatever the corpus
    got = {r["slice"]: np.frombuffer(bytes(r["cells"]), np.int64) for r in docs.select("text").mapInArrow(count, kind).repartition(CELLS // SLICE, "slice").mapInArrow(add, kind).collect()}
    if not got:
        return np.ones(CELLS, np.float32)
    share = np.concatenate([got[i] for i in range(CELLS // SLICE)]) / got[-1][0]
    return np.log1p(1 / (np.minimum(share, 1.0) + SMOOTH)).astype(np.float32)


class Sampler:
    """Consistent samples of weighted sets."""

    #: A minimum is above (this power of e) / weight once in exp(e ** REACH) times, about 1 in 1,600.
    REACH = 2.0

    def __init__(self, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        self.idf, self.bands, self.rows = idf, bands, rows
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.r = rng.gamma(2, 1, (k, 1 << 16)).astype(np.float32)
        self.inv = 1 / self.r
        self.lnc = (np.log(rng.gamma(2, 1, (k, 1 << 16))) - self.r).astype(np.float32)
        self.beta = rng.random((k, 1 << 16), np.float32)
        self.low = np.ascontiguousarray(self.lnc.T)
        self.salt = common.mix(np.arange(1, k + 1, dtype=np.uint64))

    def weights(self, x: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[(x & np.uint64(CELLS - 1)).astype(np.int64)]

    def values(self, k: np.ndarray, x: np.ndarray, lw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithm to be minimised, step) of shingles x of logarithmic weight lw in samples k."""
        row = (x >> np.uint64(20) & np.uint64(0xFFFF)).astype(np.int64)
        beta = self.beta[k, row] + (x >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        beta -= beta >= 1
        step = np.floor(self.inv[k, row] * lw + beta)
        return self.lnc[k, row] - self.r[k, row] * (step - beta), step

    def bands_of(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The keys of the bands of weighted sets (shingles, weights) that are not empty, a row each.

        A value lies above ``low`` less the logarithm of the weight. So what is below a border that the minimum hardly ever
        passes is found by one comparison, and worked out; where the minimum does pass it, all of the set is worked out.
        """
        k, docs = len(self.r), len(sets)
        x, w = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
        first = np.concatenate([[0], np.cumsum([len(s[0]) for s in sets])])
        lw = np.log(w).astype(np.float32)
        reach = (self.REACH - np.log(np.add.reduceat(w.astype(np.float64), first[:-1]))).astype(np.float32)
        doc = np.repeat(np.arange(docs), np.diff(first))
        border = reach[doc] + lw + np.float32(1e-3)
        low = np.full(docs * k, np.inf, np.float32)
        arg, step = np.zeros(docs * k, np.int64), np.zeros(docs * k, np.float32)
        for i in range(0, len(x), 4096):
            row = (x[i : i + 4096] >> np.uint64(20) & np.uint64(0xFFFF)).astype(np.int64)
            near = np.flatnonzero(self.low.take(row, axis=0) <= border[i : i + 4096, None])
            at, j = np.divmod(near, k)
            at += i
            self._keep(low, arg, step, doc[at] * k + j, at, j, x[at], lw[at])
        for cell in np.flatnonzero(low > np.repeat(reach, k)).tolist():
            d, j = divmod(cell, k)
            for i in range(first[d], first[d + 1], 65536):
                at = np.arange(i, min(i + 65536, first[d + 1]))
                self._keep(low, arg, step, np.full(len(at), cell), at, np.full(len(at), j), x[at], lw[at])
        sample = x[arg] + step.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sample = common.mix(sample.reshape(docs, k) ^ self.salt)
        return common.mix(sample.reshape(docs, self.bands, self.rows).sum(axis=2, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64))

    def _keep(self, low: np.ndarray, arg: np.ndarray, step: np.ndarray, cell: np.ndarray, at: np.ndarray, j: np.ndarray, x: np.ndarray, lw: np.ndarray) -> None:
        """Put the smallest values into their cells, the first of equal ones."""
        a, t = self.values(j, x, lw)
        before = low[cell]
        np.minimum.at(low, cell, a)
        best = np.flatnonzero((a == low[cell]) & (a < before))[::-1]
        arg[cell[best]], step[cell[best]] = at[best], t[best]

    @staticmethod
    def identity(x: np.ndarray, tf: np.ndarray) -> int:
        """A 64-bit hash of the weighted set."""
        return int(common.mix(x ^ common.mix(tf.astype(np.uint64))).sum(dtype=np.uint64).astype(np.int64))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, rk (hash of the text), fp (of the weighted set; null without words), weight, bands: written to the shared folder."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(idf)
    made: list[Sampler] = []

    def run(batches):
        if not made:
            made.append(Sampler(shared.value))
        s = made[0]
        for b in batches:
            fp, weight, bands, todo = [], [], [], []

            def sample():
                if todo:
                    got = s.bands_of([t[1:] for t in todo]).astype(np.int64)
                    for (i, *_), g in zip(todo, got, strict=True):
                        bands[i] = g
                    todo.clear()

            held = 0
            for x, tf in sets_of(b.column("text").to_pylist()):
                bands.append(None)
                if not len(x):
                    fp.append(None), weight.append(None)
                    continue
                w = s.weights(x, tf)
                fp.append(s.identity(x, tf)), weight.append(float(w.sum()))
                todo.append((len(bands) - 1, x, w))
                held += len(x)
                if held > 1 << 18:
                    sample()
                    held = 0
            sample()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(fp, pa.int64()), pa.array(weight, pa.float64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "rk", "fp", "weight", "bands"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text")
    return common.materialise(x.mapInArrow(run, "doc_id bigint, rk bigint, fp bigint, weight double, bands array<bigint>"), "dedup-signatures")


def similarity(idf: np.ndarray, a: tuple, b: tuple) -> float:
    """Jaccard similarity of two shingle sets: the larger of the weighted and the plain one."""
    (x, tx), (y, ty) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    own = idf[(y & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.float64)
    both = float((np.minimum(tx[at], ty)[same] * own[same]).sum())
    whole = float((tx * idf[(x & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.float64)).sum()) + float((ty * own).sum())
    plain = float(np.minimum(tx[at], ty)[same].sum())
    return max(both / (whole - both), plain / (float(tx.sum() + ty.sum()) - plain))


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, with their similarity; texts: fp, text."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        kept: tuple = (None, None)
        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            out = []
            for p, q, t, u in zip(a, b, ta, tb, strict=True):
                if kept[0] != p:
                    kept = p, next(iter(sets_of([t])))
                s = similarity(shared.value, kept[1], next(iter(sets_of([u]))))
                if s >= similar:
                    out.append((p, q, s))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    right = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    whole = right.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
    return common.materialise(whole.mapInArrow(run, "a bigint, b bigint, similarity double"), "dedup-links")


def block_links(docs: list[tuple[int, int, int, str]], idf: np.ndarray, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links that join components among two blocks: docs are (fp, component, block, text); block -1 is main.

    Similarities come from one product over the shingles that several documents hold; a shingle held c times is c columns.
    """
    sets = list(sets_of([d[3] for d in docs]))
    size = np.array([len(x) for x, _ in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    x = np.concatenate([x for x, _ in sets])
    tf = np.concatenate([t for _, t in sets])
    weight = np.bincount(doc, weights=tf * idf[(x & np.uint64(CELLS - 1)).astype(np.int64)], minlength=len(sets))
    copy = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    x, doc = np.repeat(x, tf), np.repeat(doc, tf)
    col = common.mix(x + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(col, kind="stable")
    col, doc, x = col[order], doc[order], x[order]
    first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    held = np.diff(np.concatenate([first, [len(col)]]))
    number = np.repeat(np.cumsum(held > 1) - 1, held)
    shared = np.repeat(held > 1, held)
    every = idf[(x & np.uint64(CELLS - 1)).astype(np.int64)]
    number, doc, w = number[shared], doc[shared], np.sqrt(every[shared])
    step = max(256, (1 << 22) // len(sets))
    cuts = np.searchsorted(number, np.arange(0, (int(number[-1]) if len(number) else -1) + 1 + step, step))

    def product(w: np.ndarray, whole: np.ndarray) -> np.ndarray:
        both = np.zeros((len(sets), len(sets)), np.float32)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            m = np.zeros((len(sets), step), np.float32)
            m[doc[a:b], number[a:b] - k * step] = w[a:b]
            both += m @ m.T
        return both / (whole[:, None] + whole[None, :] - both)

    sim = product(w, weight)
    # plain similarity can reach the border only from here on; its product is made if pairs of two components lie between
    least = similar * float(every.min()) / (similar * float(every.min()) + (1 - similar) * float(every.max()))
    comp = np.unique([d[1] for d in docs], return_inverse=True)[1]
    if (np.triu((sim >= least - 1e-4) & (sim < similar + 1e-4), 1) & (comp[:, None] != comp[None, :])).any():
        sim = np.maximum(sim, product(np.ones(len(w), np.float32), np.bincount(np.repeat(np.arange(len(sets)), size), weights=tf, minlength=len(sets))))
    i, j = np.nonzero(np.triu(sim >= similar - 1e-4, 1))
    root = {d[1]: d[1] for d in docs}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(docs[p][1]), find(docs[q][1])
        # the product is in single precision: what is near the border is worked out exactly
        if a != b and (sim[p, q] >= similar + 1e-4 or similarity(idf, sets[p], sets[q]) >= similar):
            root[max(a, b)] = min(a, b)
            out.append((docs[p][0], docs[q][0]))
    return out


BLOCK_DOCS, BLOCK_CHARS, SALTS = 512, 4_000_000, 32


def closed(members: DataFrame, comp: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between components of members that share a bucket, none left out.

    Candidates are grouped by what buckets connect. A group's largest component is its main part; the others are compared with each
    other and with it, in pairs of blocks of about BLOCK_DOCS documents or BLOCK_CHARS characters.
    """
    spark = members.sparkSession
    # what grows with the corpus is shuffled, never broadcast
    at = common.materialise(members.join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("key", "fp", "hub", F.coalesce("comp", "fp").alias("comp")), "dedup-at")
    mixed = common.materialise(at.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key"), "dedup-mixed")
    open_ = common.materialise(at.join(mixed.hint("merge"), "key", "left_semi"), "dedup-open")
    groups = components(open_.select(F.col("hub").alias("a"), F.col("fp").alias("b")).where("a <> b"))
    rows = open_.select("fp", "comp").distinct().join(groups.select(F.col("node").alias("fp"), F.col("comp").alias("grp")).hint("merge"), "fp")
    rows = common.materialise(rows.join(texts.hint("merge"), "fp").select("grp", "comp", "fp", "text"), "dedup-rows")
    parts = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.sum("n") / BLOCK_DOCS, F.sum("chars") / BLOCK_CHARS))).cast("int")
    mains = common.materialise(parts.groupBy("grp").agg(F.max(F.struct("n", "comp"))["comp"].alias("main")), "dedup-mains")
    sides = common.materialise(parts.join(mains.hint("merge"), "grp").groupBy("grp", (F.col("comp") == F.col("main")).alias("is_main"), "main").agg(blocks.alias("nb")), "dedup-sides")
    wide = sides.groupBy("grp", "main").agg(F.max(F.when(F.col("is_main"), F.col("nb"))).alias("nm"), F.max(F.when(~F.col("is_main"), F.col("nb"))).alias("no")).where("no is not null")
    # a group may hold a third of all rows: its rows meet the sizes in SALTS places
    wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    x = rows.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit("salt")), F.lit(SALTS))).join(wide.hint("merge"), ["grp", "salt"]).withColumn("is_main", F.col("comp") == F.col("main"))
    x = x.withColumn("b", F.pmod(F.xxhash64("fp"), F.when(F.col("is_main"), F.col("nm")).otherwise(F.col("no"))).cast("int"))
    own = "struct(cast({} as int) as i, cast({} as int) as t)"
    cells = f"""if(is_main, transform(sequence(0, no - 1), i -> {own.format("i", "no + b")}),
        concat(transform(sequence(b, no - 1), t -> {own.format("b", "t")}), transform(sequence(0, nm - 1), m -> {own.format("b", "no + m")}),
               if(b = 0, cast(array() as array<struct<i:int,t:int>>), transform(sequence(0, b - 1), i -> {own.format("i", "b")}))))"""
    x = x.select("grp", "comp", "fp", "text", F.when(F.col("is_main"), -1).otherwise(F.col("b")).alias("b"), F.explode(F.expr(cells)).alias("c")).select("grp", "comp", "fp", "text", "b", "c.i", "c.t")
    # dealt by all three: else the planner keeps what the join has by group, and a group's block pairs stay in one task
    x = x.repartition("grp", "i", "t")
    shared = spark.sparkContext.broadcast(idf)

    def run(table: pa.Table) -> pa.Table:
        docs = list(zip(table["fp"].to_pylist(), table["comp"].to_pylist(), table["b"].to_pylist(), table["text"].to_pylist(), strict=True))
        got = block_links(docs, shared.value, similar)
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    return common.materialise(x.groupBy("grp", "i", "t").applyInArrow(run, "a bigint, b bigint"), "dedup-closed")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, rk, class_id, class_size, keep_id and keep_rk (the row that stands for its class)."""
    idf = idf_table(docs)
    sig = signatures(docs, idf)
    # rows of equal sets are one element
    sets = common.materialise(sig.where("fp is not null").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk")).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "dedup-sets")
    band = common.materialise(sets.select("fp", F.explode("bands").alias("key")), "dedup-bands")
    company = common.materialise(band.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup-company")
    members = common.materialise(band.join(company.hint("merge"), "key"), "dedup-members")
    degree = common.materialise(members.groupBy("fp").agg(F.sum("n").alias("degree")), "dedup-degree")
    ranked = common.materialise(members.join(degree.hint("merge"), "fp").select("key", "fp", "degree"), "dedup-ranked")
    hubs = common.materialise(ranked.groupBy("key").agg(F.max(F.struct("degree", "fp"))["fp"].alias("hub")), "dedup-hubs")
    members = common.materialise(ranked.join(hubs.hint("merge"), "key").select("key", "fp", "hub"), "dedup-members")
    needed = degree.select("fp").join(sets.select("fp", "rep").hint("merge"), "fp").select("fp", F.col("rep.doc_id").alias("need_id"), F.col("rep.rk").alias("need_rk"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text")
    # the list of needed rows grows with the corpus, so it is shuffled, never broadcast
    texts = source.join(needed.hint("merge"), (source["rk"] == needed["need_rk"]) & source["doc_id"].eqNullSafe(needed["need_id"])).select("fp", "text")
    texts = common.materialise(texts, "dedup-texts")
    if texts.count() > degree.count():  # the row that stands for a set is repeated
        texts = common.materialise(texts.groupBy("fp").agg(F.first("text").alias("text")), "dedup-texts")
    stars = members.where("fp <> hub").groupBy(F.col("hub").alias("a"), F.col("fp").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
    links = verified(stars, texts, idf, similar).select("a", "b")
    comp = components(links)
    more = closed(members, comp, texts, idf, similar)
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    of = sets.select("fp", "rep", "n").join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "rep", "n", F.coalesce("comp", "fp").alias("comp"))
    of = common.materialise(of, "dedup-of")
    heads = of.groupBy("comp").agg(F.min("rep").alias("head"), F.sum("n").alias("class_size"))
    by = common.materialise(of.join(heads.hint("merge"), "comp").select("fp", "head", "class_size"), "dedup-by")
    return sig.join(by.hint("merge"), "fp", "left").select("doc_id", "rk", F.when(F.col("head").isNotNull(), F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.when(F.col("head").isNotNull(), F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce(F.col("head.rk"), F.col("rk")).alias("keep_rk"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their classes: one row of each, with all its columns. Texts without words stay."""
    got = common.materialise(classes(docs), "dedup-classes")
    kept = got.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rk") == F.col("keep_rk")))
    kept = common.materialise(kept.groupBy(F.col("doc_id").alias("dd_id"), F.col("rk").alias("dd_rk")).agg(F.count(F.lit(1)).alias("dd_n")), "dedup-kept")
    x = docs.withColumn("dd_key", F.xxhash64("text"))
    x = x.join(kept.hint("merge"), (F.col("dd_key") == F.col("dd_rk")) & x["doc_id"].cast("long").eqNullSafe(F.col("dd_id")))
    empty = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "")) == ""
    many = x.where((F.col("dd_n") > 1) & ~empty).dropDuplicates(["dd_id", "dd_rk"])  # a row that is repeated as a whole
    return x.where((F.col("dd_n") == 1) | empty).unionByName(many).select(*docs.columns)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
