"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document of a source wants target / source_size copies, between 0 and 2: whole copies are taken at once, and the
fraction is rounded dependently. A pair of fractions moves words from one document to the other, in a random direction
whose odds keep both expectations, until one of them is a whole number; the other goes on. Moves are measured in words,
so the words of a pair stay as they were and a source ends within one document of its target. Documents meet in chunks
of about CHUNK by hash; what is left of each chunk meets the rest of 64 others, and so on up a reduction tree, so no
task holds more than some chunks and there are log64(n) rounds. The last fraction of a source goes to the nearer whole.

Equal rows (same doc_id, source and size) are grouped with a map-side combine first and share their copies evenly, so a
row repeated a million times is one element. Randomness is a hash of the pair, so reruns agree.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source, sorted last; sources
without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
CHUNK = 64
_EPS = 1e-9


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight; targets stop at most times the source's size and the
    excess is shared among the rest by weight until none is above (solved at once: sources are full in the order of size over weight).

    The table of sources is an aggregate with a row per source, so ranking it needs no big sort.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = by.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    x = x.withColumn("left_words", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.col("left_words") / F.col("left_w"))
    x = x.withColumn("mark", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(every))
    level = F.coalesce(F.col("mark.level"), F.lit(float("inf")))
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def _uniform(*parts):
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items, seed: int):
    """Fold an array of (id, s, p) by pivotal pairs: (done: settled (id, up), rest: the fraction left or null)."""
    entry = "struct<id:bigint,s:double,p:double>"
    settled = "array<struct<id:bigint,up:boolean>>"

    def step(acc, b):
        a = acc["rest"]
        up = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"])  # words that may go from b to a
        down = F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
        moved = F.when(_uniform(a["id"], b["id"], F.lit(seed)) * (up + down) < down, up).otherwise(-down)
        pa, pb = a["p"] + moved / a["s"], b["p"] - moved / b["s"]
        whole = lambda p: (p < _EPS) | (p > 1 - _EPS)
        mark = lambda x, p: F.struct(x["id"].alias("id"), (p > 0.5).alias("up"))
        rest = lambda x, p: F.struct(x["id"].alias("id"), x["s"].alias("s"), p.alias("p")).cast(entry)
        both = F.struct(F.concat(acc["done"], F.array(mark(a, pa), mark(b, pb))).cast(settled).alias("done"), F.lit(None).cast(entry).alias("rest"))
        first = F.struct(F.concat(acc["done"], F.array(mark(a, pa))).cast(settled).alias("done"), rest(b, pb).alias("rest"))
        second = F.struct(F.concat(acc["done"], F.array(mark(b, pb))).cast(settled).alias("done"), rest(a, pa).alias("rest"))
        start = F.struct(acc["done"].alias("done"), rest(b, b["p"]).alias("rest"))
        return F.when(a.isNull(), start).when(whole(pa) & whole(pb), both).when(whole(pa), first).otherwise(second)

    return F.aggregate(items, F.struct(F.array().cast(settled).alias("done"), F.lit(None).cast(entry).alias("rest")), step)


def pivotal(fractions: DataFrame, chunks: int, seed: int = 7) -> DataFrame:
    """(id, up): which fractions are rounded up. fractions: source, id (unique), s > 0, 0 < p < 1; chunks: of the largest source."""
    item = F.struct((-F.col("s")).alias("o"), "id", "s", "p")  # large documents first: what is left is small
    plain = lambda xs: F.transform(F.array_sort(xs), lambda x: F.struct(x["id"].alias("id"), x["s"].alias("s"), x["p"].alias("p")))
    at, done, level = fractions, None, 0
    while True:
        got = at.groupBy("source", "chunk").agg(_fold(plain(F.collect_list(item)), seed + level).alias("f"))
        got = common.materialise(got, f"mix-level{level}")
        settled = got.select(F.explode("f.done").alias("d")).select("d.id", "d.up")
        done = settled if done is None else done.unionByName(settled)
        rest = got.where(F.col("f.rest").isNotNull()).select("source", "chunk", "f.rest.*")
        if chunks <= 1:
            return done.unionByName(rest.select("id", (F.col("p") >= 0.5).alias("up")))
        chunks, level = -(-chunks // CHUNK), level + 1
        at = rest.withColumn("chunk", F.floor(F.col("chunk") / CHUNK).cast("long"))


def copies(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """A row per distinct (doc_id, source, size): m equal rows, and the copies they take together.

    sized: doc_id, source, size. The result adds source_size, target, m and n.
    """
    items = common.materialise(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-items")
    targets = common.materialise(source_targets(items.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most), "mix-targets")
    want = F.col("target") / F.col("source_size") * F.col("m")
    x = items.join(targets, items["source"].eqNullSafe(targets["source"]), "inner").drop(targets["source"])
    x = x.withColumn("want", F.when(F.col("size") > 0, want).otherwise(0.0))
    x = x.withColumn("whole", F.floor(F.col("want") + _EPS)).withColumn("p", F.col("want") - F.col("whole"))
    x = x.withColumn("id", F.xxhash64("doc_id", "source", "size", F.lit(seed)))
    split = x.where((F.col("p") > _EPS) & (F.col("size") > 0))
    most_items = items.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-int(most_items) // CHUNK))
    fractions = split.select("source", "id", F.col("size").cast("double").alias("s"), "p", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(chunks)).alias("chunk"))
    # one row per id: should two ids be equal, a rounding may move, but no row is repeated
    ups = pivotal(fractions, chunks, seed).where("up").groupBy("id").agg(F.max(F.lit(1)).alias("up"))
    return x.join(ups, "id", "left").select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "m", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("n"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; a row per row of documents with the words it gives to the mix."""
    docs = common.table(spark, sf_dir, "documents")
    x = copies(docs.select("doc_id", "source", common.n_words("text").alias("size")))
    each = x.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    n = F.floor(F.col("n") / F.col("m")) + F.when(F.col("i") <= F.pmod("n", "m"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed table itself: the rows of docs, each as often as the mix takes it (none, once or twice)."""
    x = copies(docs.select("doc_id", "source", common.n_words("text").alias("size"))).where("n > 0").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), F.col("m").alias("mix_m"), F.col("n").alias("mix_n"))
    key = docs["doc_id"].eqNullSafe(x["mix_id"]) & docs["source"].eqNullSafe(x["mix_source"]) & (common.n_words(docs["text"]) == x["mix_size"])
    got = docs.join(x, key)
    once = got.where("mix_m = 1").withColumn("mix_take", F.col("mix_n"))
    # rows that share doc_id, source and size are numbered; equal ones are one row with a count first, so none of them is hot
    equal = got.where("mix_m > 1").groupBy(*[docs[c] for c in docs.columns], "mix_id", "mix_source", "mix_size", "mix_m", "mix_n").agg(F.count(F.lit(1)).alias("mix_equal"))
    upto = F.sum("mix_equal").over(Window.partitionBy("mix_id", "mix_source", "mix_size").orderBy(*[F.xxhash64(*docs.columns), *docs.columns]).rowsBetween(Window.unboundedPreceding, 0))
    more = F.least(F.greatest(F.pmod("mix_n", "mix_m") - upto + F.col("mix_equal"), F.lit(0)), F.col("mix_equal"))
    many = equal.withColumn("mix_take", F.col("mix_equal") * F.floor(F.col("mix_n") / F.col("mix_m")) + more).drop("mix_equal")
    return once.unionByName(many).where("mix_take > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_take")))).select(*[docs[c] for c in docs.columns])
