"""The training-data operators against brute force, round trips and odd inputs."""

import base64
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import compare
from veilmap.llm import ann, bpe, chat, common, components, exact_topk, lattice, minhash, mixing, queries, token_counts, token_files, toxicity, vectors, warc

SP = common.tokenizer_path(lattice.MODEL)
WORD = common.tokenizer_path(token_files.MODEL)
ODD = ["", None, " ", "  two  spaces ", "\n\t", "é 王 😀 ﬁ ß", "<s> </s> <|endoftext|>", "a" * 5000, "the cat " * 3000, "▁x ▁▁", "\x00\x1f", "İ Σ ς"]


def documents(spark, texts, **more):
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, extra bigint")
    return df.withColumn("size", F.lit("clash")).withColumn("b", F.lit(1)).withColumn("n", F.lit(None).cast("int"))


def words(n, seed=0, size=60):
    r = random.Random(seed)
    return [" ".join(f"w{r.randint(0, 5000)}" for _ in range(size)) for _ in range(n)]


# --- 1 ------------------------------------------------------------------------------------------------


def test_chat_sql(spark, sf):
    compare(chat.op1_chat_formatting(spark, sf), chat.OP1_SQL, sf)


def test_chat_null_turns(spark, tmp_path):
    """A null turn comes first, in the query and in its SQL."""
    rows = [(1, 1, "user", "b"), (1, None, "user", "z"), (1, 2, "assistant", "c"), (1, None, "assistant", None), (2, None, None, None), (2, 0, "assistant", "x <|im_end|>")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cols = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256"
    want = sorted(con.execute(f"select {cols} from ({chat.OP1_SQL})").fetchall())
    assert sorted(map(tuple, chat.op1_chat_formatting(spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect())) == want


def test_chat_trees(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}<|im_end|>\\", 1.0) for i in range(70)]
    rows += [(1, 100, 68, "assistant", "better", 9.0), (2, 1, 99, None, None, None), (3, 1, 2, "u", "c", 0.0), (3, 2, 1, "u", "c", 0.0), (3, 3, 2, "u", "c", 0.0)]
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    got = {(r["tree"], r["leaf"]): r for r in chat.format_trees(df).collect()}
    assert set(got) == {(1, 69), (1, 100), (2, 1)}
    assert chat.parse(got[1, 69]["formatted"]) == [(r[3], r[4]) for r in rows[:70]]
    assert chat.parse(got[2, 1]["formatted"]) == [("", "")]
    best = {r["tree"]: r["leaf"] for r in chat.format_trees(df, top=1).collect()}
    assert best == {1: 100, 2: 1}
    text, spans = got[1, 100]["formatted"], got[1, 100]["loss_spans"]
    assert [chat.unescape(text[s["start"] : s["end"]]) for s in spans][-1] == "better"
    assert chat.format_trees(df.limit(0)).count() == 0


def test_chat_escape(spark):
    texts = ["<|", "<\\|", "<\\\\|a<|im_start|>", "a<b|c", "", "<" * 5 + "|" * 5]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r")).collect()
    for r in got:
        assert "<|" not in r["e"] and chat.unescape(r["e"]) == r["t"] and chat.unescape_role(r["r"]) == r["t"]
    assert chat.unescape_role("a\\nb\\\\n") == "a\nb\\n"


# --- 2 ------------------------------------------------------------------------------------------------


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(full.values())
        want = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if want[s] > most * sizes[s]]
        if not over:
            return full | want
        full |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    texts = [*words(300, 1, 40), *words(40, 2, 300), "", None, "one"]
    docs = documents(spark, texts).drop("size")
    docs = docs.unionByName(docs.where("extra < 4"))
    sized = docs.select("doc_id", "source", common.n_words("text").alias("size"))
    got = mixing.copies(sized).collect()
    sizes: dict = {}
    for r in sized.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = filled(sizes)
    taken: dict = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["n"] <= 2 * r["m"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["n"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 300 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(sized.repartition(7)).collect()))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(common.n_words("text"))).first()[0] == sum(taken.values())
    assert mixing.copies(sized.limit(0)).count() == 0
    assert mixing.copies(sized.where("size = 0")).agg(F.sum("n")).first()[0] == 0


def test_mixing_query(spark, sf):
    got = mixing.op2_mixing(spark, sf).toPandas()
    assert len(got) == common.table(spark, sf, "documents").count() and (got.taken <= 2 * got["size"]).all()
    assert "Python" not in mixing.op2_mixing(spark, sf)._jdf.queryExecution().toString()


# --- 3 and 8 ------------------------------------------------------------------------------------------


def vector_rows(spark, extra=True):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(0, 1, 8).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    if extra:
        rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [1.0] * 7 + [None]), (2100, [float("inf")] * 8), (None, [1.0] * 8), (2120, [1.0] * 5)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(0)).withColumn("part", F.lit("x")), rows


def test_ann_recall_and_scores(spark):
    df, rows = vector_rows(spark)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    x = {i: np.array(v, np.float64) for i, v in rows if i is not None and i < 2000}
    hits = n = 0
    for q in {r["query_id"] for r in got}:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r["vec_id"] for r in own}
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(r["score"] == pytest.approx(float(x[q] @ x[r["vec_id"]]), abs=1e-12) for r in own)
        best = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        hits, n = hits + len(set(best) & {r["vec_id"] for r in own}), n + 20
    assert n and hits / n >= 0.9
    assert {r["query_id"] for r in got} == {i for i in x if i % 20 == 0}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_repeated_query(spark):
    x = np.random.default_rng(4).normal(size=(40, 8))
    rows = [(i, x[i].tolist()) for i in [0, 0, 0, *range(1, 40)]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == (1 + np.argsort(-(x[1:] @ x[0]))[:20]).tolist()


def by_query(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_ann_lengths(spark):
    """Vectors of every length are searched, among their own."""
    r = np.random.default_rng(6)
    x = {i: r.normal(size=8 if i < 700 else 5 if i < 760 else 3) for i in range(763)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id bigint, embedding array<double>")
    got = by_query(ann.nearest(df, F.col("vec_id") % 10 == 0, 20, part_rows=100))
    assert set(got) == {i for i in x if i % 10 == 0}
    hits = []
    for q, found in got.items():
        near = sorted((i for i in x if i != q and len(x[i]) == len(x[q])), key=lambda i: (-float(x[i] @ x[q]), i))[:20]
        assert len(found) == len(near)
        if len(x[q]) < 8:
            assert [f[0] for f in found] == near
        hits.append(len(set(near) & {f[0] for f in found}) / len(near))
    assert np.mean(hits) >= 0.9


def test_ann_short_parts(spark, monkeypatch):
    """Where the parts that a query visits hold fewer than k rows, all parts are searched."""
    monkeypatch.setattr(ann, "PART_SAMPLE", 8)
    r = np.random.default_rng(7)
    centre = r.normal(size=(40, 6)) * 20
    x = {i: centre[i % 40] + r.normal(size=6) * 0.01 for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id bigint, embedding array<double>")
    got = by_query(ann.nearest(df, F.col("vec_id") % 20 == 0, 60, part_rows=8))
    assert {q: len(f) for q, f in got.items()} == {q: 60 for q in range(0, 400, 20)}
    for q, found in got.items():
        assert len({f[0] for f in found}) == 60 and q not in {f[0] for f in found}


def test_topk_odd(spark):
    df, _ = vector_rows(spark)
    assert exact_topk.top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    some = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(8)] + [(0, [0.0, 1.0])] * 5, "vec_id bigint, embedding array<double>").withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(None).cast("int"))
    got = by_query(exact_topk.top_products(some, F.col("vec_id") == 0, 5, 1.0))
    assert got == {0: [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1)]}
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert by_query(exact_topk.top_products(zero, F.col("vec_id") == 0, 5, 1.0)) == {0: [(1, 0), (2, 0)]}


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_topk_buckets(spark, monkeypatch, most):
    """Many buckets, most of which a block of queries never meets; tasks that keep little pass on more."""
    monkeypatch.setattr(vectors, "MOST_FOUND", most)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    r = np.random.default_rng(8)
    x = {i: (r.normal(size=6) * 3.0 ** r.integers(0, 6)).round(2) for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id bigint, embedding array<double>")
    got = by_query(exact_topk.top_products(df, F.col("vec_id") % 50 == 0))
    w = {i: np.array([math.floor(256 * float(c)) for c in v]) for i, v in x.items()}
    for q in range(0, 900, 50):
        want = sorted((-int(w[q] @ w[i]), i) for i in w if i != q)[:5]
        assert got[q] == [(i, -v) for v, i in want]


def test_ann_query(spark, sf):
    assert ann.op3_ann(spark, sf).count() == 25 * 20


def test_ann_balance():
    x = np.random.default_rng(0).normal(0, 1, (500, 6))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 5, np.random.default_rng(1))
    assert np.bincount(part).max() <= 105


def test_topk_sql(spark, sf):
    compare(exact_topk.op8_exact_topk(spark, sf), exact_topk.OP8_SQL, sf)


@pytest.mark.parametrize("scale", [256.0, 1e8])  # the second passes what doubles hold exactly, and fits 64 bits
def test_topk_brute(spark, scale):
    df, rows = vector_rows(spark)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.top_products(df, F.col("vec_id") % 50 == 0, 5, scale).collect()}
    x = {i: [math.floor(scale * c) for c in v] for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    want = {}
    for q in (i for i in x if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q and len(x[i]) == len(x[q]))[:5]
        want |= {(q, k + 1): (i, -v) for k, (v, i) in enumerate(s)}
    assert got == want


def test_topk_pruning():
    """Coordinate pruning loses nothing."""
    r = np.random.default_rng(5)
    base = r.normal(0, 100, (20, 12))
    x = np.floor(base[r.integers(0, 20, 600)] + r.normal(0, 6, (600, 12))).astype(np.int64)
    ids = np.arange(600)
    bounds = {int(i): int(np.sort(x @ x[i])[-8]) for i in range(40)}
    got = exact_topk.block_topk(ids[:40], x[:40], ids, x, bounds, 5)
    for q in range(40):
        s = x @ x[q]
        want = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert [int(v) for v in got[1][got[0] == q]][: len(want)] == want


# --- 4 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("m", [2, 7])
def test_topk_repeated_query(m):
    r = np.random.default_rng(m)
    x = r.integers(-50, 50, (60, 8))
    q = x[:1] * 20  # longer than all others, so its own products lead
    xid = np.concatenate([np.zeros(m, np.int64), np.arange(1, 61)])
    got = exact_topk.block_topk(np.zeros(1, np.int64), q, xid, np.concatenate([np.repeat(q, m, axis=0), x]), None, 5)
    s = x @ q[0]
    want = sorted((-int(v), i + 1) for i, v in enumerate(s))[:5]
    assert [(-int(v), int(i)) for i, v in zip(got[1], got[2], strict=True)] == want


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[102] == 100 and 200 not in got


def test_icws_estimates_similarity():
    r = np.random.default_rng(0)
    idf = r.uniform(0.5, 2, minhash.CELLS).astype(np.float32)
    s = minhash.Sampler(idf, 400, 1)
    x = np.unique(r.integers(0, 1 << 63, 600).astype(np.uint64))
    a, b = x[:450], x[150:]
    ta, tb = r.integers(1, 3, len(a)), r.integers(1, 3, len(b))
    keys = s.bands_of([(a, s.weights(a, ta)), (b, s.weights(b, tb))])
    same = (keys[0] == keys[1]).mean()
    assert same == pytest.approx(minhash.similarity(idf, (a, ta), (b, tb)), abs=0.08)


def test_bands_by_all_values():
    """The border saves work only: keys are those of the smallest of all values, for sets of any size."""
    r = np.random.default_rng(1)
    s = minhash.Sampler(r.uniform(0.1, 2, minhash.CELLS).astype(np.float32))
    sets = []
    for n in [1, 2, 3, 10, 500, 9000, *[20] * 60]:
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        sets.append((x, s.weights(x, r.integers(1, 4, len(x)))))
    for (x, w), got in zip(sets, s.bands_of(sets), strict=True):
        lw, want = np.log(w).astype(np.float32), []
        for j in range(len(s.r)):
            a, step = s.values(np.full(len(x), j), x, lw)
            i = int(a.argmin())
            want.append(x[i : i + 1] + step[i : i + 1].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ s.salt[j : j + 1])
        want = minhash.common.mix(np.concatenate(want)).reshape(s.bands, s.rows).sum(axis=1, dtype=np.uint64)
        assert (minhash.common.mix(want + np.arange(s.bands, dtype=np.uint64)) == got).all()


def brute_classes(docs, idf):
    sets = [next(iter(minhash.sets_of([t]))) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and minhash.similarity(idf, sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(docs))]


def copies_of(text, n, edits, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        w = text.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_dedup_brute(spark):
    base = words(40, 5, 150)
    texts = [*base, *base[:5], *copies_of(base[7], 60, 9, 1), *copies_of(base[9], 3, 1, 2), "", None, "", "one two", "one two", "ONE  two", *[" ".join(base[3].split()[:80]) + " " + t for t in base[20:26]]]
    docs = documents(spark, texts).withColumn("doc_id", F.col("extra"))
    idf = minhash.idf_table(docs)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    want = brute_classes(list(enumerate(texts)), idf)
    assert [got[i] for i in range(len(texts))] == want
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert minhash.classes(docs.limit(0)).count() == 0
    twice = minhash.deduplicate(docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")))
    assert sorted(r["doc_id"] for r in twice.collect()) == [0, 1, 2]


def test_dedup_null_ids(spark):
    t = words(2, 9)
    df = spark.createDataFrame([(None, t[0]), (None, t[0]), (5, t[1]), (5, t[0])], "doc_id bigint, text string")
    assert sorted(map(str, ((r["doc_id"], r["class_id"]) for r in minhash.classes(df).collect()))) == sorted(map(str, [(None, 5), (None, 5), (5, 5), (5, 5)]))


def test_block_links_exact():
    r = np.random.default_rng(1)
    idf = r.uniform(0.6, 1.6, minhash.CELLS).astype(np.float32)
    texts = [t for b in words(6, 3, 80) for t in copies_of(b, 12, 8, 4)] + ["a a a a a a a a a a", "a a a a a a a a a"]
    got = minhash.block_links([(i, i, 0, t) for i, t in enumerate(texts)], idf)
    want = brute_classes(list(enumerate(texts)), idf)
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(texts))] == want


def test_dedup_large_group(spark):
    # pairs of plain similarity 0.8 and a little more that share what a third of all documents hold
    common_text = " ".join(f"c{i}" for i in range(84))

    def ends(name, n):
        return f"{common_text} " + " ".join(f"{name}{i}" for i in range(n))

    other = [f"{common_text} " + " ".join(f"f{k}x{i}" for i in range(90)) for k in range(40)]
    texts = [*(ends(n, 10) for n in "ab"), *other, *words(84, 21, 100)]
    docs = documents(spark, texts).withColumn("doc_id", F.col("extra"))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, *range(2, len(texts))]
    # and in the product of two blocks
    idf = minhash.idf_table(docs)
    assert minhash.block_links([(i, i, 0, t) for i, t in enumerate(texts[:4])], idf) == [(0, 1)]
    # at what a third holds, weight may not let less similar texts join
    heavy = np.full(minhash.CELLS, np.log1p(1 / minhash.SMOOTH), np.float32)
    x = np.arange(1000, dtype=np.uint64)
    heavy[750:] = np.log1p(1 / (1 / 3 + minhash.SMOOTH))
    ones = np.ones(1000, np.int64)
    assert minhash.similarity(heavy, (x[:750], ones[:750]), (x, ones)) < 0.8


# --- 5, 6 and 10 --------------------------------------------------------------------------------------


def noise(n, seed):
    r = random.Random(seed)
    bits = ["a", "aa", " ", "  ", "the", "\n", "王", "é", "😀", "x", "ing", "0", "11", "▁", "\t", "<s>", "ﬁ", "er", "'", "'s", "...", "    ", "É", "½", "_"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_counts_and_ids_as_library(spark, monkeypatch):
    texts = [t or "" for t in ODD] + noise(1500, 1)
    want = bpe.library(SP).encode(texts)
    t, e = token_counts.transducer(SP), lattice.encoder(SP)
    assert t.count(texts) == [len(w) for w in want]
    assert [np.frombuffer(x, np.int32).tolist() for x in e.encode(texts)] == want
    for chunk in (1, 5):  # cut anywhere, so chunks without border come too
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert t.count(texts[:400]) == [len(w) for w in want[:400]]
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "PORTION", 1000)
    assert t.count(texts[:200]) == [len(w) for w in want[:200]] and len(t.states) < 5000
    e.words.most = e.parts.most = 2000
    assert [np.frombuffer(x, np.int32).tolist() for x in e.encode(texts[:50]) for _ in (0,)] == want[:50]
    e.words.most = e.parts.most = common.KEPT_BYTES


def test_chunk_maps_compose():
    """A map of a chunk holds for any entry: walking two chunks is walking their join."""
    t = token_counts.Transducer(SP)
    text = " the catalogue,unbelievable\nΣx ab" * 3
    kinds = t.alphabet.classes(text)
    border = t.alphabet.borders(kinds)
    zero = np.zeros(1, np.int32)
    whole = t.walk(kinds, border, np.array([0]), np.array([len(text)]), zero)
    for cut in range(len(text)):
        mid, a = t.walk(kinds, border, np.array([0]), np.array([cut]), zero)
        end, b = t.walk(kinds, border, np.array([cut]), np.array([len(text)]), mid)
        assert (end, a + b) == whole


def test_count_query(spark, sf):
    docs = documents(spark, ODD)
    got = {r["n_bytes"]: r for r in token_counts.count_tokens(docs, SP).collect()}
    assert len(token_counts.count_tokens(docs, SP).collect()) == len(ODD) and got[24000]["over_limit"] and not got[0]["over_limit"]
    lib = bpe.library(SP)
    text = {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}
    assert all(r["n_tokens"] == len(lib.encode(text[r["doc_id"]])) for r in token_counts.op5_token_counts(spark, sf).collect())


def test_encode_query(spark, sf):
    lib = bpe.library(SP)
    text = {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}
    for r in lattice.op6_sentencepiece(spark, sf).collect():
        ids = np.array(lib.encode(text[r["doc_id"]]), np.int32)
        assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)
    got = lattice.encode_documents(documents(spark, ODD), SP).collect()
    assert [r["decoded"] for r in got] == [(t or "").replace("▁", " ") for t in ODD]


def test_native_lattice(spark):
    some = ["hello", "the", "Unbelievable", "x", "aaa", "naïve", "tokenizer", "ingingin", "1234"]
    got = {r["word"]: r["ids"] for r in lattice.encode_words_native(spark.createDataFrame([(w,) for w in [*some, None, "the"]], "word string"), SP).collect()}
    assert got == {w: bpe.library(SP).encode(w) for w in some}


def test_word_tokenizer_as_library():
    t = token_files.tokenizer(WORD)
    texts = [x or "" for x in ODD] + noise(1500, 2)
    assert [np.frombuffer(x, np.uint32).tolist() for x in t.encode(texts)] == [e.ids for e in t.lib.encode_batch(texts, add_special_tokens=False)]


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 1000, 40000):
        for top in (1, 2, 49408, 1 << 32):
            v = r.integers(0, top, n).astype(np.uint32)
            v[: n // 50] = top - 1
            assert (token_files.decode_block(token_files.encode_block(v)) == v).all()
    skewed = np.where(r.random(4000) < 0.02, 40000, r.integers(0, 16, 4000)).astype(np.uint32)
    assert len(token_files.encode_block(skewed)) < 4000


def test_files(spark, tmp_path):
    docs = documents(spark, ODD)
    docs = docs.unionByName(docs.where("extra = 8"))
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, path, WORD)
    got = token_files.read_documents(spark, path).collect()
    t = token_files.tokenizer(WORD)
    known = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 8)}
    for i, x in enumerate(ODD):
        if i not in (3, 8):
            ids = np.array([*t.lib.encode(x or "", add_special_tokens=False).ids, 2], np.uint32)
            assert (known[i]["n_tokens"], known[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda d: (d is not None, d))
    for f in sorted((tmp_path / "t").glob("part-*")):
        data = f.read_bytes()
        every = [g[2] for g in token_files.read_groups(data)]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint32)
        assert (token_files.read_slice(data, 3, 50) == flat[3:53]).all() if data else True
    token_files.write_tokens(docs.limit(0), f"file://{tmp_path}/none", WORD)
    assert token_files.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_files_query(spark, sf):
    t, at = token_files.tokenizer(WORD), 0
    got = {r["doc_id"]: r for r in token_files.op10_token_files(spark, sf).collect()}
    for r in sorted(common.table(spark, sf, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.lib.encode(r["text"], add_special_tokens=False).ids, 2], np.uint32)
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# --- 7 ------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op7_toxicity(spark, sf).toPandas().merge(common.table(spark, sf, "labels").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    own = got[got.held_out]
    assert ((own.predicted == own.toxic).mean() >= 0.9) and (own[own.toxic == 0].predicted.mean() <= 0.08)
    rank = own.score.rank()
    pos, neg = (own.toxic == 1).sum(), (own.toxic == 0).sum()
    assert (rank[own.toxic == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) >= 0.9


def test_toxicity_odd(spark):
    docs = documents(spark, [*(f"fine words {i} here" for i in range(60)), *(f"you idiot {i} there" for i in range(30)), *ODD])
    labels = spark.createDataFrame([(i, int(60 <= i < 90)) for i in range(90)] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    model, thresholds = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 90 + len(ODD) and all(0 <= r["tox_score"] <= 1 for r in got) and thresholds == {"en": 0.5}
    tox = [r["tox_score"] >= 0.5 for r in sorted(got, key=lambda r: r["extra"])[:90]]
    assert tox[:60] == [False] * 60 and sum(tox[60:]) >= 28
    kept = toxicity.reject(docs, model, {"en": 0.6})
    assert kept.columns == docs.columns and kept.where("extra < 60").count() == 60
    none, _ = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none is None and toxicity.score_documents(docs, none).agg(F.max("tox_score")).first()[0] == 0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------


def test_warc_sql(spark, sf):
    compare(warc.op9_warc(spark, sf), warc.OP9_SQL, sf)


def test_warc_segments_and_copies(spark, tmp_path):
    big = "".join(random.Random(1).choice("aé王\r\n<>") for _ in range(90_000))
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "WARC/1.1\r\n\r\n"), (6, "u", "s"), (6, "u", "s"), (0, "u", "s")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, segment=1 << 14)
    got = warc.read_payloads(spark, path).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    by = {r["record_id"].split(":")[3]: r for r in got if not r["record_id"].endswith(":2>")}
    assert by["1"]["payload"].decode() == big and by["1"]["warc_type"] == "response"
    assert by["2"]["warc_type"] == "revisit" and by["2"]["refers"] == by["1"]["record_id"] and by["2"]["payload_bytes"] == len(big.encode())
    assert by["2"]["digest"] == base64.b32encode(hashlib.sha1(big.encode()).digest()).decode()
    assert by["4"]["warc_type"] == "revisit" and by["3"]["payload_bytes"] == 0 and by["0"]["warc_type"] == "response"
    assert sum(r["warc_type"] == "revisit" and ":6:" in r["record_id"] for r in got) == 2
    assert warc.read_records(spark, path).where("segment is not null").count() > 10
    warc.write_archives(pages.where("page_id >= 6"), f"{path}2", min_bytes=5)
    assert {r["warc_type"] for r in warc.read_payloads(spark, f"{path}2").collect()} == {"response"}


def test_warc_odd(spark, tmp_path):
    pages = spark.createDataFrame([(7, "u", "same" * 50)] * 300 + [(i, None, "same" * 50) for i in range(8, 40)] + [(7, "v", "same" * 50)], "page_id bigint, url string, html string").withColumn("number", F.lit("clash"))
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_payloads(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == 333 == len({r["record_id"] for r in got}) and sum(r["warc_type"] == "response" for r in got) == 1
    assert all(r["problem"] is None and r["payload_bytes"] == 200 for r in got)
    os.makedirs(tmp_path / "sf")
    pages.limit(0).write.parquet(f"{tmp_path}/sf/pages.parquet")
    assert warc.op9_warc(spark, str(tmp_path / "sf")).count() == 0


def test_warc_loss_is_loud(spark, sf, monkeypatch):
    bad = spark.createDataFrame([("<urn:veilmap:page:1:X:1>", "total length differs", 1)], "record_id string, problem string, payload_bytes bigint")
    monkeypatch.setattr(warc, "read_payloads", lambda *a: bad.selectExpr("*", "'response' as warc_type", "'X' as digest", "'' as refers", "cast(null as binary) as payload"))
    with pytest.raises(Exception, match="total length differs"):
        warc.op9_warc(spark, sf).collect()


def test_count_and_encode_nothing(spark):
    none = documents(spark, ["a"]).limit(0)
    assert token_counts.count_tokens(none, SP).count() == 0 and lattice.digest_documents(none, SP).count() == 0
    twice = documents(spark, ["a b", "a b"]).unionByName(documents(spark, ["a b"]))
    assert [r["n_tokens"] for r in token_counts.count_tokens(twice, SP).collect()] == [2, 2, 2] == [r["n_tokens"] for r in lattice.digest_documents(twice, SP).collect()]


def test_warc_broken():
    part = lambda k, total, n=2: {"segment": k, "total": total, "block": b"x" * n}
    assert warc.assembled([part(1, None), part(3, 4)])[1] and warc.assembled([part(1, None), part(2, 5)])[1] and warc.assembled([part(1, None), part(2, None)])[1]
    assert warc.assembled([part(1, None), part(2, 4)]) == (b"xxxx", None)
    assert warc.unchunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


# --- all ----------------------------------------------------------------------------------------------


def test_names():
    names = queries.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and len(names) == 10
    assert set(queries.oracle_sql()) <= set(names)


def test_hashes_follow_bytes():
    r = random.Random(0)
    parts = [" ".join(r.choice(["ab", "c", "déf", "gh" * r.randint(1, 40)]) for _ in range(30)).encode() for _ in range(20)]
    sums, start, end, firsts = common.split_words(parts, ~common.BLANK)
    buf = b"\n".join(parts) + b"\n"
    seen: dict = {}
    for h, a, b in zip(common.span_hash(sums, start, end).tolist(), start, end):
        assert seen.setdefault(buf[a:b], h) == h
    assert len(set(seen.values())) == len(seen) and firsts.tolist() == [30 * i for i in range(21)]


def test_blocks_of_vectors(spark):
    df, _ = vector_rows(spark)
    # 430 good ones, one of zeros, one without components and one shorter
    assert vectors.usable(df).count() == 433
