"""The pipeline's stages in order, each against a brute-force version of it."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from veilmap.llm import bpe, common, lattice, minhash, mixing, toxicity


def test_pipeline(spark, sf):
    docs = common.table(spark, sf, "documents")
    model, cut = toxicity.fit(docs, common.table(spark, sf, "labels"))
    clean = pipeline.STAGES[0][1](spark, docs, sf)
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    score = np.concatenate([model.score(p) for _, p in common.blocks([(r["text"] or "").lower() for r in rows])])
    want = [r["doc_id"] for r, s in zip(rows, score) if s < cut.get(r["lang"], 0.5)]
    assert sorted(r["doc_id"] for r in clean.collect()) == want and 0 < len(want) < len(rows)

    single = common.materialise(pipeline.STAGES[1][1](spark, clean, sf), "test-single")
    idf = minhash.idf_table(clean)
    left = [r for r in rows if r["doc_id"] in set(want)]
    sets = [next(iter(minhash.sets_of([r["text"]]))) for r in left]
    first = list(range(len(left)))

    def find(i):
        return i if first[i] == i else find(first[i])

    for i in range(len(left)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and minhash.similarity(idf, sets[i], sets[j]) >= 0.8:
                first[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted({left[find(i)]["doc_id"] for i in range(len(left))})
    assert sorted(r["doc_id"] for r in single.collect()) == want
    assert single.columns == docs.columns

    mixed = common.materialise(pipeline.STAGES[2][1](spark, single, sf), "test-mixed")
    n = {r["doc_id"]: r["n"] for r in mixing.copies(single.select("doc_id", "source", common.n_words("text").alias("size"))).collect()}
    got: dict = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: c for d, c in n.items() if c} and mixed.columns == docs.columns

    out = pipeline.STAGES[3][1](spark, mixed, sf).collect()
    lib, text = bpe.library(common.tokenizer_path(lattice.MODEL)), {r["doc_id"]: r["text"] for r in rows}
    assert len(out) == sum(got.values())
    assert all(r["n_tokens"] == len(lib.encode(text[r["doc_id"]])) and r["round_trip"] for r in out)
    whole = pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, out))


def test_pipeline_odd(spark, sf):
    """Null and empty texts, repeated rows, clashing columns and an empty table go through every stage."""
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 900, 30)) for _ in range(40)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate([*texts, None, "", " ", "one", "\n"])]
    rows += [rows[0]] * 20 + [(900, texts[0] + " x", "de", "s1"), (None, texts[1], None, None), rows[-1], rows[40]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("class_id", "size", "n", "target", "tox_score_", "dd_key_", "rep"):
        docs = docs.withColumn(name, F.lit("clash"))
    at = docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = common.materialise(stage(spark, at, sf), f"odd-{name}")
        assert out.count() > 0 and (i + 1 == len(pipeline.STAGES) or out.columns == docs.columns)
        if name == "near_dedup":
            kept = [x["doc_id"] for x in out.collect()]
            assert kept.count(0) == 1 and 900 not in kept and kept.count(40) == 2 and {41, 42, 43, 44} <= set(kept)
        at = out
    at = docs.limit(0)
    for i, (name, stage) in enumerate(pipeline.STAGES):
        at = common.materialise(stage(spark, at, sf), f"none-{name}")
        assert at.count() == 0 and (i + 1 == len(pipeline.STAGES) or at.columns == docs.columns)
