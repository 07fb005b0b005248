"""Disclosure, sampling and ingest as behaviour over tables."""

import pytest
from pyspark.sql import functions as F

from veilmap import fixtures as fx
from veilmap.functions import spatial
from veilmap.operators import access, aggregate, viewport
from veilmap.plans.store import Store, add_field, check_declaration
from veilmap.sources import readers
from veilmap.streaming import ingest

FRAME = spatial.Frame(0.0, 0.0, 100.0, 100.0)


def made(spark, rows):
    df = spark.createDataFrame(rows, "entity bigint, x double, y double, labels array<string>")
    return access.with_keys(spatial.place(df.withColumn("rank", viewport.hashed_rank(F.col("entity"))), FRAME))


def answers(items, viewer):
    v = access.visible(items, viewer).withColumn("matched", F.lit(True)).withColumn("highlighted", F.lit(True)).withColumn("in_set", F.lit(True)).withColumn("in_ref", F.lit(True))
    return [sorted(map(tuple, df.collect())) for df in (viewport.tile_counts(v, 3), viewport.sample(v, 2, viewport.threshold(v, 2)).select("tile", "entity"), aggregate.field_summary(v, "x"), aggregate.histogram(v, "x", aggregate.default_edges(v, "x", 5)))]


def test_hidden_item_changes_nothing(spark):
    base = [(i, float(i * 7 % 100), float(i * 13 % 100), ["a"]) for i in range(60)]
    viewer = access.Viewer.of("a")
    before = answers(made(spark, base), viewer)
    assert answers(made(spark, [*base, (999, 1e9, -1e9, ["b"])]), viewer) == before
    assert answers(made(spark, [*base, (999, 50.0, 50.0, ["a"])]), viewer) != before


def test_sample_nests(spark):
    """A deeper view shows every item of the coarser one, and a sampler that drops the floor is told apart."""
    rows = made(spark, [(i, (i * 37 % 1000) / 10, (i * 91 % 1000) / 10, ["a"]) for i in range(800)])
    shown = [{r["entity"] for r in viewport.sample(rows, k, viewport.threshold(rows, k)).collect()} for k in (0, 1, 2, 3)]
    assert all(a <= b for a, b in zip(shown, shown[1:]))
    no_floor = viewport.Sampling(k_min=0, target=1)
    assert {r["entity"] for r in viewport.sample(rows, 3, viewport.threshold(rows, 3, no_floor), None, no_floor).collect()} != shown[3]


def test_overlap_counts_once(spark):
    rows = made(spark, [(1, 1.0, 1.0, ["a", "b"]), (2, 1.0, 1.0, ["c"]), (3, 1.0, 1.0, []), (4, 1.0, 1.0, None)])
    assert access.authorised(rows, access.Viewer.of("a", "b")).count() == 1
    assert access.authorised(rows, access.Viewer(read_all=True)).count() == 2


def test_nan_and_null(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "v double").withColumn("in_set", F.lit(True)).withColumn("in_ref", F.lit(False))
    s = aggregate.field_summary(rows, "v").first()
    assert (s["items"], s["finite"], s["none"], s["minimum"], s["mean"]) == (4, 1, 1, 1.0, 1.0)
    h = {r["grp"]: r["count"] for r in aggregate.histogram(rows, "v", [0.0, 2.0]).collect()}
    assert h == {"bin": 1, "rest": 2, "none": 1}


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", FRAME, "name string")
    src = f"{tmp_path}/in"
    rows = spark.createDataFrame([(i, None, f"k{i}", float(i), 1.0, ["a"], f"n{i}") for i in range(20)], "row bigint, id bigint, key string, x double, y double, labels array<string>, name string")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    ingest.run_ingest(stream, store, "me", f"{tmp_path}/cp").awaitTermination()
    assert store.items().count() == 20 and store.receipts().count() == 1
    e = store.items().where("key = 'k3'").first()["entity"]
    one = spark.createDataFrame([(e,)], "entity bigint")
    store.change(one, "suppress")
    assert store.suppressed().count() == 1
    store.change(one, "unsuppress")
    store.change(one, "delete")
    assert store.suppressed().count() == 0 and store.items().count() == 19
    old = store.manifest()
    store.compact()
    assert store.items().count() == 19 and store.manifest()["deletes"] == [] and store.items(old).count() == 19
    digest = ingest.batch_digest(rows)
    assert digest == ingest.batch_digest(rows.repartition(3)) != ingest.batch_digest(rows.limit(3))
    with pytest.raises(ingest.Conflict):
        ingest.receipt(store.receipts(), "me", "stream-0", "other")


def test_edits_through_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", FRAME, "name string, n int")
    rows = spark.createDataFrame([(i, None, f"k{i}", float(i), 2.0, ["a"] if i % 2 else ["b"], f"n{i}", i) for i in range(6)], "row bigint, id bigint, key string, x double, y double, labels array<string>, name string, n int")
    assert store.take(rows, "me", "1").count() == 0
    item = {r["key"]: r for r in store.items().collect()}
    one = spark.createDataFrame([(item["k5"]["entity"],)], "entity bigint")
    store.change(one, "suppress")
    some = "row bigint, id bigint, key string, x double, y double, name string"
    # k1 gets a place, k2 keeps its own, k5 by its number gets a new key and loses its name; a repeated row, a taken key
    edits = [(1, None, "k1", 50.0, 60.0, "new"), (2, None, "k2", None, None, None), (3, item["k5"]["number"], "k9", None, None, None), (4, None, "k1", 1.0, 1.0, "x"), (5, item["k3"]["number"], "k4", None, None, "x"), (6, None, "k9", 1.0, 1.0, None), (7, None, "q", None, None, None), (8, 999, None, 1.0, 1.0, None)]
    refused = {r["row"]: r["reason"] for r in store.take(spark.createDataFrame(edits, some), "me", "2").collect()}
    assert refused == {4: "one_item_twice", 5: "names_two_items", 6: "one_value_twice", 7: "names_no_item", 8: "unknown_id"}
    got = {r["key"]: r for r in store.items().collect()}
    assert sorted(got) == ["k0", "k1", "k2", "k3", "k4", "k9"]
    assert (got["k1"]["x"], got["k1"]["y"], got["k1"]["name"], got["k1"]["n"], got["k1"]["labels"], got["k1"]["keys"]) == (50.0, 60.0, "new", 1, ["a"], ["a"])
    assert (got["k2"]["x"], got["k2"]["name"], got["k2"]["n"]) == (2.0, None, 2)
    assert got["k9"]["number"] == item["k5"]["number"] and got["k9"]["entity"] != item["k5"]["entity"] and got["k9"]["n"] == 5
    assert got["k1"]["code"] != item["k1"]["code"] and got["k2"]["code"] == item["k2"]["code"]
    assert {r["entity"] for r in store.suppressed().collect()} >= {got["k9"]["entity"]}
    assert store.take(spark.createDataFrame(edits, some), "me", "2") is None
    with pytest.raises(ingest.Conflict):
        store.take(rows, "me", "2")
    # a writer's scope: items of other labels are as absent, their keys stay taken, labels not held can't be set
    b = access.Viewer.of("b")
    labelled = spark.createDataFrame([(1, item["k1"]["number"], None, None, None, None), (2, None, "k1", 1.0, 1.0, None), (3, None, "k4", None, None, ["b"]), (4, None, "z", 1.0, 1.0, ["a"]), (5, None, "z", 1.0, 1.0, ["b"])], "row bigint, id bigint, key string, x double, y double, labels array<string>")
    assert {r["row"]: r["reason"] for r in store.take(labelled, "b", "1", b).collect()} == {1: "unknown_id", 2: "value_held", 4: "label_not_held"}
    assert {r["key"] for r in access.authorised(store.items(), b).collect()} == {"k0", "k2", "k4", "z"}
    with pytest.raises(ValueError):
        store.take(spark.createDataFrame([(1, None, "w", 1.0, None, None)], some), "me", "3")
    store.declare("attribute", "score", "double")
    store.declare("attribute", "score", "double")
    with pytest.raises(ValueError):
        store.declare("attribute", "score", "int")
    store.take(spark.createDataFrame([(1, None, "k0", None, None, 0.5)], "row bigint, id bigint, key string, x double, y double, score double"), "me", "4")
    assert {r["key"]: r["score"] for r in store.items().collect()} == {"k0": 0.5, "k1": None, "k2": None, "k3": None, "k4": None, "k9": None, "z": None}
    store.compact()
    assert store.items().count() == 7 and store.manifest()["segments"].__len__() == 1


def test_rows_are_decided_in_order(spark):
    """Against a walk through the batch, row by row."""
    import random

    r = random.Random(9)
    held = {e: f"k{e}" if e % 3 else None for e in range(12)}
    scope = {e for e in held if e % 5}
    rows = [(i, r.choice([None, None, r.randint(0, 14)]), r.choice([None, f"k{r.randint(0, 14)}", f"f{r.randint(0, 9)}"]), *r.choice([(1.0, 1.0), (None, None)])) for i in range(400)]
    want, items, values = {}, set(), set()
    for row, i, key, x, _ in rows:
        by_id = i if i in scope else None
        holder = next((e for e, k in held.items() if key is not None and k == key), None)
        by_key = holder if holder in scope else None
        item, sets = by_id if by_id is not None else by_key, key if by_key is None else None
        if i is not None and by_id is None:
            reason = "unknown_id"
        elif by_id is not None and by_key is not None and by_id != by_key:
            reason = "names_two_items"
        elif item is None and x is None:
            reason = "names_no_item"
        elif holder is not None and by_key is None:
            reason = "value_held"
        elif item in items:
            reason = "one_item_twice"
        elif sets in values:
            reason = "one_value_twice"
        else:
            reason = None
            items |= {item} - {None}
            values |= {sets} - {None}
        want[row] = (reason, item if reason is None else None)
    got = ingest.resolve_rows(spark.createDataFrame(rows, "row bigint, id bigint, key string, x double, y double"), spark.createDataFrame(list(held.items()), "entity bigint, key string"), spark.createDataFrame([(e,) for e in scope], "entity bigint"))
    assert {g["row"]: (g["reason"], g["entity"]) for g in got.collect()} == want
    assert {w[0] for w in want.values()} - {None} == set(ingest.REASONS) - {"label_not_held"}


def test_page_by_bytes(spark):
    from veilmap.operators import records

    rows = made(spark, [(i, float(i), 1.0, ["a"]) for i in range(20)]).withColumn("name", F.lit("x" * 100))
    assert records.read_items(rows, ["name"], "stored", most_bytes=500).count() == 4
    assert records.read_items(rows, ["name"], "stored", most_bytes=10).count() == 1
    assert records.read_items(rows, ["name"], "stored", limit=7).count() == 7


def test_declarations(spark):
    df = spark.createDataFrame([(1, "a")], "n bigint, s string")
    assert check_declaration({"n": "bigint", "t": "string"}, df) == ["missing column t", "undeclared column s"]
    assert add_field(df, "z", "double").first()["z"] is None


def test_sources(spark, tmp_path):
    spark.createDataFrame([(13.4, 52.5)], "east double, lat double").write.parquet(f"{tmp_path}/p")
    p = readers.points(spark, f"{tmp_path}/p", {"lon": "east"}, "web_mercator").first()
    assert p["x"] == pytest.approx(0.537222, abs=1e-6) and 0 < p["y"] < 0.5
    readers.write_ipc(spark.range(3), f"{tmp_path}/x.arrow")
    import pyarrow as pa

    assert pa.ipc.open_file(f"{tmp_path}/x.arrow").read_all().num_rows == 3


def test_plans(spark, sf):
    """Filters reach the scan, columns are pruned, and no Python runs in the count of tiles but for label parsing."""
    got = fx.read(spark, sf, "orders").where("o_orderpriority like '1-%'").select("o_orderkey")
    text = got._jdf.queryExecution().toString()
    assert "StringStartsWith(o_orderpriority,1-)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text
    v = fx.shown(spark, sf).where("entity > 5")
    assert "CartesianProduct" not in v._jdf.queryExecution().toString()


def test_tiles_make_short_plans(spark, sf):
    """Codes worked out in a condition on many tiles don't swell the plan, and ranges taken together let in no other tile."""
    from veilmap.queries import QUERIES

    assert len(QUERIES["tiles_of_box"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    rows = made(spark, [(i, (i * 37 % 1000) / 10, (i * 91 % 1000) / 10, ["a"]) for i in range(800)]).withColumn("at", spatial.tile(F.col("code"), 4)).cache()
    for tiles in ([], [0], [127, 128], list(range(0, 256, 7)), [3, 3, 200, 255], list(range(256))):
        want = {(r["entity"], r["at"]) for r in rows.collect() if r["at"] in tiles}
        assert {(r["entity"], r["tile"]) for r in viewport.in_tiles(rows, 4, tiles).collect()} == want
    assert viewport.in_tiles(rows, 0, [0]).count() == 800
    corners = spark.createDataFrame([(0, 0), (2**32 - 1, 2**32 - 1), (1, 2**31), (None, 1)], "qx bigint, qy bigint")
    assert [r[0] for r in corners.select(spatial.morton(F.col("qx"), F.col("qy"))).collect()] == [0, -1, 1 - 2**63, None]


@pytest.fixture
def narrow(spark):
    """Adaptive plans join partitions by 64 KB, as they join larger ones of larger tables."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "40"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_places_in_many_partitions(spark, narrow):
    """Rows of one cell in several partitions come by rank, and offsets are those of the partitions that the rows are in."""
    from veilmap.plans.durable import numbered

    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("entity"), (F.col("id") * 7919 % n).alias("rank"), ((F.col("id") % 3 - 1) * (1 << 61) + (F.col("id") * 104729 % n)).alias("code"))
    got = numbered(spatial.map_order(rows), "place").select("place", "code", "rank", F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in got}) > 1
    got.sort(key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, n + 1))
    order = [(r["code"] % (1 << 64) >> 32, r["rank"]) for r in got]
    assert order == sorted(order)


def test_numbers_of_wide_rows(spark, narrow):
    """Rows whose partitions are joined otherwise than those of their counts."""
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("row"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    got = ingest.next_entities(rows, 100).collect()
    assert len(got) == 20_000 and all(r["entity"] == r["row"] + 101 for r in got)


def test_hulls_of_many_members(spark):
    """Rings of an artifact with very many members reach as far as they do, and are those of all their places."""
    from veilmap.functions import shapes
    from veilmap.operators import layers

    rows = spark.range(80_000).select(F.col("id").alias("entity"), F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("qx"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)).alias("qy")).cache()
    got = layers.hulls(rows.select(F.lit("a").alias("artifact"), "entity"), rows).first()["rings"]
    places = rows.select("qx", "qy").toPandas().to_numpy()
    at = [p for ring in got for p in ring]
    assert [f(p[i] for p in at) for i in (0, 1) for f in (min, max)] == [f(places[:, i].tolist()) for i in (0, 1) for f in (min, max)]
    assert [[tuple(p) for p in ring] for ring in got] == shapes.concave_rings(places)


def test_attachments_work_out_their_targets_once(spark):
    """Chains are followed to their length, past cycles, and the served targets are read in one pass."""
    from veilmap.operators import layers

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    ok = spark.range(5).selectExpr("concat('a', id) artifact").mapInArrow(seen, "artifact string")
    chain = [("c0", "a1"), *((f"c{i}", f"c{i - 1}") for i in range(1, 6)), ("d", "gone"), ("e", "f"), ("f", "e"), ("g", "a2"), ("g", "c1")]
    labels = spark.createDataFrame(chain, "artifact string, target string")
    got = layers.attached(labels, ok)
    assert sorted(r["artifact"] for r in got.collect()) == ["c0", "c1", "c2", "c3", "c4", "c5", "g"]
    assert reads.value <= 10  # a checkpoint counts its rows, then writes them
    assert {r["artifact"] for r in layers.attached(labels, ok, 3).collect()} == {"c0", "c1", "c2", "g"}
