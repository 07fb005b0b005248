"""The registered queries of the engine, each with its SQL for the oracle where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import FRAME, LIVE_SQL, ORDERS_SQL, SHOWN_SQL, TEXTS_SQL, TIERS_SQL, VIEWER, allowed_sql, fixed_sql, tile_sql
from .functions import bins, shapes, spatial
from .functions.text import latin_tokens
from .operators import access, aggregate, categories, filters, layers, records, trees, viewport
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- positions and tiles ------------------------------------------------------------------------------


@query(f"with {ORDERS_SQL} select entity, qx, qy, qx >> 16 as cell_x, qy >> 16 as cell_y from items")
def quantise(spark, d):
    return fx.orders(spark, d).select("entity", "qx", "qy", spatial.cell16(F.col("x"), FRAME.min_x, FRAME.max_x).alias("cell_x"), spatial.cell16(F.col("y"), FRAME.min_y, FRAME.max_y).alias("cell_y"))


@query(f"with {ORDERS_SQL} select entity, {tile_sql(16)} as code_high, {tile_sql(16, '((qx & 65535) << 16)', '((qy & 65535) << 16)')} as code_low, qx as back_x, qy as back_y from items")
def morton_code(spark, d):
    x, y = spatial.unmorton(F.col("code"))
    return fx.orders(spark, d).select("entity", F.shiftrightunsigned("code", 32).alias("code_high"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("code_low"), x.alias("back_x"), y.alias("back_y"))


@query(f"with {ORDERS_SQL} select entity, {tile_sql(0)} as t0, {tile_sql(1)} as t1, {tile_sql(3)} as t3, {tile_sql(8)} as t8, {tile_sql(16)} as t16 from items")
def tile_prefix(spark, d):
    return fx.orders(spark, d).select("entity", *[spatial.tile(F.col("code"), k).alias(f"t{k}") for k in (0, 1, 3, 8, 16)])


_LL = "select event_id, value / 500.0 * 360.0 - 180.0 as lon, (event_id % 1801) / 10.0 - 90.0 as lat from events"


def _lonlat(spark, d):
    return fx.read(spark, d, "events").select("event_id", (F.col("value") / 500.0 * 360.0 - 180.0).alias("lon"), (F.pmod("event_id", F.lit(1801)) / 10.0 - 90.0).alias("lat"))


@query(f"""with ll as ({_LL}), f as (select event_id, least(greatest((lon + 180) / 360, 0), 1) as mx, least(greatest(0.5 - ln(tan(pi() / 4 + radians(least(greatest(lat, -85.0511287798066), 85.0511287798066)) / 2)) / (2 * pi()), 0), 1) as my,
  0.5 - lat / 180 as ey from ll) select event_id, round(mx, 9) as mx, round(my, 9) as my, round(ey, 9) as ey, round(degrees(2 * atan(exp((0.5 - my) * 2 * pi())) - pi() / 2), 6) as lat_back from f""")
def mercator(spark, d):
    x, y = spatial.forward("web_mercator", F.col("lon"), F.col("lat"))
    _, e = spatial.forward("equirectangular", F.col("lon"), F.col("lat"))
    p = _lonlat(spark, d).select("event_id", x.alias("mx"), y.alias("my"), e.alias("ey"))
    return p.select("event_id", F.round("mx", 9).alias("mx"), F.round("my", 9).alias("my"), F.round("ey", 9).alias("ey"), F.round(spatial.inverse("web_mercator", F.col("mx"), F.col("my"))[1], 6).alias("lat_back"))


@query(f"with ll as ({_LL}) select event_id as entity from ll where (lon between -20 and 70 and lat between -35 and 61) or (lon between 100 and 130 and abs(lat) <= 85 and lat >= 10)")
def f_region_wgs84(spark, d):
    """A box in degrees, and a polygon whose sides are meridians and parallels, over items on a Mercator plane."""
    unit = spatial.Frame(0.0, 0.0, 1.0, 1.0)
    x, y = spatial.forward("web_mercator", F.col("lon"), F.col("lat"))
    items = spatial.place(_lonlat(spark, d).where("abs(lat) <= 85").select(F.col("event_id").alias("entity"), x.alias("x"), y.alias("y")), unit)
    ring = [[100.0, 10.0], [130.0, 10.0], [130.0, 85.0], [100.0, 85.0]]
    either = {"any_of": [{"region": {"space": "wgs84", "bbox": [-20, -35, 70, 61]}}, {"region": {"space": "wgs84", "polygon": [ring]}}]}
    return filters.matching(items, either, filters.Scope({}, frame=unit, projection="web_mercator")).select("entity")


@query("select count(*) filter (where epoch_us(o_orderdate) < 883612800000000 or epoch_us(o_orderdate) > 946684800000000 or o_totalprice < 50000 or o_totalprice > 200000) as moved, count(*) as items from orders")
def clip_report(spark, d):
    frame = spatial.Frame(883612800000000.0, 50_000.0, 946684800000000.0, 200_000.0)
    return fx.orders(spark, d).agg(F.count_if(spatial.clipped(F.col("x"), F.col("y"), frame)).alias("moved"), F.count(F.lit(1)).alias("items"))


@query("""with e as (select min(cast(epoch_us(o_orderdate) as double)) as x0, max(cast(epoch_us(o_orderdate) as double)) as x1, min(o_totalprice) as y0, max(o_totalprice) as y1 from orders)
select x0 - 0.05 * (x1 - x0) as min_x, y0 - 0.05 * (y1 - y0) as min_y, x1 + 0.05 * (x1 - x0) as max_x, y1 + 0.05 * (y1 - y0) as max_y from e""")
def auto_frame(spark, d):
    f = spatial.fit_frame(fx.orders(spark, d), 0.05)
    return spark.createDataFrame([(f.min_x, f.min_y, f.max_x, f.max_y)], "min_x double, min_y double, max_x double, max_y double")


@query(f"with {ORDERS_SQL} select entity, row_number() over (order by {tile_sql(16)}, rank) as place from items")
def map_order(spark, d):
    from .plans.durable import numbered

    # places by partition offsets, as a sorted file's row numbers would be
    x = spatial.map_order(fx.orders(spark, d).select("entity", "code", "rank"))
    return numbered(x, "place").select("entity", "place")


# --- access -------------------------------------------------------------------------------------------


@query(f"with {SHOWN_SQL} select entity, rank from shown")
def visible_set(spark, d):
    return fx.shown(spark, d).select("entity", "rank")


@query(f"with {ORDERS_SQL} select entity from items where {allowed_sql('MACHINERY', 'p2')} and {LIVE_SQL}")
def visible_conjunction(spark, d):
    """Another viewer's set: conjunctions, alternatives and single terms."""
    return fx.shown(spark, d, fx.OTHER).select("entity")


@query("""with l as (select o_orderkey as entity, c_mktsegment as seg, 'p' || substr(o_orderpriority, 1, 1) as p from orders join customer on o_custkey = c_custkey)
select entity, seg = 'BUILDING' and p = 'p1' as by_whole, false as by_parts from l""")
def quoted_terms(spark, d):
    """Labels '"seg&p"&x': the term seg&p is one term, so holding seg and p admits to nothing."""
    o = fx.orders(spark, d).where("seg is not null").select("entity", F.array(F.concat(F.lit('"'), "seg", F.lit("&"), "p", F.lit('"&x'))).alias("labels"))
    x = access.with_keys(o)
    see = lambda *terms: F.exists("keys", lambda k: access.satisfied(k, access.Viewer.of(*terms)))
    return x.select("entity", see("BUILDING&p1", "x").alias("by_whole"), see("BUILDING", "p1", "x").alias("by_parts"))


@query(f"with {ORDERS_SQL} select entity from items where entity % 7 <> 3 and {LIVE_SQL}")
def read_all(spark, d):
    return fx.shown(spark, d, access.Viewer(read_all=True)).select("entity")


@query(f"with {ORDERS_SQL} select entity from items where entity % 7 = 0 and {LIVE_SQL}")
def no_terms(spark, d):
    return fx.shown(spark, d, access.Viewer.of()).select("entity")


@query(f"""with {ORDERS_SQL} select entity, unnest(case entity % 7 when 0 then ['public'] when 1 then ['&' || case when seg < p then seg || '&' || p else p || '&' || seg end] when 2 then [seg, p] else [seg] end) as key from items where entity % 7 <> 3""")
def label_keys(spark, d):
    return access.item_keys(fx.items(spark, d)).withColumn("key", F.regexp_replace("key", "\0", "&"))


@query(f"with {SHOWN_SQL} select entity from shown")
def visible_by_relation(spark, d):
    it = fx.items(spark, d)
    got = access.authorised_by_relation(it, access.item_keys(it), VIEWER)
    for gone in fx.overlay(spark, d):
        got = got.join(gone, "entity", "left_anti")
    return got.select("entity")


@query(f"""with {SHOWN_SQL} select entity, case entity % 7 when 0 then 'public' when 1 then 'BUILDING&p1' when 2 then case when seg = 'BUILDING' and p = 'p1' then 'BUILDING,p1' when seg = 'BUILDING' then 'BUILDING' else 'p1' end else 'BUILDING' end as why from shown""")
def why_visible(spark, d):
    return access.why_visible(fx.shown(spark, d), VIEWER).select("entity", F.array_join("why", ",").alias("why"))


@query(f"with {ORDERS_SQL} select entity from items where {allowed_sql('MACHINERY', 'p2')}")
def write_scope(spark, d):
    return access.writable(fx.items(spark, d), fx.OTHER).select("entity")


# --- filters ------------------------------------------------------------------------------------------


def _filter(name: str, expr: dict, where: str, **scope) -> None:
    def run(spark, d):
        return filters.matching(fx.shown(spark, d), expr, fx.scope(**scope)).select("entity")

    run.__name__ = name
    query(f"with {SHOWN_SQL} select entity from shown where {where}")(run)


def _point(x: float, y: float) -> tuple[float, float]:
    return FRAME.min_x + x * (FRAME.max_x - FRAME.min_x), FRAME.min_y + y * (FRAME.max_y - FRAME.min_y)


_P = [_point(0.1, 0.05), _point(0.45, 0.1), _point(0.4, 0.5), _point(0.25, 0.2), _point(0.1, 0.45)]
_G = [shapes.on_grid(p, FRAME) for p in _P]


def _polygon_sql(ring: list[tuple[int, int]]) -> str:
    edge, cross = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = f"(cast(qx - {x1} as hugeint) * {y2 - y1} - cast(qy - {y1} as hugeint) * {x2 - x1})"
        edge.append(f"({side} = 0 and qx between {min(x1, x2)} and {max(x1, x2)} and qy between {min(y1, y2)} and {max(y1, y2)})")
        if y1 != y2:
            cross.append(f"(case when qy >= {min(y1, y2)} and qy < {max(y1, y2)} and {side} {'<' if y2 > y1 else '>'} 0 then 1 else 0 end)")
    return f"({' or '.join(edge)} or ({' + '.join(cross)}) % 2 = 1)"


def _ellipse_sql(cx: float, cy: float, a: float, b: float) -> str:
    sx, sy = spatial.SIDE / (FRAME.max_x - FRAME.min_x), spatial.SIDE / (FRAME.max_y - FRAME.min_y)
    return f"pow((qx - {(cx - FRAME.min_x) * sx!r}) / {sx * a!r}, 2) + pow((qy - {(cy - FRAME.min_y) * sy!r}) / {sy * b!r}, 2) <= 1"


_C = _point(0.3, 0.3)
_BOX = [*_point(0.2, 0.1), *_point(0.4, 0.5)]
_A, _B = shapes.on_grid((_BOX[0], _BOX[1]), FRAME), shapes.on_grid((_BOX[2], _BOX[3]), FRAME)
_WKT = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*_P, _P[0]]) + "))"

_filter("f_category_eq", {"status": {"eq": "O"}}, "status = 2")
_filter("f_category_in", {"status": {"in": ["F", 3, "unknown"]}}, "status in (1, 3)")
_filter("f_keyword_eq", {"priority": {"eq": "1-URGENT"}}, "priority = '1-URGENT'")
_filter("f_keyword_in", {"priority": {"in": ["1-URGENT", "5-LOW"]}}, "priority in ('1-URGENT', '5-LOW')")
_filter("f_prefix", {"priority": {"prefix": "4-"}}, "priority like '4-%'")
_filter("f_contains", {"priority": {"contains": "IG"}}, "priority like '%IG%'")
_filter("f_number_eq", {"any_of": [{"cust": {"in": [*range(1, 40), "77"]}}, {"cust": {"eq": 100}}, {"whole": {"eq": "150000"}}]}, "cust between 1 and 39 or cust in (77, 100) or whole = 150000")
_filter("f_bool_eq", {"large": {"eq": True}}, "coalesce(large, false)")
_filter("f_date_eq", {"odate": {"in": [f"1997-01-{d:02}T00:00:00Z" for d in range(1, 32)]}}, "us in (" + ", ".join(str(852076800000000 + i * 86400000000) for i in range(31)) + ")")
_filter("f_range", {"price": {"range": {"gte": 50000, "lt": 150000}}}, "price >= 50000 and price < 150000 and not isnan(price)")
_filter("f_range_nan", {"price": {"range": {"gt": 100000}}}, "price > 100000 and not isnan(price)")
_filter("f_date_range", {"odate": {"range": {"gte": "1997-01-01T00:00:00Z", "lt": "1998-01-01T00:00:00Z"}}}, "us >= 852076800000000 and us < 883612800000000")
_filter("f_unique", {"key": {"in": ["key-1", "key-7", "key-14", "none"]}}, "entity in (1, 7, 14)")
_filter("f_none_of", {"none_of": [{"status": {"eq": "O"}}, {"status": {"eq": "P"}}]}, "status = 1")
_filter("f_none_of_number", {"none_of": [{"price": {"range": {"gt": 100000}}}]}, "price is not null and (isnan(price) or price <= 100000)")
_filter("f_tree", {"all_of": [{"any_of": [{"status": {"eq": "F"}}, {"priority": {"prefix": "2"}}]}, {"any_of": [{"price": {"range": {"lt": 90000}}}, {"none_of": [{"priority": {"eq": "2-HIGH"}}]}]}]}, "(coalesce(status, 0) = 1 or priority like '2%') and (coalesce(price < 90000 and not isnan(price), false) or priority <> '2-HIGH')")
_filter("f_empty_all", {"all_of": []}, "true")
_filter("f_empty_any", {"any_of": []}, "false")
_filter("f_bbox", {"region": {"bbox": _BOX}}, f"qx between {_A[0]} and {_B[0]} and qy between {_A[1]} and {_B[1]}")
# on this plane of microseconds and prices a circle that holds anything takes in all prices near its middle
_filter("f_circle", {"region": {"circle": {"centre": _C, "radius": 300.0 * fx.DAY}}}, _ellipse_sql(*_C, 300.0 * fx.DAY, 300.0 * fx.DAY))
_filter("f_ellipse", {"region": {"ellipse": {"centre": _C, "a": 100.0 * fx.DAY * 5, "b": 90_000.0}}}, _ellipse_sql(*_C, 500.0 * fx.DAY, 90_000.0))
_filter("f_polygon", {"region": {"polygon": [_P]}}, _polygon_sql(_G))
_filter("f_wkt", {"region": {"wkt": _WKT}}, _polygon_sql(_G))


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select entity from shown where entity in (select entity from members where artifact = 'n3')")
def f_member_of(spark, d):
    _, m = fx.tiers(spark, d)
    return filters.matching(fx.shown(spark, d), {"member_of": {"layer": "tiers", "artifact": "n3"}}, fx.scope(members=lambda _, a: m.where(F.col("artifact") == a))).select("entity")


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select entity from shown where status = 1 or entity in (select entity from members where artifact = 'r1')")
def f_region_artifact(spark, d):
    _, m = fx.tiers(spark, d)
    expr = {"any_of": [{"status": {"eq": "F"}}, {"region": {"artifact": {"layer": "tiers", "artifact": "r1"}}}, {"member_of": {"layer": "tiers", "artifact": "hidden"}}]}
    return filters.matching(fx.shown(spark, d), expr, fx.scope(members=lambda _, a: None if a == "hidden" else m.where(F.col("artifact") == a))).select("entity")


@query(f"with {SHOWN_SQL}, li as (select l_orderkey, sum(l_quantity) as v from lineitem group by 1) select entity from shown join li on entity = l_orderkey where v >= 120")
def f_scoped(spark, d):
    q = fx.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity")).agg(F.sum("l_quantity").alias("value"))
    return filters.matching(fx.shown(spark, d), {"price@lines": {"range": {"gte": 120}}}, fx.scope(scoped={"price@lines": q})).select("entity")


_HI = {"priority": {"prefix": "1"}}


def _flagged(spark, d, match: dict | None = None, high: dict | None = None):
    x = filters.with_flag(fx.shown(spark, d), match, fx.scope(), "matched")
    return filters.with_flag(x, high, fx.scope(), "highlighted")


@query(f"with {SHOWN_SQL} select count(*) as visible, count(*) filter (where status = 2) as matched, count(*) filter (where status = 2 and priority like '1%') as highlighted from shown")
def f_highlight(spark, d):
    x = _flagged(spark, d, {"status": {"eq": "O"}}, _HI)
    return x.agg(F.count(F.lit(1)).alias("visible"), F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & F.col("highlighted")).alias("highlighted"))


@query(f"with {TEXTS_SQL} select entity from texts where list_contains(tokens, 'the') and list_contains(tokens, 'and') and list_contains(tokens, 'from')")
def t_match(spark, d):
    return filters.matching(fx.texts(spark, d), {"text": {"match": "The AND from the"}}, fx.scope()).select("entity")


@query(f"with {TEXTS_SQL} select entity from texts where list_contains(tokens, 'was')::int + list_contains(tokens, 'from')::int + list_contains(tokens, 'idiot')::int >= 2")
def t_mofn(spark, d):
    return filters.matching(fx.texts(spark, d), {"text": {"match": "was from idiot", "minimum_should_match": 2}}, fx.scope()).select("entity")


@query(f"with {TEXTS_SQL} select entity from texts where ' ' || array_to_string(tokens, ' ') || ' ' like '% in the %'")
def t_phrase(spark, d):
    return filters.matching(fx.texts(spark, d), {"text": {"phrase": "In the"}}, fx.scope()).select("entity")


@query(f"with {TEXTS_SQL} select entity, len(tokens) as n_tokens from texts")
def t_tokens_native(spark, d):
    x = fx.read(spark, d, "documents")
    return x.select(F.col("doc_id").alias("entity"), F.size(latin_tokens(F.col("text"))).cast("long").alias("n_tokens"))


# --- viewport -----------------------------------------------------------------------------------------

_M, _H = {"price": {"range": {"gte": 100000}}}, {"status": {"eq": "O"}}
_MS, _HS = "coalesce(price >= 100000 and not isnan(price), false)", "coalesce(status = 2, false)"


@query(f"with {SHOWN_SQL} select {tile_sql(5)} as tile, count(*) as visible, count(*) filter (where {_MS}) as matched, count(*) filter (where {_MS} and {_HS}) as highlighted from shown group by 1")
def tile_counts(spark, d):
    return viewport.tile_counts(_flagged(spark, d, _M, _H), 5)


_IN = f"qx between {_A[0] >> 28 << 28} and {(_B[0] >> 28 << 28) + (1 << 28) - 1} and qy between {_A[1] >> 28 << 28} and {(_B[1] >> 28 << 28) + (1 << 28) - 1}"


@query(f"with {SHOWN_SQL} select {tile_sql(4)} as tile, count(*) as visible from shown where {_IN} group by 1")
def tiles_of_box(spark, d):
    x = viewport.in_tiles(fx.shown(spark, d), 4, spatial.tiles_of_box(tuple(_BOX), 4, FRAME))
    return x.groupBy("tile").agg(F.count(F.lit(1)).alias("visible"))


@query(f"with {SHOWN_SQL} select {tile_sql(3)} as tile, {tile_sql(6)} as cell, count(*) as visible, count(*) filter (where {_MS}) as matched from shown group by 1, 2")
def underlay(spark, d):
    return viewport.sub_cells(_flagged(spark, d, _M), 3, 3)


@query(f"with {SHOWN_SQL} " + " union all ".join(f"select {k} as depth, count(distinct {tile_sql(k)}) as tiles from shown" for k in range(7)))
def occupied_tiles(spark, d):
    return viewport.occupied(fx.shown(spark, d), 6)


_CUT = f"cast(16 as hugeint) * (select count(distinct {tile_sql(4)}) from shown) * 1152921504606846976 // (select count(*) from shown)"


@query(f"""with {SHOWN_SQL}, t as (select entity, rank, {tile_sql(4)} as tile from shown), r as (select *, row_number() over (partition by tile order by rank) as place,
  count(*) filter (where cast(rank as hugeint) < {_CUT}) over (partition by tile) as c from t) select tile, entity, place from r where place <= least(500, greatest(2, c))""")
def theta_sample(spark, d):
    x = fx.shown(spark, d)
    return viewport.sample(x, 4, viewport.threshold(x, 4)).select("tile", "entity", F.col("place").cast("long").alias("place"))


@query(f"with {SHOWN_SQL}, r as (select entity, {tile_sql(2)} as tile, row_number() over (partition by {tile_sql(2)} order by rank) as place from shown where {_MS}) select tile, entity, place from r where place <= 20")
def filtered_sample(spark, d):
    x = _flagged(spark, d, _M).where("matched")
    return viewport.sample(x, 2, None, 20).select("tile", "entity", F.col("place").cast("long").alias("place"))


@query(f"with {SHOWN_SQL}, t as (select *, {tile_sql(3)} as tile from shown), s as (select tile, least(count(*), 30) as served from t where {_MS} group by 1) select tile, count(*) as visible, count(*) filter (where {_MS}) as matched, count(*) filter (where {_MS}) as highlighted, coalesce(any_value(served), 0) as served from t left join s using (tile) group by 1")
def served_counts(spark, d):
    x = _flagged(spark, d, _M)
    return viewport.tile_counts(x, 3, viewport.sample(x.where("matched"), 3, None, 30))


@query(f"with {SHOWN_SQL} select entity as id, {tile_sql(2)} as tile, coalesce(status, 0) as status, priority from shown where {tile_sql(2)} in (0, 1)")
def point_columns(spark, d):
    x = viewport.in_tiles(fx.shown(spark, d), 2, [0, 1])
    return viewport.points(x, ["status", "priority"], ("status",)).drop("code")


@query(f"with {SHOWN_SQL}, {TIERS_SQL}, ok as (select artifact, level from artifacts join masked using (artifact) where masked >= 5) select entity, max_by(artifact, level) as tag from shown left join (select entity, artifact, level from members join ok using (artifact)) using (entity) group by 1")
def tagged_points(spark, d):
    a, m = fx.tiers(spark, d)
    x = fx.shown(spark, d)
    ok = layers.served(a, m, x, VIEWER, "count", 5).select("artifact", F.col("level").alias("depth"))
    return viewport.tagged(x, m, ok).select("entity", "tag")


@query(f"with {SHOWN_SQL} select {tile_sql(2)} as tile, count(*) as visible, case {tile_sql(2)} when 1 then 0 when 0 then 1 when 3 then 2 end as ordinal from shown where {tile_sql(2)} in (0, 1, 3) group by 1")
def named_tiles(spark, d):
    x = viewport.tile_counts(_flagged(spark, d), 2).select("tile", "visible")
    return viewport.named_tiles(x, [1, 0, 3, 1])


@query(f"with {SHOWN_SQL} select least(16, 60 - case when rank = 0 then 0 else cast(floor(log2(rank)) as int) + 1 end) as band, count(*) as items from shown where rank > 0 group by 1")
def rank_bands(spark, d):
    return viewport.banded(fx.shown(spark, d).where("rank > 0")).groupBy("band").agg(F.count(F.lit(1)).alias("items"))


# --- aggregates ---------------------------------------------------------------------------------------

_SETS = f"sets as (select *, {_MS} as in_set, true as in_ref from shown)"
_AGG = "count(*) filter (where in_set) as count, count(*) filter (where in_ref) as reference_count"


def _sets(spark, d, match: dict | None = _M):
    return filters.with_flag(fx.shown(spark, d), match, fx.scope(), "in_set").withColumn("in_ref", F.lit(True))


@query(f"with {SHOWN_SQL}, {_SETS} select count(*) filter (where in_set) as count from sets")
def agg_set(spark, d):
    return aggregate.set_size(_sets(spark, d))


_TOP = "top as (select priority as k, count(*) as n, row_number() over (order by count(*) desc, priority) - 1 as ord from sets where in_set and priority is not null group by 1 order by 2 desc, 1 limit 3)"


@query(f"with {SHOWN_SQL}, {_SETS}, {_TOP} select ord, 'listed' as grp, k as key, {_AGG} from sets join top on priority = k group by all union all select 3, 'rest', null, {_AGG} from sets where priority not in (select k from top) having count(*) > 0")
def agg_top(spark, d):
    return aggregate.by_values(_sets(spark, d), "priority", top=3)


@query(f"""with {SHOWN_SQL}, {_SETS}, l as (select * from (values (0, 3), (1, 1)) t(ord, k)) select ord, 'listed' as grp, k as key, count(*) filter (where in_set) as count, count(*) filter (where in_ref) as reference_count from l left join sets on status = k group by all
union all select 2, 'rest', null, {_AGG} from sets where status not in (1, 3) having count(*) > 0 union all select 3, 'none', null, {_AGG} from sets where status is null having count(*) > 0""")
def agg_named_rest_none(spark, d):
    return aggregate.by_values(_sets(spark, d), "status", named=[3, 1, 3])


@query(f"""with {SHOWN_SQL}, {_SETS}, t as (select count(*) filter (where in_set) as n, count(*) filter (where in_ref) as r from sets), g as (select priority as key, {_AGG} from sets group by 1)
select key, count, reference_count, case when n > 0 and reference_count > 0 then round((count / n) / (reference_count / r), 9) end as lift from g, t""")
def agg_lift(spark, d):
    x = _sets(spark, d)
    got = aggregate.by_values(x, "priority", top=10).where("grp = 'listed'").select("key", "count", "reference_count")
    return aggregate.with_lift(got, aggregate.totals(x)).withColumn("lift", F.round("lift", 9))


@query(f"with {SHOWN_SQL}, {_SETS} select {tile_sql(6)} as cell, {_AGG} from sets group by 1")
def agg_cells(spark, d):
    return aggregate.by_cells(_sets(spark, d), 6)


_AX, _AY = (_A[0] >> 27, _B[0] >> 27), (_A[1] >> 27, _B[1] >> 27)


@query(f"with {SHOWN_SQL}, {_SETS} select {tile_sql(5)} as cell, {_AGG} from sets where (qx >> 27) between {_AX[0]} and {_AX[1]} and (qy >> 27) between {_AY[0]} and {_AY[1]} group by 1")
def agg_area(spark, d):
    return aggregate.by_cells(_sets(spark, d), 5, aggregate.in_area(5, tuple(_BOX), FRAME))


@query(f"with {SHOWN_SQL}, {_SETS}, {_TOP} select coalesce(ord, 3) as ord, case when ord is null then 'rest' else 'listed' end as grp, k as key, {tile_sql(3)} as cell, {_AGG} from sets left join top on priority = k group by all having count(*) > 0")
def agg_value_cells(spark, d):
    return aggregate.by_values(_sets(spark, d), "priority", top=3, depth=3)


@query(f"with {SHOWN_SQL}, {_SETS} select count(distinct status) as groups from sets where in_set")
def agg_distinct(spark, d):
    return aggregate.distinct_groups(_sets(spark, d), "status")


def _hist_sql(value: str, edges: list, cast: str) -> str:
    n = len(edges) - 1
    lit = lambda e: repr(e) if cast == "double" else str(e)
    case = " ".join(f"when {value} >= {lit(a)} and {value} {'<=' if i == n - 1 else '<'} {lit(b)} then {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    names = ", ".join(f"({i}, 'bin', {lit(a)}::{cast}, {lit(b)}::{cast})" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return f"""with {SHOWN_SQL}, {_SETS}, h as (select case when {value} is null then {n + 1} when {'isnan(' + value + ')' if cast == 'double' else 'false'} then {n} {case} else {n} end as o, * from sets),
names(ord, grp, lower, upper) as (values {names}, ({n}, 'rest', null, null), ({n + 1}, 'none', null, null))
select ord, grp, lower, upper, count(h.o) filter (where in_set) as count, count(h.o) filter (where in_ref) as reference_count from names left join h on ord = o group by all having grp = 'bin' or count(h.o) > 0"""


_FE, _IE = bins.cut_floats(20_000.0, 300_000.0, 7), bins.cut_ints(1000, 250_003, 6)


@query(_hist_sql("price", _FE, "double"))
def hist_range(spark, d):
    return aggregate.histogram(_sets(spark, d), "price", aggregate.range_edges("double", 20_000, 300_000, 7))


@query(_hist_sql("whole", _IE, "bigint"))
def hist_ints(spark, d):
    return aggregate.histogram(_sets(spark, d), "whole", aggregate.range_edges("bigint", 1000, 250_003, 6))


@query(f"""with {SHOWN_SQL}, {_SETS}, e as (select min(price) as a, max(price) as b from sets where price is not null and not isnan(price)),
w as (select lead * pow(10, p) as step from e, (values (1.0), (2.0), (2.5), (5.0)) l(lead), range(-3, 9) r(p) where ceil((b - floor(a / (lead * pow(10, p))) * lead * pow(10, p)) / (lead * pow(10, p))) <= 12 order by 1 limit 1),
k as (select *, floor(a / step) as first, cast(ceil((b - floor(a / step) * step) / step) as int) as n from e, w),
h as (select in_set, in_ref, case when price is null then n + 1 when isnan(price) then n else least(cast(floor(price / step) - first as int), n - 1) end as ord, n, first, step from sets, k)
select ord, case when ord < n then 'bin' when ord = n then 'rest' else 'none' end as grp, case when ord < n then (first + ord) * step end as lower, case when ord < n then (first + ord + 1) * step end as upper, {_AGG} from h group by ord, n, first, step""")
def hist_auto(spark, d):
    x = _sets(spark, d)
    return aggregate.histogram(x, "price", aggregate.default_edges(x, "price", 12)).where("count > 0 or reference_count > 0")


@query(f"""with {SHOWN_SQL}, {_SETS}, e as (select min(whole) as a, max(whole) as b from sets),
w as (select step from e, (select cast(lead * pow(10, p) as bigint) as step from (values (1.0), (2.0), (2.5), (5.0)) l(lead), range(0, 9) r(p) where lead * pow(10, p) = floor(lead * pow(10, p))) where b // step - a // step < 9 order by 1 limit 1),
h as (select cast(whole // step - a // step as int) as ord, step, a, in_set, in_ref from sets, e, w)
select ord, 'bin' as grp, (a // step + ord) * step as lower, (a // step + ord + 1) * step as upper, {_AGG} from h group by ord, step, a""")
def hist_ints_auto(spark, d):
    x = _sets(spark, d)
    return aggregate.histogram(x, "whole", aggregate.default_edges(x, "whole", 9)).where("count > 0 or reference_count > 0")


@query(f"""with {SHOWN_SQL}, {_SETS}, m as (select *, year(make_timestamp(us)) * 12 + month(make_timestamp(us)) - 1 as mon from sets), e as (select min(mon) as a, max(mon) as b from m),
w as (select k from e, (values (1), (2), (3), (6), (12), (24), (60), (120)) s(k) where b // k - a // k < 20 order by 1 limit 1)
select cast(mon // k - a // k as int) as ord, 'bin' as grp, epoch_us(make_timestamp(cast((mon // k) * k // 12 as bigint), cast((mon // k) * k % 12 + 1 as bigint), 1, 0, 0, 0)) as lower,
  epoch_us(make_timestamp(cast((mon // k + 1) * k // 12 as bigint), cast((mon // k + 1) * k % 12 + 1 as bigint), 1, 0, 0, 0)) as upper, {_AGG} from m, e, w group by all""")
def hist_time(spark, d):
    x = _sets(spark, d)
    return aggregate.histogram(x, "odate", aggregate.default_edges(x, "odate", 20)).where("count > 0 or reference_count > 0")


@query(f"""with {SHOWN_SQL}, {_SETS}, t as (select count(*) as n from sets), c as (select count(*) as i from sets, t where cast(rank as hugeint) < cast(400 as hugeint) * 1152921504606846976 // n),
h as (select least(whole // 50000, 9) as o from sets, t where cast(rank as hugeint) < cast(400 as hugeint) * 1152921504606846976 // n and whole < 500000)
select cast(r.k as int) as ord, cast((count(h.o) * 2 * max(n) + max(i)) // (2 * max(i)) as bigint) as count from range(0, 10) r(k) left join h on h.o = r.k, t, c group by 1""")
def hist_sampled(spark, d):
    x = _sets(spark, d, None)
    return aggregate.sampled_histogram(x, "whole", [i * 50_000 for i in range(11)], 400).where("grp = 'bin'").select("ord", "count")


@query(f"with {SHOWN_SQL} select count(*) as items, count(*) filter (where price is not null and not isnan(price)) as finite, count(*) filter (where price is null) as none, min(price) filter (where not isnan(price)) as minimum, max(price) filter (where not isnan(price)) as maximum, round(fsum(price) filter (where price is not null and not isnan(price)) / count(*) filter (where price is not null and not isnan(price)), 6) as mean from shown")
def summary(spark, d):
    return aggregate.field_summary(fx.shown(spark, d), "price").withColumn("mean", F.round("mean", 6))


@query(f"with {SHOWN_SQL} select count(*) as items, count(whole) as finite, count(*) filter (where whole is null) as none, cast(min(whole) as double) as minimum, cast(max(whole) as double) as maximum, sum(whole) / count(whole) as mean from shown")
def summary_ints(spark, d):
    return aggregate.field_summary(fx.shown(spark, d), "whole")


_OK = "ok as (select artifact, level, masked from artifacts join masked using (artifact) where masked >= 5)"


@query(f"""with {SHOWN_SQL}, {_SETS}, {TIERS_SQL}, ok as (select artifact from artifacts join masked using (artifact) where level = 1 and masked >= 5), om as (select * from members join ok using (artifact)),
g as (select artifact, {_AGG} from sets join om using (entity) group by 1), l as (select artifact from g where count > 0 order by count desc, artifact limit 4),
f as (select s.entity, in_set, in_ref, max(case when l.artifact is not null then 2 when om.artifact is not null then 1 else 0 end) as held from sets s left join om on s.entity = om.entity left join l on om.artifact = l.artifact group by 1, 2, 3)
select 'listed' as grp, artifact, count, reference_count from g where artifact in (select artifact from l)
union all select case held when 1 then 'rest' else 'none' end, null, {_AGG} from f where held < 2 group by held""")
def agg_layer(spark, d):
    a, m = fx.tiers(spark, d)
    x = _sets(spark, d)
    ok = layers.served(a.where("level = 1"), m, x, VIEWER, "count", 5).select("artifact")
    return aggregate.by_artifacts(x, m.join(ok, "artifact", "left_semi"), top=4)


@query(f"""with {SHOWN_SQL}, {_SETS}, {TIERS_SQL}, om as (select * from members where artifact in ('r1', 'r3')), c as (select s.entity, {tile_sql(2)} as cell, in_set, in_ref, artifact from sets s left join om using (entity)),
f as (select grp, artifact, cell, {_AGG} from (select 'listed' as grp, * from c where artifact is not null union all select 'none', * from c where artifact is null) group by 1, 2, 3) select * from f where count > 0 or reference_count > 0""")
def agg_layer_cells(spark, d):
    x, (_, m) = _sets(spark, d), fx.tiers(spark, d)
    own = m.where("artifact in ('r1', 'r3')")
    return aggregate.by_artifacts(x, own, own.select("artifact").distinct(), depth=2)


# --- layers -------------------------------------------------------------------------------------------


def _layer(spark, d):
    a, m = fx.tiers(spark, d)
    return a, m, fx.shown(spark, d)


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select artifact, masked from masked")
def masked_count(spark, d):
    _, m, x = _layer(spark, d)
    return layers.masked_counts(m, x)


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select artifact, masked from artifacts join masked using (artifact) where size > 0 and masked >= 0.3 * size")
def criterion_fraction(spark, d):
    a, m, x = _layer(spark, d)
    return layers.served(a, m, x, VIEWER, "fraction", 0.3).select("artifact", "masked")


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select artifact, coalesce(masked, 0) as masked from artifacts left join masked using (artifact) where size > 0 and coalesce(masked, 0) >= size")
def criterion_all(spark, d):
    a, m, x = _layer(spark, d)
    return layers.served(a, m, x, VIEWER, "all").select("artifact", "masked")


@query(f"""with {SHOWN_SQL}, {TIERS_SQL}, gen as (select artifact, cast(entity % 3 as int) as rank, entity from members where artifact like 'c%'), c as (select artifact, rank, count(*) as n, count(*) filter (where entity in (select entity from shown)) as s from gen group by 1, 2)
select artifact, min(rank) as rank from c where n = s group by 1""")
def containment(spark, d):
    _, m, x = _layer(spark, d)
    return layers.contained(m.where("artifact like 'c%'").withColumn("rank", F.pmod("entity", F.lit(3)).cast("int")), x)


@query(f"""with {SHOWN_SQL}, {TIERS_SQL}, {_OK}, l as (select 'L' || artifact as artifact, artifact as target from artifacts where level < 2 union all select 'M' || artifact, 'L' || artifact from artifacts where level < 2)
select artifact from l where replace(target, 'L', '') in (select artifact from ok)""")
def attachments(spark, d):
    a, m, x = _layer(spark, d)
    ok = layers.served(a, m, x, VIEWER, "count", 5)
    top = a.where("level < 2").select("artifact").distinct()  # distinct, so that sizes aren't worked out for it
    pair = lambda name, target: F.struct(name.alias("artifact"), target.alias("target"))
    own, first, second = F.col("artifact"), F.concat(F.lit("L"), "artifact"), F.concat(F.lit("M"), "artifact")
    labels = top.select(F.inline(F.array(pair(first, own), pair(second, first))))
    return layers.attached(labels, ok).select("artifact")


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select artifact, count(*) as masked, round(avg(qx), 3) as mean_x, round(avg(qy), 3) as mean_y, min(qx) as min_qx, max(qx) as max_qx, min(qy) as min_qy, max(qy) as max_qy from members join shown using (entity) where artifact not like 'c%' group by 1")
def centroid_box(spark, d):
    _, m, x = _layer(spark, d)
    return layers.centroids(m.where("artifact not like 'c%'"), x).withColumn("mean_x", F.round("mean_x", 3)).withColumn("mean_y", F.round("mean_y", 3))


@query(f"with {SHOWN_SQL} select 'status-' || status as artifact, count(*) as masked from shown where status is not null group by 1")
def attribute_layer(spark, d):
    x = fx.shown(spark, d)
    m = layers.by_attribute(x, "status").withColumn("artifact", F.concat(F.lit("status-"), F.col("artifact").cast("string")))
    return layers.masked_counts(m, x)


@query(f"with {SHOWN_SQL} select 'box' as artifact, count(*) as masked from shown where qx between {_A[0]} and {_B[0]} and qy between {_A[1]} and {_B[1]} union all select 'circle', count(*) from shown where {_ellipse_sql(*_C, 60_000.0, 60_000.0)} union all select 'polygon', count(*) from shown where {_polygon_sql(_G)}")
def spatial_layer(spark, d):
    x = fx.shown(spark, d)
    qx, qy = F.col("qx"), F.col("qy")
    m = layers.by_shape(x, {"box": shapes.in_box(qx, qy, _BOX, FRAME), "circle": shapes.in_circle(qx, qy, _C, 60_000.0, FRAME), "polygon": shapes.in_polygon(qx, qy, [_P], FRAME)})
    return layers.masked_counts(m, x)


# the circle's half axis of 60,000 µs is thinner than a grid place: it may hold nothing, and then has no row
SQL["spatial_layer"] = f"select * from ({SQL['spatial_layer']}) where masked > 0"


@query(f"with {SHOWN_SQL}, {TIERS_SQL}, ex as (select artifact, entity from members where artifact in ('r0', 'r1')) select artifact, (select count(*) from shown) - count(*) filter (where entity in (select entity from shown)) as masked from ex group by 1")
def excluding_layer(spark, d):
    _, m, x = _layer(spark, d)
    return layers.excluding_counts(m.where("artifact in ('r0', 'r1')"), x)


@query(f"""with {SHOWN_SQL}, {TIERS_SQL}, t as (select {tile_sql(2)} as tile, m.artifact, bool_or({_MS}) as matched, bool_or({_MS} and {_HS}) as highlighted from members m join shown using (entity) where m.artifact like 'n%' group by 1, 2),
r as (select t.*, masked, row_number() over (partition by tile order by masked desc, artifact) as place from t join masked using (artifact)) select tile, artifact, masked, matched, highlighted, place from r where place <= 5""")
def tile_artifacts(spark, d):
    _, m = fx.tiers(spark, d)
    m = m.where("artifact like 'n%'")
    x = _flagged(spark, d, _M, _H)
    return layers.in_tiles(m, x, layers.masked_counts(m, x), 2, 5).withColumn("place", F.col("place").cast("long")).select("tile", "artifact", "masked", "matched", "highlighted", "place")


def _passing(spark, d):
    a, m, x = _layer(spark, d)
    return layers.served(a, m, x, VIEWER, "count", 5)


_BR = f"with {SHOWN_SQL}, {TIERS_SQL}, ok as (select * from artifacts join masked using (artifact) where masked >= 5), kids as (select parent as artifact, count(*) as child_count from ok where parent is not null group by 1)"
_BS = "select artifact, coalesce(title, artifact) as name, masked, coalesce(child_count, 0) as child_count from ok left join kids using (artifact)"


@query(f"{_BR} {_BS} where parent is null")
def browse_roots(spark, d):
    return layers.browse(_passing(spark, d))


@query(f"{_BR} {_BS} where parent = 'r2'")
def browse_children(spark, d):
    return layers.browse(_passing(spark, d), parent="r2")


@query(f"{_BR}, p as ({_BS} where lower(coalesce(title, artifact)) like '%c1%') select * from p order by masked desc, artifact limit 10")
def browse_search(spark, d):
    return layers.browse(_passing(spark, d), query="C1", limit=10)


# the whole layer as a nested one, r1 and two nations withheld; each node is drawn at depths from its rung to its children's
_TREE = f"""with recursive {SHOWN_SQL}, {TIERS_SQL}, ok as (select artifact from artifacts join masked using (artifact) where masked >= 5 and artifact not in ('r1', 'n3', 'n8')),
climb as (select a.artifact, a.parent from artifacts a join ok using (artifact) where a.parent is not null
    union select c.artifact, a.parent from climb c join artifacts a on a.artifact = c.parent where c.parent not in (select artifact from ok) and a.parent is not null),
links as (select c.artifact, c.parent from climb c join ok o on o.artifact = c.parent),
walk as (select artifact, 0 as rung from ok where artifact not in (select artifact from links) union all select l.artifact, w.rung + 1 from walk w join links l on l.parent = w.artifact),
steps as (select artifact, rung, (select min(b.rung) from links l join walk b on b.artifact = l.artifact where l.parent = w.artifact) as below from walk w),
depths as (select d.depth, (select count(*) from steps where rung <= d.depth and {{drawn}}) as size from (select distinct rung as depth from steps) d),
cut as (select coalesce(max(depth) filter (where size <= {{budget}}), 0) as depth from depths)
select artifact, rung, below is null or below > d.depth as frontier from steps, cut d where rung <= d.depth and {{drawn}}"""


def _tree(spark, d, budget, prune):
    a = fx.tiers(spark, d)[0].withColumn("parents", F.array_compact(F.array("parent")))
    return trees.drawn_cut(a, _passing(spark, d).where("artifact not in ('r1', 'n3', 'n8')"), budget, prune)


@query(_TREE.format(drawn="true", budget=40))
def tree_cut(spark, d):
    return _tree(spark, d, 40, False)


@query(_TREE.format(drawn="(below is null or below > d.depth)", budget=20))
def tree_cut_pruned(spark, d):
    return _tree(spark, d, 20, True)


_CUT_TREE, _CUT_END = _TREE.format(drawn="true", budget=40).rsplit("select artifact, rung, below", 1)


@query(f"""{_CUT_TREE.rstrip()}, {_SETS}, front as (select artifact from steps, cut d where rung <= d.depth and (below is null or below > d.depth)), om as (select * from members where artifact in (select artifact from front)),
g as (select artifact, {_AGG} from sets join om using (entity) group by 1), l as (select artifact from g where count > 0 order by count desc, artifact limit 5),
f as (select s.entity, in_set, in_ref, max(case when l.artifact is not null then 2 when om.artifact is not null then 1 else 0 end) as held from sets s left join om on s.entity = om.entity left join l on om.artifact = l.artifact group by 1, 2, 3)
select 'listed' as grp, artifact, count, reference_count from g where artifact in (select artifact from l)
union all select case held when 1 then 'rest' else 'none' end, null, {_AGG} from f where held < 2 group by held""")
def agg_top_at_cut(spark, d):
    return aggregate.top_at_cut(_sets(spark, d), fx.tiers(spark, d)[1], _tree(spark, d, 40, False), 5)


@query()
def hull(spark, d):
    _, m, x = _layer(spark, d)
    return layers.hulls(m.where("artifact like 'r%'"), x).withColumn("rings", F.to_json("rings"))


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select artifact, min(qx) as min_qx, max(qx) as max_qx, min(qy) as min_qy, max(qy) as max_qy, true as closed from members join shown using (entity) where artifact like 'n%' group by 1")
def hull_box(spark, d):
    """Rings reach just as far as the members do, and each has an area or is a group of one or two."""
    _, m, x = _layer(spark, d)
    rings = layers.hulls(m.where("artifact like 'n%'"), x).select("artifact", F.explode("rings").alias("ring"))
    p = rings.select("artifact", "ring", F.explode("ring").alias("p"))
    area = F.expr("aggregate(sequence(0, size(ring) - 1), cast(0 as decimal(38,0)), (s, i) -> cast(s + cast(ring[i][0] as decimal(18,0)) * ring[(i + 1) % size(ring)][1] - cast(ring[i][1] as decimal(18,0)) * ring[(i + 1) % size(ring)][0] as decimal(38,0)))")
    at = lambda i: F.get(F.col("p"), i)
    return p.groupBy("artifact").agg(F.min(at(0)).alias("min_qx"), F.max(at(0)).alias("max_qx"), F.min(at(1)).alias("min_qy"), F.max(at(1)).alias("max_qy"), F.bool_and((area > 0) | (F.size("ring") < 3)).alias("closed"))


# --- categories ---------------------------------------------------------------------------------------


def _vocabulary(spark, d):
    p = fx.read(spark, d, "part").select(F.col("p_brand").alias("key")).distinct()
    return p.select(F.regexp_extract("key", "([0-9]+)", 1).cast("int").alias("code"), "key", F.concat(F.lit("The "), F.lower("key"), F.lit(" line")).alias("title"))


_VOC = "voc as (select distinct cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) as code, p_brand as key, 'The ' || lower(p_brand) || ' line' as title from part)"


@query(f"with {_VOC} select code, key from voc where key > 'Brand#2' order by key limit 8")
def cat_values(spark, d):
    return categories.enumerate_values(_vocabulary(spark, d), "Brand#2", 8).select("code", "key")


@query(f"with {_VOC} select code, key from voc where code in (3, 5, 999)")
def cat_resolve(spark, d):
    return categories.resolve(_vocabulary(spark, d), [3, 5, 999]).select("code", "key")


@query(f"with {SHOWN_SQL}, {_VOC} select code, key from voc where code in (select cast(nation as int) from shown)")
def cat_derived(spark, d):
    x = fx.shown(spark, d).select(F.col("nation").cast("int").alias("nation"))
    return categories.listable(_vocabulary(spark, d), x, "nation").select("code", "key")


@query(f"with {_VOC} select code, key, 0 as kind from voc where lower(key) like 'brand#1%'")
def suggest(spark, d):
    return categories.suggest(categories.entry_table(_vocabulary(spark, d)), "BRAND#1", 50).select("code", "key", "kind")


@query(f"with {SHOWN_SQL}, {_VOC} select code, key, (select count(*) from shown where nation = code and {_MS}) as count, (select count(*) from shown where nation = code) as total from voc where code in (select nation from shown)")
def suggest_counts(spark, d):
    x = _flagged(spark, d, _M).withColumn("nation", F.col("nation").cast("int"))
    return categories.suggest(categories.entry_table(_vocabulary(spark, d)), "line", 100, x, "nation", x.where("matched")).select("code", "key", "count", "total")


@query(f"with {_VOC}, h as (select code, key, row_number() over (order by lower(key), key) as place, count(*) over () as n from voc where lower(key) like 'brand#%') select code, key, n > 4 as more from h where place <= 4")
def suggest_more(spark, d):
    return categories.suggest(categories.entry_table(_vocabulary(spark, d)), "Brand#", 4).select("code", "key", "more")


# --- records ------------------------------------------------------------------------------------------


@query(f"with {SHOWN_SQL} select entity as id, status, priority, {tile_sql(16)} as order_cell, rank as order_rank, round({FRAME.min_y!r} + (qy + 0.5) / 4294967296 * {FRAME.max_y - FRAME.min_y!r}, 6) as position_y from shown order by order_cell, order_rank limit 200")
def items_page(spark, d):
    return records.read_items(fx.shown(spark, d), ["status", "priority"], limit=200, frame=FRAME).drop("position_x").withColumn("position_y", F.round("position_y", 6))


@query(f"with {SHOWN_SQL} select entity as id, entity as order_entity from shown where entity > 700 order by entity limit 150")
def items_cursor(spark, d):
    return records.read_items(fx.shown(spark, d), [], "stored", (700,), 150)


@query(f"with {SHOWN_SQL} select entity as id, {_MS} as matched, entity as order_entity from shown order by entity limit 300")
def items_unmatched(spark, d):
    return records.read_items(_flagged(spark, d, _M), [], "stored", None, 300, "matched", True)


@query(f"with {SHOWN_SQL} select count(*) as visible, count(*) filter (where {_MS}) as matched from shown")
def head_counts(spark, d):
    return records.head_counts(_flagged(spark, d, _M), "matched")


@query(f"with {SHOWN_SQL} select entity, priority, 'public' as why, 'orders' as views from shown where entity = 14")
def item_card(spark, d):
    got = records.item_card(fx.items(spark, d), VIEWER, 14, [("orders", None), ("secret", "MACHINERY")], *fx.overlay(spark, d))
    return got.select("entity", "priority", F.array_join("why", ",").alias("why"), F.array_join("views", ",").alias("views"))


@query(f"with {SHOWN_SQL}, {TIERS_SQL} select artifact, level, parent, title, masked from artifacts join masked using (artifact) where masked >= 5 and level = 1 and artifact > 'n1'")
def artifacts_page(spark, d):
    return records.read_artifacts(_passing(spark, d), level=1, after="n1").select("artifact", "level", "parent", "title", "masked")


# --- ingest -------------------------------------------------------------------------------------------


def _batch(spark, d):
    e = fx.read(spark, d, "events")
    n = lambda k: F.col("event_id") % k
    block = lambda k: (F.col("event_id") - n(k)).cast("string")
    key = F.when(n(5) == 0, F.concat(F.lit("new-"), block(15))).when(n(3) != 0, F.concat(F.lit("key-"), block(6)))
    place = lambda c: F.when(n(10) != 0, F.col(c))
    labels = F.when(n(13) == 0, F.array(F.lit("HOUSEHOLD"))).when(n(9) == 0, F.array(F.lit("MACHINERY")))
    return e.select(F.col("event_id").alias("row"), F.when(n(40) == 0, -F.col("event_id")).when(n(4) == 0, F.col("event_id") - n(8)).alias("id"), key.alias("key"), place("value").alias("x"), place("value").alias("y"), labels.alias("labels"))


_BATCH = """batch as (select event_id as row, case when event_id % 40 = 0 then -event_id when event_id % 4 = 0 then event_id - event_id % 8 end as id,
  case when event_id % 5 = 0 then 'new-' || (event_id - event_id % 15) when event_id % 3 <> 0 then 'key-' || (event_id - event_id % 6) end as key, event_id % 10 = 0 or value is null as nowhere, event_id % 13 = 0 as shut from events)"""


# rows are decided in order, so the recursion settles in each round the rows that are first in all that they claim
@query(f"""with recursive {ORDERS_SQL}, held as (select entity, key, {allowed_sql('MACHINERY', 'p2')} as mine from items), {_BATCH},
j as (select b.*, h.entity as by_id, case when k.mine then k.entity end as by_key, k.entity is not null as taken from batch b left join held h on h.entity = b.id and h.mine left join held k on k.key = b.key),
r as (select row, coalesce(by_id, by_key) as item, case when by_key is null then key end as sets, case when shut then 'label_not_held' when id is not null and by_id is null then 'unknown_id' when by_id <> by_key then 'names_two_items'
  when coalesce(by_id, by_key) is null and nowhere then 'names_no_item' when by_key is null and taken then 'value_held' end as reason from j),
w as (select row, coalesce('i' || item, 'r' || row) as a, coalesce('v' || sets, 'r' || row) as b, 0 as st from r where reason is null
  union all select row, a, b, case when ok then 1 when bool_or(ok) over (partition by a) or bool_or(ok) over (partition by b) then 2 else 0 end
  from (select row, a, b, row = min(row) over (partition by a) and row = min(row) over (partition by b) as ok from w where st = 0)),
kept as (select row, a, b from w where st = 1),
f as (select r.row, r.item, coalesce(r.reason, case when i.row < r.row then 'one_item_twice' when v.row < r.row then 'one_value_twice' end) as reason from r
  left join kept i on i.a = 'i' || r.item left join kept v on v.b = 'v' || r.sets)
select row, case when reason is not null then 'refuse' when item is not null then 'edit' else 'create' end as verdict, case when reason is null then item end as entity, reason from f""")
def resolve_rows(spark, d):
    items = fx.items(spark, d)
    scope = access.writable(items, fx.OTHER)
    return ingest.resolve_rows(_batch(spark, d), items.select("entity", "key"), scope, fx.OTHER).select("row", "verdict", "entity", "reason")


@query("select event_id as row, 100 + row_number() over (order by event_id) as entity from events")
def new_entities(spark, d):
    rows = fx.read(spark, d, "events").select(F.col("event_id").alias("row"))
    return ingest.next_entities(rows, 100).select("row", "entity")


@query("""with e as (select user_id as entity, event_id as seq, event_type, case when event_id % 5 = 0 then null else value end as value, event_id % 2 = 0 as has_value, event_id % 3 = 0 as has_type from events),
l as (select entity, max(seq) filter (where has_value) as sv, max(seq) filter (where has_type) as st from e group by 1)
select c_custkey as entity, case when l.sv is not null then (select value from e x where x.seq = l.sv) else c_acctbal end as value, case when l.st is not null then (select event_type from e x where x.seq = l.st) else c_mktsegment end as kind from customer left join l on c_custkey = l.entity""")
def edit_keep_clear(spark, d):
    c = fx.read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("kind"))
    e = fx.read(spark, d, "events")
    named = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, F.lit("value")), F.when(F.col("event_id") % 3 == 0, F.lit("kind"))))
    edits = e.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.col("event_type").alias("kind"), named.alias("present"))
    return ingest.apply_edits(c, edits, ["value", "kind"])


_CH = "ch as (select user_id as entity, event_id as seq, case event_id % 7 when 0 then 'delete' when 1 then 'unsuppress' when 2 then 'unsuppress' else 'suppress' end as op from events)"


@query(f"with {_CH}, del as (select distinct entity from ch where op = 'delete'), sup as (select entity from ch where op <> 'delete' group by 1 having max_by(op, seq) = 'suppress') select entity, 'deleted' as state from del union all select entity, 'suppressed' from sup")
def overlay_sequence(spark, d):
    e = fx.read(spark, d, "events")
    op = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 7 <= 2, "unsuppress").otherwise("suppress")
    gone, hidden = ingest.overlay_state(e.select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), op.alias("op")))
    return gone.withColumn("state", F.lit("deleted")).unionByName(hidden.withColumn("state", F.lit("suppressed")))


@query("select l_orderkey || '-' || l_partkey as key, count(*) as holders from lineitem group by 1 having count(*) > 1 union all select cast(l_suppkey % 7 as varchar), count(*) from lineitem where l_suppkey % 7 > 0 group by 1")
def unique_conflicts(spark, d):
    li = fx.read(spark, d, "lineitem")
    pairs = ingest.unique_conflicts(li.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("key")), "key")
    # few values with very many holders, and null, which is free
    return pairs.unionByName(ingest.unique_conflicts(li.select(F.when(F.col("l_suppkey") % 7 > 0, (F.col("l_suppkey") % 7).cast("string")).alias("key")), "key"))


@query("with v as (select row_number() over (order by p_brand) as code, p_brand as key from (select distinct p_brand from part where p_size < 3)), n as (select distinct p_brand as key from part where p_brand not in (select key from v)) select cast(code as int) as code, key from v union all select cast(row_number() over (order by key) + (select coalesce(max(code), 0) from v) as int), key from n")
def mint_codes(spark, d):
    from pyspark.sql import Window

    p = fx.read(spark, d, "part")
    v = p.where("p_size < 3").select(F.col("p_brand").alias("key")).distinct().withColumn("code", F.row_number().over(Window.orderBy("key")).cast("int"))
    return ingest.mint_codes(v.select("code", "key"), p.select(F.col("p_brand").alias("key")), True)[0]


@query(f"with {ORDERS_SQL} select entity, rank from items where entity % 97 <> 0")
def compact(spark, d):
    return ingest.compact(fx.orders(spark, d), fx.overlay(spark, d)[0])[0].select("entity", "rank")


@query("""with c as (select *, c_custkey % 5 = 0 as edited, c_custkey % 3 = 0 as moved, c_custkey % 35 = 0 as gone from customer)
select 'c' || c_custkey as key, case when edited and moved then 1.0 else cast(c_custkey % 90 as double) end as x, case when edited and moved then 2.0 else cast(c_custkey % 70 as double) end as y,
  case when edited then null else c_name end as name, c_acctbal as balance, c_mktsegment as label from c where not gone""")
def store_flow(spark, d):
    """A store through a batch that creates, one that edits, its repetition, deletions, a merge and a compaction."""
    from .plans.durable import shared_folder
    from .plans.store import Store

    store = Store(spark, f"{shared_folder(spark)}/veilmap-store-{uuid.uuid4().hex}", spatial.Frame(0.0, 0.0, 100.0, 100.0), "name string, balance double")
    c = fx.read(spark, d, "customer")
    n = lambda k: F.col("c_custkey") % k
    head = [F.col("c_custkey").alias("row"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key")]
    made = c.select(*head, n(90).cast("double").alias("x"), n(70).cast("double").alias("y"), F.array("c_mktsegment").alias("labels"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    edits = c.where(n(5) == 0).select(*head, F.when(n(3) == 0, 1.0).alias("x"), F.when(n(3) == 0, 2.0).alias("y"), F.lit(None).cast("string").alias("name"))
    for i in range(3):  # four parts of a size, which a merge takes together
        store.take(made.where(n(3) == i), "q", f"made-{i}")
    store.take(edits, "q", "edits")
    if store.take(edits, "q", "edits") is not None:
        raise RuntimeError("a batch was taken twice")
    store.change(store.items().where("cast(substr(key, 2) as bigint) % 35 = 0"), "delete")
    store.merge()
    store.compact()
    return store.items().select("key", "x", "y", "name", "balance", F.col("labels")[0].alias("label"))


@query("with p as (select l_orderkey as entity, l_returnflag as view from lineitem) select distinct entity from p where view = 'R' and entity not in (select entity from p where view <> 'R')")
def drop_view(spark, d):
    p = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("view"))
    return ingest.drop_view(p, "R")[1]


@query("""with m as (select distinct 's' || l_suppkey as artifact, l_orderkey as entity from lineitem where l_linenumber = 1), a as (select distinct artifact from m), x as (select distinct 's' || l_suppkey as artifact, l_orderkey as entity from lineitem where l_linenumber = 2)
select artifact, count(*) as members from (select * from m union select * from x where artifact in (select artifact from a)) group by 1""")
def grow_members(spark, d):
    li = fx.read(spark, d, "lineitem")
    take = lambda n: li.where(F.col("l_linenumber") == n).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("artifact"), F.col("l_orderkey").alias("entity"))
    m = take(1).distinct()
    return ingest.grow_members(m, take(2), m.select("artifact").distinct(), False)[0].groupBy("artifact").agg(F.count(F.lit(1)).alias("members"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_rows(spark, d):
    from .sources import readers

    return readers.from_json(fx.read(spark, d, "events").select("event_id", "props"), "props", "k bigint").select("event_id", "k")


@query(f"select c_custkey as id, {fixed_sql('c_acctbal', -1000.0, 10000.0)} as qx, {fixed_sql('c_nationkey', 0.0, 25.0)} as qy from customer")
def point_source(spark, d):
    """A Parquet table of points under other names, placed on the grid."""
    from .sources import readers

    p = readers.points(spark, f"{d}/customer.parquet", {"id": "c_custkey", "x": "c_acctbal", "y": "c_nationkey"})
    return spatial.place(p, spatial.Frame(-1000.0, 0.0, 10000.0, 25.0)).select("id", "qx", "qy")


@query("select unnest(['missing column c_phone', 'column c_name is string, declared int', 'undeclared column c_nationkey', 'undeclared column c_acctbal', 'undeclared column c_mktsegment']) as finding")
def source_check(spark, d):
    """A source's schema against its declaration; no row is read."""
    from .plans.store import check_declaration

    found = check_declaration({"c_custkey": "bigint", "c_phone": "string", "c_name": "int"}, fx.read(spark, d, "customer"))
    return spark.createDataFrame([(x,) for x in found], "finding string")


@query("select n_nationkey as key, n_name as name, n_regionkey as region from nation")
def arrow_source(spark, d):
    """Rows given as an Arrow table."""
    import pyarrow as pa

    from .sources import readers

    rows = fx.read(spark, d, "nation").limit(1000).toArrow()  # a dimension
    return readers.from_arrow(spark, pa.table({"key": rows["n_nationkey"], "name": rows["n_name"], "region": rows["n_regionkey"]}))


@query("select distinct 'n' || c_nationkey as artifact, o_orderkey as entity from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def member_table(spark, d):
    from .sources import readers

    c = fx.read(spark, d, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("artifact"), F.col("c_custkey").alias("cust"))
    return readers.members(c, fx.orders(spark, d).select("entity", "cust"), "cust")


#: What the bench times: the main verbs.
HEADLINE = ["visible_set", "tile_counts", "underlay", "theta_sample", "filtered_sample", "agg_top", "agg_lift", "agg_cells", "hist_range", "hist_auto", "summary", "agg_layer", "t_match", "f_polygon", "tile_artifacts", "browse_search", "items_page", "resolve_rows"]
