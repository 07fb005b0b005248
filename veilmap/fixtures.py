"""The driver's tables in the roles of the data model, and the same roles as SQL for the oracle.

Items are orders on a map of order date and total price. Labels come from the customer's segment and the order's priority;
every seventh order is public, every seventh asks for both, every seventh for either, every seventh has no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import spatial
from .operators import access, viewport
from .operators.filters import Field, Scope

DAY = 86_400_000_000
FRAME = spatial.Frame(7305.0 * DAY, 0.0, 14610.0 * DAY, 600_000.0)
VIEWER = access.Viewer.of("BUILDING", "p1")
OTHER = access.Viewer.of("MACHINERY", "p2")
STATUS = {"F": 1, "O": 2, "P": 3}
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} as timestamp_ntz))")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without keys: entity, x, y, qx, qy, code, rank, fields and labels."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    b = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.col("o_orderkey").alias("entity"), F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")).alias("key"), micros("o_orderdate").alias("us"), F.col("o_totalprice").alias("y"), F.col("c_mktsegment").alias("seg"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("p"), F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("letter"), F.col("o_orderpriority").alias("priority")
    )
    m = lambda n: F.pmod("entity", F.lit(n))
    b = b.withColumn("x", F.col("us").cast("double")).withColumn("odate", F.timestamp_micros("us"))
    b = b.withColumn("status", F.when(m(11) != 0, F.when(F.col("letter") == "F", 1).when(F.col("letter") == "O", 2).when(F.col("letter") == "P", 3)))
    b = b.withColumn("price", F.when(m(17) != 0, F.when(m(13) == 0, F.lit(float("nan"))).otherwise(F.col("y")))).withColumn("whole", F.floor("y").cast("long")).withColumn("large", F.when(m(19) != 0, F.col("y") > 200_000))
    seg = lambda *x: F.array(*x)
    labels = F.when(m(7) == 0, seg(F.lit("public"))).when(m(7) == 1, seg(F.concat("seg", F.lit("&"), "p"))).when(m(7) == 2, seg(F.col("seg"), F.col("p"))).when(m(7) == 3, F.array().cast("array<string>")).otherwise(seg(F.col("seg")))
    return spatial.place(b.withColumn("labels", labels).withColumn("rank", viewport.hashed_rank(F.col("entity"))), FRAME)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).withColumn("keys", access.plain_keys(F.col("labels")))


def overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"))
    return o.where("entity % 97 = 0"), o.where("entity % 89 = 0")


def shown(spark: SparkSession, sf_dir: str, viewer: access.Viewer = VIEWER) -> DataFrame:
    """The visible set of a viewer."""
    return access.visible(items(spark, sf_dir), viewer, *overlay(spark, sf_dir))


SCOPE_FIELDS = {
    "cust": Field("int"), "large": Field("bool"),
    "status": Field("category", codes=STATUS), "priority": Field("keyword"), "price": Field("float"), "whole": Field("int"), "odate": Field("timestamp"), "key": Field("unique"), "seg": Field("keyword"), "text": Field("text", tokens="tokens"),
}


def scope(spark: SparkSession | None = None, sf_dir: str = "", **more) -> Scope:
    return Scope(SCOPE_FIELDS, frame=FRAME, **more)


def tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, members) of the tiered layer region, nation, customer over orders."""
    n, r, c = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("c_custkey"))
    tag = lambda s, k: F.concat(F.lit(s), F.col(k).cast("string"))
    rows = o.join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    members = rows.select("entity", F.explode(F.array(tag("r", "n_regionkey"), tag("n", "c_nationkey"), tag("c", "c_custkey"))).alias("artifact"))
    none = F.lit(None).cast("string")
    a = r.select(tag("r", "r_regionkey").alias("artifact"), F.lit(0).alias("level"), none.alias("parent"), F.col("r_name").alias("title"))
    a = a.unionByName(n.select(tag("n", "n_nationkey").alias("artifact"), F.lit(1).alias("level"), tag("r", "n_regionkey").alias("parent"), F.col("n_name").alias("title")))
    a = a.unionByName(c.select(tag("c", "c_custkey").alias("artifact"), F.lit(2).alias("level"), tag("n", "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("title")))
    size = members.groupBy("artifact").agg(F.count(F.lit(1)).alias("size"))
    return a.join(size, "artifact", "left").fillna(0, ["size"]).withColumn("label_text", F.col("artifact")), members


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text items with tokens."""
    from .functions.text import tokens_of

    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entity"), "source", tokens_of(F.col("text")).alias("tokens"))


# --- the same in SQL --------------------------------------------------------------------------------


def tile_sql(depth: int, qx: str = "qx", qy: str = "qy") -> str:
    """Interleaving of the top bits of two places."""
    if depth == 0:
        return "cast(0 as bigint)"
    bits = " + ".join(f"((({qx} >> {32 - depth + i}) & 1) << {2 * i}) + ((({qy} >> {32 - depth + i}) & 1) << {2 * i + 1})" for i in range(depth))
    return f"cast({bits} as bigint)"


def fixed_sql(v: str, low: float, high: float) -> str:
    return f"cast(least(greatest(floor(({v} - {low!r}) / ({high!r} - {low!r}) * 4294967296.0), 0), 4294967295) as bigint)"


ORDERS_SQL = f"""
base as (select o_orderkey as entity, 'key-' || o_orderkey as key, epoch_us(o_orderdate) as us, o_totalprice as y, c_mktsegment as seg, 'p' || substr(o_orderpriority, 1, 1) as p,
    c_nationkey as nation, o_custkey as cust, o_orderstatus as letter, o_orderpriority as priority from orders left join customer on o_custkey = c_custkey),
o1 as (select *, cast(us as double) as x, case when entity % 11 <> 0 then case letter when 'F' then 1 when 'O' then 2 when 'P' then 3 end end as status,
    case when entity % 17 <> 0 then case when entity % 13 = 0 then 'nan'::double else y end end as price, cast(floor(y) as bigint) as whole, case when entity % 19 <> 0 then y > 200000 end as large,
    cast('0x' || substr(md5('k' || entity), 1, 15) as bigint) as rank from base),
items as (select *, {fixed_sql("x", FRAME.min_x, FRAME.max_x)} as qx, {fixed_sql("y", FRAME.min_y, FRAME.max_y)} as qy from o1)"""


def allowed_sql(seg: str = "BUILDING", p: str = "p1") -> str:
    return f"(entity % 7 = 0 or (entity % 7 = 1 and seg = '{seg}' and p = '{p}') or (entity % 7 = 2 and (seg = '{seg}' or p = '{p}')) or (entity % 7 in (4, 5, 6) and seg = '{seg}'))"


LIVE_SQL = "entity % 97 <> 0 and entity % 89 <> 0"
SHOWN_SQL = f"{ORDERS_SQL},\nshown as (select * from items where {allowed_sql()} and {LIVE_SQL})"
TIERS_SQL = """
members as (select o_orderkey as entity, unnest(['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey]) as artifact from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
sizes as (select artifact, count(*) as size from members group by 1),
artifacts as (select a.*, coalesce(size, 0) as size from (
    select 'r' || r_regionkey as artifact, 0 as level, null as parent, r_name as title from region
    union all select 'n' || n_nationkey, 1, 'r' || n_regionkey, n_name from nation
    union all select 'c' || c_custkey, 2, 'n' || c_nationkey, case when c_custkey % 3 <> 0 then c_name end from customer) a left join sizes using (artifact)),
masked as (select artifact, count(*) as masked from members where entity in (select entity from shown) group by 1)"""
# signs join letters or digits to their like only: those between unlike ones become spaces first
TEXTS_SQL = r"""texts as (select doc_id as entity, source, regexp_extract_all(
    regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '(\p{L})[''’.:·]([\p{N}_])', '\1 \2', 'g'), '([\p{N}_])[''’.:·,;]([\p{L}_])', '\1 \2', 'g'), '[\p{L}\p{M}\p{N}_]+(?:[''’.:·][\p{L}\p{N}_]+)*') as tokens from documents)"""
