"""Map views: tile counts, sub-cells, zoom-stable samples, point columns and tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial

RANK_BITS = 60
MOST_RANGES = 8


@dataclass(frozen=True)
class Sampling:
    """How many points a tile shows."""

    k_min: int = 2
    k_max: int = 500
    target: int = 16
    rank_bits: int = RANK_BITS


def hashed_rank(key: Column, salt: str = "k") -> Column:
    """A uniform rank of 60 bits from a hash of the key: the order that sampling follows."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 15), 16, 10).cast("long")


def tiles_frame(spark, tiles: list[int]) -> DataFrame:
    """A request's tiles with their places in the request. The list is the request's own, bounded by its caller."""
    rows = [(t, i) for i, t in enumerate(dict.fromkeys(tiles))]
    return spark.createDataFrame(rows, "tile bigint, ordinal int")


def in_tiles(items: DataFrame, depth: int, tiles: list[int]) -> DataFrame:
    """Items of the named tiles, as (.., tile): by the tile itself, and by code ranges, which files in map order can prune.

    Where tiles make more than MOST_RANGES ranges, those with the narrowest gaps are taken together: the condition on the tile
    is exact, and a condition on the code, which may be an expression, is short whatever the request is.
    """
    size = 1 << 64 - 2 * depth
    starts = sorted((t * size + (1 << 63)) % (1 << 64) - (1 << 63) for t in set(tiles))  # codes are signed
    wide = sorted((i for i in range(1, len(starts)) if starts[i] > starts[i - 1] + size), key=lambda i: starts[i - 1] - starts[i])
    cuts = [0, *sorted(wide[: MOST_RANGES - 1]), len(starts)]
    near = F.col("code").isNotNull() if depth == 0 else F.lit(False)
    for a, b in zip(cuts, cuts[1:]) if starts and depth else ():
        near = near | F.col("code").between(starts[a], starts[b - 1] + size - 1)
    tile = spatial.tile(F.col("code"), depth)
    return items.where(tile.isin(*sorted(set(tiles))) if tiles else F.lit(False)).where(near).withColumn("tile", tile)


def tile_counts(shown: DataFrame, depth: int, served: DataFrame | None = None) -> DataFrame:
    """tile, visible, matched, highlighted and, with a sample, served: for each tile that holds a visible item.

    shown: visible items with code, matched and highlighted.
    """
    out = shown.withColumn("tile", spatial.tile(F.col("code"), depth)).groupBy("tile").agg(F.count(F.lit(1)).alias("visible"), F.count_if("matched").alias("matched"), F.count_if(F.col("matched") & F.col("highlighted")).alias("highlighted"))
    if served is not None:
        n = served.groupBy("tile").agg(F.count(F.lit(1)).alias("served"))
        out = out.join(n, "tile", "left").withColumn("served", F.coalesce("served", F.lit(0)).cast("long"))
    return out


def sub_cells(shown: DataFrame, depth: int, offset: int) -> DataFrame:
    """Exact counts of the cells offset levels below the tiles: tile, cell, visible, matched."""
    if not 0 <= offset <= 4:
        raise ValueError("an underlay is at most 4 levels finer")
    cells = shown.withColumn("cell", spatial.tile(F.col("code"), depth + offset))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("visible"), F.count_if("matched").alias("matched")).select(F.shiftrightunsigned("cell", 2 * offset).alias("tile"), "cell", "visible", "matched")


def occupied(visible: DataFrame, depth: int) -> DataFrame:
    """depth, tiles: how many tiles of each depth up to ``depth`` hold a visible item, counted exactly in one pass."""
    deepest = visible.select(spatial.tile(F.col("code"), depth).alias("t")).distinct()
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")
    up = deepest.select("t", level).select("depth", F.expr(f"shiftrightunsigned(t, 2 * ({depth} - depth))").alias("t"))
    return up.groupBy("depth").agg(F.countDistinct("t").alias("tiles"))


def threshold(visible: DataFrame, depth: int, s: Sampling = Sampling()) -> int | None:
    """The rank below which a depth shows items: target * occupied tiles / visible items of the rank space; None shows all.

    Both figures come from the visible set of the whole view, before any filter.
    """
    r = visible.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(spatial.tile(F.col("code"), depth)).alias("tiles")).first()
    if not r["n"]:
        return None
    cut = (s.target * r["tiles"] << s.rank_bits) // r["n"]
    return None if cut >= 1 << s.rank_bits else cut


def sample(matched: DataFrame, depth: int, cut: int | None, k: int | None = None, s: Sampling = Sampling()) -> DataFrame:
    """The items each tile shows: the m smallest ranks, m = min(cap, max(min(k_min, cap), items below the cut)).

    A filtered request has no cut. Ranks up to the cap are found by a bounded top-k per tile, so a crowded tile is never
    sorted whole; items below the cut are counted by a partial aggregate.
    """
    cap = s.k_max if k is None else k
    floor = min(s.k_min, cap)
    x = matched.withColumn("tile", spatial.tile(F.col("code"), depth))
    order = Window.partitionBy("tile").orderBy("rank", "entity")
    top = x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    if cut is None:
        return top
    return top.where((F.col("place") <= floor) | (F.col("rank") < F.lit(cut)))


def banded(items: DataFrame, bands: int = 16, rank_bits: int = RANK_BITS) -> DataFrame:
    """items with the number of leading zeros of their rank, up to ``bands``: written as a partition, a sample of low ranks
    reads few files."""
    return items.withColumn("band", F.least(F.lit(bands), F.lit(rank_bits) - F.length(F.regexp_replace(F.bin("rank"), "^0$", ""))))


def points(served: DataFrame, fields: list[str], categories: tuple[str, ...] = ()) -> DataFrame:
    """Point columns: id, code, tile and fields; an absent category is code 0."""
    cols = [F.coalesce(F.col(f), F.lit(0)).alias(f) if f in categories else F.col(f) for f in fields]
    return served.select(F.col("entity").alias("id"), "code", "tile", *cols)


def tagged(served: DataFrame, members: DataFrame, artifacts: DataFrame) -> DataFrame:
    """served with a tag: the deepest served artifact that holds the item, the smallest id on ties, else null.

    members: artifact, entity. artifacts: artifact, depth (those the viewer is served).
    """
    own = members.join(artifacts, "artifact").groupBy("entity").agg(F.min(F.struct((-F.col("depth")).alias("o"), "artifact")).alias("best")).select("entity", F.col("best.artifact").alias("tag"))
    return served.join(own, "entity", "left")


def named_tiles(counts: DataFrame, tiles: list[int]) -> DataFrame:
    """The rows of the named tiles, with the place of each in the request."""
    return counts.join(tiles_frame(counts.sparkSession, tiles), "tile").orderBy("ordinal")
