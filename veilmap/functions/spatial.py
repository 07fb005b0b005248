"""Positions on the 32-bit grid: quantising, Morton codes, tiles and map projections, as Spark columns and plan-time helpers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 1 << 32
MAX_LATITUDE = 85.0511287798066


@dataclass(frozen=True)
class Frame:
    """The rectangle that the grid covers."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float


# --- quantising -----------------------------------------------------------------------------------


def fixed32(v: Column, low: float, high: float) -> Column:
    """The 32-bit grid place of v as a bigint, clamped to the frame; null and NaN give null."""
    scaled = (v - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(float(SIDE))
    held = F.greatest(F.lit(0.0), F.least(F.lit(float(SIDE - 1)), F.floor(scaled).cast("double")))
    return F.when(v.isNotNull() & ~F.isnan(v), F.when(scaled <= 0, F.lit(0)).when(scaled >= float(SIDE - 1), F.lit(SIDE - 1)).otherwise(held.cast("long")))


def cell16(v: Column, low: float, high: float) -> Column:
    """The 16-bit cell of v: the top half of fixed32."""
    return F.shiftright(fixed32(v, low, high), 16)


def unfixed32(q: Column, low: float, high: float) -> Column:
    """The middle of a grid place in the frame's units."""
    return F.lit(float(low)) + (q.cast("double") + 0.5) / F.lit(float(SIDE)) * F.lit(float(high) - float(low))


def fixed32_value(v: float, low: float, high: float) -> int:
    """fixed32 of one number, for plans."""
    return max(0, min(SIDE - 1, math.floor((v - low) / (high - low) * SIDE)))


def clipped(x: Column, y: Column, frame: Frame) -> Column:
    """Whether a position lies outside the frame and was moved to its edge."""
    return (x < frame.min_x) | (x > frame.max_x) | (y < frame.min_y) | (y > frame.max_y)


# --- Morton codes ---------------------------------------------------------------------------------


def _spread(v: Column) -> Column:
    """A place with a zero bit before each of its bits: its binary digits read to the base 4.

    v is named once, so plans that work codes out in several conditions stay small.
    """
    return F.conv(F.bin(v), 4, 10).cast("long")


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(qx: Column, qy: Column) -> Column:
    """The 64-bit interleaving of two 32-bit places, x on even bits, as a signed long."""
    return _spread(qx).bitwiseOR(F.shiftleft(_spread(qy), 1))


def unmorton(code: Column) -> tuple[Column, Column]:
    return _gather(code), _gather(F.shiftrightunsigned(code, 1))


def morton_value(x: int, y: int) -> int:
    """Interleaving of two numbers, unsigned, for plans."""
    out = 0
    for i in range(32):
        out |= (x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1
    return out


def tile(code: Column, depth: int) -> Column:
    """The tile of depth 0 to 32 that a code lies in: its top 2 * depth bits."""
    if depth == 0:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(code, 64 - 2 * depth) if depth < 32 else code


def tiles_of_box(box: tuple[float, float, float, float], depth: int, frame: Frame) -> list[int]:
    """Tiles that a box (min x, min y, max x, max y) touches, row by row."""
    side = 32 - depth
    x0, x1 = (fixed32_value(v, frame.min_x, frame.max_x) >> side for v in (box[0], box[2]))
    y0, y1 = (fixed32_value(v, frame.min_y, frame.max_y) >> side for v in (box[1], box[3]))
    return [morton_value(x, y) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]


def n_tiles_of_box(box: tuple[float, float, float, float], depth: int, frame: Frame) -> int:
    side = 32 - depth
    x0, x1 = (fixed32_value(v, frame.min_x, frame.max_x) >> side for v in (box[0], box[2]))
    y0, y1 = (fixed32_value(v, frame.min_y, frame.max_y) >> side for v in (box[1], box[3]))
    return (x1 - x0 + 1) * (y1 - y0 + 1)


# --- projections ----------------------------------------------------------------------------------

PROJECTIONS = ("none", "web_mercator", "equirectangular", "gall_isographic")


def forward(kind: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to the unit square, y to the south."""
    if kind == "none":
        return lon, lat
    x = (lon + 180.0) / 360.0
    if kind == "web_mercator":
        held = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat))
        y = 0.5 - F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2)) / F.lit(2 * math.pi)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    if kind in ("equirectangular", "gall_isographic"):  # both are linear; they differ in the aspect of the frame
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 0.5 - F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)) / 180.0
    raise ValueError(f"unknown projection {kind!r}")


def inverse(kind: str, x: Column, y: Column) -> tuple[Column, Column]:
    if kind == "none":
        return x, y
    lon = x * 360.0 - 180.0
    if kind == "web_mercator":
        return lon, F.degrees(2 * F.atan(F.exp((0.5 - y) * F.lit(2 * math.pi))) - F.lit(math.pi / 2))
    if kind in ("equirectangular", "gall_isographic"):
        return lon, (0.5 - y) * 180.0
    raise ValueError(f"unknown projection {kind!r}")


def forward_value(kind: str, lon: float, lat: float) -> tuple[float, float]:
    if kind == "none":
        return lon, lat
    x = (lon + 180.0) / 360.0
    if kind == "web_mercator":
        held = max(-MAX_LATITUDE, min(MAX_LATITUDE, lat))
        y = 0.5 - math.log(math.tan(math.pi / 4 + math.radians(held) / 2)) / (2 * math.pi)
        return max(0.0, min(1.0, x)), max(0.0, min(1.0, y))
    return max(0.0, min(1.0, x)), 0.5 - max(-90.0, min(90.0, lat)) / 180.0


def aspect(kind: str) -> float:
    """Width over height of the whole world in the projection's plane."""
    return {"equirectangular": 2.0, "gall_isographic": math.sqrt(2.0)}.get(kind, 1.0)


# --- frames ---------------------------------------------------------------------------------------


def fit_frame(points: DataFrame, margin: float = 0.0) -> Frame:
    """The extent of x and y, with a margin as a share of each side; one aggregate over the table."""
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c))
    r = points.agg(*[f(fine(c)) for c in ("x", "y") for f in (F.min, F.max)]).first()
    x0, x1, y0, y1 = (float(v) if v is not None else 0.0 for v in r)
    x1, y1 = (x1 if x1 > x0 else x0 + 1.0), (y1 if y1 > y0 else y0 + 1.0)
    return Frame(x0 - margin * (x1 - x0), y0 - margin * (y1 - y0), x1 + margin * (x1 - x0), y1 + margin * (y1 - y0))


def snap_square(frame: Frame, most: int = 16) -> tuple[int, int, int]:
    """(zoom, x, y) of the smallest aligned square of the unit world that holds a frame; a border belongs to the later square."""

    def at(v: float, z: int) -> int:
        return max(0, min((1 << z) - 1, math.floor(v * (1 << z))))

    for z in range(most, 0, -1):
        x, y = at(frame.min_x, z), at(frame.min_y, z)
        if x == at(frame.max_x, z) and y == at(frame.max_y, z):
            return z, x, y
    return 0, 0, 0


def square_frame(z: int, x: int, y: int) -> Frame:
    side = 1.0 / (1 << z)
    return Frame(x * side, y * side, (x + 1) * side, (y + 1) * side)


def place(points: DataFrame, frame: Frame) -> DataFrame:
    """points (x, y, ...) with qx, qy and code."""
    out = points.withColumn("qx", fixed32(F.col("x"), frame.min_x, frame.max_x)).withColumn("qy", fixed32(F.col("y"), frame.min_y, frame.max_y))
    return out.withColumn("code", morton(F.col("qx"), F.col("qy")))


def map_order(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """Ranged and sorted by cell, then rank: files written from it prune by code."""
    cell = tile(F.col("code"), 16)
    return rows.repartitionByRange(cell, F.col(rank)).sortWithinPartitions(cell, rank)
