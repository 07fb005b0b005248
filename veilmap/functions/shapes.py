"""Shapes on the grid: boxes, circles, ellipses and polygons as predicates, WKT and WKB, simplifying, and hulls."""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spatial import SIDE, Frame, fixed32_value, forward_value

Point = tuple[float, float]
Ring = list[Point]


def on_grid(p: Point, frame: Frame) -> tuple[int, int]:
    return fixed32_value(p[0], frame.min_x, frame.max_x), fixed32_value(p[1], frame.min_y, frame.max_y)


# --- predicates on (qx, qy) -------------------------------------------------------------------------


def in_box(qx: Column, qy: Column, box: Sequence[float], frame: Frame) -> Column:
    """Inclusive, on the quantised grid."""
    a, b = on_grid((box[0], box[1]), frame), on_grid((box[2], box[3]), frame)
    return qx.between(min(a[0], b[0]), max(a[0], b[0])) & qy.between(min(a[1], b[1]), max(a[1], b[1]))


def in_ellipse(qx: Column, qy: Column, centre: Point, a: float, b: float, angle: float, frame: Frame) -> Column:
    """Within an ellipse of half axes a and b in the frame's units, turned by angle degrees: the conic's value is at most 1."""
    sx, sy = SIDE / (frame.max_x - frame.min_x), SIDE / (frame.max_y - frame.min_y)
    cx, cy = (centre[0] - frame.min_x) * sx, (centre[1] - frame.min_y) * sy
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    dx, dy = (qx.cast("double") - F.lit(cx)) / F.lit(sx), (qy.cast("double") - F.lit(cy)) / F.lit(sy)
    u, v = (dx * c + dy * s) / F.lit(a), (dy * c - dx * s) / F.lit(b)
    return u * u + v * v <= 1.0


def in_circle(qx: Column, qy: Column, centre: Point, radius: float, frame: Frame) -> Column:
    return in_ellipse(qx, qy, centre, radius, radius, 0.0, frame)


def in_polygon(qx: Column, qy: Column, rings: Sequence[Sequence[Point]], frame: Frame) -> Column:
    """Even-odd over all rings; what lies on an edge is inside. The bounding box is tested first.

    On which side of an edge a point lies is told by a cross product of doubles where that is certain, and by one of whole numbers
    of 38 decimal digits where the point is too near.
    """
    grid = [[on_grid(p, frame) for p in ring] for ring in rings]
    every = [p for ring in grid for p in ring]
    if not every:
        return F.lit(False)
    total = F.lit(0)
    for ring in grid:
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            total = total + _meeting(qx, qy, p, q)
    xs, ys = [p[0] for p in every], [p[1] for p in every]
    return qx.between(min(xs), max(xs)) & qy.between(min(ys), max(ys)) & ((total >= _ON_EDGE) | (total % 2 == 1))


#: Doubles of this size in a cross product of grid points have a certain sign: each of its products errs by less than 2**14.
_SURE, _ON_EDGE = 2.0**16, 1 << 20


def _meeting(qx: Column, qy: Column, p: tuple[int, int], q: tuple[int, int]) -> Column:
    """1 where a ray from the point to the right crosses the edge, _ON_EDGE where the point lies on it, else 0."""
    (x1, y1), (x2, y2) = (p, q) if p[1] <= q[1] else (q, p)
    beside = qx.between(min(x1, x2), max(x1, x2))
    if y1 == y2:
        return F.when((qy == y1) & beside, _ON_EDGE).otherwise(0)

    def side(kind: str) -> Column:
        number = lambda v: F.lit(v).cast(kind)
        return (qx.cast(kind) - number(x1)) * number(y2 - y1) - (qy.cast(kind) - number(y1)) * number(x2 - x1)

    rough, exact = side("double"), side("decimal(20,0)")
    crosses = F.when(qy < y2, 1).otherwise(0)
    close = F.when((exact == 0) & beside, _ON_EDGE).when(exact < 0, crosses).otherwise(0)
    return F.when(~qy.between(y1, y2) | (rough > _SURE), 0).when(rough < -_SURE, crosses).otherwise(close)


def contains(rings: Sequence[Sequence[tuple[int, int]]], p: tuple[int, int]) -> bool:
    """The definition of in_polygon for one grid point, in Python's whole numbers."""
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            side = (p[0] - x1) * (y2 - y1) - (p[1] - y1) * (x2 - x1)
            if side == 0 and min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2):
                return True
            if (y1 <= p[1] < y2 and side < 0) or (y2 <= p[1] < y1 and side > 0):
                inside = not inside
    return inside


def project_ring(ring: Ring, kind: str, frame: Frame) -> Ring:
    """A ring in degrees in the frame's plane, its edges cut so fine that each part spans about one cell of 16 bits."""
    out: Ring = []
    cell = (frame.max_x - frame.min_x) / 65536
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b = forward_value(kind, x1, y1), forward_value(kind, x2, y2)
        straight = kind != "web_mercator" or x1 == x2 or y1 == y2
        n = 1 if straight else max(1, min(4096, math.ceil(math.dist(a, b) / cell)))
        out += [forward_value(kind, x1 + (x2 - x1) * i / n, y1 + (y2 - y1) * i / n) for i in range(n)]
    return out


# --- WKT and WKB ------------------------------------------------------------------------------------


def from_wkt(text: str) -> list[list[Ring]]:
    """Polygons (each a list of rings) of a POLYGON or MULTIPOLYGON."""
    m = re.fullmatch(r"\s*(MULTIPOLYGON|POLYGON)\s*(Z|M|ZM)?\s*(EMPTY|\(.*\))\s*", text, re.I | re.S)
    if not m:
        raise ValueError("no polygon in this text")
    if m[3].upper() == "EMPTY":
        return []
    tree = re.sub(r"([-+0-9.eE]+(?:\s+[-+0-9.eE]+)+)", lambda p: "[" + ",".join(p[0].split()[:2]) + "]", m[3]).replace("(", "[").replace(")", "]")
    import json

    got = json.loads(tree)
    polygons = got if m[1].upper() == "MULTIPOLYGON" else [got]
    return [[_open([(float(x), float(y)) for x, y in ring]) for ring in p] for p in polygons]


def _open(ring: Ring) -> Ring:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def to_wkb(polygons: list[list[Ring]]) -> bytes:
    """Little-endian WKB of one polygon, or of several as a multipolygon."""

    def polygon(rings: list[Ring]) -> bytes:
        out = struct.pack("<BII", 1, 3, len(rings))
        for r in rings:
            closed = [*r, r[0]] if r else []
            out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)
        return out

    if len(polygons) == 1:
        return polygon(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(polygon, polygons))


def from_wkb(data: bytes) -> list[list[Ring]]:
    at = 0

    def take(order: str, form: str):
        nonlocal at
        got = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return got

    def shape() -> list[list[Ring]]:
        order = "<" if take("<", "B")[0] == 1 else ">"
        (kind,) = take(order, "I")
        if kind & 0x20000000:  # an SRID follows
            take(order, "I")
        extra = (kind & 0x80000000 != 0) + (kind & 0x40000000 != 0)
        kind &= 0xFFFF
        extra += {1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
        kind %= 1000
        (n,) = take(order, "I")
        if kind == 6:
            return [p for _ in range(n) for p in shape()]
        if kind != 3:
            raise ValueError("no polygon in these bytes")
        rings = []
        for _ in range(n):
            (m,) = take(order, "I")
            rings.append(_open([take(order, f"{2 + extra}d")[:2] for _ in range(m)]))
        return [rings]

    return shape()


# --- simplifying and hulls ----------------------------------------------------------------------------


def simplify(ring: Sequence[tuple[int, int]], zoom: int | None = None, most: int = 2048) -> list[tuple[int, int]]:
    """A ring of at most ``most`` points: corners of the smallest triangles go first, those below a pixel of the zoom and as many more as needed.

    A corner's weight is the area of the triangle with its neighbours, and at least that of any neighbour that went before it.
    """
    n = len(ring)
    least = 0.0 if zoom is None else (SIDE / 2.0 ** (zoom + 10)) ** 2
    before, after = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    before[:1], after[-1:] = [n - 1], [0]

    def area(i: int) -> float:
        return abs(_turn(ring[before[i]], ring[i], ring[after[i]])) / 2

    weight = [area(i) for i in range(n)]
    queue = [(w, i) for i, w in enumerate(weight)]
    heapq.heapify(queue)
    left = n
    while queue and left > 3:
        w, i = heapq.heappop(queue)
        if w != weight[i]:
            continue  # weighed anew since
        if w >= least and left <= most:
            break
        weight[i], left = -1.0, left - 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            weight[j] = max(w, area(j))
            heapq.heappush(queue, (weight[j], j))
    return [p for p, w in zip(ring, weight, strict=True) if w >= 0]


def convex_hull(points: np.ndarray) -> list[tuple[int, int]]:
    """Counter-clockwise hull of grid points, in whole numbers."""
    pts = sorted({(int(x), int(y)) for x, y in (_outer(points) if len(points) > 4096 else points)})
    if len(pts) <= 2:
        return pts

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    return lower[:-1] + upper[:-1]


def _outer(points: np.ndarray, directions: int = 32) -> np.ndarray:
    """points without those that surely lie inside the polygon of the furthest points in some directions."""
    flat = points.astype(np.float64)
    turn = np.arange(directions) * (2 * math.pi / directions)
    far = {int((flat @ np.array([math.cos(t), math.sin(t)])).argmax()) for t in turn}
    ring = convex_hull(points[sorted(far)])
    if len(ring) < 3:
        return points
    inside = np.ones(len(points), bool)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        inside &= (x2 - x1) * (flat[:, 1] - y1) - (y2 - y1) * (flat[:, 0] - x1) > _SURE
    return points[~inside]


def near_groups(points: np.ndarray, within: float) -> np.ndarray:
    """A group number per point, so that points at most ``within`` apart share one (some a little further apart do too).

    Points are put on a grid of that side; occupied cells that touch are joined.
    """
    cells, at = np.unique(np.floor((points - points.min(axis=0)) / within).astype(np.int64), axis=0, return_inverse=True)
    wide = int(cells[:, 1].max()) + 3
    key = cells[:, 0] * wide + cells[:, 1]
    a, b = [], []
    for step in (1, wide - 1, wide, wide + 1):
        to = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        hit = (key[to] == key + step) & (np.abs(cells[to, 1] - cells[:, 1]) <= 1)
        a.append(np.flatnonzero(hit))
        b.append(to[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1][at.ravel()]
        label = new


def _turn(a, b, c) -> int:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


class _Ring:
    """One group's boundary while it is dug: points by the point before them, and which points are not on it yet.

    Points are listed by the squares of a grid, some tens in each, so that a search looks at those near its edge only.
    """

    def __init__(self, points: np.ndarray, full: int = 32):
        self.points = points
        hull = convex_hull(points)
        self.after = dict(zip(hull, [*hull[1:], hull[0]], strict=True))
        low, span = points.min(axis=0), np.ptp(points, axis=0).astype(np.float64) + 1
        key = lambda p: (p[:, 0] - low[0]).astype(np.uint64) * np.uint64(span[1]) + (p[:, 1] - low[1]).astype(np.uint64)
        self.free = ~np.isin(key(points), key(np.array(hull, np.int64)))
        self.low, self.reach = low.astype(np.float64), float(np.hypot(*span))
        self.side = max(math.sqrt(span[0] * span[1] * full / len(points)), float(span.max()) / 4096)
        self.wide, self.high = (int(n) for n in span // self.side + 1)
        square = self._square(points)
        square = square[:, 0] * self.high + square[:, 1]
        self.listed = np.argsort(square, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(square, minlength=self.wide * self.high))])

    def _square(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((p - self.low) / self.side).astype(np.int64), 0, [self.wide - 1, self.high - 1])

    def _beside(self, a, d: np.ndarray, depth: float) -> np.ndarray:
        """All points, and maybe more, that lie up to ``depth`` from an edge on its inner side, in order."""
        n = math.ceil(np.hypot(*d) / depth)
        inward = np.array([-d[1], d[0]]) / np.hypot(*d) * depth
        ends = np.array(a, np.float64) + d * (np.arange(n + 1) / n)[:, None]
        corners = np.stack([ends[:-1], ends[1:], ends[:-1] + inward, ends[1:] + inward])
        low, top = self._square(corners.min(axis=0) - 2.0), self._square(corners.max(axis=0) + 2.0)
        k = (top - low).max(axis=0) + 1
        if n * int(k[0]) * int(k[1]) > self.wide * self.high:
            return np.arange(len(self.points))
        x, y = low[:, :1, None] + np.arange(k[0])[:, None], low[:, 1:, None] + np.arange(k[1])
        fits = (x <= top[:, :1, None]) & (y <= top[:, 1:, None])
        squares = np.unique((x * self.high + y)[fits])
        start, size = self.first[squares], self.first[squares + 1] - self.first[squares]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.sort(self.listed[at])

    def nearest(self, a, b):
        """The free point nearest to the edge on its inner side or on it, among those beside it."""
        d = np.array([b[0] - a[0], b[1] - a[1]], np.float64)
        depth = self.side
        while True:
            every = depth >= self.reach
            at = np.arange(len(self.points)) if every else self._beside(a, d, depth)
            at = at[self.free[at]]
            v = (self.points[at] - np.array(a)).astype(np.float64)
            along, off = v @ d, d[0] * v[:, 1] - d[1] * v[:, 0]
            fine = (along > 0) & (along < d @ d) & (off > -1e-9 * (d @ d))
            if not every:
                fine &= off <= depth * np.hypot(*d)
            at, off = at[fine], off[fine]
            while len(at):
                k = int(off.argmin())
                c = tuple(int(x) for x in self.points[at[k]])
                if _turn(a, b, c) >= 0:
                    return at[k], c
                at, off = np.delete(at, k), np.delete(off, k)
            if every:
                return None
            depth *= 2

    def crossed(self, a, b) -> bool:
        """Whether a segment would meet the boundary anywhere but at its own ends."""
        x0, x1, y0, y1 = min(a[0], b[0]), max(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
        for p, q in self.after.items():
            if p in (a, b) or q in (a, b) or max(p[0], q[0]) < x0 or min(p[0], q[0]) > x1 or max(p[1], q[1]) < y0 or min(p[1], q[1]) > y1:
                continue
            if _turn(a, b, p) * _turn(a, b, q) <= 0 and _turn(p, q, a) * _turn(p, q, b) <= 0:
                return True
        return False

    def ring(self) -> list[tuple[int, int]]:
        out = [min(self.after, key=lambda p: (p[1], p[0]))] if self.after else []
        while out and (nxt := self.after[out[-1]]) != out[0]:
            out.append(nxt)
        return out


def concave_rings(points: np.ndarray, budget: int = 2048, reach: float = 2.0) -> list[list[tuple[int, int]]]:
    """Counter-clockwise rings around the groups of points, dug from their convex hulls towards near inner points.

    ``reach`` times the typical spacing is what an edge may bridge: points further apart are other groups, and of longer edges the
    longest is bent to the nearest inner point beside it, while rings stay simple and the budget lasts. Nothing lies in the triangle that
    such a bend cuts away, so every point stays inside or on its ring.
    """
    pts = points.astype(np.int64)
    pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))]
    pts = pts[np.concatenate([[True], (np.diff(pts, axis=0) != 0).any(axis=1)])] if len(pts) else pts
    if len(pts) < 3:
        return [[tuple(p) for p in pts.tolist()]] if len(pts) else []
    area = max(1.0, float(np.ptp(pts[:, 0])) * float(np.ptp(pts[:, 1])))
    bridge = max(1.0, reach * math.sqrt(area / len(pts)))
    group = near_groups(pts, bridge)
    order = np.argsort(group, kind="stable")
    rings = [_Ring(own) for own in np.split(pts[order], np.flatnonzero(np.diff(group[order])) + 1)]
    queue: list[tuple] = []

    def ask(r: int, a, b) -> None:
        if (n := math.dist(a, b)) > bridge:
            heapq.heappush(queue, (-n, r, a, b))

    for r, x in enumerate(rings):
        for a, b in x.after.items():
            if len(x.after) > 2:
                ask(r, a, b)
    while queue and budget > 0:
        _, r, a, b = heapq.heappop(queue)
        x = rings[r]
        got = x.nearest(a, b)
        if got is None or x.crossed(a, got[1]) or x.crossed(got[1], b):
            continue
        at, c = got
        x.free[at] = False
        x.after[a], x.after[c] = c, b
        ask(r, a, c)
        ask(r, c, b)
        budget -= 1
    return sorted(x.ring() for x in rings)


def neighbours(points: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of points that a Delaunay triangulation joins; equal points are joined to the first of them.

    Points are put in one by one: triangles whose circle holds the new point go, and their outline is joined to it.
    """
    low = points.min(axis=0) if len(points) else 0
    scale = max(1e-300, float(np.ptp(points, axis=0).max())) if len(points) else 1.0
    unit = (points - low) / scale
    _, first, at = np.unique(unit, axis=0, return_index=True, return_inverse=True)
    out = {tuple(sorted((int(first[g]), i))) for i, g in enumerate(at.ravel().tolist()) if first[g] != i}
    n = len(unit)
    xy = np.concatenate([unit.reshape(-1, 2), [[-1e4, -1e4], [1e4, -1e4], [0.5, 2e4]]])
    corners = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = xy[t[:, 0]], xy[t[:, 1]] - xy[t[:, 0]], xy[t[:, 2]] - xy[t[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        bb, cc = (b**2).sum(axis=1), (c**2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], axis=1)
        flat = np.abs(d) < 1e-14
        return np.where(flat[:, None], a, a + u), np.where(flat, np.inf, (u**2).sum(axis=1))

    centre, radius = circles(corners)
    for i in sorted(first.tolist()):
        hit = ((xy[i] - centre) ** 2).sum(axis=1) <= radius * (1 + 1e-12)
        edges = np.sort(np.concatenate([corners[hit][:, [0, 1]], corners[hit][:, [1, 2]], corners[hit][:, [2, 0]]]), axis=1)
        edges, times = np.unique(edges, axis=0, return_counts=True)
        outline = edges[times == 1]
        new = np.concatenate([outline, np.full((len(outline), 1), i)], axis=1)
        c, r = circles(new)
        corners, centre, radius = np.concatenate([corners[~hit], new]), np.concatenate([centre[~hit], c]), np.concatenate([radius[~hit], r])
    for t in corners.tolist():
        out |= {tuple(sorted(e)) for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) if max(e) < n}
    return out
