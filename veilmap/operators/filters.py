"""The filter language: a tree of dicts with one key per node, turned into Spark predicates.

``{"all_of": [..]}``, ``{"any_of": [..]}``, ``{"none_of": [..]}``, ``{"region": {..}}``, ``{"member_of": {..}}`` or
``{column: {op: value}}``, at most four levels deep. An unknown column or operator is refused; an unknown value matches
nothing. A field scoped to a view is named ``field@view``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.spatial import Frame
from ..functions.text import tokens

DEPTH = 4
NUMBERS = ("bool", "int", "float", "decimal", "timestamp")


class FilterError(ValueError):
    """A filter that is refused."""


@dataclass
class Field:
    """A filterable column: its kind, and for a category the codes of its keys."""

    kind: str  # category, keyword, text, unique, bool, int, float, decimal, timestamp
    column: str | None = None
    codes: Mapping[str, int] | None = None
    tokens: str | None = None  # the token column of a text field


@dataclass
class Scope:
    """What names in a filter mean."""

    fields: Mapping[str, Field]
    frame: Frame | None = None
    projection: str = "none"
    members: Callable[[str, str], DataFrame | None] | None = None  # (layer, artifact) to entities; None: not served
    scoped: Mapping[str, DataFrame] = field(default_factory=dict)  # "field@view" to (entity, value)


def _instant(value) -> int:
    if isinstance(value, datetime):
        d = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return int(round((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6))
    if isinstance(value, str):
        return _instant(datetime.fromisoformat(value.replace("Z", "+00:00")))
    return int(value)


def _number(f: Field, value) -> Column:
    if f.kind == "timestamp":
        return F.timestamp_micros(F.lit(_instant(value)))
    if f.kind == "bool":
        return F.lit(bool(value))
    if isinstance(value, str):
        value = int(value) if f.kind in ("int", "decimal") else float(value)
    return F.lit(value) if abs(value) < 1 << 63 or isinstance(value, float) else F.lit(str(value)).cast("decimal(20,0)")


def _real(f: Field, col: Column) -> Column:
    """The column with NaN as absent: NaN matches no bound and equals nothing."""
    return F.when(~F.isnan(col), col) if f.kind == "float" else col


def _category(f: Field, value) -> Column | None:
    if isinstance(value, bool):
        return None  # true is not code 1
    if isinstance(value, str):
        if f.codes is None:
            return F.lit(value)
        return F.lit(f.codes[value]) if value in f.codes else None
    if isinstance(value, int) and f.codes is not None:
        return F.lit(value) if value in f.codes.values() else None
    return None


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = p if out is None else out | p
    return out


def _leaf(f: Field, col: Column, ops: Mapping) -> Column:
    if len(ops) != 1 and "range" not in ops and not (set(ops) <= {"match", "minimum_should_match"}):
        raise FilterError("a leaf has one operator")
    op, value = next(iter(ops.items()))
    if f.kind == "category":
        if op not in ("eq", "in"):
            raise FilterError(f"a category has no {op}")
        known = [c for c in (_category(f, v) for v in ([value] if op == "eq" else value)) if c is not None]
        return col.isin(*known) if known else F.lit(False)
    if f.kind in ("keyword", "unique"):
        if op == "eq":
            return col == F.lit(value)
        if op == "in":
            return col.isin(*value) if value else F.lit(False)
        if f.kind == "keyword" and op == "prefix":
            return col.startswith(value)
        if f.kind == "keyword" and op == "contains":
            return col.contains(value)
        raise FilterError(f"a {f.kind} has no {op}")
    if f.kind in NUMBERS:
        real = _real(f, col)
        if op in ("eq", "in"):
            values = [v for v in ([value] if op == "eq" else value) if not (isinstance(v, float) and math.isnan(v))]
            return F.coalesce(real.isin(*[_number(f, v) for v in values]), F.lit(False)) if values else F.lit(False)
        if op == "range":
            if not value or not set(value) <= {"gte", "gt", "lte", "lt"} or {"gte", "gt"} <= set(value) or {"lte", "lt"} <= set(value):
                raise FilterError("a range has one bound on each side at most, and one at least")
            tests = {"gte": lambda b: real >= b, "gt": lambda b: real > b, "lte": lambda b: real <= b, "lt": lambda b: real < b}
            out = F.lit(True)
            for k, v in value.items():
                out = out & (F.lit(False) if isinstance(v, float) and math.isnan(v) else tests[k](_number(f, v)))
            return out
        raise FilterError(f"a number has no {op}")
    if f.kind == "text":
        own = F.col(f.tokens) if f.tokens else F.col((f.column or "") + "_tokens")
        if "match" in ops:
            words = sorted(set(tokens(ops["match"])))
            least = ops.get("minimum_should_match", len(words))
            if not words or least > len(words):
                return F.lit(False)
            return _once(own, lambda ts: _held(ts, words, least))
        if op == "phrase":
            words = tokens(value)
            return _once(own, lambda ts: _adjacent(ts, words)) if words else F.lit(False)
        raise FilterError(f"a text has no {op}")
    raise FilterError(f"unknown kind {f.kind}")


def _once(value: Column, test) -> Column:
    """A test of a value that names it several times, with the value worked out once for each row."""
    return F.exists(F.array(value), test)


def _held(ts: Column, words: list[str], least: int) -> Column:
    """Whether at least so many of the words are among the tokens."""
    if least == len(words):
        return reduce(and_, (F.array_contains(ts, w) for w in words))
    return F.size(F.array_intersect(ts, F.array(*map(F.lit, words)))) >= least


def _adjacent(ts: Column, words: list[str]) -> Column:
    """Whether the words stand among the tokens side by side."""
    every = _held(ts, sorted(set(words)), len(set(words)))
    n = len(words)
    if n == 1:
        return every
    want = F.array(*map(F.lit, words))
    return every & (F.size(ts) >= n) & F.exists(F.sequence(F.lit(1), F.size(ts) - n + 1), lambda i: F.slice(ts, i, F.lit(n)) == want)


class Compiler:
    """Turns one filter into a predicate over items (qx, qy, entity and fields), with the joins that it needs."""

    def __init__(self, scope: Scope):
        self.scope = scope
        self.joins: list[tuple[str, DataFrame]] = []

    def named(self, name: str) -> tuple[Field, Column]:
        base = name.split("@")[0]
        f = self.scope.fields.get(base)
        if f is None:
            raise FilterError(f"unknown column {base!r}")
        if "@" in name:
            table = self.scope.scoped.get(name)
            if table is None:
                raise FilterError(f"unknown column {name!r}")
            own = f"scoped_{len(self.joins)}"
            self.joins.append((own, table.select("entity", F.col("value").alias(own))))
            return f, F.col(own)
        return f, F.col(f.column or base)

    def _membership(self, spec: Mapping) -> Column:
        if self.scope.members is None:
            raise FilterError("no layers here")
        found = self.scope.members(spec["layer"], spec["artifact"])
        if found is None:
            return F.lit(False)
        own = f"member_{len(self.joins)}"
        self.joins.append((own, found.select("entity").distinct().withColumn(own, F.lit(True))))
        return F.coalesce(F.col(own), F.lit(False))

    def _region(self, spec: Mapping) -> Column:
        if "artifact" in spec:
            return self._membership(spec["artifact"])
        frame, qx, qy = self.scope.frame, F.col("qx"), F.col("qy")
        if frame is None:
            raise FilterError("no frame here")
        degrees = spec.get("space") == "wgs84"
        place = (lambda ring: shapes.project_ring(ring, self.scope.projection, frame)) if degrees else (lambda ring: list(map(tuple, ring)))
        if "bbox" in spec:
            x0, y0, x1, y1 = spec["bbox"]
            if degrees:
                (x0, y0), (x1, y1) = (shapes.forward_value(self.scope.projection, *p) for p in ((x0, y0), (x1, y1)))
            return shapes.in_box(qx, qy, (x0, y0, x1, y1), frame)
        if "circle" in spec:
            c = spec["circle"]
            return shapes.in_circle(qx, qy, tuple(c["centre"]), c["radius"], frame)
        if "ellipse" in spec:
            c = spec["ellipse"]
            return shapes.in_ellipse(qx, qy, tuple(c["centre"]), c["a"], c["b"], c.get("angle", 0.0), frame)
        if "polygon" in spec:
            return shapes.in_polygon(qx, qy, [place([tuple(p) for p in ring]) for ring in spec["polygon"]], frame)
        if "wkt" in spec:
            return _any([shapes.in_polygon(qx, qy, [place(r) for r in rings], frame) for rings in shapes.from_wkt(spec["wkt"])])
        raise FilterError("unknown region")

    def node(self, expr: Mapping, depth: int = 1) -> Column:
        """A predicate that is never null."""
        if depth > DEPTH:
            raise FilterError(f"a filter is at most {DEPTH} deep")
        if not isinstance(expr, Mapping) or len(expr) != 1:
            raise FilterError("a node has one key")
        key, value = next(iter(expr.items()))
        if key == "all_of":
            out = F.lit(True)
            for v in value:
                out = out & self.node(v, depth + 1)
            return out
        if key == "any_of":
            return _any([self.node(v, depth + 1) for v in value])
        if key == "none_of":
            return self._none_of(value, depth)
        if key == "region":
            return F.coalesce(self._region(value), F.lit(False))
        if key == "member_of":
            return self._membership(value)
        f, col = self.named(key)
        return F.coalesce(_leaf(f, col, value), F.lit(False))

    def _none_of(self, parts: list, depth: int) -> Column:
        """Carries a value in the one column named, and none of the tests holds."""
        names = {next(iter(p)) for p in parts}
        if len(names) != 1 or names & {"all_of", "any_of", "none_of", "region", "member_of"}:
            raise FilterError("none_of names one column")
        name = names.pop()
        if self.scope.fields.get(name.split("@")[0], Field("text")).kind == "text":
            raise FilterError("none_of is not for texts")
        f, col = self.named(name)
        there = col.isNotNull() & (col != 0) if f.kind == "category" and f.codes is not None else col.isNotNull()
        return there & ~_any([F.coalesce(_leaf(f, col, p[name]), F.lit(False)) for p in parts])


def with_flag(items: DataFrame, expr: Mapping | None, scope: Scope, name: str) -> DataFrame:
    """items with a boolean column: whether the filter holds (without filter it does)."""
    if expr is None:
        return items.withColumn(name, F.lit(True))
    c = Compiler(scope)
    test = c.node(expr)
    out = items
    for _, table in c.joins:
        out = out.join(table, "entity", "left")
    return out.withColumn(name, test).drop(*[n for n, _ in c.joins])


def matching(items: DataFrame, expr: Mapping | None, scope: Scope) -> DataFrame:
    """The items for which the filter holds. Predicates on columns reach the scan; a lone membership is a semi join."""
    if expr is None:
        return items
    if set(expr) == {"member_of"} and scope.members is not None:
        found = scope.members(expr["member_of"]["layer"], expr["member_of"]["artifact"])
        return items.limit(0) if found is None else items.join(found.select("entity"), "entity", "left_semi")
    c = Compiler(scope)
    test = c.node(expr)
    if not c.joins:
        return items.where(test)
    return with_flag(items, expr, scope, "matched_").where("matched_").drop("matched_")
