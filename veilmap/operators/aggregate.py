"""Groupings of a set of items against a reference set: counts, lift, cells, histograms, field summaries and layers.

A set is a DataFrame of visible items with two booleans: ``in_set`` and, where there is a reference, ``in_ref``.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins as edges_
from ..functions import spatial

MOST_GROUPINGS, MOST_GROUPS, MOST_BINS, MOST_CELLS = 16, 1000, 1000, 1 << 20


class Refused(ValueError):
    """A request that is refused before anything is planned."""


def check_request(groupings: list[dict]) -> None:
    """Refuse what the limits do not allow."""
    if len(groupings) > MOST_GROUPINGS:
        raise Refused(f"at most {MOST_GROUPINGS} groupings")
    for g in groupings:
        kind = g.get("kind")
        if kind not in ("set", "values", "bins", "cells", "artifacts"):
            raise Refused(f"unknown grouping {kind!r}")
        if "top" in g and "named" in g:
            raise Refused("top or named, not both")
        if kind in ("values", "artifacts") and not ("top" in g or "named" in g):
            raise Refused("which groups: top or named")
        if not 1 <= g.get("top", 1) <= MOST_GROUPS or len(g.get("named", [])) > MOST_GROUPS:
            raise Refused(f"at most {MOST_GROUPS} groups")
        if kind == "bins" and g.get("type") == "bool":
            raise Refused("a bool has no bins")
        if not 1 <= g.get("bins", 1) <= MOST_BINS:
            raise Refused(f"1 to {MOST_BINS} bins")
        if kind == "bins" and "depth" in g:
            raise Refused("bins have no cells")
        if not 0 <= g.get("depth", 0) <= 32:
            raise Refused("cells are of depth 0 to 32")
        if "area" in g and "depth" not in g:
            raise Refused("an area needs cells")
        low, high = g.get("range", (0, 1))
        if not low < high:
            raise Refused("a range rises")
        if kind == "artifacts" and g.get("hierarchy") in ("nested", "dag") and "top" in g and "cut" not in g:
            raise Refused("a tree needs a cut")
        if kind == "artifacts" and g.get("hierarchy") not in ("nested", "dag") and "cut" in g:
            raise Refused("only a tree has a cut")


def totals(rows: DataFrame) -> DataFrame:
    """total and reference_total: the sizes of both sets."""
    return rows.agg(F.count_if("in_set").alias("total"), F.count_if("in_ref").alias("reference_total"))


def _lift(count: Column, total: Column, ref: Column, ref_total: Column) -> Column:
    return F.when((ref > 0) & (total > 0), (count / total) / (ref / ref_total))


def with_lift(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """counts (count, reference_count) with lift. sizes is one row."""
    t = sizes.first()
    return counts.withColumn("lift", _lift(F.col("count"), F.lit(t["total"]), F.col("reference_count"), F.lit(t["reference_total"])))


def _tally(by: DataFrame, *keys: str) -> DataFrame:
    return by.groupBy(*keys).agg(F.count_if("in_set").alias("count"), F.count_if("in_ref").alias("reference_count"))


def set_size(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("in_set").alias("count"))


def top_values(rows: DataFrame, column: str, n: int) -> list:
    """The n values most frequent in the set, equal counts by value."""
    counts = rows.where(F.col("in_set") & F.col(column).isNotNull()).groupBy(column).count()
    return [r[0] for r in counts.orderBy(F.desc("count"), column).limit(n).collect()]  # n values at most


def by_values(rows: DataFrame, column: str, top: int | None = None, named: list | None = None, listable: DataFrame | None = None, depth: int | None = None, area: Column | None = None) -> DataFrame:
    """One row per listed value, then ``rest`` and ``none``, each by cells where a depth is given.

    Columns: ord (place in the listing), grp (listed, rest, none), key, [cell], count, reference_count. Named values are listed
    in order, each once, with rows of zero; values that are not in listable are left out. An area narrows cells only: the
    listing is that of the whole set.
    """
    listed = top_values(rows, column, top) if named is None else list(dict.fromkeys(named))
    if named is not None and listable is not None and listed:
        open_ = {r[0] for r in listable.where(F.col(column).isin(*listed)).select(column).distinct().collect()}
        listed = [v for v in listed if v in open_]
    c = F.col(column)
    n = len(listed)
    place = F.when(c.isNull(), F.lit(n + 1))
    if listed:
        at = F.array_position(F.array(*map(F.lit, listed)), c)
        place = place.when(at > 0, at - 1)
    grouped = rows.withColumn("ord", place.otherwise(F.lit(n)).cast("int"))
    keys = ["ord"]
    if depth is not None:
        grouped = grouped.withColumn("cell", spatial.tile(F.col("code"), depth))
        if area is not None:
            grouped = grouped.where(area)
        keys.append("cell")
    counts = _tally(grouped, *keys)
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[column]
    names = spark.createDataFrame([(i, "listed", v) for i, v in enumerate(listed)] + [(n, "rest", None), (n + 1, "none", None)], f"ord int, grp string, key {kind}")
    if depth is not None:
        return counts.where("count > 0 or reference_count > 0").join(names, "ord").select("ord", "grp", "key", "cell", "count", "reference_count")
    out = names.join(counts, "ord", "left").fillna(0, ["count", "reference_count"])
    keep = (F.col("count") > 0) | (F.col("reference_count") > 0)
    if named is not None:
        keep = keep | (F.col("grp") == "listed")
    return out.where(keep).select("ord", "grp", "key", "count", "reference_count")


def distinct_groups(rows: DataFrame, column: str) -> DataFrame:
    """How many values have an item in the set."""
    return rows.where("in_set").agg(F.countDistinct(column).alias("groups"))


def by_cells(rows: DataFrame, depth: int, area: Column | None = None) -> DataFrame:
    """Non-empty cells of a depth: cell, count, reference_count."""
    x = rows.withColumn("cell", spatial.tile(F.col("code"), depth))
    return _tally(x if area is None else x.where(area), "cell").where("count > 0 or reference_count > 0")


def in_area(depth: int, box: tuple[float, float, float, float], frame: spatial.Frame) -> Column:
    """Whether an item's cell lies in the inclusive rectangle of cells that a box spans."""
    shift = 32 - depth
    xs = sorted(spatial.fixed32_value(v, frame.min_x, frame.max_x) >> shift for v in (box[0], box[2]))
    ys = sorted(spatial.fixed32_value(v, frame.min_y, frame.max_y) >> shift for v in (box[1], box[3]))
    return F.shiftright("qx", shift).between(*xs) & F.shiftright("qy", shift).between(*ys)


# --- histograms -------------------------------------------------------------------------------------


def _finite(c: Column, kind: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c) if kind in ("double", "float") else c


def default_edges(visible: DataFrame, column: str, n: int) -> list:
    """Readable edges over the least and largest finite value of the visible set, whatever the filter."""
    kind = dict(visible.dtypes)[column]
    c = F.unix_micros(column) if kind == "timestamp" else _finite(F.col(column), kind)
    r = visible.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
    if r["a"] is None:
        return []
    if kind == "timestamp":
        return edges_.readable_times(r["a"], r["b"], n)
    if kind in ("double", "float"):
        return edges_.readable_floats(float(r["a"]), float(r["b"]), n)
    return edges_.readable_ints(int(r["a"]), int(r["b"]), n)


def range_edges(kind: str, low, high, n: int) -> list:
    return edges_.cut_floats(float(low), float(high), n) if kind in ("double", "float") else edges_.cut_ints(int(low), int(high), n)


def histogram(rows: DataFrame, column: str, edges: list) -> DataFrame:
    """One row per bin with its edges, then ``rest`` (values outside, NaN) and ``none`` (no value) where either set has some."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[column]
    value = F.unix_micros(column) if kind == "timestamp" else F.col(column)
    n = len(edges) - 1
    x = rows.withColumn("ord", F.when(value.isNull(), n + 1).otherwise(F.coalesce(edges_.bin_of(value, edges), F.lit(n))).cast("int"))
    counts = _tally(x, "ord")
    num = "double" if kind in ("double", "float") else "bigint"
    names = spark.createDataFrame([(i, "bin", a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))] + [(n, "rest", None, None), (n + 1, "none", None, None)], f"ord int, grp string, lower {num}, upper {num}")
    out = names.join(counts, "ord", "left").fillna(0, ["count", "reference_count"])
    return out.where("grp = 'bin' or count > 0 or reference_count > 0")


def sampled_histogram(rows: DataFrame, column: str, edges: list, sample: int, rank_bits: int = 60) -> DataFrame:
    """A histogram counted over the items of rank below sample / n of the rank space and scaled to n, halves rounded up;
    exact where the set is no larger than the sample."""
    n = rows.agg(F.count_if("in_set").alias("n")).first()["n"]
    if n <= sample:
        return histogram(rows, column, edges)
    part = rows.where(F.col("rank") < F.lit((sample << rank_bits) // n))
    items = part.agg(F.count_if("in_set").alias("n")).first()["n"]
    got = histogram(part, column, edges)
    scaled = F.floor((F.col("count").cast("decimal(38,0)") * (2 * n) + items) / (2 * items)) if items else F.lit(0)
    return got.withColumn("count", scaled.cast("long"))


# --- summaries --------------------------------------------------------------------------------------


def exact_sum_state(rows: DataFrame, column: str) -> DataFrame:
    """(n, total): partial exact sums of a double column as whole multiples of 2**-1074, one row per task, as decimal text."""

    def run(batches):
        n, total = 0, Fraction(0)
        for b in batches:
            part = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            n += len(part)
            total += _exact(part)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([str(int(total * (1 << 1074)))])], ["n", "total"])

    return rows.select(F.col(column).cast("double")).mapInArrow(run, "n bigint, total string")


def _exact(values) -> Fraction:
    """The exact sum of finite doubles: mantissas are added as whole numbers by exponent."""
    import numpy as np

    m, e = np.frexp(values)
    whole = np.round(np.ldexp(m, 53)).astype(np.int64)
    out = Fraction(0)
    for k in np.unique(e):
        part = whole[e == k]
        s = int((part >> 26).sum()) * (1 << 26) + int((part & ((1 << 26) - 1)).sum())
        shift = int(k) - 53
        out += Fraction(s * (1 << shift)) if shift >= 0 else Fraction(s, 1 << -shift)
    return out


def exact_mean(rows: DataFrame, column: str) -> float | None:
    """The mean of the finite values, rounded once (ties to even)."""
    parts = exact_sum_state(rows.where(F.abs(F.col(column).cast("double")) < F.lit(math.inf)).where(~F.isnan(F.col(column).cast("double"))), column).collect()
    n = sum(r["n"] for r in parts)
    return float(Fraction(sum(int(r["total"]) for r in parts), n << 1074)) if n else None


def field_summary(visible: DataFrame, column: str) -> DataFrame:
    """items, finite, none, minimum, maximum and mean of one field over the visible set.

    Whole numbers are added as decimals; doubles by exact sums, so the mean is rounded once whatever the order.
    """
    kind = dict(visible.dtypes)[column]
    c = F.unix_micros(column) if kind == "timestamp" else F.col(column)
    fine = _finite(c, kind)
    base = [F.count(F.lit(1)).alias("items"), F.count(fine).alias("finite"), F.count_if(F.col(column).isNull()).alias("none"), F.min(fine).cast("double").alias("minimum"), F.max(fine).cast("double").alias("maximum")]
    if kind in ("double", "float"):
        return visible.agg(*base).withColumn("mean", F.lit(exact_mean(visible, column)).cast("double"))
    total = F.sum(c.cast("decimal(20,0)"))
    return visible.agg(*base, (total.cast("double") / F.count(c)).alias("mean"))


# --- layers -----------------------------------------------------------------------------------------


def by_artifacts(rows: DataFrame, members: DataFrame, listed: DataFrame | None = None, top: int | None = None, depth: int | None = None) -> DataFrame:
    """Counts by artifact, then ``rest`` (in a served artifact that is not listed only) and ``none`` (in none that is served).

    members: artifact, entity of the artifacts served to the viewer. listed: artifact (a table), or the top of the set by count.
    Artifacts may overlap: an item counts in each that holds it. With a depth, each group is counted by cells.
    """
    if (listed is None) == (top is None):
        raise Refused("which groups: top or named")
    if top is not None and not 1 <= top <= MOST_GROUPS:
        raise Refused(f"at most {MOST_GROUPS} groups")
    cells = [] if depth is None else ["cell"]
    own = rows if depth is None else rows.withColumn("cell", spatial.tile(F.col("code"), depth))
    # one join of items and memberships, whose exchange serves the counts and the rest
    held = own.select("entity", "in_set", "in_ref", *cells).join(members.select("artifact", "entity").distinct(), "entity", "left")
    if listed is None:
        counts = _tally(held.where("artifact is not null"), "artifact")
        listed = counts.where("count > 0").orderBy(F.desc("count"), "artifact").limit(top).select("artifact")
    names = listed.select("artifact", F.lit(1).alias("yes"))
    flagged = held.join(names, "artifact", "left")
    shown = _tally(flagged.where("yes = 1"), "artifact", *cells)
    if depth is None:
        shown = names.select("artifact").join(shown, "artifact", "left").fillna(0, ["count", "reference_count"])
    shown = shown.select(F.lit("listed").alias("grp"), "artifact", *cells, "count", "reference_count")
    state = F.max(F.when(F.col("yes") == 1, 2).when(F.col("artifact").isNotNull(), 1).otherwise(0))
    items = flagged.groupBy("entity").agg(state.alias("state"), F.bool_or("in_set").alias("in_set"), F.bool_or("in_ref").alias("in_ref"), *[F.first(c).alias(c) for c in cells])
    left = items.where("state < 2").withColumn("grp", F.when(F.col("state") == 1, "rest").otherwise("none"))
    kind = dict(members.dtypes)["artifact"]
    rest = _tally(left, "grp", *cells).where("count > 0 or reference_count > 0").select("grp", F.lit(None).cast(kind).alias("artifact"), *cells, "count", "reference_count")
    return shown.unionByName(rest) if depth is None else shown.where("count > 0 or reference_count > 0").unionByName(rest)


def top_at_cut(rows: DataFrame, members: DataFrame, cut: DataFrame, top: int, depth: int | None = None) -> DataFrame:
    """The top artifacts of a treed layer at a drawn cut (see trees): ranked are those with nothing drawn beneath them; rest and none
    count against them."""
    drawn = cut.where("frontier").select("artifact")
    return by_artifacts(rows, members.join(drawn, "artifact", "left_semi"), top=top, depth=depth)


def answer(rows: DataFrame, groupings: list[dict], members: dict[str, DataFrame] | None = None, cuts: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """The tables of a request: its groupings are checked against the limits before anything is planned.

    A grouping: kind (set, values, bins, cells, artifacts), column or layer, and top, named, bins, range, sample, depth as the kind
    allows. members and cuts: by layer, of what the viewer is served.
    """
    check_request(groupings)
    out = []
    for g in groupings:
        if g["kind"] == "set":
            out.append(set_size(rows))
        elif g["kind"] == "values":
            out.append(by_values(rows, g["column"], g.get("top"), g.get("named"), depth=g.get("depth")))
        elif g["kind"] == "cells":
            out.append(by_cells(rows, g["depth"]))
        elif g["kind"] == "bins":
            kind = dict(rows.dtypes)[g["column"]]
            edges = range_edges(kind, *g["range"], g["bins"]) if "range" in g else default_edges(rows, g["column"], g["bins"])
            out.append(sampled_histogram(rows, g["column"], edges, g["sample"]) if "sample" in g else histogram(rows, g["column"], edges))
        else:
            held = members[g["layer"]]
            if "cut" in g:
                out.append(top_at_cut(rows, held, cuts[g["layer"]], g["top"], g.get("depth")))
            else:
                listed = rows.sparkSession.createDataFrame([(a,) for a in g["named"]], f"artifact {dict(held.dtypes)['artifact']}") if "named" in g else None
                out.append(by_artifacts(rows, held, listed, g.get("top"), g.get("depth")))
    return out


def ranked_artifacts(counts: DataFrame, n: int) -> DataFrame:
    """The first n by count, equal ones by artifact, with their place."""
    return counts.orderBy(F.desc("count"), "artifact").limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "artifact")))
