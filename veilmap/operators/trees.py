"""Hierarchies as tables: what edges mean, re-rooting on what passes, rungs, and the cut that a request draws.

A node's rung is the length of the longest path down to it in the re-rooted graph. With ``near`` and ``far`` the smallest and
the largest rung among its children, a cut at depth d draws a node where rung <= d and, if children stand for their parents,
far > d: just then some path goes on below d only. So every node is drawn over one interval of depths, the sizes of all cuts
are running sums of interval ends, and what lies on the frontier (nothing drawn beneath it) is told by near > d. Nothing but
the depth of the cut comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import settled

HIERARCHIES = ("flat", "nested", "dag", "stacked", "tiered")
TREED = ("nested", "dag")
MOST_ROUNDS = 64


class HierarchyError(ValueError):
    """Edges that the layer's kind does not allow."""


def roll_ups(kind: str, artifacts: DataFrame) -> DataFrame:
    """(artifact, parent): the edges of a layer along which a parent can stand for its children; none but in nested and dag layers.

    artifacts: artifact, level, parents (array). Flat and stacked layers have no edges, nested nodes one parent at most; edges
    stay within one level in nested and dag layers and lead from a coarser level to a finer one in tiered layers.
    """
    if kind not in HIERARCHIES:
        raise HierarchyError(f"unknown hierarchy {kind!r}")
    edges = artifacts.select("artifact", "level", F.explode("parents").alias("parent")).where("parent is not null").dropDuplicates(["artifact", "parent"])
    levels = artifacts.select(F.col("artifact").alias("parent"), F.col("level").alias("above"))
    if kind in ("flat", "stacked"):
        wrong = edges
    elif kind == "tiered":
        wrong = edges.join(levels, "parent", "left").where("above is null or above >= level")
    else:
        wrong = edges.join(levels, "parent", "left").where("above is null or not (above <=> level)")
        if kind == "nested":
            wrong = wrong.select("artifact").unionByName(edges.groupBy("artifact").count().where("count > 1").select("artifact"))
    first = wrong.select("artifact").first()
    if first:
        raise HierarchyError(f"{kind} layer: the edges of {first[0]!r} are not allowed")
    links = edges.select("artifact", "parent")
    return links if kind in TREED else links.limit(0)


def rerooted(edges: DataFrame, passing: DataFrame) -> DataFrame:
    """(artifact, parent) among passing nodes: each hangs from its nearest passing ancestors, withheld ones skipped."""
    names = passing.select("artifact").distinct()
    open_ = names.select(F.col("artifact").alias("parent"), F.lit(True).alias("passes"))
    climb = edges.select("artifact", "parent").distinct().join(names, "artifact", "left_semi")
    found = None
    for _ in range(MOST_ROUNDS):
        told = settled(climb.join(open_, "parent", "left").select("artifact", "parent", "passes"))
        here = told.where("passes").select("artifact", "parent")
        found = here if found is None else found.unionByName(here)
        held = told.where("passes is null").select("artifact", F.col("parent").alias("middle"))
        if held.isEmpty():
            return found.distinct()
        climb = held.join(edges.select(F.col("artifact").alias("middle"), "parent"), "middle").select("artifact", "parent").distinct()
    raise HierarchyError("a path is longer than any hierarchy may be, or goes round")


def rungs(passing: DataFrame, links: DataFrame) -> DataFrame:
    """artifact, rung, near, far of every passing node. links: what rerooted gives."""
    links = settled(links)
    known = settled(passing.select("artifact").distinct().withColumn("rung", F.lit(0)))
    for _ in range(MOST_ROUNDS):
        above = known.select(F.col("artifact").alias("parent"), F.col("rung").alias("above"))
        least = links.join(above, "parent").groupBy("artifact").agg((F.max("above") + 1).alias("least"))
        step = settled(known.join(least, "artifact", "left").select("artifact", F.greatest("rung", F.coalesce("least", "rung")).alias("rung"), (F.coalesce("least", F.lit(0)) > F.col("rung")).alias("moved")))
        known = step.drop("moved")
        if step.where("moved").isEmpty():
            below = links.join(known, "artifact").groupBy(F.col("parent").alias("artifact")).agg(F.min("rung").alias("near"), F.max("rung").alias("far"))
            return known.join(below, "artifact", "left")
    raise HierarchyError("a path is longer than any hierarchy may be, or goes round")


def cut_sizes(steps: DataFrame, prune: bool) -> DataFrame:
    """depth, size of the cut at each depth. steps: what rungs gives."""
    ends = steps.select(F.col("rung").alias("depth"), F.lit(1).alias("n"))
    if prune:
        ends = ends.unionByName(steps.where("far is not null").select(F.col("far").alias("depth"), F.lit(-1).alias("n")))
    # a row per depth
    return ends.groupBy("depth").agg(F.sum("n").alias("n")).select("depth", F.sum("n").over(Window.orderBy("depth")).alias("size"))


def at_depth(steps: DataFrame, depth: int, prune: bool) -> DataFrame:
    """artifact, rung, frontier of the cut at a depth."""
    drawn = steps.where((F.col("rung") <= depth) & (F.col("far").isNull() | (F.col("far") > depth) if prune else F.lit(True)))
    return drawn.select("artifact", "rung", (F.col("near").isNull() | (F.col("near") > depth)).alias("frontier"))


def drawn_cut(artifacts: DataFrame, passing: DataFrame, budget: int | None, prune: bool, kind: str | None = None) -> DataFrame:
    """artifact, rung, frontier of the cut that a treed layer draws: the deepest within the budget, the coarsest where none is.

    artifacts: artifact, parents (array), and level where the layer's kind is to be checked.
    """
    edges = roll_ups(kind, artifacts) if kind else artifacts.select("artifact", F.explode("parents").alias("parent")).where("parent is not null")
    if kind and kind not in TREED:
        raise HierarchyError(f"a {kind} layer has no cut")
    steps = settled(rungs(passing, rerooted(edges, passing)))
    sizes = cut_sizes(steps, prune)
    depth = sizes.agg(F.coalesce(F.max(F.when(F.lit(budget is None) | (F.col("size") <= (budget or 0)), F.col("depth"))), F.lit(0))).first()[0]
    return at_depth(steps, depth, prune)


def lineage(links: DataFrame, node) -> DataFrame:
    """(artifact, steps): passing ancestors of a node with how many links away each is at the nearest."""
    level = links.where(F.col("artifact") == F.lit(node)).select(F.col("parent").alias("artifact")).distinct()
    out = None
    for step in range(1, MOST_ROUNDS):
        level = settled(level.withColumn("steps", F.lit(step)))
        if level.isEmpty():
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        level = links.join(level.select("artifact"), "artifact", "left_semi").select(F.col("parent").alias("artifact")).distinct().join(out.select("artifact"), "artifact", "left_anti")
    raise HierarchyError("a path is longer than any hierarchy may be, or goes round")
