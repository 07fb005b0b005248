"""Cuts of hierarchies against their definition over all walks."""

import random

import pytest

from veilmap.operators import trees


def walks_of(parents):
    """Every walk from a node without parents down to a node without children."""
    kids = {n: [c for c, ps in parents.items() if n in ps] for n in parents}
    out, todo = [], [[n] for n, ps in parents.items() if not ps]
    while todo:
        walk = todo.pop()
        todo += [walk + [c] for c in kids[walk[-1]]]
        if not kids[walk[-1]]:
            out.append(walk)
    return out


class ByWalks:
    """What a walk shows is what passes on it; a node's rung is its last place on any walk."""

    def __init__(self, parents, passing):
        self.walks = [[n for n in w if n in passing] for w in walks_of(parents)]
        self.rung = {}
        for w in self.walks:
            for i, n in enumerate(w):
                self.rung[n] = max(i, self.rung.get(n, 0))
        inner = {n for w in self.walks for n in w[:-1]}
        self.ends = {n for n in self.rung if n not in inner}

    def cut(self, d, prune):
        if not prune:
            return {n for n, r in self.rung.items() if r <= d}
        whole = [w for w in self.walks if w and w[-1] in self.ends]
        # a walk that begins below others' nodes shows nothing of its own above them
        return {n for w in whole for n in [n for n in w if self.rung[n] <= d][-1:]}

    def frontier(self, cut):
        return {n for n in cut if not any(n in w and cut & set(w[w.index(n) + 1 :]) for w in self.walks)}


def forest(seed, graphs, most):
    r, parents, passing = random.Random(seed), {}, set()
    for g in range(graphs):
        names = [g * 100 + i for i in range(r.randint(1, most))]
        for i, n in enumerate(names):
            parents[n] = r.sample(names[:i], min(i, r.choice([0, 1, 1, 2])))
        passing |= {n for n in names if r.random() < 0.7}
    return parents, passing


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts(spark, seed):
    parents, passing = forest(seed, 60, 10)
    want = ByWalks(parents, passing)
    arts = spark.createDataFrame(list(parents.items()), "artifact bigint, parents array<bigint>")
    names = spark.createDataFrame([(n,) for n in passing], "artifact bigint")
    edges = arts.selectExpr("artifact", "explode(parents) as parent")
    links = trees.rerooted(edges, names)
    steps = trees.settled(trees.rungs(names, links))
    assert {r["artifact"]: r["rung"] for r in steps.collect()} == want.rung
    for prune in (True, False):
        sizes = {r["depth"]: r["size"] for r in trees.cut_sizes(steps, prune).collect()}
        for d, size in sizes.items():
            got = {r["artifact"]: r["frontier"] for r in trees.at_depth(steps, d, prune).collect()}
            assert set(got) == want.cut(d, prune) and len(got) == size
            assert {n for n, f in got.items() if f} == want.frontier(set(got))
    for budget, prune in ((None, True), (90, True), (150, False), (1, False)):
        got = {r["artifact"] for r in trees.drawn_cut(arts, names, budget, prune).collect()}
        depths = range(max(want.rung.values()), -1, -1)
        assert got == next((c for d in depths if budget is None or len(c := want.cut(d, prune)) <= budget), want.cut(0, prune)) if budget else want.cut(max(want.rung.values()), prune)
    node = max(want.rung, key=want.rung.get)
    assert {r["artifact"] for r in trees.lineage(links, node).collect()} == {n for w in want.walks if node in w for n in w[: w.index(node)]}


def test_kinds(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "artifact string, level int, parents array<string>")
    tree = frame(("a", 0, []), ("b", 0, ["a"]), ("c", 0, ["b"]))
    assert trees.roll_ups("nested", tree).count() == 2
    levels = frame(("a", 0, []), ("b", 1, ["a"]))
    assert trees.roll_ups("tiered", levels).count() == 0 and trees.roll_ups("flat", frame(("a", 0, []))).count() == 0
    for kind, rows in (("flat", tree), ("stacked", tree), ("nested", levels), ("dag", levels), ("tiered", tree), ("nested", frame(("a", 0, []), ("b", 0, []), ("c", 0, ["a", "b"]))), ("dag", frame(("a", 0, ["x"]))), ("heap", tree)):
        with pytest.raises(trees.HierarchyError):
            trees.roll_ups(kind, rows)
    with pytest.raises(trees.HierarchyError):
        trees.drawn_cut(levels, levels.select("artifact"), 3, True, "tiered")
    with pytest.raises(trees.HierarchyError):
        trees.rungs(tree.select("artifact"), spark.createDataFrame([("a", "b"), ("b", "a")], "artifact string, parent string"))
