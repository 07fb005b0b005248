"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) of the nodes in links (a, b): comp is the smallest node of the component.

    Each round takes the smallest label among neighbours and then the label's own label, so long chains shorten
    geometrically. Only links and labels are shuffled; each round is written to the shared folder.
    """
    both = common.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-links")
    label = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc-label")
    for _ in range(most_rounds):
        # labels grow with the corpus, so they are shuffled, never broadcast
        near = both.join(label.select(F.col("node").alias("b"), "comp").hint("merge"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        step = common.materialise(label.join(near.hint("merge"), "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp")), "cc-near")
        own = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jump = step.join(own.hint("merge"), "comp", "left").select("node", "old", F.least(F.col("comp"), F.coalesce("up", "comp")).alias("comp"))
        before, label = label, common.materialise(jump, "cc-label")
        common.release(before, step)
        if label.where("comp <> old").isEmpty():
            common.release(both)
            return label.select("node", "comp")
    raise RuntimeError(f"no components after {most_rounds} rounds")
