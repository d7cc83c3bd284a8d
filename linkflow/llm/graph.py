"""Connected components of an edge table, by labels that shrink to the least."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b); comp is the least node
    of the component. In each round a node takes the least label around it and
    then its label's label, so a path of n nodes takes about log n rounds.
    Nothing but the number of changed labels comes to the driver; minima are
    taken before the shuffle, so a hub is no hot group.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "graph-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "graph-labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.least("comp", "least").alias("comp"), F.col("comp").alias("was"))
        to = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        jumped = near.join(to, near["comp"] == to["next"], "left").select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "was")
        new = written(jumped, "graph-labels")
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels
