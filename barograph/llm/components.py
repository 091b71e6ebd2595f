"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b), for every node that has an edge.

    Rounds of taking the least label among neighbours, then the label of the label (which halves the depth of the label
    trees), until nothing changes. Each round's labels are written to the shared folder. A node that a third of all edges
    touch costs partial minima before the shuffle; nothing is gathered per node.
    """
    edges = C.stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = C.stash(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        before = C.mark()
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "least").alias("low"), "component")
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        new = low.join(up, "low").select("node", F.least("low", "root").alias("component"), (F.least("low", "root") < F.col("component")).alias("moved"))
        new = C.stash(new, "labels")
        C.discard(edges.sparkSession, before - 1)  # the labels before are not read again
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
