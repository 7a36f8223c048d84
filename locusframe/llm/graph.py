"""Connected components by DataFrame rounds; nothing of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in edges (a, b), comp being the smallest node reachable.

    Each round takes the smallest label of the neighbours and then the label of that label, so long chains halve. Labels are written
    after each round. Minima combine before the shuffle, so a node with very many neighbours is no larger there than any other."""
    both = store.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", "m").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        step = store.written(step.join(up, "c", "left").select("node", F.least("c", "cc").alias("comp"), (F.least("c", "cc") != F.col("comp")).alias("moved")), "labels")
        labels = step.select("node", "comp")
        if step.filter("moved").limit(1).count() == 0:
            return labels
