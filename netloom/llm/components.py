"""Connected components by label propagation with pointer jumping.

Every round, each node takes the smallest label among its own and its
neighbours', then the label of the node its label names, so chains shrink by
doubling. Rounds end when no label moves. Labels and edges stay distributed;
each round is cut by a checkpoint, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.session import checkpoint


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for each long node of an edge, the smallest node it reaches.

    Self-loops and repeated edges are allowed; nodes without an edge don't appear.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = checkpoint(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpoint(links.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")).select("node", "root"))
    while True:
        near = links.join(labels.select(F.col("node").alias("v"), "root"), "v").select(F.col("u").alias("node"), "root")
        taken = near.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        jumped = taken.alias("t").join(labels.select(F.col("node").alias("root"), F.col("root").alias("further")), "root")
        settled = jumped.select("node", F.least("root", "further").alias("root"))
        moved = settled.join(labels.withColumnRenamed("root", "was"), "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved"))
        moved = checkpoint(moved)
        labels = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return labels
