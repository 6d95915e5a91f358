"""Order and structure of the topology: undirected links, components, breadth-first order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from netloom.sources import schema as S
from netloom.sources.session import checkpoint


#: Levels of a breadth-first order that are kept apart before they are put into one table.
MERGED_LEVELS = 32


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the place of each row from 0, without sorting all rows in one task: ranges are ranked apart
    and start where the ranges before them end. The order must be total."""
    parts = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_within", within).join(before, "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_n", "_before", "_within")


def dedupe_links(links: DataFrame) -> DataFrame:
    """One undirected link for each pair of chassis: seq of the first, source < target, and on each side
    the first label that is not empty."""
    forward = F.col("source_chassis_id") <= F.col("target_chassis_id")
    turned = links.select("seq", F.least("source_chassis_id", "target_chassis_id").alias("source_chassis_id"), F.greatest("source_chassis_id", "target_chassis_id").alias("target_chassis_id"), F.when(forward, F.col("local_port")).otherwise(F.col("remote_port")).alias("local_port"), F.when(forward, F.col("remote_port")).otherwise(F.col("local_port")).alias("remote_port"))

    def first_label(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name) != "", F.col("seq"))).alias(name)

    return turned.groupBy("source_chassis_id", "target_chassis_id").agg(F.min("seq").alias("seq"), first_label("local_port"), first_label("remote_port"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it reaches; edges are a, b, of numbers.

    Labels spread to neighbours and jump along the labels they name, a checkpoint a
    round, until none moves.
    """
    links = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        taken = near.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        jumped = taken.join(labels.select(F.col("node").alias("root"), F.col("root").alias("further")), "root")
        settled = jumped.select("node", F.least("root", "further").alias("root"))
        compared = checkpoint(settled.join(labels.withColumnRenamed("root", "was"), "node"))
        labels = compared.select("node", "root")
        if compared.filter("root <> was").isEmpty():
            return labels


def bfs_order(devices: DataFrame, links: DataFrame) -> DataFrame:
    """chassis_id, pos, depth, parent and rank of every device (pos, chassis_id).

    A queue would start at the first device by place, add the neighbours of each
    device in the order of the links, and go on with the first device left. Here all
    components grow together, a level a round: within a component the new devices of a
    level follow the rank of the device that reaches them first, then the link's
    place and side. Components follow each other by the place of their roots. What
    the links of a level lead to is new unless it is in this level or the last.
    """
    place = devices.select("chassis_id", F.col("pos").alias("node"))
    ends = links.select("seq", "source_chassis_id", "target_chassis_id").join(place.select(F.col("chassis_id").alias("source_chassis_id"), F.col("node").alias("a")), "source_chassis_id").join(place.select(F.col("chassis_id").alias("target_chassis_id"), F.col("node").alias("b")), "target_chassis_id")
    edges = checkpoint(ends.filter("a <> b").select("seq", "a", "b"))
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next"), "seq", F.lit(0).alias("side")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next"), "seq", F.lit(1).alias("side")))
    roots = components(place, edges)
    level = checkpoint(roots.filter("node = root").select("node", "root", F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(None).cast("long").alias("parent")))
    before, levels, depth = level.limit(0), [level], 0
    while True:
        depth += 1
        steps = level.join(both, "node").select("root", F.col("next").alias("node"), F.col("node").alias("parent"), F.struct("at", "seq", "side").alias("key"))
        fresh = steps.join(level.select("node").unionByName(before.select("node")), "node", "left_anti").groupBy("root", "node").agg(F.min("key").alias("key"), F.min_by("parent", "key").alias("parent"))
        # places follow the roots, so ranges share the sort of a component of any size
        placed = numbered(fresh, "at", F.col("root"), F.col("key"), F.col("node"))
        before, level = level, checkpoint(placed.select("node", "root", F.lit(depth).alias("depth"), F.col("at").cast("int"), "parent"))
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) > MERGED_LEVELS:
            levels = [checkpoint(reduce(DataFrame.unionByName, levels))]
    ranked = numbered(reduce(DataFrame.unionByName, levels), "rank", F.col("root"), F.col("depth"), F.col("at"))
    parents = place.select(F.col("node").alias("parent"), F.col("chassis_id").alias("parent_chassis_id"))
    return ranked.join(place, "node").join(parents, "parent", "left").select("chassis_id", F.col("node").alias("pos"), "root", "depth", F.col("parent_chassis_id").alias("parent"), "rank")


def discovery_order(ordered: DataFrame, placed: DataFrame) -> DataFrame:
    """node_id, parent_id and discovery_order: each device in breadth-first order, after it what is
    attached to it, at the end what is attached to nothing."""
    devices = ordered.select(S.device_id(F.col("chassis_id")).alias("node_id"), S.device_id(F.col("parent")).alias("parent_id"), F.struct(F.lit(0).alias("loose"), F.col("rank").alias("rank"), F.lit(-1).alias("kind"), F.col("pos").alias("pos"), F.lit(0).cast("long").alias("seq")).alias("key"))
    ranks = ordered.select(F.col("chassis_id").alias("parent"), "rank")
    attached = placed.join(ranks, "parent", "left")
    key = F.struct(F.col("rank").isNull().cast("int").alias("loose"), F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), F.col("kind_order").alias("kind"), F.col("order.pos").alias("pos"), F.col("order.seq").alias("seq"))
    others = attached.select("node_id", S.device_id(F.col("parent")).alias("parent_id"), key.alias("key"))
    return numbered(devices.unionByName(others), "discovery_order", F.col("key"), F.col("node_id")).drop("key")


def tree_depths(nodes: DataFrame) -> DataFrame:
    """node_id and depth of every node in the tree of parent_id; a node whose parent is missing is a root."""
    rest = nodes.select("node_id", "parent_id")
    orphan = rest.join(rest.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
    level, depth = checkpoint(orphan.select("node_id", F.lit(0).alias("depth"))), 0
    levels = level
    while not level.isEmpty():
        depth += 1
        level = checkpoint(rest.join(level.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id", F.lit(depth).alias("depth")))
        levels = levels.unionByName(level)
    return levels


def depths_and_siblings(nodes: DataFrame) -> DataFrame:
    """The children of every node in order, for a tree view: node_id, parent_id, sibling_rank; a node
    whose parent is missing hangs on nothing."""
    ids = nodes.select(F.col("node_id").alias("parent_id"))
    tree = nodes.join(ids, "parent_id", "left_semi").select("node_id", "parent_id", "discovery_order")
    return tree.withColumn("sibling_rank", F.row_number().over(W.partitionBy("parent_id").orderBy("discovery_order")) - 1)
