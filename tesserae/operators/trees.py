"""Conversation trees: the path of the active message, the longest path, or all messages by time.

Paths are grown for all conversations at once by parent pointers whose length doubles each round, to any depth; a node met again
ends its path. Each path is built once at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.lineage import kept


def _chains(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, leaf, path from root to leaf) of starts(conv, leaf); a path to a node that is not there is left out."""
    hop = kept(nodes.where(F.col("parent").isNotNull()).select("conv", "id", F.col("parent").alias("up")))
    met = kept(starts.select("conv", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("depth")).distinct())
    reach, n = 1, met.count()
    while True:
        # met has all nodes less than reach steps above a leaf, hop leads reach steps up
        far = met.join(hop, ["conv", "id"]).select("conv", "leaf", F.col("up").alias("id"), (F.col("depth") + reach).alias("depth"))
        met = kept(met.unionByName(far).groupBy("conv", "leaf", "id").agg(F.min("depth").alias("depth")))
        before, n = n, met.count()
        if n == before:
            break
        after = hop.select("conv", F.col("id").alias("up"), F.col("up").alias("_next"))
        hop, reach = kept(hop.join(after, ["conv", "up"]).select("conv", "id", F.col("_next").alias("up"))), 2 * reach
    there = nodes.select("conv", "id", F.lit(True).alias("_there")).distinct()
    rows = met.join(there, ["conv", "id"], "left").groupBy("conv", "leaf")
    paths = rows.agg(F.sort_array(F.collect_list(F.struct("depth", "id")), asc=False).alias("_p"), F.count("_there").alias("_n"))
    return paths.where(F.size("_p") == F.col("_n")).select("conv", "leaf", F.col("_p.id").alias("path"))


def _depths(nodes: DataFrame) -> DataFrame:
    """(conv, id, depth, lost, cyclic): steps from each node to its root; lost: a parent above is not there; cyclic: there is no root.

    A row a node throughout: each holds an ancestor and the steps to it, which double each round.
    """
    there = nodes.select("conv", F.col("id").alias("parent"), F.lit(True).alias("_there")).distinct()
    first = nodes.select("conv", "id", "parent").dropDuplicates(["conv", "id"]).join(there, ["conv", "parent"], "left")
    lost = F.col("parent").isNotNull() & F.col("_there").isNull()
    now = kept(first.select("conv", "id", F.when(F.col("_there"), F.col("parent")).alias("up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth"), lost.alias("lost")))
    for _ in range(max(1, now.count()).bit_length() + 1):
        if now.where(F.col("up").isNotNull()).isEmpty():
            break
        above = now.select("conv", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("lost").alias("_l"))
        more = now.join(above, ["conv", "up"], "left")
        now = kept(more.select("conv", "id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.col("lost") | F.coalesce("_l", F.lit(False))).alias("lost")))
    return now.select("conv", "id", "depth", "lost", F.col("up").isNotNull().alias("cyclic"))


def active_paths(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, path) of conversations(conv, current) over nodes(conv, id, parent); the longest path where current is unknown or not there."""
    starts = conversations.join(nodes.select("conv", F.col("id").alias("current")), ["conv", "current"], "left_semi").select("conv", F.col("current").alias("leaf"))
    rest = nodes.join(conversations.select("conv").join(starts, "conv", "left_anti"), "conv", "left_semi")
    return _chains(starts, nodes).select("conv", "path").unionByName(longest_paths(rest))


def longest_paths(nodes: DataFrame) -> DataFrame:
    """(conv, path): each conversation's longest path; of equal ones that with the smaller joined ids.

    Only the deepest leaves' paths are built, and those of leaves below a cycle, whose lengths are not known before.
    """
    inner = nodes.where(F.col("parent").isNotNull()).select("conv", F.col("parent").alias("id")).distinct()
    leaves = kept(_depths(nodes).where("not lost or cyclic").join(inner, ["conv", "id"], "left_anti"))
    deepest = leaves.where("not cyclic").groupBy("conv").agg(F.max("depth").alias("depth"))
    leaves = leaves.where("not cyclic").join(deepest, ["conv", "depth"], "left_semi").unionByName(leaves.where("cyclic"), allowMissingColumns=True).select("conv", F.col("id").alias("leaf"))
    order = Window.partitionBy("conv").orderBy(F.desc(F.size("path")), F.array_join("path", "|"))
    return _chains(leaves, nodes).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("conv", "path")


def all_nodes(nodes: DataFrame) -> DataFrame:
    """(conv, id, place) by message time, unknown times last, then id."""
    order = Window.partitionBy("conv").orderBy(F.col("time").asc_nulls_last(), "id")
    return nodes.select("conv", "id", F.row_number().over(order).alias("place"))
