"""Paths of long, cyclic and broken conversation trees."""

from pyspark.sql import functions as F

from tesserae.operators import trees


def test_paths_longer_than_4096(spark):
    n = 4500
    rows = [("long", f"{k:05d}", f"{k - 1:05d}" if k else None) for k in range(n)] + [("long", "side", f"{n - 9:05d}")]
    rows += [("ring", "a", "b"), ("ring", "b", "c"), ("ring", "c", "b"), ("lost", "x", "gone")]
    nodes = spark.createDataFrame(rows, "conv string, id string, parent string")
    starts = spark.createDataFrame([("long", f"{n - 1:05d}"), ("ring", "a"), ("lost", "x"), ("none", None)], "conv string, current string")
    want = {"long": [f"{k:05d}" for k in range(n)], "ring": ["c", "b", "a"]}
    assert {r["conv"]: r["path"] for r in trees.active_paths(starts, nodes).collect()} == want
    assert {r["conv"]: r["path"] for r in trees.longest_paths(nodes).collect()} == want


def test_longest_path_of_a_long_conversation_with_many_branches(spark):
    """Rows stay in proportion to nodes: 20,001 messages in a chain, a third of them with a branch of their own."""
    n = 20_001
    i = F.col("id")
    chain = spark.range(n).select(F.lit("c").alias("conv"), F.lpad(i.cast("string"), 6, "0").alias("id"), F.when(i > 0, F.lpad((i - 1).cast("string"), 6, "0")).alias("parent"))
    side = spark.range(0, n, 3).select(F.lit("c").alias("conv"), F.concat(F.lpad(i.cast("string"), 6, "0"), F.lit("b")).alias("id"), F.lpad(i.cast("string"), 6, "0").alias("parent"))
    depths = trees._depths(chain.unionByName(side))
    assert depths.count() == n + len(range(0, n, 3)) and depths.agg(F.max("depth")).first()[0] == n - 1
    (row,) = trees.longest_paths(chain.unionByName(side)).collect()
    assert row.path == [f"{k:06d}" for k in range(n)]


def test_longest_paths_with_cycles_and_lost_parents(spark):
    nodes = [("a", "1", None), ("a", "2", "1"), ("a", "3", "gone"), ("a", "4", "3"), ("a", "5", "4"), ("b", "1", "2"), ("b", "2", "1"), ("b", "3", "2"), ("c", "1", None), ("c", "y", "1"), ("c", "x", "1"), ("d", "1", "1")]
    found = {r.conv: r.path for r in trees.longest_paths(spark.createDataFrame(nodes, "conv string, id string, parent string")).collect()}
    assert found == {"a": ["1", "2"], "b": ["1", "2", "3"], "c": ["1", "x"]}
