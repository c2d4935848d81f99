"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps; and what
near-dedup needs around it: pairs between the components of a bucket.

Each step is a grouped minimum, with partial minima before the shuffle, and a join on the vertex, in which the edges of a hub
stay where they are (spread_join). If there are few edges in all, a vertex gathers its neighbours instead and no join is needed: the driver keeps
something of every plan and task, and a round of few edges weighs on it as much as one of many. Each round is written to the shared folder. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, spread_join

#: Rows of a bucket that one task compares with the bucket's strays.
BLOCK = 1000
#: Partitions of an edge table: at least FEW, of ROWS rows.
FEW, ROWS = 16, 200_000
#: Edges that one vertex may gather, if there are no more altogether.
SMALL = 50_000


def few(rows: DataFrame, total: int) -> DataFrame:
    """rows in partitions of some size, however many partitions a shuffle has: many rounds of nearly empty ones cost more than the work."""
    return rows.coalesce(max(FEW, total // ROWS))


def _gathered(edges: DataFrame, total: int) -> DataFrame:
    """(u, vs, m) of every u of edges(u, v): its neighbours, each once, and the least of them and u itself; for at most SMALL edges."""
    low = edges.groupBy("u").agg(F.collect_set("v").alias("vs"), F.min("v").alias("m"))
    return few(low, total).select("u", "vs", F.least("m", "u").alias("m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if total <= SMALL:
        larger = F.filter("vs", lambda v: v > F.col("u"))
        return _gathered(both, total).select(F.explode(larger).alias("u"), F.col("m").alias("v"))  # repeated edges go in the next step
    low = few(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), total).select("u", F.least("m", "u").alias("m"), "n")
    out = spread_join(both.where("v > u"), low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return few(few(out.where("u <> v"), total).distinct(), total)


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if total <= SMALL:
        out = _gathered(down, total).select(F.explode(F.array_append("vs", F.col("u"))).alias("u"), F.col("m").alias("v"))
    else:
        low = few(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), total)
        joined = spread_join(down, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = joined.union(low.select("u", F.col("m").alias("v")))
    return few(few(out.where("u <> v"), total).distinct(), total)


def _stars(edges: DataFrame, total: int) -> bool:
    """Whether every vertex has either one edge to a smaller one, or only edges from larger ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return few(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")), total).where("up > 1 or up = 1 and down = 1").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of edges(u, v) but the roots themselves; root: the component's smallest vertex.

    Loops and repeated edges change nothing; an empty table gives an empty result.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = edges.count()
    edges = few(edges, total)
    while not _stars(edges, total):
        edges = few(cut(_small_star(_large_star(edges, total), total)), total)
    return edges.select("u", F.col("v").alias("root"))


def across(rows: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Pairs between the components of each bucket of rows(key, id, root, ...): u, v and the other columns as u_... and v_....

    facts(id, ...): columns that are added to both ends, for the ids in buckets of several components only.

    A bucket's largest component is not compared with itself: only its strays, the rows of all others, meet the bucket's
    rows, and these are dealt out by BLOCK. Each pair comes once a bucket.
    """
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n")).where("parts > 1").drop("parts")
    total = rows.count()
    open_ = few(spread_join(rows, main, "key", total), total)
    open_ = cut(open_ if facts is None else few(open_.join(facts, "id"), total))
    tasks = F.ceil(F.col("n") / BLOCK).cast("int")
    end = lambda x: [F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in open_.columns if c not in ("key", "id", "main", "n"))]
    strays = open_.where("root <> main").select("key", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("_salt"), *end("u"))
    every = open_.select("key", F.pmod(F.xxhash64("id"), tasks).cast("int").alias("_salt"), F.col("main"), *end("v"))
    return strays.join(every, ["key", "_salt"]).where("u_root <> v_root and (v_root = main or u < v)").drop("_salt", "main")
