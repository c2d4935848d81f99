"""Mixing sources to target weights, as a min-cost flow from documents to sources.

A document may belong to several sources. Documents are aggregated by their membership pattern; a network of
start -> pattern (one arc for each repetition, with convex costs) -> source -> end (the source's quota) is solved
for a maximum flow of least cost, so nothing is repeated while unrepeated words are left that could fill the
quota. Then each pattern's words are taken: whole rounds of all its documents, and for the rest the first
documents in an order seeded by a hash of the id.

Only patterns and sources (bounded, checked) come to the driver. The place where the rest of a pattern ends is found by
bucket totals of the hash, so only the documents of one bucket in BUCKETS are ever sorted.

Defined results: a null text has size 0; sizes of 0 take 0. A null source is a source of its own, the last; a document's
sources are a set, and one without any is not taken. More than MAX_PATTERNS patterns raise ValueError. Rows
that share an id are placed alike; the last document taken of a pattern may be cut (split_last), so that
the quota is met to the word. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, n_words, text_of

#: Buckets of the seeded order.
BUCKETS = 1 << 12
#: Patterns that may come to the driver; more raise ValueError.
MAX_PATTERNS = 4096
MAX_REPEATS = 3


def targets(sizes: dict, total: float, weights: tuple[float, ...] = (1, 2, 3), cap: float = MAX_REPEATS) -> dict:
    """Words wanted of each source: shares of total by weight, none above cap times its size.

    sizes: source -> words. Sources by code point, null last, get the weights in turn. What a capped source can't
    take is shared among the others by weight, until none is above its cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free = {}, list(order)
    while free:
        each = max(0.0, total - sum(out.values())) / sum(weight[s] for s in free)
        over = [s for s in free if each * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: each * weight[s] for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int = MAX_REPEATS) -> dict:
    """Words of each (pattern, source) in a maximum flow of least cost.

    capacity: pattern -> words of one round; members: pattern -> its sources; quota: source -> words.
    Costs stand on the arcs of the rounds only and rise from round to round, so shortest augmenting paths use all that
    round 1 can give before round 2 opens; within a round every path costs the same, and breadth-first search finds it.
    """
    flow = {(p, s): 0 for p in members for s in members[p]}
    holders: dict = {}
    for p, s in flow:
        holders.setdefault(s, []).append(p)
    room = dict(quota)
    for _ in range(repeats):
        left = dict(capacity)
        while True:
            came: dict = {("p", p): None for p in left if left[p] > 0}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = at = queue.popleft()
                if kind == "s" and room[x] > 0:
                    end = at
                    break
                steps = [("s", s) for s in members[x]] if kind == "p" else [("p", p) for p in holders[x] if flow[p, x] > 0]
                for step in steps:
                    if step not in came:
                        came[step] = at
                        queue.append(step)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            arcs = list(zip(path, path[1:]))
            amount = min(left[path[0][1]], room[end[1]], *(flow[b[1], a[1]] for a, b in arcs if a[0] == "s"))
            for a, b in arcs:
                if a[0] == "p":
                    flow[a[1], b[1]] += amount
                else:
                    flow[b[1], a[1]] -= amount
            left[path[0][1]] -= amount
            room[end[1]] -= amount
    return flow


@dataclass(frozen=True)
class Plan:
    """targets and sizes by source; rounds: pattern -> (whole rounds, words of the rest)."""

    targets: dict
    sizes: dict
    rounds: dict


def sized(docs: DataFrame, sources: Column, text: str = "text") -> DataFrame:
    """(doc_id, size, sources array, place): what the mix needs of a document. place: its seeded hash."""
    members = F.array_sort(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    return docs.select("doc_id", n_words(text_of(docs, text)).alias("size"), members.alias("sources"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> Plan:
    """The mix of rows(size, sources)."""
    found = rows.groupBy("sources").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r["sources"]): r["words"] for r in found}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes, sum(capacity.values()), weights, cap)
    flow = min_cost_flow(capacity, {p: p for p in capacity}, {s: round(t) for s, t in want.items()}, cap)
    rounds = {}
    for p, n in capacity.items():
        used = sum(flow[p, s] for s in p)
        rounds[p] = divmod(used, n) if n else (0, 0)
    return Plan(want, sizes, rounds)


def take(rows: DataFrame, mix: Plan, seed: int = 20, split_last: bool = True) -> DataFrame:
    """rows(doc_id, size, sources) with taken, the words that the mix takes; repeats count."""
    spark, schema = rows.sparkSession, "sources array<string>, whole long, rest long"
    rounds = F.broadcast(spark.createDataFrame([(list(p), a, b) for p, (a, b) in mix.rounds.items()], schema))
    placed = rows.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    placed = placed.withColumn("_b", F.shiftrightunsigned("_h", 64 - (BUCKETS.bit_length() - 1)))
    same = F.col("r.sources").eqNullSafe(F.col("d.sources"))
    joined = placed.alias("d").join(rounds.alias("r"), same).select("d.*", "whole", "rest")
    totals = joined.where("rest > 0").groupBy("sources", "_b", "rest").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sources").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ends = totals.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rest and rest < before + n").select("sources", "_b", "before")
    ends = F.broadcast(spark.createDataFrame(ends.collect(), "sources array<string>, end long, before long"))  # at most one a pattern
    # without an end, the rest takes nothing (rest 0)
    at_end = joined.alias("d").join(ends.alias("r"), same, "left").select("d.*", "end", "before")
    order = Window.partitionBy("sources").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = F.least(F.greatest(extra, F.lit(0)), F.col("size"))
    if not split_last:
        last = F.when(2 * last >= F.col("size"), F.col("size")).otherwise(0)
    inside = at_end.where("_b = end").withColumn("_extra", last.cast("long"))
    outside = at_end.where("end is null or _b <> end").withColumn("_extra", F.when(F.col("_b") < F.col("end"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    out = inside.unionByName(outside)
    return out.withColumn("taken", (F.col("whole") * F.col("size") + F.col("_extra")).cast("long")).select("doc_id", "size", "sources", "taken", "whole", "_extra")


def mix(docs: DataFrame, sources: Column, text: str = "text", weights: tuple[float, ...] = (1, 2, 3), cap: int = MAX_REPEATS, seed: int = 20) -> tuple[DataFrame, Plan]:
    """(doc_id, size, sources, taken, ...) of every row, and the plan behind it."""
    rows = cut(sized(docs, sources, text))
    found = plan(rows, weights, cap)
    return take(rows, found, seed), found


def apply(docs: DataFrame, sources: Column, text: str = "text", weights: tuple[float, ...] = (1, 2, 3), cap: int = MAX_REPEATS, seed: int = 20) -> DataFrame:
    """docs, each row as often as the mix takes its document, whole documents only. Rows of one id are taken alike."""
    rows = cut(sized(docs, sources, text))
    taken = take(rows, plan(rows, weights, cap), seed, split_last=False)
    copies = (F.col("whole") + (F.col("_extra") > 0).cast("long")).cast("int")
    often = taken.groupBy(F.col("doc_id").alias("_id")).agg(F.max(copies).alias("_n")).where("_n > 0")
    out = docs.join(often, docs["doc_id"].eqNullSafe(often["_id"]))
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), often["_n"])).alias("_copy_in_mix")).drop("_copy_in_mix")
