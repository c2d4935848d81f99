"""Sharding by a minimax contiguous partition of atomic groups.

Documents of equal text form a group, groups are ordered by the text's MD5, and shards are runs of that order. The
smallest feasible capacity of a shard is found by binary search, with a greedy check of each candidate; the cuts are the
greedy ones at that capacity.

The driver never sees all groups. It holds the bytes of key prefixes; where a prefix' inner order could still change a
check, or it is heavy, it is split into longer prefixes, until the checks at lower and upper bounds agree. Every round fetches a
bounded number of rows. Slots are ranks by prefix, then by cells of (group, salt of the id), so a group of copies that
holds a third of the rows is numbered by many tasks.

Defined results: a null text is an empty text, of size 1. Rows of one id are numbered one by one. With fewer groups than
shards some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, text_of

#: Hexadecimal digits of the first prefixes, and by which they grow.
FIRST_DIGITS, MORE_DIGITS, KEY_DIGITS = 4, 2, 32
#: A prefix of more than this share of the bytes is split before any search.
HEAVY = 1 / 4096
SALTS = 256


@dataclass(frozen=True)
class Unit:
    """All groups of one key prefix."""

    prefix: str
    bytes: int
    groups: int


class Partition:
    """Bounds and cuts of a partition of ordered units into shards."""

    def __init__(self, units: list[Unit], shards: int) -> None:
        self.units, self.shards = sorted(units, key=lambda u: u.prefix), shards
        self.at = [0]
        for u in self.units:
            self.at.append(self.at[-1] + u.bytes)
        self.total = self.at[-1]

    def _ends(self, capacity: int, hopeful: bool) -> list[int]:
        """Greedy ends of the shards: as if every unit could be cut anywhere (hopeful), or only at its ends unless it is one group."""
        ends = [0]
        for _ in range(self.shards):
            reach = ends[-1] + capacity
            k = bisect_right(self.at, reach) - 1
            at = self.at[k]
            if hopeful and k < len(self.units) and self.units[k].groups > 1:
                at = reach
            ends.append(max(at, ends[-1]))
        return ends[1:]

    def _least(self, hopeful: bool) -> int:
        low, high = -(-self.total // self.shards), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            if self._ends(mid, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return high

    def unsure(self) -> list[Unit]:
        """Units to split before the capacity and the cuts are exact; none if they are."""
        low, high = self._least(True), self._least(False)
        spans = list(zip(self._ends(low, False), self._ends(high, True)))
        return [u for k, u in enumerate(self.units) if u.groups > 1 and any(a < self.at[k + 1] and self.at[k] <= b and b < self.total + 1 for a, b in spans if a < self.total)]

    def cuts(self) -> list[str]:
        """Smallest prefixes of the second and later shards."""
        ends = self._ends(self._least(False), False)
        return [self.units[bisect_right(self.at, e) - 1].prefix for e in ends[:-1] if e < self.total]


def _units(groups: DataFrame, digits: int, within: list[Unit]) -> list[Unit]:
    rows = groups
    if within:
        size = len(within[0].prefix)
        chosen = groups.sparkSession.createDataFrame([(u.prefix,) for u in within], "_p string")
        rows = groups.join(F.broadcast(chosen), F.substring("key", 1, size) == F.col("_p"))
    found = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    return [Unit(r["p"], r["b"], r["n"]) for r in found.collect()]


def boundaries(groups: DataFrame, shards: int) -> list[str]:
    """Key prefixes where the shards after the first begin, for groups(key, bytes)."""
    units = {u.prefix: u for u in _units(groups, FIRST_DIGITS, [])}
    total = sum(u.bytes for u in units.values())
    while True:
        many = [u for u in units.values() if u.groups > 1]
        split = [u for u in many if u.bytes > total * HEAVY] or Partition(list(units.values()), shards).unsure()
        if not split:
            return Partition(list(units.values()), shards).cuts()
        size = min(len(u.prefix) for u in split)
        split = [u for u in split if len(u.prefix) == size]
        for u in split:
            del units[u.prefix]
        units |= {u.prefix: u for u in _units(groups, min(KEY_DIGITS, size + MORE_DIGITS), split)}


def shard_of(key: Column, cuts: list[str]) -> Column:
    return sum((key >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)


def assign(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in every shard) of each row."""
    t = text_of(docs, text)
    rows = cut(docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.md5(F.encode(t, "UTF-8")).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    placed = rows.withColumn("shard", shard_of(F.col("key"), boundaries(groups, shards)).cast("int"))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    prefix = F.substring("key", 1, 3)
    cells = placed.groupBy("shard", "key", "_salt").agg(F.count(F.lit(1)).alias("n")).withColumn("_p", prefix)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = cells.groupBy("shard", "_p").agg(F.sum("n").alias("n"))  # at most 4096 prefixes, and one more a cut
    runs = runs.select("shard", "_p", F.coalesce(F.sum("n").over(before("shard").orderBy("_p")), F.lit(0)).alias("_run"))
    inside = F.coalesce(F.sum("n").over(before("shard", "_p").orderBy("key", "_salt")), F.lit(0))
    cells = cells.withColumn("_in", inside).join(F.broadcast(runs), ["shard", "_p"]).select("key", "_salt", (F.col("_run") + F.col("_in")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("key", "_salt").orderBy("doc_id"))
    out = placed.withColumn("_k", rank).join(cells, ["key", "_salt"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_k") - 1).cast("long").alias("slot"), "key")
