"""SimHash near-dedup with Golay-code keys.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 values of the text's shingles of
four words. Fingerprints that differ in at most four bits are linked; components of links are the groups.

Candidates: the bits are cut into three segments of 22, 21 and 21. Of four wrong bits, sorted by segment, either
one segment has none, or two segments have exactly one each. For the first case there is a key of each whole
segment. For the second there is a key for each pair of segments, made of two indices of Golay codewords: one
wrong bit turns a segment's parity, so the even word gives the index of its nearest codeword and the odd word
those of all codewords within four bits (one or six), and only even meets odd. So every link is found,
with about one candidate for 800,000 pairs of unrelated fingerprints: 10^9 distinct fingerprints give 6 * 10^11 candidates, each
one exclusive-or in a join, which is what this is planned for. Exact copies are one fingerprint before any of this.

Defined results: a null or wordless text has fingerprint zero, and is linked as any other; a text of under four
words is one shingle. A row with null doc_id gets its group's component, and a group with null ids only gets
null. Repeated rows share a group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import HOT_SHARE, LEAST_HOT, cut, map_texts, spread_join
from tesserae.llm.components import BLOCK, roots
from tesserae.llm.golay import Golay

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Shingles whose bits are counted at once.
GRAMS = 1 << 16


golay_tables = functools.cache(Golay)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    w = text.encode("utf-8", "replace").lower().split()  # on bytes: A-Z, and the six ASCII separators
    if not w:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    grams = map(b" ".join, zip(*(w[k:] for k in range(size)))) if len(w) >= size else [b" ".join(w)]
    n = max(1, len(w) - size + 1)
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, GRAMS):
        ones += np.unpackbits(h[k : k + GRAMS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp: the fingerprint as a signed long."""

    of = lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]
    return map_texts(docs, text, {"fp": "long"}, lambda: of)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, keys and sides of fingerprints (unsigned). Of a pair's key, side 0 meets side 1; rows of a segment's key, side 2, meet each other."""
    g = golay_tables()
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    odd = [np.bitwise_count(s) & 1 for s in seg]
    nearest = [g.nearest(s) for s in seg]
    near = [g.near(s) for s in seg]
    every = np.arange(len(fp))
    out = [(every, np.int64(t) << 56 | s.astype(np.int64), np.full(len(fp), 2)) for t, s in enumerate(seg)]
    none = np.full((len(fp), 5), -1, np.int64)
    both = [np.where(o[:, None] == 1, m, np.hstack([n[:, None], none])) for o, m, n in zip(odd, near, nearest)]
    for t, (a, b) in enumerate(PAIRS):
        tag = (np.int64(3 + t) << 56) | ((odd[a] ^ odd[b]).astype(np.int64) << 48)
        for x in range(6):
            for y in range(6):
                ka, kb = both[a][:, x], both[b][:, y]
                ok = np.flatnonzero((ka >= 0) & (kb >= 0))
                out.append((ok, tag[ok] | ka[ok] << 12 | kb[ok], odd[a][ok]))
    rows, found, sides = (np.concatenate(x) for x in zip(*out))
    return rows, found, sides.astype(np.int32)


def keyed(fps: DataFrame) -> DataFrame:
    """(id, root, key, side) of every fingerprint of fps(fp, root); id: the fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, root = b["fp"].to_numpy(np.int64), b["root"].to_numpy(np.int64)
            rows, found, sides = keys(fp.view(np.uint64))
            yield pd.DataFrame({"id": fp[rows], "root": root[rows], "key": found, "side": sides})

    return fps.select("fp", "root").mapInPandas(run, "id long, root long, key long, side int")


def linked(fps: DataFrame) -> DataFrame:
    """(u, root) of all fingerprints of fps(fp), each once there, but the roots, as in components.roots.

    In each bucket all fingerprints are compared with one of the other side first; and then those that are not linked by now
    with each other. So many near copies cost one comparison a key rather than one a pair, and no link that could join
    two groups is left out. In the second step a hot bucket, as in spread_join, is dealt out by BLOCK of its rows, and of its largest
    group no two are compared; a hot bucket of one group falls out.
    """
    rows = keyed(fps.withColumn("root", F.col("fp")))
    mixed = F.col("id").bitwiseXOR(F.col("key"))  # gives each bucket an order of its own
    chosen = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 1).alias("ones"), F.min("side").alias("least"),
        F.min(F.when(F.col("side") != 1, mixed)).alias("a"), F.min(F.when(F.col("side") == 1, mixed)).alias("b"),
    )
    chosen = cut(chosen.where("n > 1 and (least = 2 or ones between 1 and n - 1)").select("key", "n", "a", "b"))
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    close = lambda u, v: (F.bit_count(u.bitwiseXOR(v)) <= MAX_BITS) & (u != v)
    rep = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")).bitwiseXOR(F.col("key"))
    near = spread_join(rows.drop("root"), chosen, "key", total).where(close(F.col("id"), rep))
    star = roots(near.select(F.col("id").alias("u"), rep.alias("v")))

    now = cut(fps.select("fp").join(star.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    rows = keyed(now)
    hot = F.broadcast(chosen.where(F.col("n") > max(LEAST_HOT, total // HOT_SHARE)).select("key", "n"))
    sizes = rows.join(hot, "key").groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = cut(sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("groups"), F.ceil(F.sum("c") / BLOCK).cast("int").alias("tasks")))
    every = rows.join(F.broadcast(main), "key", "left").where("groups is null or groups > 1")
    cold, dealt = every.where("groups is null").withColumn("_salt", F.lit(0)), every.where("groups > 1")
    left = cold.where("side <> 1").unionByName(dealt.where("root <> main").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))))
    right = cold.where("side <> 0").unionByName(dealt.withColumn("_salt", F.pmod(F.xxhash64("id"), "tasks").cast("int")))
    u, v = left.alias("u"), right.alias("v")
    same = (F.col("u.key") == F.col("v.key")) & (F.col("u._salt") == F.col("v._salt")) & (F.col("u.root") != F.col("v.root"))
    sides = (F.col("u.side") == 2) | (F.col("u.side") != F.col("v.side"))
    once = F.when(F.col("u.main").isNull(), (F.col("u.side") == 0) | (F.col("u.id") < F.col("v.id"))).otherwise((F.col("v.root") == F.col("v.main")) | (F.col("u.id") < F.col("v.id")))
    more = u.join(v, same & sides & once & close(F.col("u.id"), F.col("v.id"))).select(F.col("u.root").alias("u"), F.col("v.root").alias("v"))
    return roots(star.select("u", F.col("root").alias("v")).union(more))


def grouped(marked: DataFrame) -> DataFrame:
    """Rows of marked(doc_id, fp, ...) with component_id, the smallest doc_id of their group."""
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    total = marked.count()
    of = cut(fps.join(linked(fps).withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    group = cut(spread_join(of, least, "root", total, "m").select("fp", "component_id", "n"))  # else the next join plans all this twice
    return spread_join(marked, group, "fp", total).select(*marked.columns, "component_id")


def components(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its group)."""
    return grouped(cut(fingerprints(docs, text))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id; of rows that share this id, one.

    Rows of null doc_id stay: nothing names them, so no group can keep one of them.
    """
    marked = components(docs, text)
    kept = marked.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # the join and the choice of one row are both by doc_id, so texts move once
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
