"""Near-dedup by the Jaccard similarity of word shingles: SimHash groups and min-hash bands find candidates, exact comparison decides.

A text is the set of its shingles of SHINGLE words. Two texts are linked if intersection / union of their sets is at
least SIMILAR; components of links are the groups. Equal sets are one node before any of this.

Each text of a SimHash group (simhash.grouped: four words, four bits) is a candidate of the group's first text. Further ones, since
texts of that similarity are often further apart than four bits, share one of BANDS keys, each made of ROWS min-hashes: a pair of similarity 0.8 is missed with a chance of
(1 - 0.8^7)^36 = 0.0002, a more similar one with less. Each node is first compared with the nearest, by sketch, of the first nodes of its
buckets; then with the nearest of ASKED nodes of each of its buckets' largest components, if it is not in these itself; at
last with all nodes of its buckets that are not yet in the same component. So a large group of near copies
needs few comparisons and no pair is left out whose link could join two components. Left out are pairs that
  - cannot reach SIMILAR, since their sizes without the shingles that no other set in question has do not allow it (exact), or
  - have sketches, PLANES bits of each min-hash, that differ in over MAX_APART min-hashes: at a similarity of 0.8 that has a chance of 0.00006.

Defined results: a null or wordless text has the empty set, and such texts are equal; a text of under SHINGLE words is one
shingle. Rows of null doc_id are not compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.common import cut, map_texts, scratch, spread_join
from tesserae.llm.components import across, few, roots

SHINGLE, SEED = 5, 42
#: Pairs of one set that are compared in one task.
DEALT = 1000
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 36, 7
PLANES, MAX_APART = 4, 72
#: Words of 64 bits of a plane.
WIDE = -(-BANDS * ROWS // 64)
ASKED = 4
#: Shingles that are min-hashed at once.
BLOCK = 1024
_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACE = np.arange(BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted."""
    import xxhash

    w = text.encode("utf-8", "replace").lower().split()  # words as in simhash
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, SEED) for x in w), np.uint64, len(w))
    k, n = min(size, len(w)), max(0, len(w) - size) + 1
    out = np.full(n if k else 0, k, np.uint64)
    for j in range(k):
        out = _mixed(out + h[j : j + n])
    return np.unique(out)


def min_hashes(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes of a set of hashes."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(s), BLOCK):
        np.minimum(least, ((s[k : k + BLOCK] ^ _XOR) * _ODD).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS keys of a set's min-hashes."""
    key = _PLACE
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key + column)
    return key


def sketch(least: np.ndarray) -> np.ndarray:
    """PLANES bits of each min-hash: WIDE words of the lowest bits, then of the next, and so on."""
    bits = np.zeros((PLANES, WIDE * 64), np.uint8)
    bits[:, : len(least)] = (_mixed(least) >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits, axis=1).reshape(-1).view(np.int64)


def _id(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, id, fp, bands) of every row; id: hash of the set; fp: SimHash fingerprint."""

    def columns_of(texts: list[str]) -> list[list]:
        sets = [shingles(t) for t in texts]
        fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return [np.array([_id(s) for s in sets], np.uint64).view(np.int64), fps, [band_keys(min_hashes(s)).view(np.int64) for s in sets]]

    return map_texts(docs, text, {"id": "long", "fp": "long", "bands": "array<long>"}, lambda: columns_of)


def sets_of(docs: DataFrame, asked: DataFrame, text: str = "text") -> DataFrame:
    """(id, grams, bands, size, b0, b1, ...) of asked(id, doc_id), made anew from the texts: the sets of all documents are larger than these."""

    def columns_of(texts: list[str]) -> list[list]:
        sets = [shingles(t) for t in texts]
        least = [min_hashes(s) for s in sets]
        ids = np.array([_id(s) for s in sets], np.uint64).view(np.int64)
        return [ids, [s.view(np.int64) for s in sets], [band_keys(x).view(np.int64) for x in least], [sketch(x) for x in least]]

    texts = docs.select("doc_id", text).join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    made = map_texts(texts, text, {"id": "long", "grams": "array<long>", "bands": "array<long>", "bits": "array<long>"}, lambda: columns_of)
    # rows that share a doc_id can differ in their texts, and equal ones are one set
    rows = made.join(asked, ["id", "doc_id"]).dropDuplicates(["id"])
    return rows.select("id", "grams", "bands", F.size("grams").cast("long").alias("size"), *(F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(PLANES * WIDE)))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(u, v) whose sets have a Jaccard similarity of SIMILAR at least; sets: as of sets_of.

    v may be the end of many pairs: these are dealt out by DEALT, and v's set goes to each part, so that it is never written once a pair.
    """
    counts = cut(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    tasks = F.ceil(F.col("n") / DEALT).cast("int")
    over, under = SIMILAR
    of = lambda c: sets.select(F.col("id").alias(c), F.col("grams").alias(f"_{c}"))
    total = pairs.count()
    dealt = few(spread_join(pairs, counts, "v", total), total).select("u", "v", F.pmod(F.xxhash64("u"), tasks).cast("int").alias("_part"))
    ends = of("v").join(counts, "v").select("v", "_v", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("_part"))
    both = dealt.join(of("u"), "u").join(ends, ["v", "_part"])
    total, common = F.size("_u") + F.size("_v"), F.size(F.array_intersect("_u", "_v"))
    # |A and B| / |A or B| >= over / under, in whole numbers
    return both.where((over + under) * common.cast("long") >= over * total.cast("long")).select("u", "v").distinct()


def _apart(u: str, v: str) -> str:
    """Number of min-hashes in which two sketches differ; u, v: what their columns' names begin with."""
    word = lambda k: " | ".join(f"({u}b{p * WIDE + k} ^ {v}b{p * WIDE + k})" for p in range(PLANES))
    return " + ".join(f"bit_count({word(k)})" for k in range(WIDE))


def _possible(u: str, v: str) -> str:
    """Whether two sets can be similar: own is the number of a set's shingles that no other one has, so none of them is shared."""
    over, under = SIMILAR
    shared = f"least({u}size - {u}own, {v}size - {v}own)"
    return f"{over + under} * {shared} >= {over} * ({u}size + {v}size) and {_apart(u, v)} <= {MAX_APART}"


def nearest(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each u of pairs(u, v, ...), and of each value of any further columns, the possible v whose sketch is nearest; facts: sets without grams, with own."""
    end = lambda c: facts.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in facts.columns if x not in ("id", "bands")))
    possible = pairs.distinct().join(end("u"), "u").join(end("v"), "v").where(_possible("u_", "v_"))
    by = [c for c in pairs.columns if c != "v"]
    return possible.groupBy(by).agg(F.min_by("v", F.struct(F.expr(_apart("u_", "v_")), "v")).alias("v")).select("u", "v")


def by_main(of: DataFrame, total: int) -> DataFrame:
    """(u, v): the nodes of buckets of several components, with ASKED nodes of their bucket's largest component; of(key, id, root)."""
    sizes = of.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n")).where("parts > 1")
    main = cut(few(main, total))
    inside = cut(few(spread_join(of, main, "key", total), total))
    # each bucket has an order of its own
    drawn = (F.min(F.struct(F.xxhash64("id", "key", F.lit(j)), "id"))["id"] for j in range(ASKED))
    chosen = inside.where("root = main").groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("vs")).join(main.select("key", "n"), "key")
    chosen = cut(few(chosen, total))  # else the next join plans all this twice
    strays = inside.where("root <> main").select("key", F.col("id").alias("u"))
    return few(spread_join(strays, chosen, "key", total), total).select("u", F.explode("vs").alias("v"))


def by_simhash(rows: DataFrame) -> DataFrame:
    """(u, v): the sets of SimHash groups of rows(doc_id, id, fp), with that of their group's smallest doc_id."""
    groups = simhash.grouped(rows.select("doc_id", "id", "fp"))
    sets = cut(groups.groupBy("id", "component_id").agg(F.min("doc_id").alias("doc_id")))
    first = sets.groupBy("component_id").agg(F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("id"))).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return spread_join(sets, first, "component_id", sets.count()).where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def links(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(u, root) of all ids of rows = marked(docs) but the roots, as in components.roots."""
    spark = rows.sparkSession
    first = rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    keyed = rows.select("id", F.explode("bands").alias("key")).distinct()
    # the key gives each bucket an order of its own, so that a large group is not compared with one node only
    chosen = cut(keyed.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = cut(few(spread_join(keyed, chosen, "key", total), total).select("key", "id", F.col("rep").bitwiseXOR(F.col("key")).alias("rep")))
    near = cut(by_simhash(rows))
    asked = shared.select("id").union(near.select("u")).union(near.select("v"))
    sets_of(docs, asked.distinct().join(first, "id"), text).write.parquet(path := scratch(spark, "sets"))
    sets = spark.read.parquet(path)
    facts = sets.drop("grams").withColumn("own", F.lit(0))
    offered = near.select("u", "v", F.lit(0).alias("by")).union(shared.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"), F.lit(1).alias("by")))
    tried = few(cut(nearest(offered, facts).distinct()), total)
    found = roots(similar(tried, sets))
    ids = shared.select("key", "id")
    now = lambda: cut(few(ids.join(found.withColumnRenamed("u", "id"), "id", "left"), total).select("key", "id", F.coalesce("root", "id").alias("root")))

    of = now()
    unlike = of.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    in_question = cut(few(of.join(unlike, "key", "left_semi").select("id").distinct(), total))
    grams = sets.select("id", "grams").join(in_question, "id", "left_semi").select("id", F.explode("grams").alias("h"))
    alone = grams.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    facts = cut(few(sets.drop("grams").join(in_question, "id", "left_semi").join(alone, "id", "left"), total).fillna(0, ["own"]))
    more = few(cut(nearest(by_main(of, total), facts).join(tried, ["u", "v"], "left_anti")), total)
    tried = tried.unionByName(more)
    found = roots(found.select("u", F.col("root").alias("v")).union(similar(more, sets)))
    # a pair comes from the least of the keys that it shares
    once = F.col("key") == F.array_min(F.array_intersect("u_bands", "v_bands"))
    pairs = across(now(), facts).where(F.expr(_possible("u_", "v_"))).where(once).select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()
    done = tried.unionByName(tried.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pairs = cut(pairs.join(done, ["u", "v"], "left_anti"))
    return roots(found.select("u", F.col("root").alias("v")).union(similar(pairs, sets)))


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id; of rows that share this id, one.

    Rows of null doc_id stay: nothing names them, so no group can keep one of them.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "bands")
    named = docs.where(F.col("doc_id").isNotNull())
    marked(named, text).write.parquet(path)
    rows = spark.read.parquet(path)
    nodes = rows.groupBy("id").agg(F.min("doc_id").alias("first")).join(links(rows, named, text).withColumnRenamed("u", "id"), "id", "left")
    kept = cut(nodes.groupBy(F.coalesce("root", "id")).agg(F.min("first").alias("doc_id")).select("doc_id").distinct())
    return named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
