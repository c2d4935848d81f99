"""Hard negatives of labelled vectors by a dual-tree search.

A tree of median cuts along principal directions is fitted on a sample (at most SAMPLE rows, by hash) and every row is put
into one of its leaves. Its upper levels are the anchors' tree, the whole the candidates'; a node's centre is the mean of its
sample, its radius the largest distance of any of its rows, anchors and candidates apart. Leaves are packed in blocks of
about BLOCK candidates or ANCHORS anchors; a larger leaf has several, dealt by a hash of the id.

Inner products of two nodes lie in centre * centre +- (r |c'| + r' |c| + r r'). First each anchor leaf is scored with the candidates of
its own part of the tree, which gives each anchor scores to beat; then the trees are walked together from their roots, and a pair of nodes
whose interval holds nothing that any anchor of the node still needs is dropped with all below it. Blocks of the remaining
leaf pairs are joined and scored exactly. The result does not depend on tree, sample or block sizes.

Of rows with equal label and vector only the first by id can be among the best of anything, so others are no candidates.

Defined results: rows with a null id, label or vector, or any null or non-finite component, take no part; rows that share an id are one
row, the first by label and vector; missing components of shorter vectors are zeros. Inner products that could exceed 64
bits raise an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, hashed_sample, scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LEAST and at most MOST hundredths of the positive's.
LEAST, MOST = 50, 95
SAMPLE, MAX_DEPTH, BLOCK, ANCHORS = 8192, 10, 1024, 256
#: Largest whole number up to which doubles are exact.
EXACT = 1 << 53
NO_LIMIT = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Nodes in heap order: directions and cuts of the inner ones, centres of all."""

    depth: int
    directions: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> Tree:
        inner, n = (1 << depth) - 1, sample.shape[1]
        tree = Tree(depth, np.zeros((inner, n)), np.zeros(inner), np.zeros((2 * inner + 1, n)))
        parts = {0: sample}
        for k in range(2 * inner + 1):
            part = parts.pop(k)
            tree.centres[k] = part.mean(0) if len(part) else tree.centres[(k - 1) // 2]
            if k < inner:
                if len(part) > 1:
                    tree.directions[k] = np.linalg.eigh(np.cov(part, rowvar=False).reshape(n, n))[1][:, -1]
                    tree.cuts[k] = np.median(part @ tree.directions[k])
                right = part @ tree.directions[k] > tree.cuts[k]
                parts[2 * k + 1], parts[2 * k + 2] = part[~right], part[right]
        return tree

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", rows, self.directions[at]) > self.cuts[at])
        return at - ((1 << self.depth) - 1)


def prepared(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, q) of the rows that take part, q their components as whole numbers."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    found = found.select(F.col(id).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("q")).alias("r"))
    return found.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")


def matrix(q: pa.Array, n: int, kind=np.float64) -> np.ndarray:
    """Vectors as rows of n numbers, filled up with zeros."""
    size = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(q), n), kind)
    flat = q.flatten().to_numpy()
    if (size == n).all():
        return flat.reshape(len(q), n).astype(kind)
    row = np.repeat(np.arange(len(q)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


@dataclass
class Blocks:
    """Packed leaves: a table of blocks (block, leaf, ids, labels, vectors, far), the tree's depth here, and the radius of each node."""

    table: DataFrame
    depth: int
    radii: np.ndarray
    rows: DataFrame = field(repr=False)


def packed(rows: DataFrame, tree: Tree, depth: int, size: int, kind: str) -> Blocks:
    """Blocks of rows(id, label, q, leaf), whose leaves are those of depth; kind: the numbers' type."""
    spark, n, down = rows.sparkSession, tree.centres.shape[1], tree.depth - depth
    rows = rows.withColumn("leaf", F.shiftright("leaf", down))
    counts = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).alias("_chunks"))  # a row a leaf
    dealt = rows.join(F.broadcast(counts), "leaf").withColumn("block", F.col("leaf") + F.pmod(F.xxhash64("id"), F.col("_chunks")) * (1 << MAX_DEPTH)).drop("_chunks")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = matrix(t["q"].combine_chunks(), n)
        leaf = t["leaf"][0].as_py()
        over = [(1 << k) - 1 + (leaf >> (depth - k)) for k in range(depth + 1)]
        far = [float(np.sqrt(((x - tree.centres[k]) ** 2).sum(1).max())) for k in over]
        whole = matrix(t["q"].combine_chunks(), n, kind).tobytes()
        return pa.table({"block": t["block"][:1], "leaf": [leaf], "ids": [t["id"].to_numpy().astype("<i8").tobytes()], "labels": [t["label"].to_numpy().astype("<i8").tobytes()], "vectors": [whole], "far": [far]})

    made = dealt.groupBy("block").applyInArrow(pack, "block long, leaf long, ids binary, labels binary, vectors binary, far array<double>")
    made.write.parquet(path := scratch(spark, "blocks"))
    table = spark.read.parquet(path)
    radii = np.full((1 << (depth + 1)) - 1, -1.0)  # no rows
    nodes = table.select("leaf", F.posexplode("far").alias("level", "far")).groupBy("level", F.expr(f"shiftright(leaf, {depth} - level)").alias("place")).agg(F.max("far").alias("far"))
    for r in nodes.collect():  # fewer than 2 ** (MAX_DEPTH + 1)
        radii[(1 << r.level) - 1 + r.place] = r.far
    return Blocks(table, depth, radii, dealt.select("id", "block"))


def walk(tree: Tree, a: Blocks, b: Blocks, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs of leaves (anchors', candidates') that may hold a score of least to most, which are given by the anchors' nodes."""
    size = np.linalg.norm(tree.centres, axis=1)
    pairs = np.zeros((1, 2), np.int64)
    for level in range(b.depth + 1):
        i, j = pairs.T
        middle = np.einsum("ij,ij->i", tree.centres[i], tree.centres[j])
        wide = (a.radii[i] * size[j] + b.radii[j] * size[i] + a.radii[i] * b.radii[j]) * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
        pairs = pairs[(a.radii[i] >= 0) & (b.radii[j] >= 0) & (middle + wide >= least[i]) & (middle - wide <= most[i])]
        if level < b.depth:
            i, j = pairs.T
            sides = [i] if level >= a.depth else [2 * i + 1, 2 * i + 2]
            pairs = np.concatenate([np.stack([x, y], 1) for x in sides for y in (2 * j + 1, 2 * j + 2)])
    return pairs - [(1 << a.depth) - 1, (1 << b.depth) - 1]


def upwards(values: np.ndarray, depth: int, of) -> np.ndarray:
    """Values of all nodes from those of the leaves."""
    out = np.zeros((1 << (depth + 1)) - 1)
    out[(1 << depth) - 1 :] = values
    for k in range((1 << depth) - 2, -1, -1):
        out[k] = of(out[2 * k + 1], out[2 * k + 2])
    return out


def _scores(row: dict, kind: str, exact: bool) -> tuple[np.ndarray, ...]:
    """Ids of the block's anchors and candidates, whether labels differ, and all scores."""
    ids, labels = (np.frombuffer(row[c], "<i8") for c in ("a_ids", "a_labels"))
    other, others = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
    number = np.float64 if exact else np.int64
    x, y = (np.frombuffer(row[c], kind).reshape(len(k), -1).astype(number) for c, k in (("a_vectors", ids), ("vectors", other)))
    return ids, other, labels[:, None] != others, (x @ y.T).astype(np.int64)


def _joined(pairs: DataFrame, a: Blocks, b: Blocks) -> DataFrame:
    """Rows of both blocks for pairs(a_leaf, leaf) of leaves."""
    left = a.table.select(F.col("block").alias("a_block"), F.col("leaf").alias("a_leaf"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"))
    named = b.table.select("block", "leaf").join(pairs, "leaf").join(left.select("a_leaf", "a_block"), "a_leaf").select("a_block", "block")
    return named.join(left.drop("a_leaf"), "a_block").join(b.table.drop("leaf", "far"), "block")


def _rows(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _positives(rows: DataFrame, kind: str, exact: bool, keep: int) -> DataFrame:
    """(anchor_id, positive_id, score): each anchor's best of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, other, differ, s = _scores(batch.slice(k, 1).to_pylist()[0], kind, exact)
                s[differ | (ids[:, None] == other)] = NO_LIMIT
                best = np.argsort(~s, axis=1, kind="stable")[:, :keep]  # candidates are in order of id
                score = np.take_along_axis(s, best, 1)
                i, j = np.nonzero(score != NO_LIMIT)
                yield _rows([ids[i], other[best[i, j]], score[i, j]], ["anchor_id", "positive_id", "score"])

    return rows.mapInArrow(run, "anchor_id long, positive_id long, score long")


def _negatives(rows: DataFrame, kind: str, exact: bool, keep: int) -> DataFrame:
    """(anchor_id, positive_score, negative_id, score): the best below each score of rows' asks, from each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, other, differ, s = _scores(row, kind, exact)
                s[~differ] = NO_LIMIT
                order = np.argsort(~s, axis=1, kind="stable")
                ranked = np.take_along_axis(s, order, 1)
                place, out = {int(v): i for i, v in enumerate(ids)}, []
                for ask in row["asks"]:
                    anchor, p, least = ask["anchor_id"], ask["score"], ask["least"]
                    i = place[anchor]
                    first = int(np.searchsorted(~ranked[i], ~ask["most"]))
                    for j in range(first, min(first + keep, len(other))):
                        if ranked[i, j] < least:
                            break
                        out.append((anchor, p, other[order[i, j]], ranked[i, j]))
                yield _rows(list(np.array(out, np.int64).reshape(-1, 4).T), ["anchor_id", "positive_score", "negative_id", "score"])

    return rows.mapInArrow(run, "anchor_id long, positive_score long, negative_id long, score long")


def _first(found: DataFrame, by: list[str], id: str, most: int) -> DataFrame:
    """The first rows of each group by score, then id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows = prepared(...); is_anchor: a condition on id and label."""
    spark = rows.sparkSession
    rows.write.parquet(path := scratch(spark, "vectors"))
    rows = spark.read.parquet(path).withColumn("anchor", is_anchor)
    total, n_anchors, n, largest = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.max(F.array_max(F.transform("q", F.abs)))).first()
    n, largest = max(1, n), largest or 0
    if 100 * n * largest * largest >= 1 << 63:
        raise ValueError(f"components of {largest} give inner products beyond 64 bits")
    exact, kind = n * largest * largest < EXACT, "<i2" if largest < 1 << 15 else "<i8"
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, total) / BLOCK)))))
    few = min(depth, max(0, int(np.ceil(np.log2(max(1, n_anchors) / ANCHORS)))))
    sample = hashed_sample(rows, "id", SAMPLE, total).select("q").toArrow()["q"].combine_chunks() if total else None
    tree = Tree.fit(matrix(sample, n) if total else np.zeros((0, n)), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaves(matrix(b.column(2), n)), pa.int64())], ["id", "label", "q", "anchor", "leaf"])

    rows.select("id", "label", "q", "anchor").mapInArrow(place, "id long, label long, q array<long>, anchor boolean, leaf long").write.parquet(path := scratch(spark, "leaves"))
    placed = spark.read.parquet(path)
    same = Window.partitionBy("label", "q").orderBy("id")
    firsts = placed.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= max(positives, negatives) + 1).drop("_r", "anchor")
    a = packed(placed.where("anchor").drop("anchor"), tree, few, ANCHORS, kind)
    b = packed(firsts, tree, depth, BLOCK, kind)
    home = cut(a.rows)

    def search(score, need_of, most_of: np.ndarray, keep):
        """Own parts of the tree first, then what the walk leaves."""
        own = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(1 << depth)})).withColumn("a_leaf", F.shiftright("leaf", depth - few))
        found = cut(keep(score(_joined(own, a, b))))
        if depth == 0:
            return found
        need = np.full(1 << few, np.inf)
        for r in need_of(found).collect():  # a row a leaf of the anchors' tree
            need[r.leaf] = r.need
        pairs = walk(tree, a, b, upwards(need, few, min), upwards(most_of, few, max))
        pairs = pairs[pairs[:, 0] != pairs[:, 1] >> (depth - few)]
        if not len(pairs):
            return found
        rest = spark.createDataFrame(pd.DataFrame(pairs, columns=["a_leaf", "leaf"]))
        return cut(keep(found.drop("rank").unionByName(score(_joined(rest, a, b)))))

    leaf_of = home.select(F.col("id").alias("anchor_id"), (F.col("block") % (1 << MAX_DEPTH)).alias("leaf"), "block")
    low = F.lit(float("-inf"))

    def fifth(found: DataFrame) -> DataFrame:
        worst = found.groupBy("anchor_id").agg(F.max("rank").alias("n"), F.min("score").alias("s"))
        need = F.when(F.col("n") == positives, F.col("s").cast("double")).otherwise(low)
        return leaf_of.join(worst, "anchor_id", "left").groupBy("leaf").agg(F.min(F.coalesce(need, low)).alias("need"))

    best = search(lambda r: _positives(r, kind, exact, positives), fifth, np.full(1 << few, np.inf), lambda f: _first(f.select("anchor_id", "positive_id", "score"), ["anchor_id"], "positive_id", positives))
    # below zero LEAST hundredths are more than MOST
    asked = best.where("score >= 0").select("anchor_id", "score", F.expr(f"({LEAST} * score + 99) div 100").alias("least"), F.expr(f"{MOST} * score div 100").alias("most")).distinct()
    asked = cut(asked.join(leaf_of, "anchor_id"))
    asks = asked.groupBy(F.col("block").alias("a_block")).agg(F.collect_list(F.struct("anchor_id", "score", "least", "most")).alias("asks"))  # ANCHORS * positives, about
    most_of = np.full(1 << few, -np.inf)
    for r in asked.groupBy("leaf").agg(F.max("most").alias("most")).collect():
        most_of[r.leaf] = r.most

    def third(found: DataFrame) -> DataFrame:
        worst = found.groupBy("anchor_id", "positive_score").agg(F.max("rank").alias("n"), F.min("score").alias("s")).withColumnRenamed("positive_score", "score")
        need = F.when(F.col("n") == negatives, F.col("s")).otherwise(F.col("least")).cast("double")
        return asked.join(worst, ["anchor_id", "score"], "left").groupBy("leaf").agg(F.min(need).alias("need"))

    found = search(lambda r: _negatives(r.join(asks, "a_block"), kind, exact, negatives), third, most_of, lambda f: _first(f.select("anchor_id", "positive_score", "negative_id", "score"), ["anchor_id", "positive_score"], "negative_id", negatives))
    named = best.select("anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return named.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
