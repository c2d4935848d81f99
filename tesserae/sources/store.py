"""A store of memories in versions: a batch writes only its new rows and the ones it touches, and one rename makes the new version.

Below the root, data/<number>-<write>/ holds the parts of one write, and versions/<number>.json a manifest that names the folders of each part,
of memories by scope type and a hash of scope and content, of idempotency keys by a hash of the key. A write puts its parts into a folder of its own, then
renames its manifest to the next number; where that number is taken, another writer was first, and the batch is merged anew with
that version. So readers keep the version they opened, and a writer that dies leaves a folder that no manifest names.
A row that is written anew is stale in older folders: its id and the number of the write are noted, and readers leave it out there. A part
of more than GENERATIONS folders, or with many stale rows, is written whole.
The manifest also holds the last batch of each named stream, so a batch that is sent again changes nothing.

An index of terms (operators.postings) moves with the versions: a write adds a generation with its new rows' postings and the ids of rows
that it deleted; more than GENERATIONS are merged to one, without what is gone. So a search sees the rows of its version and no others.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import query_terms
from tesserae.operators import ingest, lexical, merge, postings, search
from tesserae.plans.lineage import kept
from tesserae.plans.scope import Scope, active, in_scope

MEMORIES = (
    "id string, scope_type string, scope_id string, content string, content_hash string, canonical_key string, tags array<string>, importance double, captured boolean, source_agent string, "
    "created_at timestamp, updated_at timestamp, expires_at timestamp, deleted_at timestamp, seq bigint, metadata map<string,string>"
)
KEYS = "key string, memory_id string, seq long"
BUCKETS, TRIES, GENERATIONS = 16, 5, 8
#: Rows of a part that one task writes, about.
ROWS = 25_000
STALE = "id string, part string, at long"
#: The number of the write that made a file.
WRITE = r".*/data/([0-9]+)-[0-9a-f]+/"
#: Rows of the index that are looked up at once for one that is in sight and not expired.
FETCHED = 4


class Conflict(Exception):
    """Another writer made the version first."""


def _part_of_memory(buckets: int, scope: Column | None = None) -> Column:
    scope = F.coalesce("scope_id", F.lit("")) if scope is None else scope
    return F.concat("scope_type", F.lit("-"), F.pmod(F.xxhash64(scope, "content_hash"), F.lit(buckets)).cast("string"))


def _part_of_key(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string")


@dataclass(frozen=True)
class Snapshot:
    """One version: parts maps a table's parts to their folders, batches a stream's name to its last batch; top: writes so far get a smaller seq."""

    version: int
    buckets: int
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    #: Folders of STALE rows, how many of them hold for each part, and how many are listed.
    stale: list[str] = field(default_factory=list)
    n_stale: dict[str, int] = field(default_factory=dict)
    n_listed: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    outcome: str | None = None
    top: int = 0
    #: Folders of the index's generations by bucket, of what rows its numbers stand for by range of number, and of the ids that are gone; numbers of indexed rows, of their tokens, and of ids that are gone.
    terms: list[dict[str, str]] = field(default_factory=list)
    numbers: list[dict[str, str]] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    n_rows: int = 0
    n_tokens: int = 0
    n_gone: int = 0
    #: Folders of (id, at): when rows were shown.
    accessed: list[str] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    # --- versions ---

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/versions")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest by default; 0 is the empty store."""
        known = self.versions()
        at = version if version is not None else (known[-1] if known else 0)
        if at == 0:
            return Snapshot(0, self.buckets)
        stream = self._fs.open(self._path(self._manifest(at)))
        try:
            return Snapshot(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _manifest(self, version: int) -> str:
        return f"{self.root}/versions/{version:020d}.json"

    def commit(self, made: Snapshot) -> Snapshot:
        """Puts a version in place, or raises Conflict if its number is taken."""
        draft = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(made.__dict__).encode()))
        stream.close()
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # fails if the target exists
        try:
            self._context.rename(draft, self._path(self._manifest(made.version)), options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(made.version) from None
            raise
        return made

    # --- reading ---

    def _read(self, snapshot: Snapshot, table: str, schema: str, parts: Iterable[str] | None = None) -> DataFrame:
        known = snapshot.parts.get(table, {})
        paths = [f for p in (known if parts is None else sorted(set(parts) & known.keys())) for f in known[p]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        if table != "memories" or not snapshot.stale:
            return rows
        stale = self.spark.read.schema(STALE).parquet(*snapshot.stale).select(F.col("id").alias("_old"), F.col("at").alias("_later"))  # ingest.MOST_BROADCAST at most
        made = F.regexp_extract(F.col("_metadata.file_path"), WRITE, 1).cast("long")
        return rows.withColumn("_made", made).join(F.broadcast(stale), (F.col("id") == F.col("_old")) & (F.col("_made") < F.col("_later")), "left_anti").drop("_made")

    def memories(self, snapshot: Snapshot | None = None, scopes: list[Scope] | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """Rows of a version, deleted ones too; with scopes, only parts of their types are opened."""
        snapshot = snapshot or self.snapshot()
        if scopes is None:
            return self._read(snapshot, "memories", MEMORIES, parts)
        types = {s.type for s in scopes}
        return self._read(snapshot, "memories", MEMORIES, [p for p in snapshot.parts.get("memories", {}) if p.rsplit("-", 1)[0] in types]).where(in_scope(scopes))

    def keys(self, snapshot: Snapshot | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        return self._read(snapshot or self.snapshot(), "keys", KEYS, parts)

    def outcome(self, snapshot: Snapshot) -> DataFrame:
        """What became of each write of the batch that made this version."""
        return self.spark.read.parquet(snapshot.outcome)

    def accessed(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(id, last_accessed_at) of the rows that were ever shown."""
        paths = (snapshot or self.snapshot()).accessed
        rows = self.spark.read.schema("id string, at timestamp").parquet(*paths) if paths else self.spark.createDataFrame([], "id string, at timestamp")
        return rows.groupBy("id").agg(F.max("at").alias("last_accessed_at"))

    # --- searching ---

    def scored(self, query: str, snapshot: Snapshot | None = None) -> DataFrame:
        """(id, scope_type, scope_id, bm25) of all rows of a version, expired ones too, that hold a term of the query."""
        snapshot = snapshot or self.snapshot()
        tokens = sorted({t for term in query_terms(query) for t in term})
        if not tokens or not snapshot.n_rows:
            return self.spark.createDataFrame([], "id string, scope_type string, scope_id string, bm25 double")
        asked = {str(b) for b in postings.buckets_of(self.spark.range(1), tokens)}
        terms, found = postings.hits(postings.unpacked(self._postings(snapshot, asked).where(F.col("term").isin(tokens))), query)
        ranges = {str(r[0]) for r in found.select(F.shiftright("number", postings.RANGE)).distinct().collect()}  # no more than folders
        return postings.scored(found.join(self._numbers(snapshot, ranges), "number"), len(terms), snapshot.n_rows, snapshot.n_tokens)

    def _postings(self, snapshot: Snapshot, asked: set[str] | None = None) -> DataFrame:
        """Blocks of postings, those of rows that are gone too."""
        paths = [g[b] for g in snapshot.terms for b in sorted(g) if asked is None or b in asked]
        return self.spark.read.schema(postings.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], postings.SCHEMA)

    def _numbers(self, snapshot: Snapshot, asked: set[str] | None = None, gone: bool = False) -> DataFrame:
        """postings.NUMBERS of the rows that are not gone, or that are."""
        paths = [g[r] for g in snapshot.numbers for r in sorted(g) if asked is None or r in asked]
        rows = self.spark.read.schema(postings.NUMBERS).parquet(*paths) if paths else self.spark.createDataFrame([], postings.NUMBERS)
        dead = self.spark.read.schema("id string").parquet(*snapshot.gone) if snapshot.gone else self.spark.createDataFrame([], "id string")
        return merge.of_ids(rows, dead, "left_semi", snapshot.n_gone) if gone else postings.without(rows, dead, snapshot.n_gone)

    def candidates(self, query: str, scopes: list[Scope], now: datetime, limit: int = lexical.CANDIDATES, snapshot: Snapshot | None = None) -> DataFrame:
        """(id, bm25) as lexical.candidates gives them by a scan: the best rows in scope that are not expired."""
        snapshot = snapshot or self.snapshot()
        seen = merge.kept(self.scored(query, snapshot).where(in_scope(scopes)).select("id", "bm25"))
        order, take, total = [F.round("bm25", 9), "id"], FETCHED * limit, seen.count()
        while True:  # the index knows no expiry; most often the first turn is the last
            best = seen.orderBy(*order).limit(take)
            live = merge.kept(self.memories(snapshot, scopes).where(active(now)).select("id").join(F.broadcast(best), "id"))  # take rows
            if take >= total or live.count() >= limit:
                return live.orderBy(*order).limit(limit)
            take *= FETCHED

    def search(self, query: str, scopes: list[Scope], now: datetime, limit: int = 20, min_score: float = 0.0) -> DataFrame:
        """search.search by words alone, its candidates from the index."""
        snapshot = self.snapshot()
        return search.search(self.memories(snapshot, scopes), query, scopes, now, limit=limit, min_score=min_score, found=self.candidates(query, scopes, now, snapshot=snapshot))

    # --- writing ---

    def _put(self, folder: str, table: str, rows: DataFrame, part: Column, name: str, n: int) -> dict[str, str]:
        """Writes about n rows by part, in as many tasks a part as it takes; name: the column that deals rows out. The parts' folders."""
        path = f"{folder}/{table}"
        task = F.pmod(F.xxhash64(name, F.lit("task")), F.lit(1 + n // (self.buckets * ROWS)))
        rows.withColumn("_part", part).repartition("_part", task).write.option("compression", "zstd").partitionBy("_part").parquet(path)
        return self._folders(path, "_part")

    def write(self, batch: DataFrame, stream: str | None = None, number: int | None = None) -> Snapshot:
        """The version after a batch (as for merge.write; seq counts from 0 in each). A batch of a named stream whose number is not new is not written again."""
        for _ in range(TRIES):
            before = self.snapshot()
            if stream is not None and number <= before.batches.get(stream, -1):
                return before
            try:
                return self.commit(self._merged(before, batch, {} if stream is None else {stream: number}))
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions were made meanwhile")

    def _merged(self, before: Snapshot, batch: DataFrame, batches: dict[str, int]) -> Snapshot:
        n, version = before.buckets, before.version + 1
        folder, drafts = f"{self.root}/data/{version:012d}-{uuid.uuid4().hex}", []

        def keep(df: DataFrame) -> DataFrame:
            """A draft of this write, gone with its end."""
            drafts.append(f"{folder}/draft/{len(drafts)}")
            df.write.option("compression", "zstd").parquet(drafts[-1])
            return self.spark.read.schema(df.schema).parquet(drafts[-1])

        asked = [r[0] for r in batch.where(F.col("idempotency_key").isNotNull()).select(F.col("idempotency_key").alias("key")).select(_part_of_key(n)).distinct().collect()]  # n at most
        top = batch.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        done = merge.write(self.memories(before), batch.withColumn("seq", F.col("seq") + before.top), self.keys(before, asked), keep)  # ids hold seq
        (merged, hit, fresh), n_touched = done.sources, done.touched.count()
        task = F.pmod(F.xxhash64("content_hash", F.lit("task")), F.lit(1 + merged.count() // (n * ROWS)))
        rows = ingest.dealt(merged, hit, fresh, {"_part": _part_of_memory(n, F.col("_scope")), "_task": task})
        rows.select("_part", *self.memories(before).columns).write.option("compression", "zstd").partitionBy("_part").parquet(f"{folder}/memories")
        made = self._folders(f"{folder}/memories", "_part")
        parts, known = self._placed(before, folder, made, done.touched, n_touched)
        written = self._read_all(made, MEMORIES)
        new = merge.of_ids(written, done.touched, "left_anti", n_touched).where(F.col("deleted_at").isNull())
        dead = merge.of_ids(written, done.touched, "left_semi", n_touched).where(F.col("deleted_at").isNotNull())
        index = self._indexed(before, folder, new, dead)
        keys = {p: [f] for p, f in self._put(folder, "keys", done.keys, _part_of_key(n), "key", index["n_rows"]).items()}
        done.outcome.withColumn("seq", F.col("seq") - before.top).write.parquet(f"{folder}/outcome")
        self._fs.delete(self._path(f"{folder}/draft"), True)
        parts = {"memories": parts, "keys": before.parts.get("keys", {}) | keys}
        return replace(before, version=version, parts=parts, batches=before.batches | batches, outcome=f"{folder}/outcome", top=before.top + top, **known, **index)

    def _placed(self, before: Snapshot, folder: str, made: dict[str, str], touched: DataFrame, n_touched: int) -> tuple[dict[str, list[str]], dict]:
        """The folders of memories' parts after made of them, and what is known of stale rows. A row keeps its part, since scope and content never change."""
        known, stale, version = before.parts.get("memories", {}), list(before.stale), before.version + 1
        most = max(1, ingest.MOST_BROADCAST // (3 * before.buckets))  # of three scope types
        old = kept(merge.of_ids(self.memories(before, parts=made), touched, "left_semi", n_touched).select("id", _part_of_memory(before.buckets).alias("part"), F.lit(version).cast("long").alias("at")))
        counts = dict(map(tuple, old.groupBy("part").count().collect()))
        whole = {p for p in made if p in known and (len(known[p]) >= GENERATIONS or before.n_stale.get(p, 0) + counts.get(p, 0) > most)}
        stayed = {}
        if whole:
            stay = merge.of_ids(self.memories(before, parts=whole), touched, "left_anti", n_touched)
            stayed = self._put(folder, "stayed", stay, _part_of_memory(before.buckets), "id", before.n_rows)
        parts = known | {p: ([stayed[p]] if p in stayed else [] if p in whole else known.get(p, [])) + [f] for p, f in made.items()}
        n_stale = {p: x for p in before.n_stale.keys() | counts.keys() if p not in whole and (x := before.n_stale.get(p, 0) + counts.get(p, 0))}
        n_listed = before.n_listed + sum(x for p, x in counts.items() if p not in whole)
        if counts.keys() - whole:
            old.where(~F.col("part").isin(sorted(whole))).repartition(1).write.parquet(f"{folder}/stale")  # at most most a part
            stale.append(f"{folder}/stale")
        if len(stale) > GENERATIONS or n_listed > ingest.MOST_BROADCAST:  # those whose rows are in no folder any more go
            oldest = {p: min(int(re.match(WRITE, f"{f}/")[1]) for f in fs) for p, fs in parts.items()}
            since = F.create_map(*(F.lit(x) for kv in oldest.items() for x in kv))
            seen = self.spark.read.schema(STALE).parquet(*stale).where(F.col("at") > since[F.col("part")])
            seen.repartition(1).write.parquet(f"{folder}/stale-whole")
            stale, n_listed = [f"{folder}/stale-whole"], sum(n_stale.values())
        return parts, {"stale": stale, "n_stale": n_stale, "n_listed": n_listed}

    def _indexed(self, before: Snapshot, folder: str, new: DataFrame, dead: DataFrame) -> dict:
        """The index's part of the version after a write of new rows, and of stored ones that are dead now. A new row's number is its seq, which no other new row has, then or later."""
        less, fewer = postings.counts(dead)
        numbers = [*before.numbers, self._numbered(f"{folder}/numbers", new.select(F.col("seq").alias("number"), "id", "scope_type", "scope_id"))]
        rows = self._read_all(numbers[-1], postings.NUMBERS).count()
        own = new.select(F.col("seq").alias("id"), "content").coalesce(1 + rows // postings.ROWS)
        terms, gone, n_gone = [*before.terms, self._generation(f"{folder}/terms", postings.packed(own))], list(before.gone), before.n_gone + less
        tokens = self._read_all(terms[-1], postings.SCHEMA).agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
        if less:
            dead.select("id").write.parquet(f"{folder}/gone")
            gone.append(f"{folder}/gone")
        if len(terms) > GENERATIONS:
            whole = Snapshot(0, before.buckets, terms=terms, numbers=numbers, gone=gone, n_gone=n_gone)
            out = self._numbers(whole, gone=True).select(F.col("number").alias("id"))
            terms = [self._generation(f"{folder}/merged", postings.repacked(postings.without(postings.unpacked(self._postings(whole)), out, n_gone)))]
            numbers, gone, n_gone = [self._numbered(f"{folder}/renumbered", self._numbers(whole))], [], 0
        return {"terms": terms, "numbers": numbers, "gone": gone, "n_rows": before.n_rows + rows - less, "n_tokens": before.n_tokens + tokens - fewer, "n_gone": n_gone}

    def _generation(self, path: str, blocks: DataFrame) -> dict[str, str]:
        """Writes blocks of postings by bucket of term, sorted by term; the buckets' folders."""
        blocks.sortWithinPartitions("_bucket", "term").write.options(**postings.WRITTEN).partitionBy("_bucket").parquet(path)
        return self._folders(path, "_bucket")

    def _numbered(self, path: str, rows: DataFrame) -> dict[str, str]:
        """Writes what numbers stand for by range of number; the ranges' folders."""
        rows.withColumn("_range", F.shiftright("number", postings.RANGE)).repartition("_range").sortWithinPartitions("_range", "number").write.options(**postings.WRITTEN).partitionBy("_range").parquet(path)
        return self._folders(path, "_range")

    def _folders(self, path: str, column: str) -> dict[str, str]:
        """The folders that partitionBy(column) made, by value."""
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())
        return {n.removeprefix(f"{column}="): f"{path}/{n}" for n in found if n.startswith(f"{column}=")}

    def _read_all(self, folders: dict[str, str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders.values()) if folders else self.spark.createDataFrame([], schema)

    def touch(self, ids: DataFrame, at: datetime) -> Snapshot:
        """The version after rows ids(id) were shown: a small file beside the rows, none of which is written again; many of them become one."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        ids.select("id", F.lit(at).cast("timestamp").alias("at")).distinct().write.parquet(f"{folder}/accessed")
        for k in range(TRIES):
            before = self.snapshot()
            paths = [*before.accessed, f"{folder}/accessed"]
            if len(paths) > GENERATIONS:
                whole = self.accessed(replace(before, accessed=paths)).withColumnRenamed("last_accessed_at", "at")
                whole.write.parquet(f"{folder}/whole-{k}")
                paths = [f"{folder}/whole-{k}"]
            try:
                return self.commit(replace(before, version=before.version + 1, accessed=paths, outcome=None))
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions were made meanwhile")

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all but the newest versions, and data folders that none of these names; how many folders went. No writer may be at work."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        named = {p for v in known[-keep:] for s in [self.snapshot(v)] for p in [*(f for t in s.parts.values() for fs in t.values() for f in fs), *(x for t in [*s.terms, *s.numbers] for x in t.values()), *s.stale, *s.gone, *s.accessed, *filter(None, [s.outcome])]}
        top = self._path(f"{self.root}/data")
        gone = [s.getPath() for s in self._fs.listStatus(top) if not any(f"/{s.getPath().getName()}/" in p for p in named)] if self._fs.exists(top) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
