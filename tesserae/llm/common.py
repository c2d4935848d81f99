"""Small helpers shared by the operators: words, single evaluation of a column, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators and words, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order, repeats included."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, whatever the optimizer does with projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of a text column that Python holds as objects at once.
ROWS = 512
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def map_texts(docs: DataFrame, text: str, fields: dict[str, str], start: Callable[[], Callable[[list[str]], list]], end: Callable[[], None] | None = None) -> DataFrame:
    """(doc_id, *fields) of every row: start(), once a task, gives the function from texts to the fields' columns; end() is called after the task.

    doc_id passes through as it is, nulls and large values too; null texts are empty; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_of = start()
        try:
            for b in batches:
                for k in range(0, b.num_rows, ROWS):
                    part = b.slice(k, ROWS)
                    columns = columns_of(part.column(1).to_pylist())
                    arrays = [pa.array(c, ARROW[t]) for c, t in zip(columns, fields.values())]
                    yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *fields])
        finally:
            if end is not None:
                end()

    rows = docs.select("doc_id", text_of(docs, text).alias("_text"))
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, t in fields.items())]))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share, with its file system."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="tesserae-"))  # one machine, as in tests
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and reread from the shared folder; its lineage ends there."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


#: Slices of the hash's range.
SLICES = 1 << 40
#: A key is hot with over 1 / HOT_SHARE of all rows, and LEAST_HOT at least; so there are at most HOT_SHARE hot keys.
HOT_SHARE, LEAST_HOT = 10_000, 100


def spread_join(rows: DataFrame, unique: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """rows joined by key with unique, which has one row a key and n, the key's number of rows; total: the number of all rows.

    The rows of a hot key stay where they are and get its row by broadcast, which HOT_SHARE bounds; all others are shuffled.
    """
    least = max(LEAST_HOT, total // HOT_SHARE)
    hot = F.broadcast(unique.where(F.col(n) > least).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, key, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(unique.where(F.col(n) <= least), key)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def hashed_sample(rows: DataFrame, key: str, most: int, count: int | None = None) -> DataFrame:
    """At most most rows, about, of rows: those of smallest hash of key, all of which are known from their number alone.

    A filter, so no task sends its own best to another one. The same key is always taken or not. count: the number of rows.
    """
    n = rows.count() if count is None else count
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(SLICES)) < max(1, SLICES * most // n))


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
