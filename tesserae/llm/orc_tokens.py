"""Token ids in ORC files: written in ascending doc_id order, read back stripe by stripe.

A file holds rows (doc_id, ids array<int>), sorted by doc_id; integers are run-length encoded, each stripe has row indexes
and a Bloom filter on doc_id, so a lookup of ids reads the footers and the stripes that may hold them, and a scan is
split at stripes. Texts are dealt out by ranges of doc_id before they are encoded, since a text moves in fewer bytes
than its ids.

Defined results: a null text has the end id only. Rows of one doc_id stand together, in one file or several; null ids come
first. An empty table gives an empty folder and result. Rows that share a doc_id get their starts in the order of
their files, and in a file of their checksums.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.bpe import Encoder, ids_array
from tesserae.llm.common import ROWS, cut, text_of

END = 1
OPTIONS = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(16 << 20),
}


#: Chunks that the library encodes in a call; its results are large objects.
CALL = 4096


@functools.cache
def library_encoder(path: str) -> Encoder:
    """An encoder whose chunks the tokenizers library encodes whole, each distinct one once while it is remembered.

    A text's ids are those of its chunks between ASCII white space: the library's normaliser, its pattern and its special
    tokens never reach across.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def new(chunks: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(chunks), CALL):
            found = library.encode_batch_fast(list(map(bytes.decode, chunks[k : k + CALL])), add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]  # 4 bytes each
        return out

    return Encoder(new)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = END, text: str = "text") -> None:
    """Encodes every text, appends the end id, and writes ORC files to path."""
    kind, last = docs.schema["doc_id"].dataType.simpleString(), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                lists = ids_array([x + last for x in e.encode(part.column(1).to_pylist())])
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    rows = docs.select("doc_id", text_of(docs, text).alias("_text")).withColumn("_p", F.spark_partition_id())
    # rows of one id, as all those without one, may be many: their texts and where they come from split them further
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("_text"), "_p").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows.select("doc_id", "_text").mapInArrow(run, f"doc_id {kind}, ids array<int>").write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids); with doc_ids only those, from the stripes whose statistics and Bloom filters allow them."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document; start: ids of all documents before it."""
    rows = read(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat, stops = np.asarray(ids.flatten(), "<u4"), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stops - starts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file", "n_tokens", "ids_crc32"])

    found = rows.select("doc_id", F.col("_metadata.file_path").alias("file"), "ids").mapInArrow(run, f"doc_id {kind}, file string, n_tokens long, ids_crc32 long")
    found = cut(found)
    id_order = F.col("doc_id").asc_nulls_first()
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    earlier = Window.orderBy(F.col("nulls").desc(), F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))  # one row a file
    inside = Window.partitionBy("file").orderBy(id_order, "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return found.join(offsets, "file").withColumn("start", start).select("doc_id", "start", "n_tokens", "ids_crc32")
