"""Token ids in ORC files.

One row holds a document: doc_id, n_tokens, ids. Files are range-partitioned and
sorted by doc_id; ids use ORC's integer run-length encoding, every
``row_index_stride`` rows have an index entry, and doc_id has a Bloom filter. Readers
split a file by stripes, skip stripes and row groups by min/max and Bloom filter,
and read n_tokens without touching ids.

Null or empty texts hold the end id alone. Equal doc_ids stand together, shorter
first. A null doc_id sorts first. Other columns of the input are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placewise.llm import word_ids
from placewise.llm.shared import byte_texts, slices

_SCHEMA = "doc_id long, n_tokens int, ids array<int>, row long"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, row (its number in the partition) of each row, in the order of the rows."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches):
            ids = batch.column("doc_id")
            texts = byte_texts(batch)
            rows, held, first = [], 0, 0
            for row in word_ids.encode_texts(texts, path):
                rows.append(row)
                held += len(row)
                if held > 16 << 20:
                    yield _batch(ids.slice(first, len(rows)), rows, done)
                    done, first, rows, held = done + len(rows), first + len(rows), [], 0
            if rows:
                yield _batch(ids.slice(first, len(rows)), rows, done)
                done += len(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _SCHEMA)


def _batch(doc_ids: pa.Array, rows: list[bytes], done: int) -> pa.RecordBatch:
    lengths = [len(r) // 4 for r in rows]
    ends = pa.array([0, *lengths], pa.int32()).to_numpy().cumsum(dtype="int32")
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(range(done, done + len(rows)), pa.int64())],
        ["doc_id", "n_tokens", "ids", "row"],
    )


def write(docs: DataFrame, folder: str, path: str | None = None, files: int | None = None, row_index_stride: int = 1000, stripe_mb: int = 16) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order; part files follow that order.

    Rows of one doc_id (or of none) are ordered by length and text and dealt to files by length, so
    that many of them share several files. Texts are sorted before they are encoded: sampling the ranges then reads doc_id
    and costs no encoding. A lost task is redone and its file replaced as a whole.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = files or max(source.rdd.getNumPartitions(), 1)
    dealt = source.repartitionByRange(n, "doc_id", F.length("text")).sortWithinPartitions("doc_id", F.length("text"), "text")
    (
        tokenised(dealt, path or word_ids.default_path())
        .write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", row_index_stride)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).mode("overwrite").orc(folder)
    )


def read(spark: SparkSession, folder: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, row (its number in its file). With ``doc_ids`` the filter reaches the stripes' statistics and Bloom filters."""
    rows = spark.read.schema(_SCHEMA).orc(folder)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document as the files hold it.

    Files are in doc_id order, so a document's start is the sum of the files before
    its own (one row for each file) and of the rows before it in its file.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("ids")
            flat, ends = memoryview(ids.values.cast(pa.int32()).buffers()[1] or b""), ids.offsets.to_pylist()
            shift = ids.values.offset
            crc = [zlib.crc32(flat[4 * (shift + a) : 4 * (shift + b)]) for a, b in zip(ends, ends[1:])]
            counts = [b - a for a, b in zip(ends, ends[1:])]
            columns = [batch.column("file"), batch.column("doc_id"), pa.array(crc, pa.int64()), pa.array(counts, pa.int64()), batch.column("row")]
            yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "ids_crc32", "n_tokens", "row"])

    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file")
    each = read(spark, folder).select(number, "doc_id", "ids", "row").mapInArrow(sums, "file int, doc_id long, ids_crc32 long, n_tokens long, row long")
    totals = read(spark, folder).select(number, "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))).select("file", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    numbered = each.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return numbered.join(before, "file").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
