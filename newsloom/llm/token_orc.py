"""Token-ID output in ORC.

One row per document: id, where its ids start within the file, how many there are, and the ids. Integers
are stored in ORC's run-length encodings, the row index has an entry every ``ROW_STRIDE`` rows, and the
document ids carry Bloom filters, so a reader skips files, stripes and row groups by metadata alone. Files
follow each other in ascending doc_id order; tasks read their stripes in parallel.

Null text counts as empty (only the end id). A null doc_id sorts first. Repeated rows are stored each.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

ROW_STRIDE = 2_000
STRIPE_BYTES = 16 << 20
END_ID = 2

SCHEMA = "doc_id long, rel_start long, n_tokens int, ids array<int>"


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Documents in ascending order, encoded where they lie. ``rel_start`` counts within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, before = tokens.encoder(path), np.asarray([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for start, texts in common.slices(batch, limit=tokens.TOGETHER):
                ids = [x + end for x in encoder.encode(texts)]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(before + offsets[:-1]), pa.array(counts.astype(np.int32)), lists], ["doc_id", "rel_start", "n_tokens", "ids"])
                before += int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, target: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` by the tokenizer file at ``path`` into ORC files below ``target``."""
    common.ship(docs.sparkSession)
    (
        encoded(docs, path, end_id)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.compress", "ZSTD")
        .orc(target)
    )


def read(spark: SparkSession, target: str, where: Column | None = None) -> DataFrame:
    """The stored rows; a condition on doc_id is pushed to the files' indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(target)
    return rows if where is None else rows.where(where)


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def file_starts(spark: SparkSession, target: str) -> DataFrame:
    """(file, before): ids in all files before it. One row per file, from two narrow columns."""
    totals = read(spark, target).select(_file(), "doc_id", (F.col("rel_start") + F.col("n_tokens")).alias("upto")).groupBy("file").agg(F.max("upto").alias("total"))
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")  # the writer numbers files in order
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def digests(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document."""
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, raw = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("rel_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "rel_start", "n_tokens", "ids_crc32"])

    rows = read(spark, target).select(_file(), "doc_id", "rel_start", "ids").mapInArrow(run, "file string, doc_id long, rel_start long, n_tokens long, ids_crc32 long")
    return rows.join(file_starts(spark, target), "file").select("doc_id", (F.col("before") + F.col("rel_start")).alias("start"), "n_tokens", "ids_crc32")
