"""What the training-data operators share: scratch tables, word splitting, hashes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import ship  # noqa: F401

#: Characters of text that one vectorised step takes at a time (a longer text is a step of its own).
SLICE_CHARS = 1_500_000
#: Distinct words that one Python worker remembers; a full memory is emptied.
WORD_CACHE = 150_000
#: Stands for a null doc_id inside joins; it sorts before every other id.
NULL_ID = -(2**63)

#: With it a query's shuffle files go as the query ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that ``cut`` wrote, and their folders.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can reach.

    Only where the setting is absent (tests on one machine) a local folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="newsloom-"))
            held = context._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/newsloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The shuffle files of the job that wrote it are of no more use; Spark removes them as the job ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables, when nothing reads them any more."""
    for old in tables:
        spark = old.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(old))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a number for each row in ``_row``, and whether it is another one than doc_id.

    Numbers ascend with doc_id (null first), then with the text. Tables normally hold each id once, which a count over
    the id column alone shows; there the id is the number. Only where ids repeat, or several rows have none, the rows
    are sorted and written once with numbers of their own.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    if docs.groupBy(own.alias("_row")).count().where("count > 1").isEmpty():
        return docs.withColumn("_row", own), False
    # Equal rows keep the order they are read in; it also parts a large group of them.
    order = [F.col("_row").asc(), F.col("text").asc_nulls_first(), F.col("_read").asc()]
    spread = docs.withColumns({"_row": own, "_read": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(spread.withColumn("_row", F.monotonically_increasing_id()).drop("_read"), "row-keys"), True


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of about ``limit`` bytes; null is empty."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary())
    start, rows = 0, batch.num_rows
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1] if rows else np.zeros(1, np.int64)
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield start, [x or b"" for x in texts.slice(start, stop - start).to_pylist()]
        start = stop


class WordHashes(dict):
    """word -> unsigned 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = WordHashes()
#: What a worker remembers, by kind of work, and the kind it is at.
_memories: list = [_hashes]
_current = None


def remember(memory) -> None:
    """``memory`` has a method clear()."""
    _memories.append(memory)


def settle(own=None) -> None:
    """A worker is used again and again; at another kind of work it forgets what it remembers of the one before."""
    global _current
    if own is not _current:
        for memory in _memories:
            if memory is not own:
                memory.clear()
        _current = own


#: A-Z to lower case; everything else stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_hashes(words: list[bytes]) -> np.ndarray:
    settle(_hashes)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def split_words(texts: list[bytes], translate: bytes | None = None) -> tuple[list[bytes], np.ndarray]:
    """Words between ASCII white space of all texts, and where each text's words begin (one more entry: the end)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words += (text.translate(translate) if translate else text).split()
        starts[i + 1] = len(words)
    return words, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries of ``h`` (runs over text borders included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Powers of two by doubling, then the binary parts of ``size`` side by side.
    parts, at, power, width = None, 0, h, 1
    while True:
        if size & width:
            piece = power[at : at + n]
            parts = mix(piece) if parts is None else mix(parts * _ODD + piece)
            at += width
        if width * 2 > size:
            return parts
        power = mix(power[:-width] * _ODD + power[width:])
        width *= 2


def doc_of(starts: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def inside(starts: np.ndarray, size: int) -> np.ndarray:
    """Mask over window starts: True where a window of ``size`` words stays within one text."""
    total = int(starts[-1])
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    docs = doc_of(starts)
    return docs[:n] == docs[size - 1 :]
