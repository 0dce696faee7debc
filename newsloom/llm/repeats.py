"""Substring deduplication by seed and extend.

Seeds: in every window of ``WINDOW`` words the smallest hash of ``SEED`` consecutive words is the window's
anchor (winnowing), so equal windows have equal anchors at the same offset. The windows of one anchor
occurrence are a block. Documents are joined on anchors, not on windows: some tenth of the rows.

Extension: blocks of one anchor with equal words on both sides as far as their windows reach are equal;
all but the first of them repeat as a whole. Where an anchor has blocks that differ, the first block of each kind
is extended word by word: its windows are compared one by one. Runs of repeated windows join into the
maximal repeats, and their words are removed, whether or not the earlier copy is removed itself.

"Earlier" is a smaller doc_id, or an earlier place in the same document. What a task reads at a time is
compared within itself first, so a passage that a third of all documents share arrives as one row of each
such slice; a repeat found there never enters the join.

A document is one row, and each row has a result. Rows that share a doc_id, or have none, are ordered by their
texts (``common.row_keys``). A null doc_id sorts first. Null and empty texts have no words. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 20
SEED = 5
#: A place holds a first window and a number of windows (at most WINDOW - SEED + 1).
STEP = 32

SEEDS = "anchor long, kind long, doc_id long, place long, known boolean"


def _sliding_argmin(v: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost smallest value in each run of ``size`` values."""
    n = len(v) - size + 1
    at, width = np.arange(len(v)), 1
    while width * 2 <= size:
        left, right = at[:-width], at[width:]
        at = np.where(v[left] <= v[right], left, right)
        width *= 2
    if width < size:
        left, right = at[:n], at[size - width : size - width + n]
        at = np.where(v[left] <= v[right], left, right)
    return at


def blocks(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(anchor, kind, text number, place) of every anchor occurrence, and the window hashes by word."""
    words, starts = common.split_words(texts)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    if len(words) < window:
        return none
    h = common.word_hashes(words)
    seeds = common.window_hashes(h, SEED)
    p = np.flatnonzero(common.inside(starts, window))
    if not len(p):
        return none
    # A run inside one text looks at seeds inside it alone.
    a = _sliding_argmin(seeds, window - SEED + 1)[p]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    heads = np.flatnonzero(fresh)
    size = np.diff(np.append(heads, len(p)))
    kinds = common.mix(np.add.reduceat(common.mix(common.window_hashes(h, window)[p]), heads) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = common.doc_of(starts)[p[heads]]
    return seeds[a[heads]], kinds, doc, (p[heads] - starts[doc]) * STEP + size


def _seeds(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for start, texts in common.slices(batch):
                anchor, kind, doc, place = blocks(texts)
                doc_id = ids[start + doc]
                order = np.lexsort((place, doc_id, kind, anchor))
                anchor, kind, doc_id, place = anchor[order], kind[order], doc_id[order], place[order]
                known = np.zeros(len(order), bool)
                known[1:] = (anchor[1:] == anchor[:-1]) & (kind[1:] == kind[:-1])
                # What is known to repeat meets no one: it is dealt out by its place.
                anchor = np.where(known, common.mix(doc_id.astype(np.uint64) + place.astype(np.uint64)), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(doc_id), pa.array(place), pa.array(known)], ["anchor", "kind", "doc_id", "place", "known"])

    return docs.mapInArrow(run, SEEDS)


def _extended(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(window, doc_id, at) for every window of the asked blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("doc_id").to_numpy(), batch.column("places").to_pylist()
            for start, texts in common.slices(batch):
                words, starts = common.split_words(texts)
                hashes = common.window_hashes(common.word_hashes(words), WINDOW)
                found, owner, at = [], [], []
                for i in range(len(texts)):
                    place = np.array(places[start + i], np.int64)
                    first, size = place // STEP, place % STEP
                    own = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    found.append(hashes[starts[i] + own])
                    owner.append(np.full(len(own), ids[start + i]))
                    at.append(own)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in found], owner, at)], ["window", "doc_id", "at"])

    wanted = asked.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    return docs.join(wanted, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "window long, doc_id long, at long")


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, place): runs of windows that start earlier too. Each doc_id stands once in ``docs`` and is not null."""
    by_kind = Window.partitionBy("anchor", "kind").orderBy("doc_id", "place")
    by_anchor = Window.partitionBy("anchor")
    spread = _seeds(docs).repartition("anchor")
    ranked = spread.withColumn("nth", F.when(F.col("known"), F.lit(2)).otherwise(F.row_number().over(by_kind)))
    ranked = ranked.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(by_anchor))
    met = common.cut(ranked.where("nth > 1 or kinds > 1").select("doc_id", "place", (F.col("nth") == 1).alias("asked")), "anchors")
    windows = common.cut(_extended(met.where("asked"), docs), "windows")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("times")).where("times > 1")
    again = windows.join(firsts, "window").where(F.struct("doc_id", "at") > F.col("first"))
    return met.where("not asked").select("doc_id", "place").unionByName(again.select("doc_id", (F.col("at") * STEP + 1).alias("place")))


def _covered(n: int, places: list[int] | None) -> np.ndarray:
    """Mask of the removed words."""
    change = np.zeros(n + 1, np.int64)
    place = np.array(places or [], np.int64)
    np.add.at(change, place // STEP, 1)
    np.add.at(change, np.minimum(place // STEP + place % STEP + WINDOW - 1, n), -1)
    return np.cumsum(change)[:n] > 0


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, text, places of every row."""
    rows, _ = common.row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = marks(rows.select(F.col("_row").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list("place").alias("places"))
    return rows.join(found, "_row", "left").select("doc_id", "text", "places")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, text (the words kept, one space between), n_words, n_removed, spans (removed runs of words)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist()
            for start, texts in common.slices(batch):
                out: list[list] = [[], [], [], []]
                for raw, own in zip(texts, places[start : start + len(texts)], strict=True):
                    words = raw.split()
                    gone = _covered(len(words), own)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    kept = words if not own else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    for column, value in zip(out, (b" ".join(kept).decode("utf-8", "replace"), len(words), int(gone.sum()), [{"s": s, "e": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]), strict=True):
                        column.append(value)
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *(pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), span), strict=True))], ["doc_id", "text", "n_words", "n_removed", "spans"])

    return _judged(docs).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, spans array<struct<s:long,e:long>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist()
            for start, texts in common.slices(batch):
                n_words, n_removed, digests = [], [], []
                for raw, own in zip(texts, places[start : start + len(texts)], strict=True):
                    words = raw.split()
                    kept = words
                    if own:
                        kept = [w for w, x in zip(words, _covered(len(words), own).tolist(), strict=True) if not x]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept))
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _judged(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
