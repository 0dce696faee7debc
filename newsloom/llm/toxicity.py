"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, their heads (first ``HEADS`` bytes), word pairs and pairs with one word between
them, hashed to ``2**BITS`` coordinates; each counts once in a text. Every coordinate has its own learning rate, and the L1 term keeps
nearly all weights at zero, so the model is a short list that is broadcast (its size is bounded by the
number of coordinates).

The model is fitted by one task on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their
id among all labelled ones, and stops taking more once it has read ``TRAIN_BYTES``; scoring reads every
document once and shuffles nothing. The settings come from ``choose_toxicity``, which never sees the held-out third.

Null and empty texts have no features; the intercept alone scores them. A document labelled more than once
counts as its highest label, and an id with several texts is learned by its smallest. Repeated rows are scored
each. A null doc_id is never learned from and never held out. With no labelled document all weights are zero and
every score is 0.5. Empty tables and extra columns are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontam import WORDS

BITS = 20
#: The sample that the model is fitted on holds at most so many documents.
TRAIN_ROWS = 15_000
#: It ends with the first document that brings its texts to so many bytes.
TRAIN_BYTES = 96_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: Unseen forms of a known word share its head.
HEADS = (4, 5, 6)
THRESHOLD = 0.7

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(texts: list[bytes], heads: tuple[int, ...] = HEADS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every word, head, pair and skip pair, repeats included. Coordinate 0 is the intercept's."""
    words, starts = common.split_words(texts, WORDS)
    h, doc = common.word_hashes(words), common.doc_of(starts)
    docs, hashes = [doc], [common.mix(h + _C)]
    _, firsts, which = np.unique(h, return_index=True, return_inverse=True)
    distinct = [words[i] for i in firsts.tolist()]
    for size in heads:
        docs.append(doc)
        hashes.append(common.mix(common.word_hashes([w[:size] for w in distinct]) + np.array([size], np.uint64) * _A)[which])
    for gap, factor in ((1, _A), (2, _B)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            hashes.append(common.mix(h[:-gap] * factor + h[gap:])[same])
    place = np.concatenate(hashes) >> np.uint64(64 - BITS)
    return np.concatenate(docs), np.maximum(place.astype(np.int64), 1)


class Ftrl:
    """FTRL-proximal with binary features."""

    def __init__(self, alpha: float = ALPHA, l1: float = L1):
        self.z, self.n, self.alpha, self.l1 = np.zeros(1 << BITS), np.zeros(1 << BITS), alpha, l1

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((BETA + np.sqrt(n)) / self.alpha + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def coordinates(texts: list[bytes], heads: tuple[int, ...] = HEADS) -> list[np.ndarray]:
    """Of each text its distinct coordinates, the intercept's last."""
    doc, place = features(texts, heads)
    both = np.unique(doc << BITS | place)
    cuts = np.searchsorted(both, np.arange(len(texts) + 1) << BITS)
    return [np.append(both[cuts[i] : cuts[i + 1]] & ((1 << BITS) - 1), 0).astype(np.int32) for i in range(len(texts))]


def learned(seen: list[tuple[np.ndarray, int]], model: Ftrl, epochs: int) -> np.ndarray:
    """The weights after ``epochs`` passes over (coordinates, label)."""
    for _ in range(epochs):
        for at, y in seen:
            model.learn(at, y)
    return model.weights()


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out third: text, toxic, order."""
    ours = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = ours.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label")).select("doc_id", "_label", F.xxhash64("doc_id").alias("_order")).orderBy("_order", "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` narrow rows
    return met.groupBy("doc_id", "_label", "_order").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by coordinate. Training runs in one executor task; the nonzero weights come back."""
    common.ship(docs.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, int]] = []
        taken = 0
        for batch in batches:
            label = batch.column("_label").to_pylist()
            for start, texts in common.slices(batch):
                if taken < TRAIN_BYTES:
                    reach = taken + np.cumsum([len(x) for x in texts])
                    texts = texts[: int(np.searchsorted(reach, TRAIN_BYTES)) + 1]
                    taken = int(reach[len(texts) - 1])
                    seen += zip(coordinates(texts), label[start : start + len(texts)], strict=True)
        w = learned(seen, Ftrl(), epochs)
        nonzero = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(nonzero), pa.array(w[nonzero])], ["place", "weight"])

    chosen = sample(docs, labels, rows).repartition(1).sortWithinPartitions("_order", "doc_id", "text").select("text", "_label")
    dense = np.zeros(1 << BITS)
    for row in chosen.mapInArrow(train, "place long, weight double").collect():  # at most 2**BITS rows
        dense[row.place] = row.weight
    return dense


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    doc, place = features(texts)
    live = weights[place] != 0
    both = np.unique(doc[live] << BITS | place[live])
    total = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total + weights[0], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(_sparse(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(held.value)
        for batch in batches:
            for start, texts in common.slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(scores(texts, dense))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, that score below the threshold."""
    common.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(_sparse(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = _dense(held.value)
        for batch in batches:
            kept = [scores(texts, dense) < threshold for _, texts in common.slices(batch)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(weights)
    return at, weights[at]


def _dense(sparse: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros(1 << BITS)
    out[sparse[0]] = sparse[1]
    return out


def predict(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
