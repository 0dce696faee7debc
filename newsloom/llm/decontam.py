"""Benchmark decontamination by suffix arrays over the training text.

Every run of documents that a task reads is a shard. Its suffixes (word positions) are sorted by their
first ``WINDOW`` words; suffixes that cannot match because a word on their way is in no test item are left
out. Each suffix of each test item is then looked up by binary search, which gives all places where its
window occurs; windows that follow each other on one diagonal join into the longest verbatim matches.

The test set is a stated query set: it is sent to the executors in blocks of at most ``BLOCK_BYTES``
(checked), and every block is run against all documents. Documents are never shuffled.

Words: ASCII letters and digits, lower-cased, and everything beyond ASCII. An item of fewer than
``WINDOW`` words, but not none, is one window. Null and empty texts have no words. Repeated rows and rows
without doc_id are judged each for itself. Empty tables on either side give no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: UTF-8 bytes of test items that are broadcast at once.
BLOCK_BYTES = 16 << 20
SHARD_CHARS = 4_000_000

_kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
WORDS = bytes(c if c in _kept else 0x20 for c in common.LOWER)

FOUND = "n_words long, runs array<struct<s:long,e:long>>, items array<string>, matches array<struct<item_id:string,item_start:long,doc_start:long,length:long>>"


class Index:
    """One block of test items: their vocabulary, windows and suffixes."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        keys, owners, places, lengths = [], [], [], []
        first_words: set[int] = set()
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.translate(WORDS).split()]
            if not ids:
                continue
            size = min(window, len(ids))
            if size < window:
                first_words.add(ids[0])
            for at in range(len(ids) - size + 1):
                keys.append(ids[at : at + size] + [0] * (window - size))
                owners.append(len(self.names))
                places.append(at)
                lengths.append(size)
            self.names.append(name)
        self.size = len(keys)
        self.keys = np.array(keys, np.uint32).reshape(-1, window)
        self.owner, self.place, self.length = (np.array(x, np.int64) for x in (owners, places, lengths))
        self.shortest = int(self.length.min()) if self.size else window
        self.opens = np.zeros(len(self.vocabulary) + 1, bool)
        self.opens[list(first_words)] = True

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``ids``, window number) of every occurrence. 0 in ``ids``: no test word, or a text's end."""
        none = np.zeros(0, np.int64)
        if not self.size or not len(ids):
            return none, none
        n = len(ids)
        stops = np.where(ids == 0, np.arange(n), n)
        run = np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)
        able = run >= self.window
        if self.shortest < self.window:
            able |= (run >= self.shortest) & self.opens[ids]
        places = np.flatnonzero(able)
        if not len(places):
            return none, none
        steps = np.arange(self.window)
        rows = np.where(steps < run[places, None], ids[np.minimum(places[:, None] + steps, n - 1)], 0)
        keys = self._packed(rows)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        array, keys = places[order], keys[order]
        low = np.searchsorted(keys, self._packed(self.keys), "left")
        # A window of fewer words matches every suffix that begins with it.
        above = np.where(steps < self.length[:, None], self.keys, np.uint32(0xFFFFFFFF))
        high = np.searchsorted(keys, self._packed(above), "right")
        count = np.maximum(high - low, 0)
        window = np.repeat(np.arange(self.size), count)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return array[low[window] + inner], window


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    out: list[list[int]] = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"s": s, "e": e} for s, e in out]


def _shard(index: Index, texts: list[bytes]) -> dict[str, list]:
    """What one shard's suffix array tells of each of its texts."""
    get, ids, starts = index.vocabulary.get, [], np.zeros(len(texts) + 1, np.int64)
    counts = []
    for i, text in enumerate(texts):
        words = text.translate(WORDS).split()
        ids += map(get, words, repeat(0))
        ids.append(0)  # no match runs on into the next text
        counts.append(len(words))
        starts[i + 1] = len(ids)
    runs, items, matches = ([[] for _ in texts] for _ in range(3))
    place, window = index.search(np.array(ids, np.uint32))
    if len(place):
        doc = np.searchsorted(starts, place, "right") - 1
        owner, at = index.owner[window], index.place[window]
        begin, size = place - starts[doc], index.length[window]
        order = np.lexsort((begin, doc))
        for d, rows in _groups(doc[order], order):
            runs[d] = _merge(begin[rows], begin[rows] + size[rows])
        order = np.lexsort((begin, begin - at, owner, doc))
        d, o, b, a, z = doc[order], owner[order], begin[order], at[order], size[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (b[1:] - a[1:] != b[:-1] - a[:-1]) | (b[1:] > b[:-1] + 1)
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(order)) - 1
        for i, j in zip(heads.tolist(), tails.tolist(), strict=True):
            matches[d[i]].append({"item_id": index.names[o[i]], "item_start": int(a[i]), "doc_start": int(b[i]), "length": int(b[j] + z[j] - b[i])})
        items = [sorted({x["item_id"] for x in found}) for found in matches]
    return {"n_words": counts, "runs": runs, "items": items, "matches": matches}


def _groups(sorted_ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(sorted_ids)) + 1
    for part in np.split(np.arange(len(rows)), cuts):
        yield int(sorted_ids[part[0]]), rows[part]


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The test set as indexes of bounded size, one after the other."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes * 1.25)) if total > block_bytes else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.collect()  # of this block only
        yield Index(sorted(("" if r.item_id is None else r.item_id, r.text.encode("utf-8", "replace")) for r in rows), window)


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id and FOUND for every row."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kinds = _arrow_types()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in common.slices(batch, limit=SHARD_CHARS):
                found = _shard(held.value, texts)
                columns = [pa.array(found[name], kind) for name, kind in kinds]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *columns], ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + FOUND)


def _arrow_types() -> list[tuple[str, pa.DataType]]:
    long = pa.int64()
    return [("n_words", long), ("runs", pa.list_(pa.struct([("s", long), ("e", long)]))), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", long), ("doc_start", long), ("length", long)])))]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, runs of hit words, items that occur, and the longest matches, for every document."""
    common.ship(docs.sparkSession)
    indexes = list(blocks(benchmark, window, block_bytes))
    if len(indexes) == 1:
        return _scan(docs, indexes[0])
    # What several blocks find in a row meets here by the row's own key: hits, not texts, are shuffled.
    rows, numbered = common.row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    parts = [_scan(rows.select(F.col("_row").alias("doc_id"), "text"), index) for index in indexes]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    gathered = both.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    joined = F.expr("""
        aggregate(runs, cast(array() as array<struct<s:bigint,e:bigint>>), (out, x) ->
          case when size(out) > 0 and x.s <= element_at(out, -1).e
               then concat(slice(out, 1, size(out) - 1), array(named_struct('s', element_at(out, -1).s, 'e', greatest(element_at(out, -1).e, x.e))))
               else concat(out, array(x)) end)""")
    gathered = gathered.withColumn("runs", joined)
    if not numbered:
        return gathered.withColumn("doc_id", F.nullif("doc_id", F.lit(common.NULL_ID)))
    return gathered.withColumnRenamed("doc_id", "_row").join(rows.select("_row", "doc_id"), "_row").select("doc_id", "n_words", "runs", "items", "matches")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts and a digest of the items for every document."""
    names = F.array_sort("items")
    return find(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(runs, 0L, (n, x) -> n + x.e - x.s)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, in which no window of a test item occurs."""
    common.ship(docs.sparkSession)
    kept = docs
    for index in blocks(benchmark, window, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not hit for _, texts in common.slices(batch, limit=SHARD_CHARS) for hit in _shard(held.value, texts)["runs"]]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
