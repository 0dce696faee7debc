"""Best-fit packing of token pieces, improved by swap-based local search.

A document longer than the sequence is cut; all its pieces but the first are full, so only one piece of
each document needs a place beside others. Those pieces are dealt by a hash into shards of bounded size.
In a shard a best-fit start puts each piece, longest first, into the fullest bin that takes it. The local
search then moves a piece, or exchanges one piece for one or two for one, between underfull bins, whenever
that raises the sum of squared fills; a bin that runs empty is gone. Bins that stay underfull after this
are opened once more and packed together over fewer shards, so that what is lost does not grow with
the number of shards.

Null text is empty (one piece, the end id alone). Repeated rows are packed each. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 1024
END_ID = 2
#: Pieces of one shard on average; a shard is packed by one task.
SHARD_PIECES = 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: cut so that the first one may be shorter and the others are full."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for first, texts in common.slices(batch, limit=tokens.TOGETHER):
                rows, numbers, starts, lengths, crcs = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts), first):
                    ids += end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        step = size if k or n % size == 0 else n % size
                        rows.append(i)
                        numbers.append(k)
                        starts.append(at)
                        lengths.append(step)
                        crcs.append(zlib.crc32(ids[4 * at : 4 * (at + step)]))
                        at, k = at + step, k + 1
                ids_column = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_column, pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of piece numbers: longest piece first, each into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # the rooms for which there is a bin, ascending
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k == len(rooms):
            room, b = size, len(bins)
            bins.append([])
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[k]
        bins[b].append(i)
        room -= n
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


def improve(bins: list[list[int]], lengths: list[int], size: int, tries: int = 40) -> list[list[int]]:
    """Local search between the underfull bins; each step raises the sum of squared fills.

    The emptiest bin (the donor) gives to fuller ones: a move of a piece that fits; an exchange of one of
    its pieces for a shorter one; an exchange of two of its pieces for one, or one for two. Filling
    the fuller bin by d > 0 from a less full one changes the sum by 2d(fuller - emptier + d) > 0.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = sorted((b for b in range(len(bins)) if fill[b] < size), key=lambda b: (fill[b], b))
    whole = [b for b in range(len(bins)) if fill[b] == size]
    done: list[int] = []
    while len(open_) > 1:
        donor = open_.pop(0)
        idle = 0
        # The fullest partners first: they need the least to become full.
        for partner in reversed(open_):
            if not bins[donor] or idle >= tries:
                break
            room = size - fill[partner]
            if not room:
                continue
            gain, give, take = _best(bins[donor], bins[partner], lengths, room)
            if gain <= 0:
                idle += 1
                continue
            idle = 0
            for i in give:
                bins[donor].remove(i)
            for i in take:
                bins[partner].remove(i)
            bins[partner] += give
            bins[donor] += take
            fill[partner] += gain
            fill[donor] -= gain
        if bins[donor]:
            done.append(donor)
        whole += [b for b in open_ if fill[b] == size]
        open_ = sorted((b for b in open_ if fill[b] < size), key=lambda b: (fill[b], b))
    return [bins[b] for b in [*whole, *open_, *done]]


def _best(mine: list[int], theirs: list[int], lengths: list[int], room: int) -> tuple[int, list[int], list[int]]:
    """The exchange that fills most of ``room``: (tokens gained by the partner, pieces given, pieces taken)."""
    best: tuple[int, list[int], list[int]] = (0, [], [])
    gives = [[i] for i in mine] + [[i, j] for a, i in enumerate(mine) for j in mine[a + 1 :]]
    takes = [[]] + [[i] for i in theirs] + [[i, j] for a, i in enumerate(theirs) for j in theirs[a + 1 :]]
    takes = takes[:200]
    for give in gives[:200]:
        n = sum(lengths[i] for i in give)
        for take in takes:
            if len(give) + len(take) > 3:
                continue
            gain = n - sum(lengths[i] for i in take)
            if best[0] < gain <= room:
                best = (gain, give, take)
                if gain == room:
                    return best
    return best


def pack_lengths(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    return improve(best_fit(lengths, size), lengths, size)


def _packer(size: int, again: bool):
    """Of one shard: bin number, offset and fill of each piece."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].tolist()
        full = [[i] for i, n in enumerate(lengths) if n >= size]
        bins = full + [[i + len(full) for i in b] for b in pack_lengths(lengths[len(full) :], size)]
        order, number, offset, fill = [], [], [], []
        for k, b in enumerate(bins):
            at, total = 0, sum(lengths[i] for i in b)
            for i in b:
                order.append(i)
                number.append(k)
                offset.append(at)
                fill.append(total)
                at += lengths[i]
        rows = rows.iloc[order].reset_index(drop=True)
        rows["sequence_id"] = (int(key[0]) << 33 | int(again) << 32) + np.array(number, np.int64)
        rows["offset"] = np.array(offset, np.int64)
        rows["fill"] = np.array(fill, np.int64)
        return rows.drop(columns="shard")

    return run


def _packed(rows: DataFrame, shards: int, size: int, again: bool) -> DataFrame:
    spread = F.pmod(F.xxhash64("doc_id", "piece", F.lit(again)), F.lit(shards)).alias("shard")
    return rows.select("*", spread).groupBy("shard").applyInPandas(_packer(size, again), PIECES + ", sequence_id long, offset long, fill long")


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut = common.cut(pieces(docs, path, size, end_id), "pieces")
    first = common.cut(_packed(cut, max(1, math.ceil(cut.count() / shard_pieces)), size, False), "packed")
    slack = first.where(F.col("fill") < size).drop("sequence_id", "offset", "fill")
    n = slack.count()
    if not n:
        return first.drop("fill")
    second = _packed(slack, max(1, math.ceil(n / (2 * shard_pieces))), size, True)
    return first.where(F.col("fill") >= size).unionByName(second).drop("fill")
