"""Nearest vectors by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Vectors and queries of one product (its single-precision result takes 16 MB).
ROWS, COLUMNS = 1024, 4096
#: Hits that are measured exactly at a time.
HITS = 250_000


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(whole), -1)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves of the decimal form away from nought, as Spark rounds."""
    y = np.abs(x) * 1e6
    low = np.floor(y)
    out = low + (y - low >= 0.5)
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(abs(x[i])))).quantize(Decimal("0.000001"), ROUND_HALF_UP) * 1_000_000)
    return np.copysign(out, x)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products summed one after the other, as the SQL's engines and the plain expression do."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Best:
    """The k best of each query so far, and the similarity below which a vector is of no use to it."""

    def __init__(self, m: int, k: int):
        self.k, self.found, self.least, self.new = k, np.zeros(0, [("q", "i8"), ("r", "f8"), ("first", "i8"), ("v", "i8"), ("c", "f8")]), np.full(m, -np.inf), []

    def add(self, **columns: np.ndarray) -> None:
        part = np.empty(len(columns["q"]), self.found.dtype)
        for name, values in columns.items():
            part[name] = values
        self.new.append(part)
        if sum(map(len, self.new)) > max(len(self.found), HITS):
            self.settle()

    def settle(self) -> None:
        every = np.concatenate([self.found, *self.new])
        self.new = []
        every = every[np.lexsort((every["v"], every["first"], -every["r"], every["q"]))]
        begin = np.searchsorted(every["q"], every["q"], "left")
        nth = np.arange(len(every)) - begin
        self.found = every[nth < self.k]
        last = every[nth == self.k - 1]
        self.least[last["q"]] = last["r"] / 1e6


def search(batches: Iterator[pa.RecordBatch], numbers: np.ndarray, asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(q, v, first, cosine) of the k vectors that come first for each query, by rounded cosine, then by their first id.

    Single precision only finds what may come up to a query's k-th best; every hit is then measured in doubles.
    """
    best, norms = Best(len(asked), k), np.sqrt(_dots(asked, asked))
    units = (asked / norms[:, None]).astype(np.float32)
    margin = 1e-6 + 2e-7 * (asked.shape[1] + 8)  # the rounding, and the error of a single-precision product
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            v, first, rows = part.column("v").to_numpy(), part.column("first").to_numpy(), matrix(part.column("embedding"))
            lengths = np.sqrt(_dots(rows, rows))
            thin = (rows / lengths[:, None]).astype(np.float32)
            for at in range(0, len(asked), COLUMNS):
                product = units[at : at + COLUMNS] @ thin.T
                least = best.least[at : at + COLUMNS] - margin
                if np.isneginf(least).any() and len(v) >= k:  # the k-th of these vectors is a bound as well
                    least = np.maximum(least, np.partition(product, len(v) - k, axis=1)[:, len(v) - k] - 2 * margin)
                q, i = np.nonzero(product >= least[:, None].astype(np.float32) - np.float32(1e-6))
                q = q + at
                for x in range(0, len(q), HITS):
                    a, b = q[x : x + HITS], i[x : x + HITS]
                    c = _dots(asked[a], rows[b]) / (norms[a] * lengths[b])
                    r = rounded(c)
                    use = r / 1e6 >= best.least[a]
                    a, b, c, r = a[use], b[use], c[use], r[use]
                    best.add(q=a, r=r, first=first[b], v=v[b], c=c)
            if np.isneginf(best.least).any() or sum(map(len, best.new)) > len(asked):
                best.settle()
    best.settle()
    found = best.found
    for start in range(0, len(found), 100_000):
        x = found[start : start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[x["q"]]), pa.array(x["v"]), pa.array(x["first"]), pa.array(x["c"])], ["q", "v", "first", "cosine"])
