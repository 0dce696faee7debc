"""Settings of the toxicity learner, chosen on the labels that may be learned from.

    python -m newsloom.llm.choose_toxicity DIR...        # every setting, on a split of the two thirds
    python -m newsloom.llm.choose_toxicity --held DIR... # the settings in ``toxicity``, once, on the held-out third

The rows with crc32(doc_id) mod 3 = 1 are left out before anything is measured. Of the others, one in four by a
second hash of the id judges what the rest has taught. The least mean log loss over the given folders wins. It reads the
bounded sample that ``toxicity.sample`` would learn from into one process.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.parquet as pq
import xxhash

from . import toxicity

HEADS = ((), (4,), (4, 5), (4, 5, 6))
ALPHAS, L1S, EPOCHS = (1.0, 2.0), (3.0, 6.0, 12.0), 3


def rows(folder: str, held: bool) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, label) of at most ``TRAIN_ROWS`` labelled documents, of the held-out third or of the others."""
    marks: dict[int, int] = {}
    for r in pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist():
        if r["doc_id"] is not None and r["toxic"] is not None and (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == held:
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), int(r["toxic"]))
    chosen = set(sorted(marks, key=lambda i: xxhash.xxh3_64_intdigest(str(i)))[: toxicity.TRAIN_ROWS])
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    found = {i: t for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True) if i in chosen}
    return [(i, (t or "").encode(), marks[i]) for i, t in sorted(found.items(), key=lambda x: xxhash.xxh3_64_intdigest(str(x[0])))]


def measured(train: list[tuple[int, bytes, int]], judge: list[tuple[int, bytes, int]], heads: tuple[int, ...], alpha: float, l1: float) -> dict:
    def read(some):
        return [(x, label) for start in range(0, len(some), 500) for x, label in zip(toxicity.coordinates([r[1] for r in some[start : start + 500]], heads), [r[2] for r in some[start : start + 500]], strict=True)]

    w = toxicity.learned(read(train), toxicity.Ftrl(alpha, l1), EPOCHS)
    tests = read(judge)
    label = np.array([y for _, y in tests])
    p = 1 / (1 + np.exp(-np.clip([w[at].sum() for at, _ in tests], -35, 35)))
    loss = -np.log(np.maximum(np.where(label == 1, p, 1 - p), 1e-12)).mean()
    said = p >= toxicity.THRESHOLD
    return {"loss": float(loss), "caught": int(said[label == 1].sum()), "toxic": int(label.sum()), "false": int(said[label == 0].sum()), "clean": int((label == 0).sum()), "weights": int(np.count_nonzero(w))}


def judged(job: tuple[str, tuple[int, ...], float, float]) -> dict:
    folder, *setting = job
    every = rows(folder, held=False)
    part = [xxhash.xxh3_64_intdigest(f"judge{r[0]}") % 4 == 0 for r in every]
    return measured([r for r, x in zip(every, part, strict=True) if not x], [r for r, x in zip(every, part, strict=True) if x], *setting)


def main(args: list[str]) -> None:
    if args[0] == "--held":
        for folder in args[1:]:
            print(folder, measured(rows(folder, held=False), rows(folder, held=True), toxicity.HEADS, toxicity.ALPHA, toxicity.L1))
        return
    settings = list(itertools.product(HEADS, ALPHAS, L1S))
    jobs = [(folder, *setting) for setting in settings for folder in args]
    with ProcessPoolExecutor(8) as pool:
        out = dict(zip(jobs, pool.map(judged, jobs), strict=True))
    for setting in sorted(settings, key=lambda s: sum(out[(f, *s)]["loss"] for f in args)):
        print(setting, *(out[(f, *setting)] for f in args), sep="\n  ")


if __name__ == "__main__":
    main(sys.argv[1:])
