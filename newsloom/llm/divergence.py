"""Quality by distribution divergence from language references.

The references are counted over all documents: for each language the shares of the character classes and
of its most common words. A document's own shares are compared with its language's reference by the
Jensen-Shannon distance (base 2, 0 to 1). Short texts have unsteady shares, so each test has a minimum
length below which it does not speak. A document whose language is null or has no reference is held
against the nearest one.

The limit of the word test comes from the corpus, by language and length: ``BANDS`` bands of length double it. In each
band the distances of the language's own documents (those that pass the base rules, equal distances once) give
a fence, as far above the median as the lower quartile is below it, times ``FENCE``; texts in a wrong language
lie in the upper half and don't move the lower one. The fence of a band is the median of those around it, and always
below the distance of a text without a single common word.

Before that stand the base rules: at least ``MIN_WORDS`` words, and at most half of them within three-word
windows that come twice or more.

Words lie between ASCII white space. Null text is empty: no words, base_failed. Every row is judged for
itself, repeated rows and null ids too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: Words in a language's reference; any of them makes up at least ``LEAST_SHARE`` of the language.
COMMON_WORDS = 40
LEAST_SHARE = 1 / 1000
#: A test is silent on texts of fewer words.
CLASS_GUARD, WORD_GUARD = 50, 100
#: Largest Jensen-Shannon distance of the classes that is kept.
CLASS_LIMIT = 0.23
#: For words: Tukey's fence lies four times the half of a normal distribution's quartile distance over its median. The
#: half counts as ``LEAST_SPREAD`` of the median at least, and bands of fewer than ``BAND_TEXTS`` distances take the next one's fence.
FENCE, LEAST_SPREAD, BAND_TEXTS, BANDS = 4, 0.05, 20, 3
#: Largest share of the distance of a text without common words that is kept.
NO_WORDS = 0.98

#: Character classes by byte; bytes that continue a code point count in none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "letter_beyond", "other")


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)), np.float64)
    for c in range(256):
        if 0x80 <= c < 0xC0:
            continue
        if 0x61 <= c <= 0x7A:
            k = 0
        elif 0x41 <= c <= 0x5A:
            k = 1
        elif 0x30 <= c <= 0x39:
            k = 2
        elif c == 0x20 or 0x09 <= c <= 0x0D:
            k = 3
        elif c in b".,;:!?'\"()-":
            k = 4
        elif c < 0x80:
            k = 5
        else:
            k = 6 if c < 0xE0 else 7
        out[c, k] = 1
    return out


CLASS_OF = _class_matrix()
_symbols = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8)).astype(np.int64)
_word_chars = np.array([int(not (0x80 <= c < 0xC0 or c == 0x20 or 0x09 <= c <= 0x0D)) for c in range(256)])

REFERENCE = "lang string, kind string, key string, n long"


def _histograms(texts: list[bytes]) -> np.ndarray:
    return np.array([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in texts], np.int64).reshape(-1, 256)


def _by_language(docs: DataFrame, wanted: dict[str, set[bytes]] | None) -> DataFrame:
    """Per task and language: class counts, the number of words, and word counts.

    Without ``wanted`` the words that reach ``LEAST_SHARE`` of the task's words: every word that reaches it in the
    whole language does so in one task at least. With it, the exact counts of those words.
    """
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        totals: Counter = Counter()
        least: dict[str, set[bytes]] = {}

        def settle(lang: str) -> None:
            """Only words that are frequent so far stay candidates."""
            own = words[lang]
            n = sum(own.values())
            least.setdefault(lang, set()).update(w for w, k in own.items() if k >= LEAST_SHARE * n)
            own.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in common.slices(batch):
                for lang in {x for x in langs[start : start + len(texts)] if x is not None}:
                    own = [x for i, x in enumerate(texts, start) if langs[i] == lang]
                    counts = words.setdefault(lang, Counter())
                    found = [w for x in own for w in x.translate(common.LOWER).split()]
                    totals[lang] += len(found)
                    if wanted is None:
                        counts.update(found)
                        if len(counts) > 300_000:
                            settle(lang)
                        classes[lang] = classes.get(lang, 0) + _histograms(own).sum(0)
                    else:
                        mine = held.value.get(lang, set())
                        counts.update(w for w in found if w in mine)
        rows: list[tuple[str, str, str, int]] = []
        for lang, counts in words.items():
            if wanted is None:
                settle(lang)
                rows += [(lang, "word", w.decode("utf-8", "replace"), 0) for w in least[lang]]
                rows += [(lang, "class", name, int(n)) for name, n in zip(CLASSES, classes[lang] @ CLASS_OF, strict=True)]
                rows.append((lang, "words", "", totals[lang]))
            else:
                rows += [(lang, "word", w.decode("utf-8", "replace"), n) for w, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(),) * 3 + (pa.int64(),))], ["lang", "kind", "key", "n"])

    return docs.select("lang", "text").mapInArrow(run, REFERENCE).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, words: int = COMMON_WORDS) -> dict[str, dict]:
    """Of each language: class shares, common words and their shares (the rest last). Counted over all rows."""
    common.ship(docs.sparkSession)
    first = common.cut(_by_language(docs, None), "classes")
    # At most 1 / LEAST_SHARE words of a language and task reach this point; few survive the exact count.
    candidates: dict[str, set[bytes]] = {}
    for row in first.where("kind = 'word'").collect():
        candidates.setdefault(row.lang, set()).add(row.key.encode())
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = _by_language(docs, candidates).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= words).orderBy("lang", "rank").collect()
    out: dict[str, dict] = {}
    for row in first.where("kind != 'word'").collect():
        own = out.setdefault(row.lang, {"classes": np.zeros(len(CLASSES)), "words": [], "counts": [], "total": 0})
        if row.kind == "words":
            own["total"] = row.n
        else:
            own["classes"][CLASSES.index(row.key)] = row.n
    for row in top:
        if row.n >= LEAST_SHARE * out[row.lang]["total"]:
            out[row.lang]["words"].append(row.key.encode())
            out[row.lang]["counts"].append(row.n)
    for own in out.values():
        own["classes"] = own["classes"] / max(1.0, own["classes"].sum())
        shares = np.array([*own.pop("counts"), 0], np.float64)
        shares[-1] = max(0, own["total"] - shares.sum())
        own["shares"] = shares / max(1.0, shares.sum())
    return {lang: out[lang] for lang in sorted(out)}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``, base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base measures of each text, and its byte histogram."""
    words, starts = common.split_words(texts)
    histograms = _histograms(texts)
    n_words = np.diff(starts)
    repeats = np.zeros(len(texts), np.int64)
    inner = common.inside(starts, 3)
    if inner.any():
        doc = common.doc_of(starts)
        places = np.flatnonzero(inner)
        keys = common.mix(common.window_hashes(common.word_hashes(words), 3)[places] + doc[places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = places[count[back] > 1]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[again + k] = True
        repeats = np.bincount(doc[covered], minlength=len(texts))
    dup_lines = []
    for x in texts:
        lines = [line for line in x.split(b"\n") if line.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    return {"n_words": n_words, "word_chars": histograms @ _word_chars, "n_symbols": histograms @ _symbols, "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": repeats, "histograms": histograms, "words": words, "starts": starts}


def bands_of(n: np.ndarray) -> np.ndarray:
    """Length band of texts of ``n`` words; -1 where the word test is silent."""
    return np.where(n >= WORD_GUARD, np.floor(BANDS * np.log2(np.maximum(n, WORD_GUARD) / WORD_GUARD)), -1).astype(np.int64)


def fences(found: dict[int, tuple[float, float, int]], none: float, last: int) -> list[float]:
    """The limit of each band up to ``last``. ``found``: lower quartile, median and number of distances by band."""
    own = {b: median + FENCE * max(median - low, LEAST_SPREAD * median) for b, (low, median, n) in found.items() if n >= BAND_TEXTS}
    # Shorter texts lie farther off: the next shorter band's fence is on the safe side, the next longer one's is the best there is.
    every = [own[max((x for x in own if x <= b), default=min(own))] if own else np.inf for b in range(last + 1)]
    reach = [min(2, b, last - b) for b in range(last + 1)]
    return [min(float(np.median(every[b - r : b + r + 1])), NO_WORDS * none) for b, r in enumerate(reach)]


def word_limits(rows: DataFrame, known: dict[str, dict]) -> list[tuple[str, int, float]]:
    """(language, band, limit) for every band that stands in ``rows``."""
    last = rows.agg(F.max("band")).first()[0]
    if last is None or last < 0:
        return []
    own = rows.where("labelled and not base_failed and band >= 0").select("word_lang", "band", "word_distance").distinct()
    quartiles = own.groupBy("word_lang", "band").agg(F.percentile_approx("word_distance", [0.25, 0.5], 10_000).alias("q"), F.count("*").alias("n"))
    found: dict[str, dict[int, tuple[float, float, int]]] = {}
    for row in quartiles.collect():
        found.setdefault(row.word_lang, {})[row.band] = (*row.q, row.n)
    out = []
    for lang, reference in known.items():
        none = np.zeros((1, len(reference["shares"])))
        none[0, -1] = 1
        limits = fences(found.get(lang, {}), float(distance(none, reference["shares"])[0]), last)
        out += [(lang, band, limit) for band, limit in enumerate(limits)]
    return out


def judged(texts: list[bytes], langs: list[str | None], known: dict[str, dict]) -> dict[str, np.ndarray]:
    """The measures; ``kept`` is the verdict before the word test, and ``word_lang`` the language that this test holds a text against."""
    base = base_counts(texts)
    n, words, starts = base["n_words"], base.pop("words"), base.pop("starts")
    failed = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * n)
    classes = base.pop("histograms") @ CLASS_OF
    classes /= np.maximum(1, classes.sum(1, keepdims=True))
    class_d, word_d = np.ones(len(texts)), np.ones(len(texts))
    nearest = np.full(len(texts), None, object)
    lower = [w.lower() if not w.islower() else w for w in words] if known else []
    tables = {lang: {w: i for i, w in enumerate(own["words"])} for lang, own in known.items()}
    for lang, own in known.items():
        at = np.array([i for i, x in enumerate(langs) if x == lang or x not in known], np.int64)
        if not len(at):
            continue
        table, rest = tables[lang], len(own["words"])
        shares = np.zeros((len(at), rest + 1))
        for row, i in enumerate(at.tolist()):
            got = [table.get(w, rest) for w in lower[starts[i] : starts[i + 1]]]
            shares[row] = np.bincount(got, minlength=rest + 1) if got else 0
        shares /= np.maximum(1, shares.sum(1, keepdims=True))
        class_d[at] = np.minimum(class_d[at], distance(classes[at], own["classes"]))
        apart = distance(shares, own["shares"])
        nearest[at[(apart < word_d[at]) | (nearest[at] == None)]] = lang  # noqa: E711
        word_d[at] = np.minimum(word_d[at], apart)
    strange = (n >= CLASS_GUARD) & (class_d > CLASS_LIMIT)
    return base | {"base_failed": failed, "kept": ~failed & ~(strange if known else np.zeros(len(texts), bool)), "class_distance": class_d, "word_distance": word_d, "word_lang": nearest, "band": bands_of(n), "labelled": np.array([x in known for x in langs], bool)}


def judge(docs: DataFrame) -> DataFrame:
    """The base measures, both distances and the verdict for every row."""
    common.ship(docs.sparkSession)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    known = references(docs)
    held = docs.sparkSession.sparkContext.broadcast(known)
    flags = ("base_failed", "kept", "class_distance", "word_distance", "band", "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in common.slices(batch):
                got = judged(texts, langs[start : start + len(texts)], held.value)
                columns = [*(pa.array(got[x].astype(np.int64)) for x in names), *(pa.array(got[x]) for x in flags), pa.array(got["word_lang"].tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *columns], ["doc_id", *names, *flags, "word_lang"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, class_distance double, word_distance double, band long, labelled boolean, word_lang string"
    rows = common.cut(docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, schema), "distances")
    limits = docs.sparkSession.createDataFrame(word_limits(rows, known), "word_lang string, band long, word_limit double")
    kept = F.col("kept") & ~F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return rows.join(F.broadcast(limits), ["word_lang", "band"], "left").select("doc_id", *names, "base_failed", kept.alias("kept"), "class_distance", "word_distance")
