"""Dictionary lookup over token streams, and the counts built on it.

Python workers find the tokens of many texts at once, the tokens that fit a word of some pattern, and the phrases among them;
no token is a row. Where a document's key repeats, or is null, its rows are one document: these few go through the plans
that deal hits by key.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, words
from ..functions.shared import checkpointed, ship


def token_rows(docs: DataFrame, key: str = "doc_id", stop: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(key, pos, tok), positions from 0."""
    return docs.select(key, F.posexplode(text.tokens(F.col("text"), stop)).alias("pos", "tok"))


#: Entries that a worker counts up before it hands them on.
HELD = 300_000


def term_counts(docs: DataFrame, key: str = "doc_id", stop: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(key, term, tf): how often each document has each of its tokens."""
    single, again = apart(docs, key)
    ship(docs.sparkSession)
    gone = frozenset(stop)

    def count(batches):
        for batch in batches:
            rows, terms, tfs = [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                found = Counter(words.tokens(body))
                for word in gone & found.keys():
                    del found[word]
                rows += [i] * len(found)
                terms += found.keys()
                tfs += found.values()
                if len(terms) > HELD or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], [key, "term", "tf"])
                    rows, terms, tfs = [], [], []

    kind = docs.schema[key].dataType.simpleString()
    tf = single.select(key, "text").mapInArrow(count, f"`{key}` {kind}, term string, tf long")
    return tf if again is None else tf.unionByName(token_rows(again, key, stop).groupBy(key, F.col("tok").alias("term")).agg(F.count("*").alias("tf")))


def class_counts(docs: DataFrame, group: str | None, stop: tuple[str, ...] | list[str] = (), key: str = "doc_id", nulls: bool = False) -> DataFrame:
    """(class, term, tf, df): of each value of ``group`` (none: null) and each token its number and that of its documents.

    Workers count their own texts up, so few rows move. Rows without a key are one document (``nulls``) or none.
    """
    label = F.col(group) if group else F.lit(None).cast("string")
    single, again = apart(docs, key)
    ship(docs.sparkSession)
    gone = frozenset(stop)

    def handed(held):
        columns = [[], [], [], []]
        for name, (tf, df) in held.items():
            columns[0] += [name] * len(tf)
            columns[1] += tf.keys()
            columns[2] += tf.values()
            columns[3] += [df[word] for word in tf]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["class", "term", "tf", "df"])

    def count(batches):
        held: dict = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tf, df = held.setdefault(name, (Counter(), Counter()))
                found = words.tokens(body)
                if gone:
                    found = [x for x in found if x not in gone]
                tf.update(found)
                df.update(set(found))
                if len(tf) > HELD:
                    yield handed(held)
        if held:
            yield handed(held)

    kind = "class string, term string, tf long, df long"
    parts = single.select(label.cast("string").alias("class"), "text").mapInArrow(count, kind)
    if again is not None:
        rows = again.select(F.col(key).alias("_key"), label.cast("string").alias("class"), F.explode(text.tokens(F.col("text"), stop)).alias("term"))
        # A document of several rows counts once, in one of its classes.
        once = rows.groupBy("_key", "class", "term").agg(F.count("*").alias("tf")).withColumn("nth", F.row_number().over(Window.partitionBy("_key", "term").orderBy("class")))
        parts = parts.unionByName(once.select("class", "term", "tf", F.when((F.col("nth") == 1) & (F.lit(nulls) | F.col("_key").isNotNull()), 1).otherwise(0).cast("long").alias("df")))
    return parts.groupBy("class", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _pattern_words(dictionary: dict[str, list[str]]) -> list[tuple]:
    """(key, pattern, place, length, word, is a beginning)."""
    out = []
    for name, patterns in dictionary.items():
        for pattern in patterns:
            parts = [w for w in pattern.lower().replace("'", " ").replace("-", " ").split() if w]
            out += [(name, pattern, i, len(parts), w.split("*")[0], "*" in w) for i, w in enumerate(parts)]
    return out


def _fitting(docs: DataFrame, pattern_words: list[tuple], key: str, stop: tuple[str, ...] | list[str]) -> DataFrame:
    """(key, pos, word, is_start) for the tokens that fit a pattern word; the others are left in their array."""
    exact, starts = sorted({w[4] for w in pattern_words if not w[5]}), sorted({w[4] for w in pattern_words if w[5]})

    def fits(tok: Column) -> Column:
        able = tok.isin(exact)
        for start in starts:
            able = able | F.startswith(tok, F.lit(start))
        return able

    seen = lambda word, is_start: F.struct(word.alias("word"), F.lit(is_start).alias("is_start"))
    placed = F.transform(text.tokens(F.col("text"), stop), lambda tok, pos: F.when(fits(tok), F.struct(pos.alias("pos"), tok.alias("tok"))))
    rows = docs.select(key, F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("x")).select(key, "x.pos", "x.tok")
    found = F.array(seen(F.col("tok"), False))
    if starts:
        begun = F.filter(F.array(*(F.lit(s) for s in starts)), lambda s: F.startswith(F.col("tok"), s))
        found = F.concat(found, F.transform(begun, lambda s: seen(s, True)))
    return rows.select(key, "pos", F.explode(found).alias("w")).select(key, "pos", "w.*")


def apart(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key is theirs alone, the other rows or None): only the key is read to tell."""
    again = docs.groupBy(F.col(key).alias("_again")).count().where("count > 1 or _again is null").select("_again")
    if again.isEmpty():
        return docs, None
    again = checkpointed(again)
    same = F.col(key).eqNullSafe(F.col("_again"))
    return docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")


def _mapped(docs: DataFrame, dictionary: dict[str, list[str]], key: str, stop: tuple[str, ...] | list[str], nested: str, counted: bool) -> DataFrame:
    """Spans, or mentions of each document and dictionary key, of rows that are a document each."""
    looked_up, keys, patterns, stop = _pattern_words(dictionary), sorted(dictionary), sorted({p for ps in dictionary.values() for p in ps}), tuple(stop)
    ship(docs.sparkSession)

    def find(batches):
        names, shapes = pa.array(keys, pa.string()), pa.array(patterns, pa.string())
        for batch in batches:
            for start, texts in words.slices(batch.column(1).to_pylist()):
                toks = words.Tokens(texts, stop)
                first, last, k, pattern = words.spans(toks, looked_up, nested)
                if counted:
                    cells, n = np.unique(toks.doc[first] * len(keys) + k, return_counts=True)
                    columns = [batch.column(0).take(pa.array(start + cells // len(keys))), names.take(pa.array(cells % len(keys))), pa.array(n.astype(np.int64))]
                else:
                    columns = [batch.column(0).take(pa.array(start + toks.doc[first])), names.take(pa.array(k)), shapes.take(pa.array(pattern)), pa.array(toks.pos(first).astype(np.int32)), pa.array(toks.pos(last).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [key, "key", *(["mentions"] if counted else ["pattern", "first", "last"])])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(find, f"`{key}` {kind}, key string, " + ("mentions long" if counted else "pattern string, first int, last int"))


def lookup(docs: DataFrame, dictionary: dict[str, list[str]], key: str = "doc_id", stop: tuple[str, ...] | list[str] = (), nested: str = "key") -> DataFrame:
    """Hits as spans of token positions.

    A hit inside a longer hit counts once: within one dictionary key, or (nested="dictionary") across all of them.
    The columns are: the document key, ``key``, ``pattern``, ``first``, ``last``.
    """
    single, again = apart(docs, key)
    hits = _mapped(single, dictionary, key, stop, nested, counted=False)
    return hits if again is None else hits.unionByName(_dealt(again, dictionary, key, stop, nested))


def counts(docs: DataFrame, dictionary: dict[str, list[str]], key: str = "doc_id", stop: tuple[str, ...] | list[str] = (), nested: str = "key") -> DataFrame:
    """(document key, ``key``, ``mentions``) for each document with a hit: the hits of ``lookup``, counted where they are found."""
    single, again = apart(docs, key)
    counted = _mapped(single, dictionary, key, stop, nested, counted=True)
    return counted if again is None else counted.unionByName(_dealt(again, dictionary, key, stop, nested).groupBy(key, "key").agg(F.count("*").alias("mentions")))


def _dealt(docs: DataFrame, dictionary: dict[str, list[str]], key: str, stop: tuple[str, ...] | list[str], nested: str) -> DataFrame:
    """The hits of documents that may be several rows."""
    pattern_words = _pattern_words(dictionary)
    spec = docs.sparkSession.createDataFrame([(w[0], w[1], w[2], w[3], w[4], w[5]) for w in pattern_words], "key string, pattern string, place int, length int, word string, is_start boolean")
    hits = _fitting(docs, pattern_words, key, stop).join(F.broadcast(spec), ["word", "is_start"])  # the dictionary is a literal
    whole = hits.groupBy(key, "key", "pattern", "length", (F.col("pos") - F.col("place")).alias("first")).agg(F.countDistinct("place").alias("met")).where("met = length")
    spans = whole.select(key, "key", "pattern", "first", (F.col("first") + F.col("length") - 1).alias("last"))
    return outermost(spans, [key, "key"] if nested == "key" else [key]).select(key, "key", "pattern", "first", "last")


def outermost(spans: DataFrame, within: list[str]) -> DataFrame:
    """Spans that lie in no longer span of the same group; equal spans of one dictionary key count once."""
    one = spans.groupBy(*dict.fromkeys([*within, "key"]), "first", "last").agg(F.min("pattern").alias("pattern"))
    # A span lies in another if one that begins before it reaches as far, or one that begins with it reaches farther.
    earlier = F.max("last").over(Window.partitionBy(*within).orderBy("first").rangeBetween(Window.unboundedPreceding, -1))
    beside = F.max("last").over(Window.partitionBy(*within, "first"))
    kept = one.withColumns({"_earlier": earlier, "_beside": beside}).where((F.coalesce("_earlier", F.lit(-1)) < F.col("last")) & (F.col("_beside") == F.col("last")))
    return kept.drop("_earlier", "_beside")


def totals(counted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per dictionary key, from ``counts``: mentions, documents with a mention, rank by mentions."""
    counted = counted.groupBy("key").agg(F.sum("mentions").alias("mentions"), F.countDistinct(key).alias("articles"))
    return counted.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mentions"))))  # one row per dictionary key


def by_week(counted: DataFrame, docs: DataFrame, date: Column, names: list[str], key: str = "doc_id") -> DataFrame:
    """(week, key, mentions, articles), from ``counts``, for every week of the corpus and every dictionary key, zeros included."""
    dated = docs.select(key, dates.monday(date).alias("week"))
    found = counted.join(dated, key).groupBy("week", "key").agg(F.sum("mentions").alias("mentions"), F.countDistinct(key).alias("articles"))
    grid = dated.select("week").distinct().select("week", F.explode(F.array(*(F.lit(n) for n in names))).alias("key"))
    return grid.join(found, ["week", "key"], "left").select("week", "key", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("articles", F.lit(0)).alias("articles"))


def shares(weekly: DataFrame, group: str = "week", value: str = "mentions") -> DataFrame:
    """The share of each row in its group's total; null where the total is nought."""
    total = F.sum(value).over(Window.partitionBy(group))
    return weekly.withColumn("share", F.round(F.try_divide(F.col(value), F.nullif(total, F.lit(0))), 6))


def wide(weekly: DataFrame, names: list[str], value: str = "mentions") -> DataFrame:
    return weekly.groupBy("week").pivot("key", names).agg(F.sum(value))


def long(table: DataFrame, names: list[str], value: str = "mentions") -> DataFrame:
    return table.unpivot("week", names, "key", value)


def in_context(docs: DataFrame, keyword: str, window: int = 6, key: str = "doc_id") -> DataFrame:
    """(key, pos, before, keyword, after) for every place of a keyword."""
    toks = F.col("toks")
    rows = docs.select(key, text.tokens(F.col("text")).alias("toks"))
    places = F.filter(F.transform(toks, lambda t, i: F.when(t == keyword, i)), lambda i: i.isNotNull())
    found = rows.select(key, "toks", F.explode(places).alias("pos"))
    first = F.greatest(F.col("pos") - window, F.lit(0))
    before = F.slice(toks, first + 1, F.col("pos") - first)
    after = F.slice(toks, F.col("pos") + 2, F.lit(window))
    return found.select(key, "pos", F.array_join(before, " ").alias("before"), F.lit(keyword).alias("keyword"), F.array_join(after, " ").alias("after"))


def split_topics(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Topics of ;-separated lists, counted over all given columns."""
    parts = [df.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.explode(F.split(c, ";")).alias("topic")) for df, c in columns]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(F.trim("topic").alias("topic")).agg(F.count("*").alias("mention_count"))
