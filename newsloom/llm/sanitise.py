"""Personal data: patterns, and terms that give a protected entity away.

The base finds e-mail addresses, IP addresses, card numbers and telephone numbers. Each of their values is
a protected entity. Over the whole corpus it is counted in how many documents an entity stands, in how many of
them a term stands too, anywhere in the text, and in how many documents the term stands at all. With N documents, the
pointwise mutual information of entity e and term t, as a share of all there is to know of e, is

    PMI(e; t) / IC(e) = 1 - ln(1 / P(e | t)) / ln(N / n(e)),    P(e | t) = (n(e, t) + a P(e)) / (df(t) + a), P(e) = n(e) / N.

In a document that holds e, terms whose share reaches ``DISCLOSURE`` are generalised too. ``PRIOR`` (a) documents in
which e is as frequent as anywhere stand against chance: few documents tell less than many, but no number of them is
too small to decide.

A term is a run of three letters or more that touches no base span. The work runs the same way at every size: texts that hold
entities (few, found by a pattern that no base span escapes) are gathered with their terms, equal texts once; one pass over
all texts counts the documents of these terms, which a bit field of fixed size picks out; pairs are made of terms
rare enough to tell something, counted before they move; and what a text may not say comes back by its 64-bit hash, as equal texts have
the same entities.

Null text is empty. An empty table gives no rows. Rows are treated each for itself, whatever their doc_id (null and repeated ones
included); repeated rows count as often as they stand. Extra columns are kept by ``sanitise`` and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PRIOR = 1.0
DISCLOSURE = 0.8
#: Bits of the field that marks the terms to count (4 MB). Terms that share a bit are counted too, and left out by the join that follows.
FIELD_BITS = 1 << 25
#: Terms that one task counts before it hands them on.
COUNTED_TERMS = 200_000

_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\W\d_]{3,}")
#: Every text with a base span has an @ or matches this; few others do.
_MAYBE = r"[0-9][\x20().0-9-]{5,}[0-9]"
_NOT_DIGITS = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    """A match's local part is the run of its characters that ends at an @, from the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1] in "._%+-" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
            begin -= 1
        found = _domain.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end(), "email"
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(raw: bytes) -> list[Span]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    has_digits = bool(raw.translate(None, _NOT_DIGITS))
    if b"@" not in raw and not has_digits:
        return []
    text = raw.decode("utf-8", "replace")
    out = list(_emails(text)) if "@" in text else []
    if has_digits:
        for m in _ip.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _key(value: str) -> int:
    """Signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


def _entity(text: str, span: Span) -> int:
    return _key(f"{span[2]}:{text[span[0] : span[1]].lower()}")


def _free(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """Words that touch no span. ``spans`` ascend by start."""
    i, end = 0, -1  # the spans before i begin left of the word; the furthest of them ends at ``end``
    for m in _word.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            end = max(end, spans[i][1])
            i += 1
        if end <= m.start():
            yield m


def _maybe() -> Column:
    return F.coalesce(F.contains("text", F.lit("@")) | F.col("text").rlike(_MAYBE), F.lit(False))


def _holding(docs: DataFrame) -> DataFrame:
    """(key, n, entities, terms): each text with an entity once, and the number of rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            rows: dict[int, list] = {}
            for start, texts in common.slices(batch):
                for key, raw in zip(keys[start:], texts, strict=False):
                    if key in rows:
                        rows[key][0] += 1
                    elif spans := base_spans(raw):
                        text = raw.decode("utf-8", "replace")
                        words = {m[0].lower() for m in _free(text, spans)}
                        rows[key] = [1, list({_entity(text, x) for x in spans}), [_key(w) for w in words]]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), *(pa.array([x[i] for x in rows.values()], kind) for i, kind in enumerate((pa.int64(), lists, lists)))], ["key", "n", "entities", "terms"])

    found = docs.where(_maybe()).select(F.xxhash64("text").alias("key"), "text").mapInArrow(run, "key long, n long, entities array<long>, terms array<long>")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))


def _field(terms: DataFrame) -> bytes:
    """Bits of the terms; at most FIELD_BITS / 64 rows come to the driver."""
    at = F.col("term").bitwiseAND(FIELD_BITS - 1)
    words = terms.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 63 AS INT))")).alias("bits")).toArrow()
    field = np.zeros(FIELD_BITS // 64, np.int64)
    field[words["at"].to_numpy()] = words["bits"].to_numpy()
    return field.astype("<i8").tobytes()


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) over all documents for the given terms, and for some more."""
    field = docs.sparkSession.sparkContext.broadcast(_field(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.settle()
        wanted, keys, counts = field.value, {}, {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for _, texts in common.slices(batch):
                for raw in texts:
                    mine = set()
                    for chunk in set(raw.split()):
                        own = keys.get(chunk)
                        if own is None:
                            words = [_key(w.lower()) for w in _word.findall(chunk.decode("utf-8", "replace"))]
                            own = tuple(k for k in words if wanted[(k & (FIELD_BITS - 1)) >> 3] >> (k & 7) & 1)
                            if len(keys) > common.WORD_CACHE:
                                keys.clear()
                            if len(chunk) <= 64:
                                keys[chunk] = own
                        mine.update(own)
                    for k in mine:
                        counts[k] = counts.get(k, 0) + 1
                if len(counts) > COUNTED_TERMS:
                    yield counted()
                    counts = {}
        yield counted()

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _told(docs: DataFrame, share: float = DISCLOSURE) -> DataFrame:
    """(key, entity, term) for the texts that hold an entity and a term that tells too much about it."""
    common.ship(docs.sparkSession)
    held, total = common.cut(_holding(docs), "holding"), F.lit(float(docs.count()))

    def most(n: Column) -> Column:
        # The share reaches its limit up to a document frequency that the pair alone gives.
        chance = F.col("n_entity") / total
        return (n + PRIOR * chance) / F.pow(chance, F.lit(1 - share)) - PRIOR

    entities = held.select("key", "n", F.explode("entities").alias("entity"))
    alone = entities.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    # An entity that stands in every document has nothing to tell.
    entities = entities.join(alone, "entity").where(F.col("n_entity") < total)
    entities = common.cut(entities.select("key", "entity", "n_entity"), "entities")
    reach = entities.groupBy("key").agg(F.max(most(F.col("n_entity"))).alias("reach"))
    terms = held.select("key", "n", F.explode("terms").alias("term"))
    counts = common.cut(_document_counts(docs, terms), "term-counts")
    rare = common.cut(terms.join(counts, "term").join(reach, "key").where("df <= reach").select("key", "n", "term", "df"), "rare-terms")
    common.drop(counts, held)
    pairs = rare.join(entities, "key")
    telling = pairs.groupBy("entity", "term", "n_entity", "df").agg(F.sum("n").alias("n")).where(F.col("df") <= most(F.col("n"))).select("entity", "term")
    told = common.cut(pairs.select("key", "entity", "term").join(telling, ["entity", "term"]), "telling")
    common.drop(rare, entities)
    return told


def disclosing(docs: DataFrame, share: float = DISCLOSURE) -> DataFrame:
    """(entity, term): terms that tell too much about an entity."""
    return _told(docs, share).select("entity", "term").distinct()


def all_spans(raw: bytes, terms: Iterable[int]) -> tuple[list[Span], list[Span], str]:
    """(base spans, all spans, text). ``terms``: those that this document may not say."""
    base = base_spans(raw)
    text = raw.decode("utf-8", "replace") if base else ""
    if not base or not terms:
        return base, base, text
    told = set(terms)
    more = [(m.start(), m.end(), "term") for m in _free(text, base) if _key(m[0].lower()) in told]
    rank = (*KINDS, "term")
    return base, sorted(base + more, key=lambda s: (s[0], rank.index(s[2]), s[1])), text


def replaced(text: str, spans: list[Span]) -> str:
    """Every span gives way to its kind's name; of overlapping spans the one that begins first takes all they cover."""
    out, at, last = [], 0, -1
    for begin, end, kind in spans:
        if begin < last:
            at = last = max(last, end)
            continue
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = last = end
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may hold base spans, with what they may not say in ``_terms``; and the others."""
    terms = _told(docs).groupBy(F.col("key").alias("_text")).agg(F.collect_set("term").alias("_terms"))
    maybe = docs.where(_maybe()).withColumn("_text", F.xxhash64("text"))
    return maybe.join(terms, "_text", "left").select(*docs.columns, "_terms"), docs.where(~_maybe())


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans for every row."""
    maybe, others = _parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    columns = ("n_email", "n_ip", "n_card", "n_phone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("_terms").to_pylist()
            for start, texts in common.slices(batch):
                found = [all_spans(raw, own[i] or ()) for i, raw in enumerate(texts, start)]
                counts = [pa.array([sum(s[2] == kind for s in base) for base, _, _ in found], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), *counts, digest, pa.array([_joined(x) for _, x, _ in found], pa.string())], ["doc_id", *columns, "base_sha256", "spans"])

    some = maybe.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in columns) + ", base_sha256 string, spans string")
    none = hashlib.sha256(b"").hexdigest()
    return some.unionByName(others.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in columns), F.lit(none).alias("base_sha256"), F.lit("").alias("spans")))


def sanitise(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the spans of ``text`` replaced. ``n_chars``, where there is one, follows."""
    maybe, others = _parts(docs)
    text_at = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("_terms").to_pylist()
            old, new = batch.column("text"), []
            for start, texts in common.slices(batch):
                for i, raw in enumerate(texts, start):
                    _, spans, text = all_spans(raw, own[i] or ())
                    new.append(replaced(text, spans) if spans else old[i].as_py())
            columns = [batch.column(i) for i in range(len(schema))]
            columns[text_at] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = maybe.mapInArrow(run, schema).unionByName(others)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
