"""From raw articles to a usable corpus: filters, outlet names, dates, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, values
from . import counting


def usable(articles: DataFrame) -> DataFrame:
    """Rows with text, its spacing repaired."""
    return articles.where(F.col("text").isNotNull() & ~F.trim("text").isin(*values.UNUSABLE)).withColumn("text", text.spacing_repaired(F.col("text")))


def is_page_junk(title: Column) -> Column:
    return F.coalesce(title.rlike(values.PAGE_JUNK), F.lit(False))


def is_letter(section: Column, title: Column) -> Column:
    by_section = F.lower(F.regexp_replace(section, r"\s", "")).contains("letter")
    return F.coalesce(by_section, F.lit(False)) | F.coalesce(title.rlike(values.LETTER_TITLE), F.lit(False))


def without_junk(articles: DataFrame) -> DataFrame:
    return articles.where(~is_page_junk(F.col("titles")) & ~is_letter(F.col("section"), F.col("titles")))


def with_outlet(articles: DataFrame) -> DataFrame:
    origin = F.col("origin")
    return articles.withColumns({"outlet": text.outlet(origin), "family": text.outlet_family(origin), "is_online": text.is_online(origin)})


def dated(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a date in range and its week, the others for diagnosis)."""
    rows = articles.withColumn("date", dates.patched(F.col("dates")))
    good = F.coalesce(dates.in_range(F.col("date")), F.lit(False))
    return rows.where(good).withColumn("week", dates.monday(F.col("date"))), rows.where(~good)


def relevant(articles: DataFrame, column: str = "election_relevant") -> DataFrame:
    """Rows marked yes; a table without the mark passes whole."""
    if column not in articles.columns:
        return articles
    return articles.where(F.coalesce(F.trim(F.lower(column)) == "yes", F.lit(False)))


def signal_counts(docs: DataFrame, key: str = "doc_id", rest: dict | None = None, gated: dict | None = None, context: dict | None = None, other: dict | None = None) -> DataFrame:
    """Per document: hits of the signal, of its gated word, of the words that open the gate, and of the other side."""
    parts = {"rest": rest or values.PROVINCIAL, "gated": gated or values.GATED, "context": context or values.CONTEXT, "other": other or values.FEDERAL}
    joined = {f"{part}/{name}": patterns for part, table in parts.items() for name, patterns in table.items()}
    hits = counting.counts(docs, joined, key).groupBy(key).agg(*(F.sum(F.when(F.col("key").startswith(f"{p}/"), F.col("mentions")).otherwise(0)).alias(p) for p in parts))
    return docs.select(key).join(hits, key, "left").select(key, *(F.coalesce(p, F.lit(0)).alias(p) for p in parts))


def signal_filter(docs: DataFrame, key: str = "doc_id", **dictionaries: dict) -> DataFrame:
    """Keys of documents whose signal outweighs the other side; the gated word counts only beside a context word."""
    n = signal_counts(docs, key, **dictionaries)
    return n.where(F.col("rest") + F.when(F.col("context") > 0, F.col("gated")).otherwise(0) > F.col("other"))


def first_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def left_join_first(left: DataFrame, right: DataFrame, key: str, *order: Column) -> DataFrame:
    """Left join on the first right row of each key; null keys match nothing."""
    return left.join(first_per_key(right, key, *order), key, "left")
