"""Row selections, recodes and level orders of small series and marks; scalar summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def with_tokens(docs: DataFrame, stop: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Documents that have a token left, with their number as ``n_tokens``. Null text has none."""
    return docs.withColumn("n_tokens", F.coalesce(F.size(text.tokens(F.coalesce("text", F.lit("")), stop)), F.lit(0))).where("n_tokens > 0")


def within(rows: DataFrame, column: str, wanted: tuple[str, ...] | list[str], value: str, date: str, first: str, last: str) -> DataFrame:
    """Rows whose ``column`` is one of ``wanted``, whose ``value`` is known and whose ``date`` lies from ``first`` to ``last``."""
    day = F.col(date).cast("date")
    return rows.where(F.col(column).isin(*wanted) & F.col(value).isNotNull() & day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def recoded(column: Column, names: dict[str, str]) -> Column:
    """New names for some values; the others stay."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[column], column) if names else column


def levelled(rows: DataFrame, column: str, levels: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows whose value is a level, with its place among the levels (from 1) as ``level``."""
    place = F.array_position(F.array(*(F.lit(x) for x in levels)), F.col(column))
    return rows.withColumn("level", place).where("level > 0")


def either(*parts: DataFrame) -> DataFrame:
    """Rows of any of the parts, each once."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct()


def class_table(assigned: DataFrame, topic: str, group: str) -> DataFrame:
    """(topic, class, n): how often each topic stands in each class, with its share of the class."""
    counted = assigned.groupBy(F.col(topic).alias("topic"), F.col(group).alias("class")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("class").agg(F.sum("n").alias("total"))  # one row per class
    return counted.join(totals, "class").select("topic", "class", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
