"""Repeatable samples and chunks, ordered by a digest of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import checkpointed


def _order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def of_size(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows; the same ones whenever the rows are the same."""
    return rows.orderBy(_order(key, seed), key).limit(n)


def of_fraction(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A share of the rows, rounded half to even, but one at least if there are any."""
    total = rows.count()
    n = max(1, round(fraction * total)) if total else 0
    return of_size(rows, key, n, seed)


def chunks(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``chunk``: consecutive runs of ``size`` rows by ``order``, numbered from 0.

    Positions come in two steps: within ranges of the order columns, then over the ranges' sizes.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    before = sizes.select("_part", "_first", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_row") - F.col("_first")
    return numbered.join(before, "_part").withColumn("chunk", F.floor(place / size)).drop("_part", "_row", "_first", "_before")


def requests(rows: DataFrame, size: int, order: list[str], block: Column, heading: str = "") -> DataFrame:
    """(chunk, n, body): the rendered blocks of each chunk in order."""
    dealt = chunks(rows.withColumn("_block", block), size, *order)
    ordered = F.array_sort(F.collect_list(F.struct(*order, "_block")))
    return dealt.groupBy("chunk").agg(F.count("*").alias("n"), F.concat(F.lit(heading), F.array_join(F.transform(ordered, lambda x: x["_block"]), "\n")).alias("body"))
