"""Reading and writing article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("ID", "titles", "section", "origin", "dates", "text", "election_relevant")])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of articles, all strings, by header name; the unnamed row-number column is dropped, a missing one is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = without_unnamed(rows)
    return rows.select(*(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in ARTICLE))


def without_unnamed(rows: DataFrame) -> DataFrame:
    return rows.drop(*(c for c in rows.columns if c.startswith(("Unnamed", "_c")) or not c.strip()))


def read_texts(spark: SparkSession, folder: str, separator: str = "\n____________________________________________________________\n") -> DataFrame:
    """(file, at, body): files below a folder, cut into records at a separator line."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    parts = F.split("value", "\\Q" + separator + "\\E")
    return files.select(F.input_file_name().alias("file"), F.posexplode(parts).alias("at", "body")).where(F.trim("body") != "")


def fields(records: DataFrame, names: list[str]) -> DataFrame:
    """Header fields of the form ``Name: value`` at the start of a line, each as a column."""
    return records.select("*", *(F.nullif(F.regexp_extract("body", rf"(?m)^{n}:[ \t]*(.*)$", 1), F.lit("")).alias(n.lower().replace(" ", "_")) for n in names))


def write_csv(rows: DataFrame, path: str, names: list[str] | None = None) -> None:
    """With ``names``: exactly these columns in this order; missing ones are empty, others are left out."""
    if names is not None:
        rows = rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))
    rows.write.option("header", True).option("escape", '"').csv(path)


def cached_vectors(spark: SparkSession, docs: DataFrame, encode, folder: str, model: str) -> DataFrame:
    """(doc_id, embedding): vectors by a function over pandas batches, kept by model, ids and texts."""
    key = docs.agg(F.md5(F.concat(F.lit(model + "|"), F.bit_xor(F.xxhash64("doc_id", "text")).cast("string"), F.lit("|"), F.count("*").cast("string")))).first()[0]
    path = f"{folder.rstrip('/')}/{key[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        docs.select("doc_id", "text").mapInPandas(encode, "doc_id long, embedding array<float>").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
