import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import vectors
from newsloom.operators import topics


def plain(queries, rows, n):
    asked = queries.select(F.col("vec_id").alias("vec_i"), F.col("embedding").alias("e"))
    pairs = asked.crossJoin(rows).where("vec_i != vec_id").select("vec_i", F.col("vec_id").alias("vec_j"), F.round(topics.cosine(F.col("e"), F.col("embedding")), 6).alias("cosine"))
    order = Window.partitionBy("vec_i").orderBy(F.desc("cosine"), "vec_j")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_equals_the_plain_way(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 360)] + [(i, [i / 100.0] * 8) for i in range(360, 380)]  # equal ones and multiples
    rows += [(400, [0.0] * 8), (401, [0.0] * 8), (402, None), (403, [1.0, None] * 4), (404, [1.0] * 3), (10, [1.0] * 8), (11, [1.0] * 8), (11, [1.0] * 8), (None, [1.0] * 8), (450, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = table.where("vec_id % 10 = 0")
    as_rows = lambda df: sorted((r.vec_i, r.vec_j, str(r.cosine)) for r in df.collect())
    assert as_rows(topics.nearest(asked, table, 10, block)) == as_rows(plain(asked, table, 10))


def test_nearest_multiplies_matrices(spark):
    """Ten thousand pairs a vector were summed one number at a time before."""
    table = spark.range(1, 2001).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (i + 1)).cast("float") for i in range(4))).alias("embedding"))
    plan = topics.nearest(table.where("vec_id % 50 = 0"), table, 10)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_rounding_is_that_of_spark(spark):
    x = np.array([0.1234565, 0.1234575, -0.1234565, 0.9999995, 0.0000005, 1.0, 0.12345649999])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()
    assert [r[0] for r in rows] == list(vectors.rounded(x) / 1e6)
