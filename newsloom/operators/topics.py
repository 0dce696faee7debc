"""Topics: class-based term weights, assignment to centroids, labels by seed words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values, vectors as arrays
from ..functions.shared import checkpointed, ship
from . import counting


def class_term_weights(docs: DataFrame, least_docs: int = 5) -> DataFrame:
    """(class, term, tf, weight) from (doc_id, class, text): tf * ln(1 + A / f), A the mean tokens of a class, f the term's total."""
    counted = checkpointed(counting.class_counts(docs, "class"))  # read three times below
    every = counted.groupBy("term").agg(F.sum("tf").alias("f"), F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    tf = counted.select("class", "term", "tf").join(every, "term")
    mean = tf.groupBy("class").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("a")).first()["a"] or 0.0
    return tf.select("class", "term", "tf", F.round(F.col("tf") * F.ln(1 + F.lit(float(mean)) / F.col("f")), 6).alias("weight"))


def top_per_class(weights: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("class").orderBy(F.desc("weight"), "term")
    return weights.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, vectors: DataFrame, n: int, block: int = 20_000) -> DataFrame:
    """(vec_i, vec_j, cosine): of each query the ``n`` most similar other vectors; of equal ones the smaller id.

    A stated query set against all vectors. Equal vectors are one, with its n + 1 smallest ids, as no others can be chosen.
    The queries are broadcast in blocks of about ``block``; each block is one pass over the vectors, multiplied as matrices,
    and a task returns only its best n + 1 for each query. Vectors without a cosine take the plain way.
    """
    known = vectors.where("vec_id is not null").groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "copies")))
    lists = known.withColumn("nth", nth).where(F.col("nth") <= n + 1).groupBy("embedding").agg(ids.alias("ids"))
    norm = F.when(~F.exists("embedding", lambda x: x.isNull()), dot(F.col("embedding"), F.col("embedding")))
    plain = lambda df: df.withColumns({"size": F.size("embedding"), "regular": F.coalesce(norm.between(1e-30, 1e30), F.lit(False))})
    lists = checkpointed(plain(lists).withColumn("v", F.monotonically_increasing_id()).withColumn("first", F.col("ids")[0]["vec_id"]))
    asked = checkpointed(plain(queries.select("embedding").distinct()).withColumn("q", F.monotonically_increasing_id()))
    usual = asked.where("regular").groupBy("size").count().orderBy(F.desc("count"), "size").first()
    fit = F.col("regular") & (F.col("size") == (usual["size"] if usual else -1))
    total = usual["count"] if usual else 0
    blocks = -(-total // block)
    best = [_searched(asked.where(fit & (F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)), lists.where(fit), n + 1) for i in range(blocks)]
    q, v = asked.select("q", F.col("embedding").alias("e"), fit.alias("fit")), lists.select("v", "first", "embedding", fit.alias("fits"))
    others = [(q.where("not fit"), v), (q.where("fit"), v.where("not fits"))]
    best += [a.crossJoin(b).select("q", "v", "first", cosine(F.col("e"), F.col("embedding")).alias("cosine")) for a, b in others if not a.isEmpty() and not b.isEmpty()]
    if not best:
        return queries.select(F.col("vec_id").alias("vec_i"), F.col("vec_id").alias("vec_j"), F.lit(0.0).alias("cosine")).limit(0)
    found = reduce(DataFrame.unionByName, best).withColumn("cosine", F.round("cosine", 6))
    few = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "first"))).where(F.col("nth") <= n + 1)
    wide = few.select("q", "v", "cosine").join(lists.select("v", F.explode("ids").alias("x")), "v").select("q", "cosine", F.col("x.vec_id").alias("vec_j"), F.explode(F.array_repeat(F.lit(0), F.col("x.copies"))).alias("_copy"))
    named = queries.select("vec_id", F.col("embedding").alias("e")).join(asked.select("q", "embedding"), F.col("e").eqNullSafe(F.col("embedding"))).select("q", F.col("vec_id").alias("vec_i"))
    pairs = named.join(wide, "q").where("vec_i != vec_j").select("vec_i", "vec_j", "cosine")
    order = Window.partitionBy("vec_i").orderBy(F.desc("cosine"), "vec_j")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def _searched(asked: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(q, v, first, cosine): of each partition of ``lists`` the ``k`` nearest to each query, by rounded cosine, then by first id."""
    spark = lists.sparkSession
    ship(spark)
    rows = asked.select("q", "embedding").toArrow()
    held = spark.sparkContext.broadcast((rows.column("q").to_numpy(), arrays.matrix(rows.column("embedding"))))

    def search(batches):
        return arrays.search(batches, *held.value, k)

    few = lists.select("v", "first", "embedding").coalesce(max(1, spark.sparkContext.defaultParallelism))
    return few.mapInArrow(search, "q long, v long, first long, cosine double")


def centroids(vectors: DataFrame, group: str = "label") -> DataFrame:
    """(group, centroid): mean vector of each group."""
    parts = vectors.select(group, F.posexplode("embedding").alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid"))


def assigned(vectors: DataFrame, centres: DataFrame, group: str = "label", least: float | None = None) -> DataFrame:
    """(vec_id, topic, cosine): the nearest centroid; below ``least`` the topic is -1.

    Centroids, one per topic, are gathered in one array that every row compares itself with.
    """
    every = centres.select(F.struct(F.col(group).alias("topic"), "centroid").alias("c")).agg(F.collect_list("c").alias("cs"))
    scored = vectors.join(F.broadcast(every)).select("vec_id", F.transform("cs", lambda c: F.struct(F.round(cosine(F.col("embedding"), c["centroid"]), 6).alias("cosine"), (-c["topic"]).alias("minus"))).alias("s"))
    best = F.array_max("s")
    topic = -best["minus"]
    if least is not None:
        topic = F.when(best["cosine"] >= least, topic).otherwise(F.lit(-1))
    return scored.select("vec_id", topic.alias("topic"), best["cosine"].alias("cosine"))


def seed_labels(top_words: DataFrame, seeds: dict[str, list[str]] | None = None) -> DataFrame:
    """(class, label, overlap): the seed list that shares most top words; the first list wins ties, none if nothing is shared."""
    lists = list((seeds or values.SEEDS).items())
    words = top_words.groupBy("class").agg(F.collect_set("term").alias("words"))
    shared = F.array(*(F.struct(F.size(F.array_intersect("words", F.array(*(F.lit(w) for w in ws)))).alias("overlap"), F.lit(-i).alias("first"), F.lit(name).alias("label")) for i, (name, ws) in enumerate(lists)))
    best = words.select("class", F.array_max(shared).alias("best"))
    return best.where("best.overlap > 0").select("class", "best.label", "best.overlap")


def sizes(assigned_rows: DataFrame, exclude: tuple[int, ...] = (-1, 0), n: int = 12) -> DataFrame:
    """The n largest topics to show; topics in ``exclude`` are left out."""
    return assigned_rows.where(~F.col("topic").isin(*exclude)).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(n)


def reduced(centres: DataFrame, counts: DataFrame, n: int, group: str = "label") -> dict[int, int]:
    """Merge the closest centroids until n topics are left: old topic -> new topic. Works on one row per topic."""
    rows = {r[group]: (list(r["centroid"]), r["n"]) for r in centres.join(counts, group).collect()}
    name = {k: k for k in rows}

    def near(a: list[float], b: list[float]) -> float:
        top = sum(x * y for x, y in zip(a, b, strict=True))
        return top / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)

    while len(rows) > n:
        _, a, b = max((near(rows[a][0], rows[b][0]), -a, -b) for a in rows for b in rows if a < b)
        a, b = -a, -b
        (va, na), (vb, nb) = rows[a], rows.pop(b)
        rows[a] = ([(x * na + y * nb) / (na + nb) for x, y in zip(va, vb, strict=True)], na + nb)
        name = {k: a if v == b else v for k, v in name.items()}
    return name
