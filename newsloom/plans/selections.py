"""Further registered queries: selections, recodes, real dictionaries, spot checks and second-pass results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import cleaning, counting, reviews, sampling, selecting, topics
from .catalog import CENTRES, DATED, REPAIRED, STOP_SQL, TOKS, article_date, articles, query, spans_sql, table

PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "normal", "4-NOT SPECIFIED": "normal"}
LEVELS = ("urgent", "high", "normal")
_RECODE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PRIORITIES.items())


def _counted(dictionary: dict[str, list[str]]) -> str:
    names = ", ".join(f"('{k}')" for k in dictionary)
    return f"WITH {TOKS}, {spans_sql(dictionary)}, c AS (SELECT key, count(*) AS mentions, count(DISTINCT doc_id) AS articles FROM spans GROUP BY key) SELECT key, coalesce(mentions, 0) AS mentions, coalesce(articles, 0) AS articles FROM (VALUES {names}) k(key) LEFT JOIN c USING (key)"


def _count(spark, sf_dir, dictionary):
    counted = counting.counts(table(spark, sf_dir, "documents"), dictionary).groupBy("key").agg(F.sum("mentions").alias("mentions"), F.countDistinct("doc_id").alias("articles"))
    names = spark.createDataFrame([(k,) for k in dictionary], "key string")
    return names.join(counted, "key", "left").select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("mentions", "articles")))


@query(_counted(values.ISSUES))
def issue_totals(spark, sf_dir):
    return _count(spark, sf_dir, values.ISSUES)


@query(_counted(values.LEADERS))
def leader_totals(spark, sf_dir):
    return _count(spark, sf_dir, values.LEADERS)


@query(_counted(values.PARTIES))
def party_totals(spark, sf_dir):
    return _count(spark, sf_dir, values.PARTIES)


_JOINED = "' ' || array_to_string(list_filter(string_split_regex(lower(" + REPAIRED + r"), '[^\p{L}\p{N}_]+'), lambda x: x <> ''), '  ') || ' '"


@query("WITH d AS (SELECT " + _JOINED + " AS line FROM documents) " + " UNION ALL ".join(f"SELECT '{p.replace(' ', '_')}' AS tok, CAST(coalesce(sum((length(line) - length(replace(line, ' {p.replace(' ', '  ')} ', ''))) // {len(p) + 3}), 0) AS BIGINT) AS n FROM d" for p in values.PHRASES))
def issue_phrases(spark, sf_dir):
    toks = articles(spark, sf_dir).select(F.explode(text.compounded(text.tokens(F.col("text")), list(values.PHRASES))).alias("tok"))
    names = [p.replace(" ", "_") for p in values.PHRASES]
    found = toks.where(F.col("tok").isin(names)).groupBy("tok").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in names], "tok string").join(found, "tok", "left").select("tok", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def relevant_articles(spark, sf_dir):
    mark = F.when(F.col("quality") == 1, " Yes").when(F.col("quality") == 0, "no")
    marked = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("election_relevant", mark)
    return cleaning.relevant(marked).select("doc_id", "source")


@query(rf"""WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(lower({REPAIRED}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '' AND x NOT IN ({STOP_SQL}))) AS n_tokens FROM documents)
SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens FROM t WHERE n_tokens > 0""")
def documents_with_tokens(spark, sf_dir):
    return selecting.with_tokens(articles(spark, sf_dir), values.STOP_WORDS).select("doc_id", "n_tokens")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice IS NOT NULL AND CAST(o_orderdate AS DATE) BETWEEN date '1996-01-01' AND date '1997-06-30'")
def listed_values_in_window(spark, sf_dir):
    return selecting.within(table(spark, sf_dir, "orders"), "o_orderpriority", ("1-URGENT", "5-LOW"), "o_totalprice", "o_orderdate", "1996-01-01", "1997-06-30").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(f"SELECT CASE o_orderpriority {_RECODE} ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1")
def recoded_counts(spark, sf_dir):
    name = selecting.recoded(F.col("o_orderpriority"), PRIORITIES)
    return table(spark, sf_dir, "orders").groupBy(name.alias("priority")).agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT CASE o_orderpriority {_RECODE} ELSE o_orderpriority END AS priority FROM orders) SELECT priority, list_position({list(LEVELS)}, priority)::BIGINT AS level, count(*) AS n FROM r WHERE priority IN {LEVELS} GROUP BY ALL ORDER BY level")
def levelled_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(selecting.recoded(F.col("o_orderpriority"), PRIORITIES).alias("priority"))
    return selecting.levelled(rows, "priority", LEVELS).groupBy("priority", "level").agg(F.count("*").alias("n")).orderBy("level")


@query("SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def union_distinct_ids(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return selecting.either(labels.where("toxic = 1").select("doc_id"), labels.where("quality = 0").select("doc_id"))


@query(f"WITH {CENTRES}, a AS (SELECT vec_id, label AS topic FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1), c AS (SELECT topic, label AS class, count(*) AS n FROM a JOIN embeddings USING (vec_id) GROUP BY ALL) SELECT topic, class, n, round(n / sum(n) OVER (PARTITION BY class), 6) AS share FROM c")
def topic_by_class(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = topics.assigned(vectors, topics.centroids(vectors)).select("vec_id", "topic").join(vectors.select("vec_id", "label"), "vec_id")
    return selecting.class_table(found, "topic", "label")


@query(f"SELECT count(*) AS n, count(DISTINCT source) AS outlets, min({DATED}) AS first, max({DATED}) AS last, CAST(sum(n_chars) AS BIGINT) AS n_chars, round(avg(n_chars), 4) AS mean_chars FROM documents")
def corpus_scalars(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("n"), F.countDistinct("source").alias("outlets"), F.min(article_date()).alias("first"), F.max(article_date()).alias("last"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id FROM c QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', conv_id, '1998')), conv_id) <= (SELECT round_even(0.25 * count(*), 0) FROM c)),
r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS place FROM s)
SELECT CAST(place // 20 AS BIGINT) AS chunk, count(*) AS n, string_agg('Row ' || conv_id, chr(10) ORDER BY conv_id) AS body FROM r GROUP BY 1""")
def spot_check_requests(spark, sf_dir):
    chosen = sampling.of_fraction(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", 0.25, 1998)
    return sampling.requests(chosen, 20, ["conv_id"], F.concat(F.lit("Row "), F.col("conv_id").cast("string")))


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events WHERE json_valid(props))
SELECT concat(event_id, '::0') AS row_id, k % 2 = 0 AS agrees, round(value, 4) AS revised_sentiment_score, CAST(k AS INTEGER) AS revised_certainty FROM e""")
def second_pass_reviews(spark, sf_dir):
    """Events stand for the reviewer's answers: each is made one JSON result and read back by the second pass's schema."""
    read = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    review = F.struct(F.concat(F.col("event_id").cast("string"), F.lit("::0")).alias("row_id"), (F.col("k") % 2 == 0).alias("agrees"), F.round("value", 4).alias("revised_sentiment_score"), F.col("k").cast("int").alias("revised_certainty"))
    results = read.select(F.col("event_id").cast("string").alias("custom_id"), F.lit("succeeded").alias("status"), F.to_json(F.struct(F.array(review).alias("reviews"))).alias("text"))
    rows, _ = reviews.parsed_reviews(results)
    return rows.select("row_id", "agrees", "revised_sentiment_score", "revised_certainty")
