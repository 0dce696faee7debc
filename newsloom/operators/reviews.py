"""The two-pass extraction: results to rows, rows under doubt, and patches by review."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

ROW = "topic:string, potential_merge:string, actor:string, actor_party_bucket:string, sentiment_score:double, ascribing:string, public_reaction:string, other_actors:string, other_observations:string, example_quote:string, quote_is_direct:boolean, topic_certainty:int, actor_certainty:int, sentiment_certainty:int, ascribing_certainty:int, public_certainty:int"
RESULT = f"articles array<struct<article_id:string, relevant:boolean, skip_reason:string, topics_mentioned:array<string>, rows:array<struct<{ROW}>>>>, _bad string"
REVIEW = "row_id string, agrees boolean, reasoning string, revised_sentiment_score double, revised_actor string, revised_ascribing string, revised_topic string, revised_certainty int"

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def scored(requests: DataFrame, scorer: Scorer, schema: str = "custom_id string, status string, text string") -> DataFrame:
    """Send requests to a scorer in batches. A scorer is any function over pandas batches; none is built in."""
    return requests.mapInPandas(scorer, schema)


def parsed(results: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, summaries, errors) of first-pass results (custom_id, status, text).

    ``known``: the articles by article_id. Failed requests, missing texts, bad JSON and unknown articles are errors.
    """
    read = results.withColumn("got", F.from_json("text", RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.when(F.col("status") != "succeeded", F.col("status")).when(F.col("text").isNull(), "no_text_block").when(F.col("got").isNull() | F.col("got._bad").isNotNull(), "bad_json")
    read = read.withColumn("failure", bad)
    items = read.where("failure is null").select("custom_id", F.explode("got.articles").alias("item"))
    unknown = items.join(known, F.col("item.article_id") == known["article_id"], "left_anti").select("custom_id", F.lit("unknown_article_id").alias("failure"), F.col("item.article_id").alias("error"))
    errors = read.where("failure is not null").select("custom_id", "failure", F.coalesce("got._bad", F.lit("")).alias("error")).unionByName(unknown)
    found = items.join(known, F.col("item.article_id") == known["article_id"])
    summaries = found.select("article_id", F.col("item.relevant").alias("relevant"), F.coalesce("item.skip_reason", F.lit("")).alias("skip_reason"), F.array_join(F.coalesce("item.topics_mentioned", F.array().cast("array<string>")), "; ").alias("topics_mentioned"))
    rows = found.where("item.relevant").select("article_id", F.posexplode("item.rows").alias("at", "row")).select(row_id(F.col("article_id"), F.col("at")).alias("row_id"), "article_id", "row.*")
    return rows, summaries, errors


def parsed_reviews(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, errors) of second-pass results (custom_id, status, text): one row per review, in the columns of ``REVIEW``."""
    shape = "reviews array<struct<" + ", ".join(":".join(x.split(" ")) for x in REVIEW.split(", ")) + ">>, _bad string"
    read = results.withColumn("got", F.from_json("text", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.when(F.col("status") != "succeeded", F.col("status")).when(F.col("text").isNull(), "no_text_block").when(F.col("got").isNull() | F.col("got._bad").isNotNull(), "bad_json")
    read = read.withColumn("failure", bad)
    rows = read.where("failure is null").select(F.explode("got.reviews").alias("review")).select("review.*")
    return rows, read.where("failure is not null").select("custom_id", "failure", F.coalesce("got._bad", F.lit("")).alias("error"))


def row_id(article: Column, at: Column) -> Column:
    return F.concat(article.cast("string"), F.lit("::"), at.cast("string"))


def in_doubt(rows: DataFrame, limit: int = values.CERTAINTY_LIMIT, fields: tuple[str, ...] = values.CERTAINTIES) -> DataFrame:
    """Rows with any known certainty below the limit."""
    return rows.where(F.least(*fields) < limit)


def patched(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows after all reviews, in their order ``n``; a review that agrees changes nothing.

    Scores, topics and certainties count if given; names count if not empty. Each revised certainty leaves a note.
    """
    live = reviews.where("not agrees")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("n")))
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    patch = live.groupBy("row_id").agg(
        last(F.col("revised_sentiment_score")).alias("_score"),
        last(named("revised_actor")).alias("_actor"),
        last(named("revised_ascribing")).alias("_ascribing"),
        last(F.col("revised_topic")).alias("_topic"),
        last(F.col("revised_certainty")).alias("_certainty"),
        F.count("revised_certainty").cast("int").alias("_notes"),
    )
    new = {"sentiment_score": "_score", "actor": "_actor", "ascribing": "_ascribing", "topic": "_topic", "sentiment_certainty": "_certainty"}
    out = rows.join(patch, "row_id", "left").withColumns({c: F.coalesce(p, c) for c, p in new.items()})
    notes = F.concat(F.coalesce("other_observations", F.lit("")), F.repeat(F.lit(values.REVIEW_NOTE), F.col("_notes")))
    return out.withColumn("other_observations", F.when(F.col("_notes") > 0, notes).otherwise(F.col("other_observations"))).drop(*new.values(), "_notes")


def review_log(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """What each review of a known row found: the values as all earlier reviews had left them."""
    before = Window.partitionBy("row_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    told = lambda c: F.last(F.when(~F.col("agrees"), c), ignorenulls=True).over(before)
    joined = reviews.join(rows.select("row_id", "sentiment_score", "actor", "ascribing", "topic"), "row_id")
    return joined.select(
        "n",
        "row_id",
        "agrees",
        F.coalesce(told(F.col("revised_sentiment_score")), "sentiment_score").alias("before_sentiment"),
        F.coalesce(told(F.nullif(F.col("revised_actor"), F.lit(""))), "actor").alias("before_actor"),
        F.coalesce(told(F.nullif(F.col("revised_ascribing"), F.lit(""))), "ascribing").alias("before_ascribing"),
        F.coalesce(told(F.col("revised_topic")), "topic").alias("before_topic"),
    )
