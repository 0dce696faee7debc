import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import text, values, words
from newsloom.operators import counting, dedup
from newsloom.plans import catalog

TEXTS = ["Über de la der the of the end", "of the", "OF THE", "", None, "...", "a.B of́ the x", "thinking THIN thi of-the-thing", "the_la the 12 ½ Ⅷ de la", "éa " * 50 + "of the", "buy the canadian", "ontario liberals, liberals"]


def table(spark, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string").repartition(2)


def test_tokens_are_those_of_the_column(spark):
    rows = table(spark).select("text", text.tokens(F.col("text")).alias("toks")).collect()
    assert all(words.tokens(r.text) == (r.toks or []) for r in rows)
    assert words.tokens("İx ΑΣ") == ["ix", "ας".replace("ς", "σ")]  # one by one, as the SQL's lower does


ODD = {"t": ["buy canadian", "*a *b", "th*"], "u": ["the *", "of the", "the"]}


@pytest.mark.parametrize(("dictionary", "stop", "nested"), [(catalog.WORDS, (), "key"), (ODD, (), "dictionary"), (values.PARTIES | ODD, tuple(values.STOP_WORDS), "key")])
def test_lookup_is_that_of_dealt_hits(spark, dictionary, stop, nested):
    for ids in (None, [None, None, 1, 1, *range(20)]):
        docs = table(spark, ids)
        plain = counting._dealt(docs, dictionary, "doc_id", stop, nested)
        as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert as_rows(counting.lookup(docs, dictionary, stop=stop, nested=nested)) == as_rows(plain)
        assert as_rows(counting.counts(docs, dictionary, stop=stop, nested=nested)) == as_rows(plain.groupBy("doc_id", "key").agg(F.count("*")))


def test_no_token_is_a_row(spark):
    plan = counting.counts(table(spark), catalog.WORDS)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_class_counts_are_those_of_token_rows(spark):
    docs = table(spark, [None, None, 1, 1, *range(20)]).withColumn("class", F.when(F.col("text") != "of the", F.substring("text", 1, 1)))
    toks = docs.select("doc_id", "class", F.explode(text.tokens(F.col("text"))).alias("term"))
    got = counting.class_counts(docs, "class")
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_rows(got.select("class", "term", "tf")) == as_rows(toks.groupBy("class", "term").agg(F.count("*").alias("tf")))
    assert as_rows(got.groupBy("term").agg(F.sum("df"))) == as_rows(toks.groupBy("term").agg(F.countDistinct("doc_id")))
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # texts without a repeated id are counted where they are read


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_top_terms_are_those_of_all_weights(spark, monkeypatch, common):
    monkeypatch.setattr(dedup, "COMMON", common)
    docs = table(spark, [None, None, 1, 1, *range(20)])
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 6)), "term")
    plain = dedup.term_weights(docs).withColumn("nth", F.row_number().over(order)).where("nth <= 3").select("doc_id", "nth", "term", F.round("weight", 6))
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert as_rows(dedup.top_terms(docs, 3)) == as_rows(plain)
