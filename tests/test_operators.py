import pandas as pd
from pyspark.sql import functions as F

from newsloom.functions import dates, text, values
from newsloom.operators import cleaning, counting, reviews, sampling, topics
from newsloom.sources import articles, html
from newsloom.streaming import weekly


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_spacing_and_titles(spark):
    assert one(spark, text.spacing_repaired(F.lit("end.Next a.b"))) == "end. Next a.b"
    assert one(spark, text.title_key(F.lit("  The  Rent_is: DUE! "))) == "the rent_is due"
    assert one(spark, text.title_key(F.lit("a_b"), keep_underscore=False)) == "ab"
    assert one(spark, text.number(F.lit("about 1,234.5 %"))) == 1234.5
    assert one(spark, text.number(F.lit("none"))) is None


def test_dates(spark):
    parse = lambda s: str(one(spark, dates.excel_or_iso(F.lit(s))))
    assert [parse(x) for x in ("45000", "2024-05", "2024-05-03", "junk")] == ["2023-03-15", "2024-05-15", "2024-05-03", "None"]
    assert str(one(spark, dates.month_day_year(F.lit("May 3, 2024")))) == "2024-05-03"
    assert str(one(spark, dates.monday(F.lit("2024-01-07").cast("date")))) == "2024-01-01"


def test_lookup_nesting_and_stop_words(spark):
    docs = spark.createDataFrame([(1, "Ontario Liberals and the liberals met PCs"), (2, None), (3, ""), (4, "buy the canadian")], "doc_id long, text string")
    by_key = {r["key"]: r.n for r in counting.lookup(docs, values.PARTIES).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert by_key == {"ontario_liberals": 1, "liberals": 2, "progressive_conservatives": 1}
    across = {r["key"]: r.n for r in counting.lookup(docs, values.PARTIES, nested="dictionary").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert across == {"ontario_liberals": 1, "liberals": 1, "progressive_conservatives": 1}
    closed_up = counting.lookup(docs, {"t": ["buy canadian"]}, stop=values.STOP_WORDS)
    assert [r.doc_id for r in closed_up.collect()] == [4]


def test_gated_signal(spark):
    docs = spark.createDataFrame([(1, "ford ford"), (2, "ford ontario"), (3, "ford ontario trudeau"), (4, "ontario ndp")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cleaning.signal_filter(docs).collect()) == [2, 4]


def test_cleaning_keeps_what_it_should(spark):
    rows = [("1", "T", "News", "The Standard", "0020-02-24", "end.Next", "Yes "), ("2", "T", "News", None, "junk", "x", None), ("3", None, None, "", "2024-01-02", "Not available.", "no"), (None, "Letters to the editor", None, "x", "2024-01-02", "y", "yes")]
    table = spark.createDataFrame(rows, articles.ARTICLE)
    kept = cleaning.without_junk(cleaning.usable(table))
    good, bad = cleaning.dated(cleaning.with_outlet(kept))
    assert [(r.ID, r.outlet, str(r.date), r.text) for r in good.collect()] == [("1", "The Standard", "2025-02-24", "end. Next")]
    assert [r.ID for r in bad.collect()] == ["2"]
    assert [r.ID for r in cleaning.relevant(good).collect()] == ["1"]
    assert cleaning.relevant(good.drop("election_relevant")).count() == 1


def test_null_keys_do_not_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "ID string, x int")
    right = spark.createDataFrame([(None, 9), ("a", 3), ("a", 4)], "ID string, y int")
    assert sorted((r.x, r.y) for r in cleaning.left_join_first(left, right, "ID", F.col("y")).collect()) == [(1, None), (2, 3)]


def test_samples_and_chunks(spark):
    rows = spark.range(10).toDF("id")
    assert sampling.of_fraction(rows, "id", 0.25, 1).count() == 2  # 2.5 rounds to even
    assert sampling.of_fraction(rows.limit(0), "id", 0.25, 1).count() == 0
    assert sampling.of_fraction(rows.limit(1), "id", 0.25, 1).count() == 1
    got = sorted((r.id, r.chunk) for r in sampling.chunks(rows.repartition(3), 4, "id").collect())
    assert got == [(i, i // 4) for i in range(10)]


def test_reviews(spark):
    rows = spark.createDataFrame([("a::0", 0.1, "x", "y", "t", 80, None)], "row_id string, sentiment_score double, actor string, ascribing string, topic string, sentiment_certainty int, other_observations string")
    revs = spark.createDataFrame([(1, "a::0", False, "", 0.0, "", None, None, 90), (2, "a::0", True, "", 0.9, "z", None, None, None), (3, "a::0", False, "", None, "w", None, "", 91), (4, "zz", False, "", 1.0, None, None, None, None)], "n int, " + reviews.REVIEW)
    r = reviews.patched(rows, revs).first()
    assert (r.sentiment_score, r.actor, r.topic, r.sentiment_certainty, r.other_observations) == (0.0, "w", "", 91, values.REVIEW_NOTE * 2)
    log = sorted((r.n, r.before_sentiment, r.before_actor, r.before_topic) for r in reviews.review_log(rows, revs).collect())
    assert log == [(1, 0.1, "x", "t"), (2, 0.0, "x", "t"), (3, 0.0, "x", "t")]


def test_doubt_ignores_unknown_certainties(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None), (2, 86, None, None, None, None), (3, 87, None, None, None, 99)], "id int, " + ", ".join(f"{c} int" for c in values.CERTAINTIES))
    assert [r.id for r in reviews.in_doubt(rows).collect()] == [2]


def test_scorer_is_any_function(spark):
    def echo(batches):
        for rows in batches:
            yield pd.DataFrame({"custom_id": rows["custom_id"], "status": "succeeded", "text": rows["body"].str.upper()})

    rows = spark.createDataFrame([("a", "b")], "custom_id string, body string")
    assert reviews.scored(rows, echo).first().text == "B"


def test_topics(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.0, 1.0], 2), (4, [0.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.topic for r in topics.assigned(vectors, topics.centroids(vectors), least=0.5).collect()}
    assert (got[1], got[2], got[3]) == (1, 1, 2)
    merged = topics.reduced(topics.centroids(vectors), vectors.groupBy("label").agg(F.count("*").alias("n")), 1)
    assert merged == {1: 1, 2: 1}


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", 'say "x",\nthen')], "ID string, titles string, text string")
    articles.write_csv(rows, str(tmp_path / "out"), ["ID", "text", "missing"])
    back = articles.read_csv(spark, str(tmp_path / "out")).first()
    assert (back.ID, back.text, back.titles) == ("1", 'say "x",\nthen', None)
    (tmp_path / "texts" / "deep").mkdir(parents=True)
    (tmp_path / "texts" / "deep" / "a.txt").write_text("Title: one\nbody" + "\n" + "_" * 60 + "\n" + "Title: two\nmore")
    records = articles.fields(articles.read_texts(spark, str(tmp_path / "texts")), ["Title"])
    assert sorted(r.title for r in records.collect()) == ["one", "two"]


def test_vector_cache_runs_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")

    def encode(batches):
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "embedding": [[1.0]] * len(rows)})

    first = articles.cached_vectors(spark, docs, encode, str(tmp_path), "m")
    again = articles.cached_vectors(spark, docs, None, str(tmp_path), "m")
    assert first.count() == again.count() == 2


def test_html_table(spark):
    page = "<title>T</title><table><tr><th>Firm</th><th>PC</th></tr><tr><td>A&amp;B</td><td>45 %</td></tr><tr><td>Writ drawn</td><td>-</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    polls = html.polls(html.table(pages, 0), {"firm": 0, "pc": 1}, ("pc",), "pc")
    assert [(r.firm, r.pc) for r in polls.collect()] == [("A&B", 45.0)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = weekly.weekly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("weekly").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    batch = events.groupBy(dates.monday(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("weekly").collect()} == {tuple(r) for r in batch.collect()}
