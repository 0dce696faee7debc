"""Registered queries on the test tables, each with its SQL where SQL can say it.

The tables stand for the corpus so: an article is a row of ``documents`` (title: first line, section: lang,
outlet: source, family: lang), its date is counted from its id, ``labels.quality`` is the relevance mark, and common
short words stand for the dictionaries, whose own words hardly occur in invented prose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, values
from ..operators import cleaning, counting, dedup, reviews, sampling, series, topics
from ..sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = {"small": ["the", "la", "der"], "pairs": ["of the", "de la", "in the"], "begins": ["thin*", "erst*"], "long": ["of the *and", "this"]}
SIGNAL = {"rest": {"on": ["of the", "thin*"]}, "gated": {"gate": ["this"]}, "context": {"ctx": ["in"]}, "other": {"fed": ["was", "with"]}}
STOP_SQL = ", ".join(f"'{w}'" for w in values.STOP_WORDS)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_date(modulus: int = 365) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(modulus)).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With spaces repaired; tokens are the same without, as a full stop parts them anyway."""
    return table(spark, sf_dir, "documents").withColumn("text", text.spacing_repaired(F.col("text")))


REPAIRED = r"regexp_replace(text, '([a-z])\.([A-Z])', '\1. \2', 'g')"
TOKS = rf"""toks AS (SELECT doc_id, lang, unnest(list) AS tok, generate_subscripts(list, 1) - 1 AS pos FROM
  (SELECT doc_id, lang, list_filter(string_split_regex(lower({REPAIRED}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS list FROM documents))"""
DATED = "date '2024-01-01' + CAST(doc_id % 365 AS INTEGER)"
WEEK = f"CAST(date_trunc('week', {DATED}) AS DATE)"


def spans_sql(dictionary: dict[str, list[str]], name: str = "spans", within: str = "key") -> str:
    """CTEs that look a dictionary up."""
    rows = ", ".join(f"('{k}', '{p}', {i}, {n}, '{w}', {str(s).lower()})" for k, p, i, n, w, s in counting._pattern_words(dictionary))
    same = "t.key = s.key AND " if within == "key" else ""
    return f"""{name}_words(key, pattern, place, length, word, is_start) AS (VALUES {rows}),
{name}_all AS (SELECT DISTINCT doc_id, key, first, last FROM (
  SELECT doc_id, key, pattern, length, pos - place AS first, pos - place + length - 1 AS last FROM toks JOIN {name}_words
  ON (NOT is_start AND tok = word) OR (is_start AND starts_with(tok, word)) GROUP BY doc_id, key, pattern, length, pos, place) GROUP BY doc_id, key, pattern, length, first, last HAVING count(*) = length),
{name} AS (SELECT * FROM {name}_all s WHERE NOT EXISTS (SELECT 1 FROM {name}_all t WHERE t.doc_id = s.doc_id AND {same}t.first <= s.first AND t.last >= s.last AND t.last - t.first > s.last - s.first))"""


KEYS = ", ".join(f"('{k}')" for k in WORDS)
WEEKLY = f"""WITH {TOKS}, {spans_sql(WORDS)}, docs AS (SELECT doc_id, {WEEK} AS week FROM documents),
counted AS (SELECT week, key, count(*) AS mentions, count(DISTINCT doc_id) AS articles FROM spans JOIN docs USING (doc_id) GROUP BY week, key),
weekly AS (SELECT week, key, coalesce(mentions, 0) AS mentions, coalesce(articles, 0) AS articles
  FROM (SELECT DISTINCT week FROM docs) CROSS JOIN (SELECT * FROM (VALUES {KEYS}) k(key)) LEFT JOIN counted USING (week, key))"""


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return counting.by_week(counting.counts(docs, WORDS), docs, article_date(), list(WORDS))


@query(f"{WEEKLY} SELECT week, key, mentions FROM weekly")
def weekly_keyword_mentions(spark, sf_dir):
    return _weekly(spark, sf_dir).select("week", "key", "mentions")


@query(f"{WEEKLY} SELECT week, key, articles FROM weekly")
def weekly_keyword_articles(spark, sf_dir):
    return _weekly(spark, sf_dir).select("week", "key", "articles")


@query(f"{WEEKLY} SELECT week, key, mentions, round(mentions / nullif(sum(mentions) OVER (PARTITION BY week), 0), 6) AS share FROM weekly")
def weekly_keyword_share(spark, sf_dir):
    return counting.shares(_weekly(spark, sf_dir)).select("week", "key", "mentions", "share")


@query(f"{WEEKLY} SELECT week, key, mentions FROM weekly")
def topic_dictionary_wide_long(spark, sf_dir):
    return counting.long(counting.wide(_weekly(spark, sf_dir), list(WORDS)), list(WORDS))


@query(f"WITH {TOKS}, {spans_sql(WORDS)} SELECT key, count(*) AS mentions, count(DISTINCT doc_id) AS articles, rank() OVER (ORDER BY count(*) DESC) AS rank FROM spans GROUP BY key")
def keyword_totals_docfreq(spark, sf_dir):
    return counting.totals(counting.counts(table(spark, sf_dir, "documents"), WORDS))


@query(f"WITH {TOKS}, {spans_sql(WORDS, within='all')} SELECT key, count(*) AS mentions FROM spans GROUP BY key")
def keyword_totals_nested(spark, sf_dir):
    return counting.counts(table(spark, sf_dir, "documents"), WORDS, nested="dictionary").groupBy("key").agg(F.sum("mentions").alias("mentions"))


@query(
    f"""WITH {TOKS}, {", ".join(spans_sql(d, n) for n, d in SIGNAL.items())},
n AS (SELECT doc_id, (SELECT count(*) FROM rest r WHERE r.doc_id = d.doc_id) AS rest, (SELECT count(*) FROM gated r WHERE r.doc_id = d.doc_id) AS gated,
 (SELECT count(*) FROM context r WHERE r.doc_id = d.doc_id) AS context, (SELECT count(*) FROM other r WHERE r.doc_id = d.doc_id) AS other FROM documents d)
SELECT * FROM n WHERE rest + CASE WHEN context > 0 THEN gated ELSE 0 END > other"""
)
def signal_filter(spark, sf_dir):
    return cleaning.signal_filter(table(spark, sf_dir, "documents"), **SIGNAL)


_TITLES = [(1, "March 3, 2025 (Page A1)", "News"), (2, "Letters to the editor", "Opinion"), (3, "Letter: on rent", None), (4, None, "Let ters"), (5, "", ""), (6, "The rent is due", "News"), (7, "Love letters found", "Life")]


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names}))"


@query(
    rf"""WITH a AS (SELECT doc_id, lang AS section, split_part(text, chr(10), 1) AS titles, {REPAIRED} AS text FROM documents WHERE text IS NOT NULL AND trim(text) NOT IN ('', 'Not available.'))
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(titles), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS title_key, length(text) AS n FROM a
WHERE NOT regexp_matches(titles, '^\s*\w+ \d{{1,2}}, \d{{4}} \(Page ') AND NOT contains(lower(regexp_replace(section, '\s', '', 'g')), 'letter')
AND NOT regexp_matches(titles, '(?i)(^\s*letters?\b.*(editor|:)|letters to the editor)')"""
)
def clean_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"section": F.col("lang"), "titles": F.substring_index("text", "\n", 1)})
    kept = cleaning.without_junk(cleaning.usable(docs))
    return kept.select("doc_id", text.title_key(F.col("titles")).alias("title_key"), F.length("text").cast("long").alias("n"))


@query(
    rf"""SELECT id, coalesce(regexp_matches(title, '^\s*\w+ \d{{1,2}}, \d{{4}} \(Page '), false) AS junk,
coalesce(contains(lower(regexp_replace(section, '\s', '', 'g')), 'letter'), false) OR coalesce(regexp_matches(title, '(?i)(^\s*letters?\b.*(editor|:)|letters to the editor)'), false) AS letter
FROM {_values(_TITLES, "id, title, section")}"""
)
def junk_rules(spark, sf_dir):
    rows = spark.createDataFrame(_TITLES, "id int, title string, section string")
    return rows.select("id", cleaning.is_page_junk(F.col("title")).alias("junk"), cleaning.is_letter(F.col("section"), F.col("title")).alias("letter"))


_ORIGINS = [(1, "The Glo be and Mail (Online); Toronto, Ont."), (2, "Whig-Standard"), (3, "The Standard"), (4, ""), (5, None), (6, "Toronto Star; Toronto"), (7, "The Ottawa Citizen (2011-)"), (8, "London Free Press (Online)"), (9, "Some Weekly (Online); Town"), (10, "The Hamilton Spec tator")]
_CASES = " ".join(f"WHEN contains(bare, '{n}') THEN '{f}'" for n, f in values.FAMILIES)
_OUTLETS = _values(list(values.OUTLETS.items()), "key, name")
_SHORT = _values(list(values.SHORT_NAMES.items()), "key, name")


@query(
    rf"""WITH o AS (SELECT id, origin, regexp_replace(lower(regexp_replace(regexp_extract(coalesce(origin, ''), '^([^;(]+)', 1), '[^A-Za-z]', '', 'g')), '^the', '') AS k,
 lower(regexp_replace(coalesce(origin, ''), '\s', '', 'g')) AS bare, trim(replace(replace(trim(split_part(origin, ';', 1)), ' (Online)', ''), ' (2011-)', '')) AS base FROM {_values(_ORIGINS, "id, origin")})
SELECT id, coalesce(c.name, 'Other') AS outlet, CASE {_CASES} ELSE split_part(regexp_replace(bare, '\(online\)|\(2011-\)|[^\p{{L}}\p{{N}}_;]', '', 'g'), ';', 1) END AS family,
 coalesce(contains(lower(origin), 'online'), false) AS is_online, coalesce(s.name, base) AS short_name
FROM o LEFT JOIN {_OUTLETS} c ON c.key = k LEFT JOIN {_SHORT} s ON s.key = lower(base)"""
)
def outlet_names(spark, sf_dir):
    rows = cleaning.with_outlet(spark.createDataFrame(_ORIGINS, "id int, origin string"))
    return rows.select("id", "outlet", "family", "is_online", text.short_outlet(F.col("origin")).alias("short_name"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def outlet_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


_DATES = [(1, "0020-02-24"), (2, "2024-05"), (3, "45000"), (4, "junk"), (5, None), (6, "2024-05-03"), (7, "May 3, 2024"), (8, "1999-01-01"), (9, "45000.5")]


@query(
    rf"""WITH d AS (SELECT id, s, CASE s WHEN '0020-02-24' THEN '2025-02-24' ELSE s END AS fixed FROM {_values(_DATES, "id, s")}),
p AS (SELECT id, CASE WHEN regexp_full_match(s, '\d+(\.\d+)?') THEN date '1899-12-30' + CAST(floor(try_cast(s AS DOUBLE)) AS INTEGER)
  WHEN regexp_full_match(s, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(s AS DATE) WHEN regexp_full_match(s, '\d{{4}}-\d{{2}}') THEN try_cast(s || '-15' AS DATE) END AS approval_date,
 coalesce(CASE WHEN regexp_full_match(fixed, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(fixed AS DATE) END, CAST(try_strptime(fixed, '%b %d, %Y') AS DATE)) AS article_date FROM d)
SELECT id, approval_date, article_date, coalesce(article_date BETWEEN date '2023-06-01' AND date '2025-12-31', false) AS in_range FROM p"""
)
def date_parse_cascade(spark, sf_dir):
    s = F.col("s")
    rows = spark.createDataFrame(_DATES, "id int, s string").select("id", dates.excel_or_iso(s).alias("approval_date"), dates.patched(s).alias("article_date"))
    return rows.withColumn("in_range", F.coalesce(dates.in_range(F.col("article_date")), F.lit(False)))


@query("SELECT d.doc_id, d.source, l.quality, coalesce(l.quality = 1, false) AS relevant FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l USING (doc_id)")
def relevance_left_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return cleaning.left_join_first(docs, labels, "doc_id", F.col("quality")).withColumn("relevant", F.coalesce(F.col("quality") == 1, F.lit(False)))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def kept_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def dropped_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_anti")


TITLE_SQL = r"trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT doc_id, lang, {TITLE_SQL} AS k, doc_id % 5 AS day FROM documents),
b AS (SELECT doc_id, day - lag(day) OVER (PARTITION BY k, lang ORDER BY day, doc_id) AS gap FROM a WHERE k <> '') SELECT doc_id FROM b WHERE gap <= 2""")
def title_adjacent_dups(spark, sf_dir):
    docs = dedup.with_title(table(spark, sf_dir, "documents")).withColumns({"family": F.col("lang"), "is_online": F.lit(False), "date": article_date(5)})
    return dedup.title_duplicates(docs)


WEIGHTS = f"""{TOKS}, tf AS (SELECT doc_id, tok AS term, count(*) AS tf FROM toks WHERE tok NOT IN ({STOP_SQL}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), total AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT doc_id, term, tf * log10(n / df) AS raw FROM tf JOIN df USING (term), total WHERE df < n),
weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(f"WITH {WEIGHTS} SELECT doc_id, nth, term, weight FROM (SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS nth FROM weights) WHERE nth <= 5")
def tfidf_top_terms(spark, sf_dir):
    return dedup.top_terms(articles(spark, sf_dir), 5)


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).withColumns({"family": F.col("lang"), "outlet": F.col("source"), "is_online": F.lit(False), "block": F.floor(F.pmod("doc_id", F.lit(30)) / 7)})


PAIRS = f"""{WEIGHTS}, about AS (SELECT doc_id, lang, source, (doc_id % 30) // 7 AS block FROM documents),
joined AS (SELECT weights.*, lang, block FROM weights JOIN about USING (doc_id)),
pairs AS (SELECT a.doc_id AS doc_i, b.doc_id AS doc_j, round(sum(a.weight * b.weight), 6) AS cosine FROM joined a JOIN joined b
 ON a.term = b.term AND a.lang = b.lang AND a.doc_id < b.doc_id AND abs(a.block - b.block) <= 1 GROUP BY 1, 2 HAVING round(sum(a.weight * b.weight), 6) >= 0.85)"""


@query(f"WITH {PAIRS} SELECT doc_i, doc_j, cosine FROM pairs")
def near_dup_pairs(spark, sf_dir):
    return dedup.similar_pairs(_blocked(spark, sf_dir))


@query()
def near_dup_survivors(spark, sf_dir):
    docs = _blocked(spark, sf_dir)
    gone = dedup.dropped(dedup.similar_pairs(docs), docs)
    return docs.select("doc_id", "lang").join(gone, "doc_id", "left_anti")


@query(f"WITH {PAIRS} SELECT a.source = b.source AS same_outlet, count(*) AS pairs, round(avg(cosine), 3) AS mean_cosine FROM pairs JOIN about a ON a.doc_id = doc_i JOIN about b ON b.doc_id = doc_j GROUP BY 1")
def syndication_report(spark, sf_dir):
    docs = _blocked(spark, sf_dir)
    return dedup.syndication(dedup.similar_pairs(docs), docs)


@query(f"""WITH {TOKS}, w AS (SELECT doc_id, pos, tok, string_agg(tok, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before,
 string_agg(tok, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS after FROM toks)
SELECT doc_id, pos, coalesce(before, '') AS before, tok AS keyword, coalesce(after, '') AS after FROM w WHERE tok = 'this'""")
def kwic(spark, sf_dir):
    return counting.in_context(articles(spark, sf_dir), "this", 6).withColumn("pos", F.col("pos").cast("long"))


@query(rf"""WITH l AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower({REPAIRED}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''), '  ') || ' ' AS line FROM documents),
c AS (SELECT doc_id, unnest(string_split(trim(replace(replace(line, ' of  the ', ' of_the '), ' in  the ', ' in_the ')), '  ')) AS tok FROM l)
SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c WHERE tok IN ('of_the', 'in_the') GROUP BY tok""")
def phrase_compound_counts(spark, sf_dir):
    joined = text.compounded(text.tokens(F.col("text")), ["of the", "in the"])
    rows = articles(spark, sf_dir).select("doc_id", F.explode(joined).alias("tok"))
    return rows.where(F.col("tok").isin("of_the", "in_the")).groupBy("tok").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


_SEED_WORDS = sorted({w for words in values.SEEDS.values() for w in words if " " not in w and "-" not in w})
_SEED_VALUES = _values([(w,) for w in _SEED_WORDS], "term")


@query(f"WITH {TOKS} SELECT term FROM {_SEED_VALUES} INTERSECT SELECT tok FROM toks")
def keyword_vocab_intersect(spark, sf_dir):
    vocabulary = counting.token_rows(articles(spark, sf_dir)).select(F.col("tok").alias("term"))
    return spark.createDataFrame([(w,) for w in _SEED_WORDS], "term string").intersect(vocabulary)


@query(f"WITH {TOKS} SELECT term FROM {_SEED_VALUES} EXCEPT SELECT tok FROM toks")
def keyword_vocab_except(spark, sf_dir):
    vocabulary = counting.token_rows(articles(spark, sf_dir)).select(F.col("tok").alias("term"))
    return spark.createDataFrame([(w,) for w in _SEED_WORDS], "term string").subtract(vocabulary)


@query()
def seed_keyword_hits(spark, sf_dir):
    docs = articles(spark, sf_dir)
    wide = docs.agg(*(F.sum(text.count_of_words(F.col("text"), words)).alias(name) for name, words in values.SEEDS.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(n).cast("long").alias("hits")) for n in values.SEEDS))).alias("r")).select("r.*")


@query(f"WITH {TOKS}, n AS (SELECT count(*) AS total FROM toks) SELECT tok AS term, count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM toks, n WHERE tok IN ('the', 'of', 'this') GROUP BY tok")
def keyword_corpus_share(spark, sf_dir):
    tf = counting.token_rows(articles(spark, sf_dir)).groupBy(F.col("tok").alias("term")).agg(F.count("*").alias("n"))
    total = tf.agg(F.sum("n")).first()[0] or 0
    return tf.where(F.col("term").isin("the", "of", "this")).withColumn("share", F.round(F.col("n") / F.lit(float(total)), 6))


@query("SELECT doc_id, source FROM documents ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return sampling.of_size(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50, 42)


@query("WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id FROM c QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', conv_id, '1998')), conv_id) <= (SELECT round_even(0.25 * count(*), 0) FROM c)")
def fraction_sample(spark, sf_dir):
    return sampling.of_fraction(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", 0.25, 1998)


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations)
SELECT CAST(place // 15 AS BIGINT) AS chunk, count(*) AS n, 'Rows:' || chr(10) || string_agg('=== ' || conv_id || '::' || turn || ' ===' || chr(10) || 'Role: ' || role || chr(10) || text || chr(10), chr(10) ORDER BY conv_id, turn) AS body FROM r GROUP BY 1""")
def chunk_requests(spark, sf_dir):
    block = F.format_string("=== %s::%s ===\nRole: %s\n%s\n", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    return sampling.requests(table(spark, sf_dir, "conversations"), 15, ["conv_id", "turn"], block, "Rows:\n")


@query("SELECT event_id, concat(event_id, '::0') AS row_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_parse_rows(spark, sf_dir):
    read = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return read.where("p is not null and p._bad is null").select("event_id", reviews.row_id(F.col("event_id"), F.lit(0)).alias("row_id"), F.col("p.k").alias("k"))


def _doubts(rows: DataFrame) -> DataFrame:
    """Certainties from ids: some null, some below the limit."""
    fields = {f: F.when(F.col("doc_id") % (i + 3) != 0, (80 + (F.col("doc_id") * (i + 7)) % 21).cast("int")) for i, f in enumerate(values.CERTAINTIES)}
    return rows.withColumns(fields)


_DOUBT_SQL = ", ".join(f"CASE WHEN doc_id % {i + 3} <> 0 THEN CAST(80 + (doc_id * {i + 7}) % 21 AS INTEGER) END AS {f}" for i, f in enumerate(values.CERTAINTIES))


@query(f"WITH r AS (SELECT doc_id, {_DOUBT_SQL} FROM labels) SELECT * FROM r WHERE least({', '.join(values.CERTAINTIES)}) < 87")
def low_certainty_flags(spark, sf_dir):
    return reviews.in_doubt(_doubts(table(spark, sf_dir, "labels").select("doc_id")))


def _review_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.where("turn = 0").select(F.col("conv_id").cast("string").alias("row_id"), (F.col("conv_id") % 7 / 10.0).alias("sentiment_score"), F.col("role").alias("actor"), F.lit("a").alias("ascribing"), F.lit("t").alias("topic"), F.lit(80).alias("sentiment_certainty"), F.lit(None).cast("string").alias("other_observations"))
    odd = F.col("conv_id") + F.col("turn")
    revs = turns.where("turn > 0").select(
        F.col("turn").alias("n"), F.col("conv_id").cast("string").alias("row_id"), (odd % 4 == 0).alias("agrees"), F.lit("").alias("reasoning"),
        F.when(odd % 3 == 0, (odd % 5 / 10.0)).alias("revised_sentiment_score"), F.when(odd % 2 == 0, F.when(odd % 6 == 0, "").otherwise(F.concat(F.lit("p"), F.col("turn").cast("string")))).alias("revised_actor"),
        F.lit(None).cast("string").alias("revised_ascribing"), F.when(odd % 5 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("revised_topic"), F.when(odd % 7 == 0, 90).cast("int").alias("revised_certainty"),
    )
    return rows, revs


_REVIEWS_SQL = """r AS (SELECT CAST(conv_id AS VARCHAR) AS row_id, conv_id % 7 / 10.0 AS sentiment_score, role AS actor, 'a' AS ascribing, 't' AS topic FROM conversations WHERE turn = 0),
v AS (SELECT turn AS n, CAST(conv_id AS VARCHAR) AS row_id, (conv_id + turn) % 4 = 0 AS agrees, CASE WHEN (conv_id + turn) % 3 = 0 THEN (conv_id + turn) % 5 / 10.0 END AS score,
 CASE WHEN (conv_id + turn) % 2 = 0 AND (conv_id + turn) % 6 <> 0 THEN 'p' || turn END AS actor, CASE WHEN (conv_id + turn) % 5 = 0 THEN 't' || turn END AS topic, CASE WHEN (conv_id + turn) % 7 = 0 THEN 90 END AS certainty FROM conversations WHERE turn > 0)"""


@query(f"""WITH {_REVIEWS_SQL}, p AS (SELECT row_id, arg_max(score, n) FILTER (score IS NOT NULL) AS s, arg_max(actor, n) FILTER (actor IS NOT NULL) AS a, arg_max(topic, n) FILTER (topic IS NOT NULL) AS t, max(certainty) AS c, count(certainty) AS k FROM v WHERE NOT agrees GROUP BY row_id)
SELECT row_id, CAST(coalesce(s, sentiment_score) AS DOUBLE) AS sentiment_score, coalesce(a, actor) AS actor, ascribing, coalesce(t, topic) AS topic, CAST(coalesce(c, 80) AS INTEGER) AS sentiment_certainty,
 CASE WHEN k > 0 THEN repeat('{values.REVIEW_NOTE}', k) END AS other_observations FROM r LEFT JOIN p USING (row_id)""")
def apply_review_patches(spark, sf_dir):
    rows, revs = _review_rows(spark, sf_dir)
    return reviews.patched(rows, revs).withColumn("sentiment_score", F.col("sentiment_score").cast("double"))


@query(f"""WITH {_REVIEWS_SQL}, w AS (SELECT v.n, row_id, agrees, last_value(CASE WHEN NOT agrees THEN score END IGNORE NULLS) OVER before AS s, last_value(CASE WHEN NOT agrees THEN v.actor END IGNORE NULLS) OVER before AS a,
 last_value(CASE WHEN NOT agrees THEN v.topic END IGNORE NULLS) OVER before AS t FROM v WINDOW before AS (PARTITION BY row_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT n, row_id, agrees, CAST(coalesce(s, sentiment_score) AS DOUBLE) AS before_sentiment, coalesce(a, actor) AS before_actor, ascribing AS before_ascribing, coalesce(t, topic) AS before_topic FROM w JOIN r USING (row_id)""")
def review_log(spark, sf_dir):
    rows, revs = _review_rows(spark, sf_dir)
    return reviews.review_log(rows, revs).withColumn("before_sentiment", F.col("before_sentiment").cast("double"))


@query("""WITH a AS (SELECT source || '; ' || lang AS topics FROM documents), b AS (SELECT lang AS topics FROM documents)
SELECT trim(t) AS topic, count(*) AS mention_count FROM (SELECT unnest(string_split(topics, ';')) AS t FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) GROUP BY 1""")
def topic_counts_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return counting.split_topics((docs.select(F.concat_ws("; ", "source", "lang").alias("topics")), "topics"), (docs.select(F.col("lang").alias("topics")), "topics"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each document: a good one, a failed one, one without text, a broken one, by id."""
    row = '{"topic":"rent","actor":"a","sentiment_score":0.5,"actor_certainty":90}'
    body = F.concat(F.lit('{"articles":[{"article_id":"'), F.col("doc_id").cast("string"), F.lit('","relevant":'), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit(f',"topics_mentioned":["x","y"],"rows":[{row},{row}]}}]}}'))
    k = F.col("doc_id") % 10
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("pass1-"), F.col("doc_id").cast("string")).alias("custom_id"), F.when(k == 7, "errored").otherwise("succeeded").alias("status"), F.when(k == 8, None).when(k == 9, '{"articles":').otherwise(body).alias("text"))


def _parsed(spark: SparkSession, sf_dir: str):
    return reviews.parsed(_results(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("article_id")))


@query("SELECT l.doc_id || '::' || i AS row_id, CAST(l.doc_id AS VARCHAR) AS article_id, 'rent' AS topic, 0.5::DOUBLE AS sentiment_score FROM labels l JOIN documents USING (doc_id), (VALUES (0), (1)) v(i) WHERE l.doc_id % 10 < 7 AND l.doc_id % 2 = 0")
def extracted_rows(spark, sf_dir):
    return _parsed(spark, sf_dir)[0].select("row_id", "article_id", "topic", "sentiment_score")


@query("SELECT CAST(doc_id AS VARCHAR) AS article_id, doc_id % 2 = 0 AS relevant, '' AS skip_reason, 'x; y' AS topics_mentioned FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 < 7")
def article_summaries(spark, sf_dir):
    return _parsed(spark, sf_dir)[1]


@query("SELECT 'pass1-' || doc_id AS custom_id, CASE doc_id % 10 WHEN 7 THEN 'errored' WHEN 8 THEN 'no_text_block' WHEN 9 THEN 'bad_json' ELSE 'unknown_article_id' END AS failure FROM documents WHERE doc_id % 10 >= 7 OR doc_id NOT IN (SELECT doc_id FROM labels)")
def error_side_output(spark, sf_dir):
    return _parsed(spark, sf_dir)[2].select("custom_id", "failure")


@query("""WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS key, count(*) AS mentions, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
SELECT week, key, mentions, total, round(mentions / nullif(sum(mentions) OVER (PARTITION BY week), 0), 6) AS share FROM w""")
def series_share_by_week(spark, sf_dir):
    weekly = table(spark, sf_dir, "events").groupBy(dates.monday(F.col("ts")).alias("week"), F.col("event_type").alias("key")).agg(F.count("*").alias("mentions"), F.round(F.sum("value"), 2).alias("total"))
    return counting.shares(weekly)


@query("SELECT CASE WHEN CAST(o_orderdate AS DATE) < date '1998-01-01' THEN 'before' ELSE 'campaign' END AS period, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def period_split(spark, sf_dir):
    return series.with_period(table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date"), "1998-01-01").groupBy("period", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_group(spark, sf_dir):
    return series.latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@query("WITH w AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS week FROM events), r AS (SELECT week, dense_rank() OVER (ORDER BY week) AS index FROM w) SELECT week, index, index - lag(index) OVER (ORDER BY week) AS step FROM r")
def week_dense_rank(spark, sf_dir):
    return series.ranked_weeks(table(spark, sf_dir, "events").select(dates.monday(F.col("ts")).alias("week")))


@query()
def loess_trend(spark, sf_dir):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), day.alias("x")).agg(F.avg("value").alias("y"))
    return series.loess(daily, 0.25).select("series", "x", F.round("y", 6).alias("y"), F.round("fit", 4).alias("fit"))


def _class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.class_term_weights(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class"), "text"), 5)


@query(f"""WITH {TOKS}, good AS (SELECT tok FROM toks GROUP BY tok HAVING count(DISTINCT doc_id) >= 5), tf AS (SELECT lang AS class, tok AS term, count(*) AS tf FROM toks WHERE tok IN (SELECT tok FROM good) GROUP BY 1, 2),
m AS (SELECT avg(n) AS a FROM (SELECT sum(tf) AS n FROM tf GROUP BY class)), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY term),
w AS (SELECT class, term, tf, round(tf * ln(1 + a / f), 6) AS weight FROM tf JOIN f USING (term), m)
SELECT class, term, tf, weight, row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS nth FROM w QUALIFY nth <= 5""")
def ctfidf_by_class(spark, sf_dir):
    return topics.top_per_class(_class_weights(spark, sf_dir), 5)


@query("""WITH s AS (SELECT event_type AS topic, epoch_us(ts) AS t FROM events), r AS (SELECT min(t) AS low, max(t) AS high FROM s)
SELECT topic, CAST(least(8, floor((t - low) / ((high - low) / 8)) + 1) AS INTEGER) AS bin, count(*) AS n FROM s, r GROUP BY 1, 2""")
def topics_over_time_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return series.time_bins(rows, F.col("t"), 8).groupBy("topic", "bin").agg(F.count("*").alias("n"))


CENTRES = """parts AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
centres AS (SELECT label, list(m ORDER BY i) AS c FROM parts GROUP BY label),
scored AS (SELECT vec_id, centres.label, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(c, c)), 6) AS cosine FROM embeddings CROSS JOIN centres)"""


@query(f"WITH {CENTRES} SELECT vec_id, label AS topic, cosine FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1")
def centroid_assign(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topics.assigned(vectors, topics.centroids(vectors))


@query(f"WITH {CENTRES}, a AS (SELECT vec_id, label AS topic FROM scored QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1) SELECT topic, count(*) AS n FROM a WHERE topic NOT IN (-1, 0) GROUP BY topic ORDER BY n DESC, topic LIMIT 5")
def largest_topics(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topics.sizes(topics.assigned(vectors, topics.centroids(vectors)), n=5)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS vec_i, b.vec_id AS vec_j, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_i, vec_j, cosine FROM p QUALIFY row_number() OVER (PARTITION BY vec_i ORDER BY cosine DESC, vec_j) <= 10""")
def cosine_pairs(spark, sf_dir):
    """Of each stated query (ids divisible by 50) the ten nearest among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return topics.nearest(v.where("vec_id % 50 = 0"), v, 10)


_TOPS = [("a", "rent"), ("a", "mortgage"), ("a", "tax"), ("b", "police"), ("b", "tax"), ("c", "zzz")]
_SEED_ROWS = _values([(i, n, w) for i, (n, ws) in enumerate(values.SEEDS.items()) for w in ws], "nth, label, term")


@query(f"SELECT class, label, CAST(count(*) AS INTEGER) AS overlap FROM {_values(_TOPS, 'class, term')} JOIN {_SEED_ROWS} USING (term) GROUP BY class, label, nth QUALIFY row_number() OVER (PARTITION BY class ORDER BY count(*) DESC, nth) = 1")
def seed_label_argmax(spark, sf_dir):
    return topics.seed_labels(spark.createDataFrame(_TOPS, "class string, term string"))


@query("SELECT source, toxic, count(*) AS n, round(avg(n_chars), 4) AS point, round(avg(n_chars) - 1.96 * stddev_samp(n_chars) / sqrt(count(*)), 4) AS lower, round(avg(n_chars) + 1.96 * stddev_samp(n_chars) / sqrt(count(*)), 4) AS upper FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def stratum_means(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    half = 1.96 * F.stddev_samp("n_chars") / F.sqrt(F.count("*"))
    return rows.groupBy("source", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("point"), F.round(F.avg("n_chars") - half, 4).alias("lower"), F.round(F.avg("n_chars") + half, 4).alias("upper"))


@query("SELECT toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic")
def counts_with_null(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("n"))


@query()
def page_extract(spark, sf_dir):
    return html.summaries(table(spark, sf_dir, "pages"))
