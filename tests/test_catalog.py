import pytest
from oracle import actual, expected

from newsloom.plans import catalog, selections  # noqa: F401  (the second adds to the first)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    assert actual(catalog.QUERIES[name](spark, SF)) == expected(catalog.SQL[name], SF)


def test_survivors_follow_the_pairs(spark):
    docs = catalog._blocked(spark, SF)
    pairs = catalog.QUERIES["near_dup_pairs"](spark, SF).collect()
    block = {r.doc_id: r.block for r in docs.select("doc_id", "block").collect()}
    gone = set()
    for i, j in sorted(((r.doc_i, r.doc_j) for r in pairs), key=lambda p: (min(block[p[0]], block[p[1]]), p)):
        if i not in gone and j not in gone:
            gone.add(j)
    kept = {r.doc_id for r in catalog.QUERIES["near_dup_survivors"](spark, SF).collect()}
    assert kept == set(block) - gone


def test_loess_is_exact_on_a_parabola(spark):
    from newsloom.operators import series

    rows = spark.createDataFrame([("a", float(x), x * x - 3.0 * x) for x in range(20)] + [("b", 1.0, 5.0)], "series string, x double, y double")
    assert all(abs(r.y - r.fit) < 1e-6 for r in series.loess(rows, 0.5).collect())


def test_pages(spark):
    rows = catalog.QUERIES["page_extract"](spark, SF).collect()
    assert len(rows) == 50 and all(r.title and r.paragraphs for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
