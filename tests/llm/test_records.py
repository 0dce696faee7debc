"""WARC archives, conversations and the pipeline."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from oracle import actual, expected

import corpus_pipeline
from newsloom.llm import queries, snapshots, warc

SF = "/root/testdata/sf0.001"


def test_archive(spark, tmp_path):
    big, other = "<p>é" + "x" * 1200, "<p>" + "y" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/\r\n2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("holder", F.lit(0)).repartition(3)
    target = f"file://{tmp_path}/warc"
    warc.write(pages, target)
    got = {r.page_id: r for r in warc.index(spark, target).collect()}
    assert len(got) == 8
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
    whole = {r.page_id: r for r in warc.reconstruct(spark, target).collect()}
    assert {i: bytes(r.payload) for i, r in whole.items()} == {i: (h or "").encode() for i, _, h in rows}
    stored = b"".join(gzip.open(p).read() for p in (tmp_path / "warc/archive").glob("*.warc.gz"))
    assert stored.count(big.encode()) == 1 and all(bytes(r.header) in stored for r in whole.values())


def test_archive_of_repeated_rows_and_of_none(spark, tmp_path):
    big = "z" * 1500
    pages = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "u", "q")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.index(spark, f"file://{tmp_path}/a").collect()) == [("1", "response", None), ("1", "revisit", 1), ("None", "response", None)]
    warc.write(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.index(spark, f"file://{tmp_path}/b").count() == 0


def test_archive_of_page_ids_with_several_payloads(spark, tmp_path):
    a, b = sorted(("a" * 2000, "b" * 2000), key=lambda x: hashlib.sha256(x.encode()).hexdigest(), reverse=True)
    rows = [(7, "u", a), (7, "u", b), (7, "u", b), (3, "u", a), (None, "u", "c" * 1500), (None, "u", "d" * 1500), (None, "v", "d" * 1500), (None, "u", a), (None, "u", "q"), (None, "u", "q")]
    target = f"file://{tmp_path}/warc"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), target)
    key = lambda i, h: (str(i), hashlib.sha1(h.encode()).hexdigest())
    got = warc.index(spark, target).collect()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted(key(i, h) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_digest, str(r.refers_to)) for r in got if r.record_type == "revisit") == sorted([(*key(7, b), "7"), (*key(3, a), "7"), (*key(None, "d" * 1500), "None"), (*key(None, a), "7")])
    whole = warc.reconstruct(spark, target).collect()
    assert sorted((str(r.page_id), bytes(r.payload).decode()) for r in whole) == sorted((str(i), h) for i, _, h in rows)
    stored = b"".join(gzip.open(p).read() for p in (tmp_path / "warc/archive").glob("*.warc.gz"))
    assert stored.count(a.encode()) == 1
    ids = [line for line in stored.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) == len(rows)
    referred = {line.split(b": ")[1] for line in stored.split(b"\r\n") if line.startswith(b"WARC-Refers-To: ")}
    assert referred <= {x.split(b": ")[1] for x in ids}


def test_archive_without_a_payload_fails(spark, tmp_path):
    target = f"file://{tmp_path}/warc"
    warc.write(spark.createDataFrame([(1, "u", "x" * 1500)], "page_id long, url string, html string"), target)
    spark.read.parquet(f"{target}/headers").withColumn("sha256", F.lit("0" * 64)).write.parquet(f"{target}/other")
    (tmp_path / "warc/headers").rename(tmp_path / "warc/old")
    (tmp_path / "warc/other").rename(tmp_path / "warc/headers")
    for read in (warc.index, warc.reconstruct):
        with pytest.raises(Exception, match="no payload is stored"):
            read(spark, target).collect()


def test_snapshots(spark):
    def turns(conv, *said):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", s) for i, s in enumerate(said)]

    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "x") + turns(4, "a") + turns(5, "a", "b", "c") + turns(6, None) + turns(7, "a", "b", "d", "e")
    rows += [(8, i, "user", f"t{i}") for i in range(700)] + [(9, i, "user", f"t{i}") for i in range(300)] + [(3, 0, "user", "a"), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(0)).repartition(4)
    got = {r.conv_id: r for r in snapshots.render(table).collect()}
    assert set(got) == {2, 3, 6, 7, 8, None}
    assert got[8].n_turns == 700 and got[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert snapshots.render(table.limit(0)).count() == 0


def test_snapshots_against_sql(spark):
    assert actual(queries.op7_snapshot_collapse(spark, SF)) == expected(queries.SQL["op7_snapshot_collapse"], SF)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("extra")).limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    kept = docs.count()
    assert 0 < kept <= 60
    assert corpus_pipeline.packed(spark, docs, SF).select("doc_id").distinct().count() == kept
    assert corpus_pipeline.packed(spark, docs.limit(0), SF).count() == 0
