"""Content-addressed WARC archive.

Each page becomes one WARC/1.1 record, a gzip member of its own. Payloads of at least ``LEAST_BYTES`` bytes
that are equal (same SHA-256 and length) are stored once: the page with the largest id holds the payload in a
``response`` record, the others are ``revisit`` records that name it. Shorter payloads are always
stored. The exact header bytes of every record stand in a table of their own, with the payload's
address; an original record is its header joined with the payload of that address.

Layout below the target folder: ``archive/`` WARC files of at most about ``FILE_BYTES`` bytes, ``parts/``
the list of the files that count (files of lost or repeated task attempts are not in it), ``headers/``
exact record headers.

Reading checks every payload against both digests in its header and fails on a mismatch.

A null html is an empty payload; a null url is written as an empty target. Every row gives one record. A page_id
may come with several payloads, and all rows without page_id are one such page: each payload of at least
``LEAST_BYTES`` bytes is held by the first row of its holder that has it, and only rows with the same payload
revisit it. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 1000
FILE_BYTES = 48 << 20
#: Time stamp of every record: the pages carry none, and equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_names = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PARTS = "file string, bytes long, records long"


def _b32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(page_id: int, sha256: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_names, f'{page_id}/{sha256}/{copy}')}>"


def header(kind: str, page_id: int, copy: int, url: str, sha1: str, sha256: str, payload_bytes: int, refers_to: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, sha256, copy)}", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url), f"WARC-Payload-Digest: sha1:{_b32(sha1)}", f"X-Payload-SHA256: {sha256}", f"X-Payload-Length: {payload_bytes}", f"X-Page-ID: {page_id}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha256, 0)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else payload_bytes}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"


def planned(pages: DataFrame) -> DataFrame:
    """Which row of each payload holds it: digests alone are shuffled for that, and a common payload is counted before it moves."""
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(common.NULL_ID)).alias("page_id"), "url", raw.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    thin = rows.select("page_id", "sha256", "payload_bytes")
    holders = thin.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("sha256", "payload_bytes").agg(F.max("page_id").alias("holder"), F.count("*").alias("times")).where("times > 1").drop("times")
    revisits = thin.join(holders.hint("merge"), ["sha256", "payload_bytes"]).where("page_id != holder").select(F.col("page_id").alias("_page"), F.col("sha256").alias("_sha"), "holder").distinct()
    marked = rows.join(revisits.hint("merge"), (F.col("page_id") == F.col("_page")) & (F.col("sha256") == F.col("_sha")), "left").drop("_page", "_sha")
    return marked


def _numbered(marked: DataFrame) -> DataFrame:
    """``copy``: 0 for the first row of a page with this payload, which is stored unless another page holds it. Page ids normally don't repeat, which one narrow count shows."""
    repeated = marked.groupBy("page_id").count().where("count > 1")
    if repeated.isEmpty():
        return marked.withColumn("copy", F.lit(0))
    order = Window.partitionBy("page_id", "sha256").orderBy("url")
    return marked.withColumn("copy", F.row_number().over(order) - 1)


def _filesystem(target: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(target)


def write(pages: DataFrame, target: str) -> None:
    """Write the archive of ``pages`` below ``target`` (any place that pyarrow and Spark both reach)."""
    common.ship(pages.sparkSession)
    folder = f"{target}/archive"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        stream, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        system.create_dir(root, recursive=True)
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                page, url, payload, sha256, holder, copy = (column[c][i].as_py() for c in ("page_id", "url", "payload", "sha256", "holder", "copy"))
                if holder is None and copy and len(payload) >= LEAST_BYTES:
                    holder = page
                kind = "response" if holder is None else "revisit"
                head = header(kind, page, copy, url or "", hashlib.sha1(payload).hexdigest(), sha256, len(payload), holder)
                member = gzip.compress(head + (payload if kind == "response" else b"") + b"\r\n\r\n", 4, mtime=0)
                if stream is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                stream.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    stream.close()
                    done.append((name, size, count))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, size, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    rows = _numbered(planned(pages))
    rows.select("page_id", "url", "payload", "sha256", "holder", "copy").mapInArrow(run, PARTS).write.parquet(f"{target}/parts")
    records(pages.sparkSession, target).select("page_id", "record_type", "refers_to", "sha256", "header").write.parquet(f"{target}/headers")


_MEMBER_CHUNK = 1 << 20


def _known(page: int | None) -> int | None:
    return None if page == common.NULL_ID else page


def _records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, exact header bytes, block) of each gzip member."""
    rest = stream.read(_MEMBER_CHUNK)
    while rest:
        one, out = zlib.decompressobj(31), []
        while True:
            out.append(one.decompress(rest))
            rest = one.unused_data
            if one.eof:
                break
            rest = stream.read(_MEMBER_CHUNK)
            if not rest:
                raise ValueError("truncated WARC file")
        rest = rest or stream.read(_MEMBER_CHUNK)
        whole = b"".join(out)
        at = whole.index(b"\r\n\r\n") + 4
        fields = dict(line.split(": ", 1) for line in whole[:at].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        n = int(fields["Content-Length"])
        if whole[at + n :] != b"\r\n\r\n":
            raise ValueError("WARC record length is wrong")
        yield fields, whole[:at], whole[at : at + n]


RECORDS = "page_id long, record_type string, refers_to long, sha256 string, sha1 string, payload_bytes long, header binary, block binary"


def records(spark: SparkSession, target: str, blocks: bool = False) -> DataFrame:
    """The records as the files hold them. Each listed file is read by one task, record by record."""
    common.ship(spark)
    folder = f"{target}/archive"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("sha256", pa.string()), ("sha1", pa.string()), ("payload_bytes", pa.int64()), ("header", pa.binary()), ("block", pa.binary())])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, head, block in _records(stream):
                        kind, sha256 = fields["WARC-Type"], fields["X-Payload-SHA256"]
                        sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (hashlib.sha256(block).hexdigest(), hashlib.sha1(block).hexdigest()) != (sha256, sha1):
                            raise ValueError(f"payload of page {fields['X-Page-ID']} does not match its digests")
                        page = int(fields["X-Page-ID"])
                        refers = fields.get("X-Refers-To-Page")
                        rows.append((_known(page), kind, _known(refers and int(refers)), sha256, sha1, int(fields["X-Payload-Length"]), head, block if blocks else b""))
                        held += len(block) * blocks + 600
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    parts = spark.read.schema(PARTS).parquet(f"{target}/parts")
    # The list is tiny however large the archive is, so Spark by itself would give it to one task.
    return parts.select("file").repartition(max(1, parts.count())).mapInArrow(run, RECORDS)


def _stored(column: str):
    """``column`` of a header's payload; reading fails where no payload has the header's address."""
    return F.coalesce(column, F.raise_error(F.concat(F.lit("no payload is stored for SHA-256 "), "sha256"))).alias(column)


def reconstruct(spark: SparkSession, target: str) -> DataFrame:
    """page_id, header, payload of every record: headers joined with the payloads by address."""
    found = records(spark, target, blocks=True).where("record_type = 'response'")
    payloads = found.groupBy("sha256").agg(F.first("block").alias("payload"))
    return spark.read.parquet(f"{target}/headers").join(payloads.hint("merge"), "sha256", "left").select("page_id", "header", _stored("payload"))


def index(spark: SparkSession, target: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archive.

    Length and SHA-1 are those of the payload that was read and verified; a revisit has them through the join
    on the payload's address.
    """
    found = records(spark, target)
    stored = found.where("record_type = 'response'").groupBy("sha256").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("sha1").alias("payload_digest"))
    heads = spark.read.parquet(f"{target}/headers").select("page_id", "record_type", "refers_to", "sha256")
    return heads.join(stored.hint("merge"), "sha256", "left").select("page_id", _stored("payload_bytes"), _stored("payload_digest"), "record_type", "refers_to")
