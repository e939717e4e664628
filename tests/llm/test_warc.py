"""Archives and their index: round trips against the pages themselves."""

import base64
import gzip
import hashlib
import uuid
from pathlib import Path

from planweave.llm import warc
from planweave.session import shared_folder

PAGES = "page_id long, url string, html string, urlkey string"
ROWS = [(5, "http://a.example/x", "<p>é🙂</p>"), (2, "https://b.example:443/y?q#z", "<p>é🙂</p>"), (9, None, None), (1, "http://a.example/x", ""), (7, "http://user@a.example:80", "x" * 300000), (8, "bad url\r\n with space", "<p>é🙂</p>"), (3, "", "a\r\n\r\nb"), (None, "http://n", "<p>é🙂</p>"), (5, "http://a.example/x", "<p>é🙂</p>")]


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "").encode() == data and j is not None)
        again = len(data) >= least and i is not None and i > first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], PAGES)
    for least in (0, 5):
        got = [tuple(r)[:5] for r in warc.report(pages, least).collect()]
        assert sorted(got, key=str) == expected(ROWS, least)
    assert warc.report(pages.limit(0)).count() == 0


def test_many_blocks_and_plain_gzip(spark):
    rows = [(i, f"http://h{i % 7}.example/{i % 50}", f"page {i % 400}") for i in range(2000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    folder = f"{shared_folder(spark)}/warc-test-{uuid.uuid4().hex}"
    captures = warc.archive(pages, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        top = warc.index(captures, folder, lines=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(top) > 1
    got = warc.read_back(captures, folder, top).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    reader = warc.Reader(folder, top)
    assert list(reader.captures("no,such)/", 5)) == []
    (place,) = reader.captures(warc.surt("http://h3.example/3"), 3)
    assert reader.read(*place)["payload"] == b"page 3"
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder.removeprefix("file://")).glob("archives/*"))
    assert whole.count(b"WARC/1.1\r\n") == 2000


def test_read_back_is_shared_out(spark):
    """Tasks by the archives' bytes, not by the few bytes of their keys; a path without a scheme is Spark's, not the worker's."""
    from pyspark.sql import functions as F

    from planweave.session import qualified

    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.example/"), "id").alias("url"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat("id", i.cast("string")), 256)), "").alias("html"))
    folder = qualified(spark, f"{shared_folder(spark).removeprefix('file://')}/warc-test-{uuid.uuid4().hex}")
    captures = warc.archive(rows, folder)
    out = warc.read_back(captures, folder, warc.index(captures, folder))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 4 and max(sizes) < 1500


def test_revisits_are_resolved(spark):
    import pytest

    pages = spark.createDataFrame([(1, " http://É.example/a", "same"), (2, "http://b.example", "same"), (3, None, "same"), (1, "http://c.example", "other")], "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/warc-test-{uuid.uuid4().hex}"
    captures = warc.archive(pages, folder)
    top = warc.index(captures, folder)
    got = {(r.page_id, r.record_type): r for r in warc.read_back(captures, folder, top).collect() if r.payload_bytes == 4}
    assert {k for k in got} == {(1, "response"), (2, "revisit"), (3, "revisit")} and len({r.payload_digest for r in got.values()}) == 1
    reader = warc.Reader(folder, top)
    with pytest.raises(ValueError):
        reader.resolved({"record_type": "revisit", "page_id": 9, "refers_to": 8, "refers_key": ")/", "payload_digest": "x", "payload_bytes": 1})


def test_surt():
    assert warc.surt("http://User@WWW.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert warc.surt(None) == ")/"
    assert "\t" not in warc.surt("http://x/a\tb\n")


def test_query_against_sql(spark):
    import duckdb

    from planweave.llm import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    expected = con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()['op9_warc']})").fetchall()
    got = [tuple(r) for r in queries.queries()["op9_warc"](spark, d).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
