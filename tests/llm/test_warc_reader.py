"""WARC files of both versions, bodies that hold a version line, and answers that aren't full responses."""

import gzip
from pathlib import Path

import duckdb
import pytest

from evalweave.llm import queries, warc

DATA = "/root/testdata/sf0.001"


def record(version, i, body, head="HTTP/1.1 200 OK"):
    block = f'{head}\r\nETag: "{i}"\r\n\r\n{body}'.encode()
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.com/{i}\r\nWARC-Date: 2024-01-01T00:00:0{i}Z\r\nWARC-Record-ID: <u{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_every_record_of_a_file(spark, tmp_path, version, zipped):
    bodies = ["one", "", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nb", "é last"]
    parts = [record(version, i, body) for i, body in enumerate(bodies)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(gzip.compress, parts) if zipped else parts))
    found = sorted(warc.read_warc(spark, f"file://{tmp_path}/a.warc").collect(), key=lambda r: r.record_id)
    assert [(r.record_id, r.status, r.body) for r in found] == [(f"<u{i}>", 200, body) for i, body in enumerate(bodies)]


@pytest.mark.parametrize(("status", "more"), [(301, []), (404, []), (503, []), (304, []), (206, []), (None, []), (200, [("content-range", "bytes 0-1/9")])])
def test_only_full_responses_are_sources(spark, status, more):
    rows = [
        ("r1", "response", "http://a.com/x", 1, "d", 200, [("etag", '"1"')]),
        ("r2", "response", "http://a.com/x", 2, "e", status, [("etag", '"2"'), *more]),
        ("r3", "revisit", "http://a.com/x", 3, None, 304, [("etag", '"1"')]),
    ]
    schema = "record_id string, type string, url string, ts long, digest string, status int, headers array<struct<name:string,value:string>>"
    found = warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    assert [(r.record_id, r.verdict, r.source_id) for r in found] == [("r3", "resolved", "r1")]


@pytest.mark.parametrize(("profile", "status", "kept"), [(None, 304, True), (None, None, True), (None, 200, False), ("http://netpreserve.org/warc/1.1/revisit/server-not-modified", 200, True), ("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", 304, False)])
def test_only_not_modified_revisits_are_resolved(spark, profile, status, kept):
    schema = "record_id string, type string, url string, ts long, digest string, status int, profile string, headers array<struct<name:string,value:string>>"
    rows = [("r1", "response", "http://a.com/x", 1, "d", 200, None, []), ("r2", "revisit", "http://a.com/x", 3, "d", status, profile, [])]
    assert [(r.record_id, r.verdict) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()] == ([("r2", "resolved")] if kept else [])


def test_pages_without_id_url_or_html(spark, tmp_path):
    rows = [(None, "http://a.com/x", "h"), (None, None, None), (3, None, "h"), (4, "http://a.com/y", None), (20, "http://a.com/y", "new"), (21, "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = [(r.page_id, r.canonical, r.source_page_id, r.verdict) for r in queries.op7_warc_revisits(spark, f"{tmp_path}").collect()]
    assert sorted(x[:3] for x in found if x[0] is not None) == [(3, None, None), (4, "a.com/y", 20), (20, "a.com/y", 20), (21, None, None)]
    assert sorted((str(x[1]), x[3]) for x in found if x[0] is None) == [("None", "missing"), ("a.com/x", "missing")]
    assert {x[3] for x in found if x[0] in (3, 21)} == {"missing"}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert queries.op7_warc_revisits(spark, f"{tmp_path}/empty").count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)
