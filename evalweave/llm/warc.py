"""WARC records and the resolution of not-modified revisits.

A revisit record of a 304 answer has no body: it stands for the body of an earlier full response. It is
resolved by an as-of join on the canonical URL: the latest full response (status 200, no Content-Range) that is
strictly earlier (of equal times the larger record id). A revisit counts as not modified by its profile, or without
one by its status 304 (or none); others, such as those of an identical digest, aren't reported. Then validators are
checked, the first that both sides have: entity tags (weakly: without ``W/``), the modification date, the payload
digest. If it agrees, the revisit is ``resolved`` and the
stored headers are updated with those that a 304 answer may change; a disagreement is a ``mismatch``, no common
validator ``unvalidated``, no earlier response ``missing``.

The join is a running maximum in ranges of time, plus a running maximum over the ranges' own maxima: a URL
with a third of all records is spread over as many tasks as there are ranges. Bodies stay out of it.

Defined cases: null or empty URLs resolve to nothing (``missing``); records without a time can't be ordered:
such responses are not candidates and such revisits are ``missing``; repeated records are reported each; of
headers that repeat a name the first counts; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, materialise, unused
from .ordered import BUCKET, add_bucket, shuffle_width

#: The header fields that a 304 answer carries for the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_|ref=)"
VERSION, BREAK = "WARC/1.0\r\n", "\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes that are buffered of a file.
PIECE = 1 << 20
#: Fixed value: how the profile of a not-modified revisit ends.
NOT_MODIFIED = "server-not-modified"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path (at least ``/``), and the sorted query
    without tracking parameters; scheme and fragment don't count. Null without a host."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"://([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"://[^/?]*([^?]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"(?s)\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def header_list(block: Column) -> Column:
    """array<struct<name, value>> of the lines ``name: value`` of a block, names in lower case."""
    lines = F.filter(F.split(block, BREAK), lambda x: F.instr(x, ":") > 0)
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value")))


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


#: The columns that parsing adds.
PARSED = ("type", "url", "ts", "record_id", "digest", "profile", "status", "headers", "body")


def parse_records(df: DataFrame, record: str = "warc") -> DataFrame:
    """The columns of ``df`` but ``record``, and type, url, ts (seconds), record_id, digest, profile, status,
    headers and body. A column of ``df`` that has one of these names, whatever its case, gets underscores at its end until nothing
    else has it."""
    taken, others = {*PARSED, *(c.lower() for c in df.columns)}, []
    for c in (c for c in df.columns if c != record):
        name = c
        if c.lower() in PARSED:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        others.append((c, name))
    parts, warc = unused(df, "__parts"), unused(df, "__warc")
    cut = df.withColumn(parts, F.split(F.regexp_replace(F.col(f"`{record}`"), r"^WARC/1\.[01]\r\n", ""), "\r\n\r\n", 3))
    cut = cut.withColumn(warc, header_list(F.get(parts, F.lit(0))))
    http, head = F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.col(warc)
    return cut.select(
        *(F.col(f"`{c}`").alias(name) for c, name in others),
        header(head, "warc-type").alias("type"),
        header(head, "warc-target-uri").alias("url"),
        F.unix_timestamp(F.try_to_timestamp(header(head, "warc-date"))).alias("ts"),
        header(head, "warc-record-id").alias("record_id"),
        header(head, "warc-payload-digest").alias("digest"),
        header(head, "warc-profile").alias("profile"),
        F.try_element_at(F.split(F.substring_index(http, BREAK, 1), " "), F.lit(2)).cast("int").alias("status"),
        header_list(http).alias("headers"),
        F.get(parts, F.lit(2)).alias("body"),
    )


def cut_records(stream: BinaryIO) -> Iterator[bytes]:
    """The records of an uncompressed WARC stream, each as long as its Content-Length says. Where that is
    missing or no record's end follows, a record goes on to the next version line."""
    line = stream.readline()
    while line:
        if not VERSION_LINE.match(line):
            line = stream.readline()
            continue
        record, length = [line], 0
        while line := stream.readline():
            record.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
            if line == b"\r\n":
                break
        record.append(stream.read(length))
        rest, line = [], stream.readline()
        while line and not VERSION_LINE.match(line):
            rest.append(line)
            line = stream.readline()
        yield b"".join(record + (rest if any(x.strip() for x in rest) else []))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of versions 1.0 and 1.1, plain or gzipped, cut by their Content-Length.

    A file is streamed in one task through ``pyarrow.fs``. Bodies that aren't UTF-8 are read with replacement
    characters; their digests are those of the file.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # the contents aren't loaded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (u for batch in batches for u in batch.column("path").to_pylist()):
            store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
            with store.open_input_file(name) as file:
                zipped = file.read(2) == b"\x1f\x8b"
                file.seek(0)
                for record in cut_records(io.BufferedReader(gzip.GzipFile(fileobj=file) if zipped else file, PIECE)):
                    yield batch_of(warc=([record.decode("utf-8", "replace")], pa.string()))

    return parse_records(files.mapInArrow(run, "warc string"))


def merged_headers(stored: Column, answer: Column) -> Column:
    """The stored headers, with the permitted ones of the 304 answer in place of theirs, sorted, one a line."""
    new = F.filter(answer, lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    kept = F.filter(stored, lambda h: ~F.array_contains(names, h["name"]))
    return F.array_join(F.array_sort(F.transform(F.concat(kept, new), lambda h: F.concat(h["name"], F.lit(": "), h["value"]))), "\n")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical, ts, verdict, validator, source_id, headers) of every not-modified revisit.

    ``records``: record_id, type, url, ts, digest, headers, status and profile as ``parse_records`` gives them. Without
    a column status every response that isn't a range counts as full.
    """
    status = F.col("status") if "status" in records.columns else F.lit(None).cast("int")
    whole = header(F.col("headers"), "content-range").isNull()
    if "status" in records.columns:
        whole = whole & (F.coalesce(status, F.lit(0)) == 200)
    unchanged = F.coalesce(status, F.lit(304)) == 304
    if "profile" in records.columns:
        unchanged = F.when(F.col("profile").isNotNull(), F.contains(F.lower("profile"), F.lit(NOT_MODIFIED))).otherwise(unchanged)
    rows = records.where((F.col("type") == "revisit") & unchanged | (F.col("type") == "response") & whole)
    rows = rows.select("record_id", "type", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "digest", "headers")
    full = F.when(F.col("type") == "response", F.struct("ts", "record_id", "digest", "headers"))
    # what follows reads the records several times: they are parsed once
    rows = materialise(rows.withColumn("full", full))
    # records without a URL or time meet nothing
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    lost = rows.where(~placed & (F.col("type") == "revisit")).withColumn("source", F.lit(None).cast(rows.schema["full"].dataType))
    rows = add_bucket(rows.where(placed), "ts", shuffle_width(records))
    earlier = Window.partitionBy("canonical", BUCKET).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("full").over(earlier)).where("type = 'revisit'")
    ranges = rows.where("full is not null").groupBy("canonical", BUCKET).agg(F.max("full").alias("last"))
    # a range's revisits also look at the ranges before it: those with revisits only get a row as well
    asked = near.select("canonical", BUCKET).distinct()
    spans = asked.join(ranges, ["canonical", BUCKET], "full")
    before = Window.partitionBy("canonical").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.max("last").over(before)).select("canonical", BUCKET, "carried")
    found = near.join(carried, ["canonical", BUCKET], "left").withColumn("source", F.coalesce("near", "carried"))
    return judged(found.select(*lost.columns).unionByName(lost))


def judged(found: DataFrame) -> DataFrame:
    """Verdict and merged headers of revisits with the response they found in ``source``."""
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = {
        "etag": (bare(header(F.col("headers"), "etag")), bare(header(F.col("source.headers"), "etag"))),
        "last-modified": (header(F.col("headers"), "last-modified"), header(F.col("source.headers"), "last-modified")),
        "digest": (F.col("digest"), F.col("source.digest")),
    }
    validator, agrees = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, (own, other) in reversed(pairs.items()):
        both = own.isNotNull() & other.isNotNull()
        validator, agrees = F.when(both, F.lit(name)).otherwise(validator), F.when(both, own == other).otherwise(agrees)
    verdict = F.when(F.col("source").isNull(), "missing").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    rows = found.withColumn("verdict", verdict).withColumn("validator", F.when(F.col("source").isNotNull(), validator))
    merged = F.when(F.col("verdict") == "resolved", merged_headers(F.col("source.headers"), F.col("headers")))
    return rows.select("record_id", "canonical", "ts", "verdict", "validator", F.col("source.record_id").alias("source_id"), merged.alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl of the table ``pages`` as WARC records (page_id, warc): each page's full response, a minute
    after the page before, and a revisit at least half a day later, with validators of several kinds. Between
    the two some pages answer with an error, with a part of the page or with 304, which can't be sources. A page
    without an id has no times, so its revisit is ``missing``."""
    i = F.col("page_id")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    date = lambda ts: F.date_format(ts.cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    stamp = lambda ts: F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = F.lit(1704067200) + i * 60
    between = first + 21600
    again = first + 43200 + (i % 7) * 600
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))

    def record(kind: str, name: str, ts: Column, http: Column, body: Column) -> Column:
        head = [line("WARC-Type", F.lit(kind)), line("WARC-Target-URI", F.coalesce(F.col("url"), F.lit(""))), line("WARC-Date", stamp(ts)), line("WARC-Record-ID", F.concat(F.lit(name + "-"), F.coalesce(i.cast("string"), F.lit(""))))]
        more = [line("WARC-Payload-Digest", F.concat(F.lit("md5:"), digest))] if kind == "response" else [F.when(i % 11 == 5, line("WARC-Payload-Digest", F.concat(F.lit("md5:"), digest))).otherwise(F.lit(""))]
        return F.concat(F.lit(VERSION), *head, *more, F.lit(BREAK), http, F.lit(BREAK), body)

    full = F.concat(
        F.lit("HTTP/1.1 200 OK" + BREAK), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")),
        line("ETag", F.concat(F.when(i % 5 == 0, "W/").otherwise(""), tag)), line("Last-Modified", date(first - 86400)), line("Cache-Control", F.lit("max-age=3600")), line("Date", date(first)),
    )
    part = F.when(i % 3 == 0, "404 Not Found" + BREAK).when(i % 3 == 1, "206 Partial Content" + BREAK + "Content-Range: bytes 0-0/9" + BREAK).otherwise("304 Not Modified" + BREAK)
    other = F.concat(F.lit("HTTP/1.1 "), part, line("ETag", F.lit('"between"')), line("Date", date(between)))
    answer = F.concat(
        F.lit("HTTP/1.1 304 Not Modified" + BREAK), line("Date", date(again)), line("Cache-Control", F.lit("max-age=600")), line("Content-Length", F.lit("0")), line("Expires", date(again + 600)),
        F.when(i % 3 != 0, line("ETag", F.when(i % 13 == 0, F.lit('"other"')).otherwise(tag))).when(i % 11 > 5, line("Last-Modified", date(first - 86400))).otherwise(F.lit("")),
    )
    html = F.coalesce(F.col("html"), F.lit(""))
    some = [record("response", "response", first, full, html), F.when(i % 17 == 3, record("response", "between", between, other, F.lit("x"))), record("revisit", "revisit", again, answer, F.lit(""))]
    return pages.select("page_id", F.explode(F.array_compact(F.array(*some))).alias("warc"))
