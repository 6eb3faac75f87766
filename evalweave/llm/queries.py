"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, centroids, fingerprint, licenses, mixing, packing, quality, simhash, toxicity, transport, url_filter, warc
from .common import documents, materialise


#: The rules of the URL query: host, path and verdict.
URL_RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = mixing.mix(materialise(mixing.source_tokens(documents(spark, sf_dir))))
    return dealt.select(dealt.doc.alias("doc_id"), "source", "tokens", "epoch", "weight", "budget", "before", "block")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.parse_records(warc.page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    found = warc.resolve_revisits(records.drop("body"))
    number = F.regexp_extract("record_id", r"^[a-z]+-(-?\d*)$", 1).try_cast("long")
    source = F.regexp_extract("source_id", r"^[a-z]+-(-?\d*)$", 1).try_cast("long")
    return found.select(number.alias("page_id"), "canonical", "ts", "verdict", "validator", source.alias("source_page_id"), "headers")


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_digests(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.assignments(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_byte_level_bpe,
        op3_url_filter,
        op4_fingerprint,
        op5_token_binary,
        op6_mixing,
        op7_warc_revisits,
        op8_transport_stream,
        op9_simhash,
        op10_toxicity,
        op11_quality,
        op12_filter_audit,
        op13_centroids,
    )
}

URL_PARTS = r"""u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)"""


def _rule_sql(rule: url_filter.Rule) -> str:
    return f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}') THEN"


def _url_sql() -> str:
    """The rules from the longest on: the first that fits decides."""
    longest = sorted(URL_RULES, key=lambda r: -len(r.name))
    names = " ".join(f"{_rule_sql(r)} '{r.name}'" for r in longest)
    verdicts = " ".join(f"{_rule_sql(r)} '{r.verdict}'" for r in longest)
    return f"WITH {URL_PARTS} SELECT page_id, host, path, CASE {names} END AS rule, CASE {verdicts} ELSE 'allow' END AS verdict FROM u"


#: The captures that ``warc.page_captures`` writes, and the latest earlier response of each revisit.
WARC_SQL = r"""
WITH c AS (
  SELECT page_id AS i, html, md5(coalesce(html, '')) AS digest, 1704067200 + page_id * 60 AS t, 1704067200 + page_id * 60 + 43200 + (page_id % 7) * 600 AS again,
         regexp_replace(coalesce(url, ''), '#.*$', '', 's') AS bare FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
  regexp_extract(bare, '://[^/?]*([^?]*)', 1) AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=)'))), '&') AS query FROM c),
k AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM h),
s AS (SELECT r.i, max(f.i) AS source FROM k r LEFT JOIN k f ON f.canonical = r.canonical AND f.t < r.again GROUP BY 1),
j AS (SELECT r.i AS page_id, r.canonical, r.again AS ts, s.source, f.t AS ft, f.html AS fhtml, f.digest AS fdigest, r.digest AS rdigest, r.t AS rt,
  '"' || substr(f.digest, 1, 16) || '"' AS ftag,
  CASE WHEN r.i % 3 <> 0 THEN CASE WHEN r.i % 13 = 0 THEN '"other"' ELSE '"' || substr(r.digest, 1, 16) || '"' END END AS rtag,
  CASE WHEN r.i % 3 = 0 AND r.i % 11 > 5 THEN r.t - 86400 END AS rmod, f.t - 86400 AS fmod,
  CASE WHEN r.i % 11 = 5 THEN r.digest END AS rsent
  FROM k r JOIN s ON s.i IS NOT DISTINCT FROM r.i LEFT JOIN k f ON f.i = s.source),
v AS (SELECT *, CASE WHEN source IS NULL THEN NULL WHEN rtag IS NOT NULL THEN 'etag' WHEN rmod IS NOT NULL THEN 'last-modified' WHEN rsent IS NOT NULL THEN 'digest' END AS validator,
  CASE WHEN source IS NULL THEN 'missing' WHEN rtag IS NOT NULL THEN CASE WHEN rtag = ftag THEN 'resolved' ELSE 'mismatch' END
    WHEN rmod IS NOT NULL THEN CASE WHEN rmod = fmod THEN 'resolved' ELSE 'mismatch' END
    WHEN rsent IS NOT NULL THEN CASE WHEN 'md5:' || rsent = 'md5:' || fdigest THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS verdict FROM j)
SELECT page_id, canonical, ts, verdict, validator, source AS source_page_id,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || CAST(octet_length(encode(coalesce(fhtml, ''))) AS VARCHAR) || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10)
    || 'date: ' || strftime(make_timestamp(ts * 1000000), '%a, %d %b %Y %H:%M:%S GMT') || chr(10)
    || 'etag: ' || CASE WHEN rtag IS NOT NULL THEN rtag ELSE CASE WHEN source % 5 = 0 THEN 'W/' ELSE '' END || ftag END || chr(10)
    || 'expires: ' || strftime(make_timestamp((ts + 600) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') || chr(10)
    || 'last-modified: ' || strftime(make_timestamp(fmod * 1000000), '%a, %d %b %Y %H:%M:%S GMT') END AS headers
FROM v"""

#: Masks by rule, then all orders of the five letters; what an order's earlier letters are is read from its text.
AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, doc_id, len(words) < 50 AS a, 100 * list_unique(words) < 65 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
c AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
  count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM f LEFT JOIN labels l USING (doc_id) GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
u AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, '[' || filter_order[1:step] || ']' AS upto, '[' || filter_order[1:step - 1] || '_]' AS before FROM o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, letter,
  sum(n) FILTER (WHERE NOT regexp_matches(failed, upto)) AS kept,
  sum(n) FILTER (WHERE contains(failed, letter) AND NOT regexp_matches(failed, before)) AS removed,
  sum(n) FILTER (WHERE contains(failed, letter) AND regexp_matches(failed, before)) AS redundant,
  sum(n) FILTER (WHERE failed = letter) AS unique_fails,
  sum(good) FILTER (WHERE contains(failed, letter) AND NOT regexp_matches(failed, before)) AS good_lost,
  sum(toxic) FILTER (WHERE contains(failed, letter) AND NOT regexp_matches(failed, before)) AS toxic_lost FROM c, u GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM g"""


def _centroid_sql(k: int, rounds: int) -> str:
    """Plain Lloyd: every round compares every vector with every centroid. Components are rows (vec_id, i, x)."""
    parts = [
        f"""w AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMS}),
v AS MATERIALIZED (SELECT vec_id, unnest(range({centroids.DIMS})) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM w),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{centroids.SALT}' || vec_id)) - 1 AS cluster FROM w QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, i, x FROM s JOIN v USING (vec_id))"""
    ]
    assigned = "d{n} AS MATERIALIZED (SELECT * FROM (SELECT vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{n} c USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
    for n in range(rounds):
        parts.append(assigned.format(n=n))
        mean = f"SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS exactly FROM d{n} JOIN v USING (vec_id) GROUP BY ALL"
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce(m.exactly, c.x) AS x FROM c{n} c LEFT JOIN ({mean}) m ON m.cluster = c.cluster AND m.i = c.i)")
    parts.append(assigned.format(n=rounds))
    named = f"(SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM d{rounds} JOIN {named} USING (cluster)"


#: SQL for those that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op3_url_filter": _url_sql(), "op7_warc_revisits": WARC_SQL, "op12_filter_audit": AUDIT_SQL, "op13_centroids": _centroid_sql(centroids.CENTROIDS, centroids.ROUNDS)}
