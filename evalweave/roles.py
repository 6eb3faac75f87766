"""The roles that the supplied tables play, as DataFrames and as SQL for the same rows.

Samples are labelled documents; their label is the quality, their group the source and their stratum the
language. Two scores with many ties are made of the text length. Snapshots of observations are the events
before and after a day; feature calls are the parts of orders, with the order's status as the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUT = "2024-01-16"

SAMPLES = """samples AS (
  SELECT d.doc_id, CAST(l.quality AS INTEGER) AS y, CAST(l.toxic AS INTEGER) AS y2, d.source, d.lang,
         CAST(d.n_chars % 100 AS DOUBLE) / 100 AS score_a, CAST((d.n_chars * 7) % 100 AS DOUBLE) / 100 AS score_b
  FROM documents d JOIN labels l USING (doc_id))"""

PREDICTIONS = (
    SAMPLES
    + """, predictions AS (
  SELECT doc_id, y, source, lang, scheme, fold, model, score, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM (
    SELECT doc_id, y, source, lang, 'mod5' AS scheme, doc_id % 5 AS fold, 'A' AS model, score_a AS score FROM samples
    UNION ALL SELECT doc_id, y, source, lang, 'mod5', doc_id % 5, 'B', score_b FROM samples
    UNION ALL SELECT doc_id, y, source, lang, 'mod3', doc_id % 3, 'A', score_a FROM samples
    UNION ALL SELECT doc_id, y, source, lang, 'mod3', doc_id % 3, 'B', score_b FROM samples) u)"""
)

CATEGORY = "CASE WHEN value < 20 THEN 'S' WHEN value < 60 THEN 'I' ELSE 'R' END"

SNAPSHOTS = f"""observations AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS target, event_type AS drug, {CATEGORY} AS category, value, ts FROM events),
old_snapshot AS (SELECT * FROM observations WHERE ts < TIMESTAMP '{CUT} 00:00:00'),
new_snapshot AS (SELECT * FROM observations WHERE ts >= TIMESTAMP '{CUT} 00:00:00')"""

CALLS = """calls AS (
  SELECT DISTINCT l.l_orderkey AS sample, p.p_brand AS feature FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
cohort AS (SELECT o_orderkey AS sample, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_orderpriority AS stratum FROM orders)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = lambda n: (n % 100).cast("double") / 100
    return docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("y2"), "source", "lang", score(F.col("n_chars")).alias("score_a"), score(F.col("n_chars") * 7).alias("score_b"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, source, lang, scheme, fold, model, score, pred), two schemes and two models."""
    rows = [F.struct(F.lit(f"mod{k}").alias("scheme"), (F.col("doc_id") % k).alias("fold"), F.lit(m).alias("model"), F.col(f"score_{m.lower()}").alias("score")) for k in (5, 3) for m in "AB"]
    return samples(spark, sf_dir).select("doc_id", "y", "source", "lang", F.explode(F.array(*rows)).alias("p")).select("doc_id", "y", "source", "lang", "p.*").withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("target"), F.col("event_type").alias("drug"), F.expr(CATEGORY).alias("category"), "value", "ts")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, cut = observations(spark, sf_dir), F.lit(f"{CUT} 00:00:00").cast("timestamp")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


def call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls before equal ones are made one."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("sample", "feature")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_rows(spark, sf_dir).distinct()


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("stratum"))
