"""Queries over the structure of a cohort: decompositions, clusters, and how sources differ."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, decomposition, shift, sketches
from ..registry import query
from ..roles import SAMPLES, call_rows, calls, cohort, samples, table
from ..session import materialise
from .models import folded, group_folds


def vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as (row, feature, value), rows of length 1."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("feature", "value"))
    return materialise(decomposition.l2_normalised(rows))


@query("M01_truncated_svd")
def truncated_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest singular values of the normalised vectors, with their shares of the variance."""
    found = decomposition.truncated_svd(vector_entries(spark, sf_dir))
    rows = [(i + 1, float(v), float(e)) for i, (v, e) in enumerate(zip(found.values, found.explained, strict=True))]
    return spark.createDataFrame(rows, "component int, value double, explained double").select("component", F.round("value", 6).alias("value"), F.round("explained", 8).alias("explained"))


@query("M01_svd_of_calls")
def svd_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature's loadings in the two leading directions of the calls, signed so that the greatest is positive.

    There are far fewer different sets of features than samples, so equal ones are one row of their number's weight."""
    sets = call_rows(spark, sf_dir).where("sample is not null").groupBy("sample").agg(F.array_sort(F.collect_set("feature")).alias("features"))  # the features of one sample
    cells, weights = decomposition.equal_sets(sets)
    entries = materialise(decomposition.l2_normalised(cells.withColumn("value", F.lit(1.0))))
    right = materialise(decomposition.truncated_svd(entries, k=2, weights=weights).right)
    turn = lambda i: F.signum(F.max_by(F.element_at("v", i), F.abs(F.element_at("v", i))))
    signs = right.agg(turn(1).alias("s1"), turn(2).alias("s2"))
    return right.crossJoin(F.broadcast(signs)).select("feature", F.round(F.element_at("v", 1) * F.col("s1"), 5).alias("first"), F.round(F.element_at("v", 2) * F.col("s2"), 5).alias("second"))  # one row


@query("M02_kmeans_sweep")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate numbers of clusters over the embedding in 50 directions, with silhouettes, sizes and the choice."""
    found = decomposition.truncated_svd(vector_entries(spark, sf_dir))
    values = F.array(*map(F.lit, found.values.tolist()))
    rows = materialise(found.left.select(F.col("row").alias("id"), F.zip_with("u", values, lambda a, b: a * b).alias("x")))
    records, _ = clustering.sweep(rows)
    return spark.createDataFrame([tuple(r.values()) for r in records], "k int, silhouette double, least long, median double, largest long, largest_share double, in_others double, selected boolean, rule string")


@query("M13_source_associations")
def source_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose presence within a source differs from all others, under a false discovery rate within the source."""
    return shift.source_associations(calls(spark, sf_dir), cohort(spark, sf_dir).select("sample", F.col("stratum").alias("source")))


@query("M13_source_classifier")
def source_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the features tell the source, out of fold: random folds, and folds of whole customers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("group"))
    named = calls(spark, sf_dir).groupBy("sample").agg(F.collect_set("feature").alias("names"))  # the features of one sample
    rows = orders.join(named, "sample", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    rows = CountVectorizer(inputCol="names", outputCol="features", binary=True, minDF=1).fit(rows).transform(rows)
    rows = materialise(StringIndexer(inputCol="source", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows).select("sample", "source", "group", "features", "label"))
    groups = group_folds(rows.groupBy("group").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("positives")), 5)
    schemes = {"stratified_random_5fold": folded(rows, "source", "sample", 5), "grouped_5fold": rows.join(groups, "group")}
    parts = [shift.source_classifier(materialise(part)).select(F.lit(name).alias("scheme"), "source", "label", "predicted") for name, part in schemes.items()]
    found = shift.recall_table(parts[0].unionByName(parts[1]), ["scheme"], "label")
    names = rows.select("label", "source").distinct()
    return found.join(F.broadcast(names), "label").select("scheme", "source", "n", F.round("recall", 6).alias("recall"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))  # a row for each source


#: What stands in for genes: whether a text holds these.
GENES = {"digit": "[0-9]", "dollar": "[$]", "bar": "[|]", "at": "@", "shout": "!!", "hash": "#"}

ANOMALY_SQL = f"""WITH {SAMPLES}, r AS (SELECT s.source, least(9, CAST(floor(score_a * 10) AS INTEGER)) AS bin, s.lang AS family, {', '.join(f"CAST(regexp_matches(d.text, '{p}') AS INTEGER) AS g_{n}" for n, p in GENES.items())} FROM samples s JOIN documents d USING (doc_id)),
s AS (SELECT source, COUNT(*) AS n FROM r GROUP BY 1),
c AS (SELECT 'score' AS part, CAST(b.v AS VARCHAR) AS cell, s.source, n, COUNT(*) FILTER (WHERE r.bin = b.v AND r.source = s.source) AS own, COUNT(*) FILTER (WHERE r.bin = b.v AND r.source <> s.source) AS others, COUNT(*) - any_value(n) AS rest FROM s, r, (SELECT DISTINCT bin AS v FROM r) b GROUP BY ALL
  UNION ALL SELECT 'family', b.v, s.source, n, COUNT(*) FILTER (WHERE r.family = b.v AND r.source = s.source), COUNT(*) FILTER (WHERE r.family = b.v AND r.source <> s.source), COUNT(*) - any_value(n) FROM s, r, (SELECT DISTINCT family AS v FROM r) b GROUP BY ALL),
j AS (SELECT part, source, own / CAST(n AS DOUBLE) AS p, others / CAST(rest AS DOUBLE) AS q FROM c),
d AS (SELECT source, part, SUM((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js FROM j GROUP BY 1, 2),
g AS (SELECT s.source, ({' + '.join(f"abs(AVG(CASE WHEN r.source = s.source THEN g_{n} END) - AVG(CASE WHEN r.source <> s.source THEN g_{n} END))" for n in GENES)}) / {len(GENES)} AS gap FROM s, r GROUP BY 1),
t AS (SELECT s.source, n, a.js AS score_js, b.js AS family_js, gap AS gene_gap, 0.4 * a.js + 0.4 * b.js + 0.2 * gap AS anomaly FROM s JOIN d a ON a.source = s.source AND a.part = 'score' JOIN d b ON b.source = s.source AND b.part = 'family' JOIN g ON g.source = s.source)
SELECT source, n, round(score_js, 9) AS score_js, round(family_js, 9) AS family_js, round(gene_gap, 9) AS gene_gap, round(anomaly, 9) AS anomaly, n >= 10 AS eligible, row_number() OVER (ORDER BY round(anomaly, 12) DESC, source) AS rank FROM t"""


@query("M14_label_free_score", ANOMALY_SQL)
def label_free_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against all others by scores, families and marks in the texts, without labels."""
    marks = table(spark, sf_dir, "documents").select("doc_id", *(F.col("text").rlike(p).alias(n) for n, p in GENES.items()))
    rows = samples(spark, sf_dir).select("doc_id", "source", F.col("score_a").alias("p"), F.col("lang").alias("family")).join(marks, "doc_id")
    found = shift.source_anomaly(rows, {n: F.col(n) for n in GENES})
    return found.withColumns({c: F.round(c, 9) for c in ("score_js", "family_js", "gene_gap", "anomaly")}).withColumn("rank", F.col("rank").cast("long"))


@query("J25_sketch_pairs")
def sketch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three cohorts that are near each other, by sketches of 21 characters, confirmed on the whole sets."""
    cohort_of = F.element_at(F.array(*map(F.lit, ("Development", "E2", "E3"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cohort_of.alias("cohort"), "text")
    found = sketches.sketch_pairs(rows)
    return found.withColumns({c: F.round(c, 9) for c in ("distance", "jaccard", "coverage")})
