"""Queries over resampling, folds, fitted models, sequences and text formats, and user functions."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import evidence, sequences, stats
from ..operators import evaluation, resampling
from ..operators.ordered import hash_ranks, positions
from ..operators.sketches import similar_sets
from ..registry import query
from ..roles import CALLS, PREDICTIONS, SAMPLES, calls, cohort, predictions, samples, table
from ..session import materialise, scratch
from ..sources import documents as docs
from .metrics import BA, CELLS
from .rows import READINGS, R_LIMIT, S_MAX, readings

#: Draws of a bootstrap, trials with anchors.
DRAWS, TRIALS, SEED = 10_000, 200, 20261114
BUDGETS = [3, 5, 10]


COUNTS = ["tp", "fn", "tn", "fp"]


def resampled_metrics(rows: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, draw, the rates of each draw): confusion counts by (group, cell) are resampled by group. ``rows``: group, y, pred."""
    cells = rows.groupBy("group", *cell).agg(*stats.confusion(F.col("y"), F.col("pred")))
    totals = resampling.resampled_totals(cells, cell, COUNTS, DRAWS, SEED)
    return totals.select(*cell, "draw", *(c.alias(n) for n, c in stats.metrics(*(F.col(c) for c in COUNTS)).items()))


def interval_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Valid draws, mean and 95 % interval of a value over its draws, of which there are DRAWS at most for each key."""
    found = df.groupBy(*keys).agg(F.count(value).alias("valid"), F.round(F.avg(value), 9).alias("mean"), *(F.round(F.percentile(value, q), 9).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))))
    return resampling.with_floor(found, DRAWS)


@query("B01_cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro mean over folds of the balanced accuracy in each draw, valid where every fold has both classes."""
    rows = predictions(spark, sf_dir).where("scheme = 'mod5'").withColumn("group", resampling.own_group(F.col("source"), F.col("doc_id")))
    ba = resampled_metrics(rows, ["fold", "model"]).groupBy("draw", "model").agg(F.count("ba").alias("folds"), F.avg("ba").alias("ba"))
    return interval_of(ba.select("model", F.when(F.col("folds") == 5, F.col("ba")).alias("ba")), ["model"], "ba")


@query("B02_group_bootstrap")
def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several metrics of whole groups drawn with replacement; a draw without both classes is invalid, and each figure says whether
    enough draws are valid (``require_floor`` stops a query where they aren't)."""
    rows = samples(spark, sf_dir).select("y", (F.col("score_a") >= 0.5).cast("int").alias("pred"), F.col("lang").alias("cohort"), resampling.own_group(F.col("source"), F.col("doc_id")).alias("group"))
    by = resampled_metrics(rows, ["cohort"])
    valid = F.col("sensitivity").isNotNull() & F.col("specificity").isNotNull()
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.when(valid, F.col(m)).cast("double").alias("value")) for m in ("sensitivity", "specificity", "ba", "mcc", "f1")))).alias("m")
    return interval_of(by.select("cohort", "draw", named).select("cohort", "m.metric", "m.value"), ["cohort", "metric"], "value")


@query("B03_paired_contrasts")
def paired_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model B less model A on the same draws."""
    rows = predictions(spark, sf_dir).where("scheme = 'mod5'").withColumn("group", resampling.own_group(F.col("source"), F.col("doc_id")))
    gap = evaluation.paired_gap(resampled_metrics(rows, ["model"]).select("draw", "model", "ba"), ["draw"], "model", "A", "B", ["ba"])
    share = lambda c: F.avg(F.when(F.col("ba_delta").isNotNull(), c.cast("double")))
    found = gap.agg(F.count("ba_delta").alias("valid"), share(F.col("ba_delta") > 0).alias("above"), share(F.col("ba_delta") < 0).alias("below"), *(F.round(F.percentile("ba_delta", q), 9).alias(n) for n, q in (("low", 0.025), ("high", 0.975))))
    return resampling.with_floor(found, DRAWS)


@query("B04_own_groups", "SELECT COUNT(DISTINCT CASE WHEN doc_id % 10 = 0 THEN 'UNRESOLVED::' || CAST(doc_id AS VARCHAR) ELSE source END) AS groups FROM documents")
def own_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").agg(F.count_distinct(resampling.own_group(group, F.col("doc_id"))).alias("groups"))


@query("B05_weighted_rank_metrics")
def weighted_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC and average precision in every draw, from cells of (group, score)."""
    rows = samples(spark, sf_dir).select("y", F.col("score_a").alias("score"), resampling.own_group(F.col("source"), F.col("doc_id")).alias("group"))
    by = resampling.resampled_ranks(rows, DRAWS, SEED)
    return by.select("draw", F.round("auroc", 9).alias("auroc"), F.round("ap", 9).alias("ap"))


@query("B06_anchor_trials")
def anchor_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a few labelled anchors a source point at the source whose rest is wrong most often, with anchors drawn alone or with
    their whole groups held out."""
    rows = samples(spark, sf_dir).withColumn("wrong", ((F.col("score_a") >= 0.5) != (F.col("y") == 1)).cast("int"))
    rows = rows.select(F.col("doc_id").alias("id"), "source", F.concat("lang", F.lit("/"), F.floor(F.col("score_b") * 10).cast("string")).alias("group"), "wrong")
    return resampling.flagged_sources(resampling.anchor_trials(rows, BUDGETS, TRIALS, SEED))


@query("B07_stratified_subsample", "WITH g AS (SELECT o_orderstatus, COUNT(*) * CAST(300 AS DOUBLE) / (SELECT COUNT(*) FROM orders) AS e FROM orders GROUP BY 1), r AS (SELECT o_orderstatus, floor(e) AS base, row_number() OVER (ORDER BY e - floor(e) DESC, o_orderstatus) AS r FROM g) SELECT o_orderstatus, CAST(base + CASE WHEN r <= 300 - (SELECT SUM(floor(e)) FROM g) THEN 1 ELSE 0 END AS BIGINT) AS n FROM r")
def stratified_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return resampling.stratified_sample(rows, "o_orderstatus", 300, "o_orderkey", SEED).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("B08_random_rows")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.random_rows(table(spark, sf_dir, "part").select("p_partkey"), 5, "p_partkey", 42)


def folded(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds a fold: rows of each label in hash order are dealt out in turn."""
    ranked = hash_ranks(rows, [label], F.xxhash64(F.lit(SEED), key), key, "__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


@query("M03_stratified_folds", f"WITH {SAMPLES} SELECT y, CAST(f AS INTEGER) AS fold, COUNT(*) AS n FROM (SELECT y, (row_number() OVER (PARTITION BY y ORDER BY doc_id) - 1) % 5 AS f FROM samples) u GROUP BY 1, 2")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(samples(spark, sf_dir), "y", "doc_id", 5).groupBy("y", "fold").agg(F.count("*").alias("n"))


def group_folds(groups: DataFrame, k: int) -> DataFrame:
    """(group, fold): groups from the most positives and rows on are dealt to the folds, there and back again, so
    that folds have like counts of both."""
    turn = F.col("position") % (2 * k)
    dealt = positions(groups, [F.col("positives").desc(), F.col("n").desc(), F.col("group")])
    return dealt.select("group", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


@query("M04_group_folds_M05_audit", f"WITH {SAMPLES} SELECT COUNT(*) AS groups, 0 AS crossing, CAST(5 AS BIGINT) AS folds FROM (SELECT DISTINCT source FROM samples) u")
def group_fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("group", F.col("source"))
    folds = group_folds(rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("y").alias("positives")), 5)
    by = rows.join(folds, "group").groupBy("group").agg(F.count_distinct("fold").alias("folds"), F.min("fold").alias("fold"))
    return by.agg(F.count("*").alias("groups"), F.sum((F.col("folds") > 1).cast("int")).cast("int").alias("crossing"), F.count_distinct("fold").alias("folds"))


@query("M06_logistic_regression")
def logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["score_a", "score_b"], outputCol="features").transform(samples(spark, sf_dir))
    model = LogisticRegression(labelCol="y", regParam=1 / max(1, rows.count()), elasticNetParam=0.0, standardization=False).fit(rows)
    return spark.createDataFrame([(float(model.intercept), *(float(c) for c in model.coefficients))], "intercept double, score_a double, score_b double")


@query("M01_M02_svd_kmeans")
def svd_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised vectors, their principal directions, and the clusters of the projections, by size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(rows)
    low = PCA(k=8, inputCol="unit", outputCol="features").fit(unit).transform(unit)
    found = KMeans(k=10, seed=42).fit(low).transform(low)
    return found.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@query("M10_fold_completeness", f"WITH {PREDICTIONS} SELECT scheme, model, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS ids, COUNT(*) = COUNT(DISTINCT doc_id) AS complete FROM predictions GROUP BY 1, 2")
def fold_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = predictions(spark, sf_dir).groupBy("scheme", "model").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    return by.withColumn("complete", F.col("n") == F.col("ids"))


@query("M12_prevalence_baseline", f"WITH {PREDICTIONS}, p AS (SELECT * FROM predictions WHERE model = 'A' AND scheme = 'mod5'), t AS (SELECT SUM(y) AS y, COUNT(*) AS n FROM p), f AS (SELECT fold, SUM(y) AS fy, COUNT(*) AS fn FROM p GROUP BY 1) SELECT fold, round(CAST(t.y - fy AS DOUBLE) / (t.n - fn), 9) AS prevalence FROM f, t")
def prevalence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = predictions(spark, sf_dir).where("model = 'A' and scheme = 'mod5'").groupBy("fold").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    total = f.agg(F.sum("y").alias("ty"), F.sum("n").alias("tn"))
    return f.crossJoin(F.broadcast(total)).select("fold", F.round((F.col("ty") - F.col("y")) / (F.col("tn") - F.col("n")), 9).alias("prevalence"))  # one row


@query("M13_source_shift", f"WITH {SAMPLES}, t AS (SELECT COUNT(*) AS n, SUM(y) AS y FROM samples), g AS (SELECT source, COUNT(*) AS n, SUM(y) AS y FROM samples GROUP BY 1) SELECT source, round(CAST(g.y AS DOUBLE) / g.n - CAST(t.y - g.y AS DOUBLE) / (t.n - g.n), 9) AS shift FROM g, t")
def source_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = samples(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    total = g.agg(F.sum("n").alias("tn"), F.sum("y").alias("ty"))
    return g.crossJoin(F.broadcast(total)).select("source", F.round(F.col("y") / F.col("n") - (F.col("ty") - F.col("y")) / (F.col("tn") - F.col("n")), 9).alias("shift"))  # one row


ANOMALY = f"WITH {SAMPLES}, b AS (SELECT source, least(4, CAST(floor(score_a * 5) AS INTEGER)) AS bin, COUNT(*) AS c FROM samples GROUP BY 1, 2), s AS (SELECT DISTINCT source FROM b), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin), g AS (SELECT s.source, k.bin, COALESCE(b.c, 0) AS c FROM s CROSS JOIN k LEFT JOIN b USING (source, bin)), t AS (SELECT *, SUM(c) OVER (PARTITION BY source) AS n, SUM(c) OVER (PARTITION BY bin) AS bc, SUM(c) OVER () AS a FROM g), d AS (SELECT source, CAST(c AS DOUBLE) / n AS p, CAST(bc - c AS DOUBLE) / (a - n) AS q FROM t) SELECT source, round(SUM((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 9) AS jsd FROM d GROUP BY 1"


@query("M14_source_anomaly", ANOMALY)
def source_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source's scores from those of all others."""
    b = samples(spark, sf_dir).groupBy("source", F.least(F.lit(4), F.floor(F.col("score_a") * 5).cast("int")).alias("bin")).agg(F.count("*").alias("c"))
    grid = b.select("source").distinct().withColumn("bin", F.explode(F.array(*map(F.lit, range(5)))))
    g = grid.join(b, ["source", "bin"], "left").fillna(0, ["c"])
    own, by_bin = g.groupBy("source").agg(F.sum("c").alias("n")), g.groupBy("bin").agg(F.sum("c").alias("bc"))
    rows = g.join(own, "source").join(F.broadcast(by_bin), "bin").crossJoin(F.broadcast(g.agg(F.sum("c").alias("a"))))  # five rows, one row
    part = stats.jensen_shannon(F.col("c") / F.col("n"), (F.col("bc") - F.col("c")) / (F.col("a") - F.col("n")))
    return rows.groupBy("source").agg(F.round(F.sum(part), 9).alias("jsd"))


@query("M15_spearman", f"WITH {SAMPLES}, g AS (SELECT source, AVG(score_a) AS s, AVG(CAST((score_a >= CAST(0.5 AS DOUBLE)) <> (y = 1) AS INTEGER)) AS e FROM samples GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY round(s, 9)) + (COUNT(*) OVER (PARTITION BY round(s, 9)) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY round(e, 9)) + (COUNT(*) OVER (PARTITION BY round(e, 9)) - 1) / CAST(2 AS DOUBLE) AS b FROM g) SELECT round(corr(a, b), 8) AS rho FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = ((F.col("score_a") >= 0.5) != (F.col("y") == 1)).cast("double")
    g = samples(spark, sf_dir).groupBy("source").agg(F.round(F.avg("score_a"), 9).alias("s"), F.round(F.avg(wrong), 9).alias("e"))
    ranked = g.select(*((F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0).alias(c) for c in ("s", "e")))  # a row for each source
    return ranked.agg(F.round(F.corr("s", "e"), 8).alias("rho"))


@query("J25_minhash_neighbours")
def minhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts whose words of 5 have a Jaccard distance below 0.2, none missed, with the distance -ln(2j/(1+j))/k. A text is
    named by the least of its documents. Single minima, as tables of MinHash, would bring most texts that share a common word of 5 together, so
    texts meet at the rarest hashes of their sets instead, as many as two that near need."""
    texts = table(spark, sf_dir, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    words = F.split(F.lower(F.trim("text")), r"\s+")
    last = F.size("w") - 4
    rows = texts.select(F.col("doc_id").alias("row"), words.alias("w")).where(F.size("w") >= 5)
    sets = materialise(rows.select("row", F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(5)), " ")))).alias("sketch")))
    j = F.col("jaccard")
    return similar_sets(sets, 0.2).select("a", "b", F.round(-F.log(2 * j / (1 + j)) / 5, 6).alias("distance"))


#: Each event is a case of its own, observed before and after. Intervals in SQL are lo, hi and whether they are closed.
EVIDENCE_SQL = f"""WITH {READINGS}, c AS (SELECT event_id AS i, sign, m, m * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 8 END AS n, CASE WHEN event_id % 5 IN (1, 3) THEN TRUE ELSE FALSE END AS swapped FROM readings),
  t AS (SELECT *, CASE WHEN swapped THEN '=' ELSE sign END AS other FROM c),
  x AS (SELECT *, CASE WHEN sign IN ('<', '<=') THEN 0 ELSE m END AS alo, CASE WHEN sign IN ('>', '>=') THEN 1e9 ELSE m END AS ahi, sign IN ('=', '>=') AS alc, sign IN ('=', '<=') AS ahc,
    CASE WHEN other IN ('<', '<=') THEN 0 ELSE n END AS blo, CASE WHEN other IN ('>', '>=') THEN 1e9 ELSE n END AS bhi, other IN ('=', '>=') AS blc, other IN ('=', '<=') AS bhc,
    CASE WHEN m <= {S_MAX} THEN 'S' WHEN m <= {R_LIMIT} THEN 'I' ELSE 'R' END AS ac, CASE WHEN i % 19 = 0 THEN 'ND' WHEN n <= {S_MAX} THEN 'S' WHEN n <= {R_LIMIT} THEN 'I' ELSE 'R' END AS bc FROM t),
  y AS (SELECT *, (alo < bhi OR alo = bhi AND alc AND bhc) AND (blo < ahi OR blo = ahi AND blc AND ahc) AS meet, m <> n OR sign <> other AS differs FROM x)
SELECT CASE WHEN i % 17 = 0 THEN 'INSUFFICIENT_PAIRED_REFERENCE' WHEN i % 13 = 0 THEN 'AMBIGUOUS_MULTIPLE_REFERENCE_STATES' WHEN i % 11 = 0 THEN 'UNSUPPORTED_OR_MISSING_MIC_OR_UNIT'
  WHEN i % 4 = 0 AND i % 8 <> 0 AND i % 12 <> 0 AND differs THEN 'DOCUMENTED_MIC_UPDATE_LINK' WHEN bc = 'ND' THEN 'CATEGORY_UNAVAILABLE_CAUSE_UNRESOLVED'
  WHEN NOT meet AND ac <> bc THEN 'DISJOINT_MIC_WITH_CATEGORY_CHANGE' WHEN NOT meet THEN 'DISJOINT_MIC_WITH_SAME_CATEGORY' WHEN ac <> bc THEN 'CATEGORY_ONLY_REFERENCE_DIFFERENCE'
  WHEN differs THEN 'OVERLAPPING_REPORTING_INTERVALS' ELSE 'SAME_REPORTED_REFERENCE' END AS evidence_state, COUNT(*) AS n FROM y GROUP BY 1"""


@query("F21_evidence_states", EVIDENCE_SQL)
def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = readings(spark, sf_dir).select("event_id", i.cast("string").alias("sample"), F.lit("Meropenem").alias("drug"), "sign", "number")
    rows = rows.withColumn("later", F.col("number") * F.element_at(F.array(F.lit(1), F.lit(2), F.lit(8)), (i % 3 + 1).cast("int"))).withColumn("other", F.when((i % 5).isin(1, 3), "=").otherwise(F.col("sign")))
    category = lambda n: F.when(n <= S_MAX, "S").when(n <= R_LIMIT, "I").otherwise("R")
    first = lambda sign, n, unit: F.struct(F.concat(sign, n.cast("string")).alias("mic"), unit.alias("unit"), category(F.col("number")).alias("category"))
    unit = F.when(i % 11 == 0, "mm").otherwise("mg/L")
    # some cases have a row more: the same in another spelling, or another reading
    again = F.when(i % 13 == 0, first(F.col("sign"), F.col("number") + 1, unit)).when((i % 7 == 0) & (i % 11 != 0), first(F.when(F.col("sign") == "=", "==").otherwise(F.col("sign")), F.col("number"), F.lit("µg/mL")))
    old = rows.select("sample", "drug", F.explode(F.array_compact(F.array(first(F.col("sign"), F.col("number"), unit), again))).alias("o")).select("sample", "drug", "o.*")
    new = rows.where(i % 17 != 0).select("sample", F.upper("drug").alias("drug"), F.concat("other", F.col("later").cast("string")).alias("mic"), F.lit("ug/ml").alias("unit"), F.when(i % 19 == 0, "ND").otherwise(category(F.col("later"))).alias("category"))
    history = rows.where(i % 4 == 0).select(
        "sample", "drug", F.concat("sign", F.col("number").cast("string")).alias("old_value"), F.concat("other", F.col("later").cast("string")).alias("new_value"),
        F.when(i % 12 == 0, "12/01/27").otherwise("01/15/24").alias("day"), F.when(i % 8 == 0, "").otherwise("https://example.org/h").alias("source_url"), F.sha2("sample", 256).alias("artifact_sha256"),
    )
    cases = rows.select("sample", "drug", F.lit("2024-06-01").cast("date").alias("as_of"))
    return evidence.audit(cases, old, new, history).groupBy("evidence_state").agg(F.count("*").alias("n"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, seq): the letters of a part's digest as bases."""
    return table(spark, sf_dir, "part").select("p_partkey", F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


DNA = "dna AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part)"


@query("F23_reverse_complement", f"WITH {DNA} SELECT p_partkey, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM dna")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("p_partkey", sequences.reverse_complement(F.col("seq")).alias("rc"))


@query("F24_occurrences_both_strands", f"WITH {DNA}, p AS (SELECT p_partkey, seq, i FROM dna, range(1, 31) t(i)) SELECT p_partkey, CAST(i AS INTEGER) AS start, CASE WHEN substr(seq, i, 3) = 'ACC' THEN '+' ELSE '-' END AS strand FROM p WHERE substr(seq, i, 3) IN ('ACC', 'GGT')")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("p_partkey", F.explode(sequences.both_strands(F.col("seq"), F.lit("ACC"))).alias("h")).select("p_partkey", "h.start", "h.strand")


@query("F25_hamming", f"WITH {DNA} SELECT a.p_partkey, CAST((SELECT COUNT(*) FROM range(1, 33) t(i) WHERE substr(a.seq, i, 1) <> substr(b.seq, i, 1)) AS INTEGER) AS distance FROM dna a JOIN dna b ON a.p_partkey + 1 = b.p_partkey")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir)
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("seq").alias("other"))
    return rows.join(other, "p_partkey").select("p_partkey", sequences.hamming(F.col("seq"), F.col("other")).alias("distance"))


@query("F26_typing_lines", "SELECT s_suppkey, CAST(s_suppkey % 50 AS VARCHAR) AS st, CAST(s_suppkey % 7 AS VARCHAR) AS gapa FROM supplier")
def typing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.concat(F.lit("x.fasta\tklebsiella\t"), (k % 50).cast("string"), F.lit("\tgapA("), (k % 7).cast("string"), F.lit(")\tinfB(3)"))
    pairs = F.map_from_arrays(F.regexp_extract_all(line, F.lit(r"(\w+)\(([^)]*)\)"), F.lit(1)), F.regexp_extract_all(line, F.lit(r"(\w+)\(([^)]*)\)"), F.lit(2)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.split(line, "\t"), 3).alias("st"), pairs["gapA"].alias("gapa"))


@query("F35_presence_vector", f"WITH {CALLS}, s AS (SELECT unnest(['Brand#1', 'Brand#2', 'Brand#99']) AS feature) SELECT c.sample, string_agg(CASE WHEN k.sample IS NULL THEN '0' ELSE '1' END, '' ORDER BY s.feature) AS bits FROM (SELECT DISTINCT sample FROM calls) c CROSS JOIN s LEFT JOIN calls k ON k.sample = c.sample AND k.feature = s.feature GROUP BY 1")
def presence_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ["Brand#1", "Brand#2", "Brand#99"]
    by = calls(spark, sf_dir).groupBy("sample").agg(F.collect_set("feature").alias("have"))
    return by.select("sample", F.concat(*(F.array_contains("have", f).cast("int").cast("string") for f in schema)).alias("bits"))


@query("S06_workbook_scan", "SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS key FROM region")
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # a fixed list
    cells = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{r.r_name}</t></is></c><c r="B{i}"><v>{r.r_regionkey}</v></c></row>' for i, r in enumerate(rows, 1))
    return _office(spark, "book.xlsx", {"xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"}).select(F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("key"))


@query("S22_document_tables", "SELECT r_name AS \"group\", n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey")
def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-cell rows name a group that the rows below belong to."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_name", "n_name").collect()  # a fixed list
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    lines, group = [], None
    for r in rows:
        if r.r_name != group:
            lines.append(f"<w:tr>{cell(r.r_name)}</w:tr>")
            group = r.r_name
        lines.append(f"<w:tr>{cell('')}{cell(r.n_name)}</w:tr>")
    found = _office(spark, "notes.docx", {"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:tbl>{"".join(lines)}</w:tbl></w:body></w:document>'})
    order = Window.partitionBy("file", "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    carried = found.withColumn("group", F.last(F.when(F.size("cells") == 1, F.get("cells", F.lit(0))), ignorenulls=True).over(order))
    return carried.where(F.size("cells") > 1).select("group", F.get("cells", F.lit(1)).alias("item"))


def _office(spark: SparkSession, name: str, parts: dict[str, str]) -> DataFrame:
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path, xml in parts.items():
            z.writestr(path, xml)
    content = spark.createDataFrame([(name, bytearray(packed.getvalue()))], "path string, content binary")
    return docs.office_rows(content)


@query("X01_scalar_function_X02_row_function", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders")
def scalar_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf(DoubleType())
    def doubled(price: pd.Series, status: pd.Series) -> pd.Series:
        return price.where(status != "F", price * 2)

    return table(spark, sf_dir, "orders").select("o_orderkey", doubled("o_totalprice", "o_orderstatus").alias("v"))


@query("X03_aggregate_function", "SELECT p_brand, round(SUM(CAST(p_size AS DOUBLE) * p_retailprice) / SUM(p_size), 6) AS weighted FROM part GROUP BY 1")
def aggregate_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum(F.col("p_size") * F.col("p_retailprice")) / F.sum("p_size"), 6).alias("weighted"))


@query("X04_table_function", "SELECT p_partkey, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) u")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.inline(F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word")))))


@query("A16_group_macro_average", f"WITH {PREDICTIONS}, c AS (SELECT source, {CELLS} FROM predictions WHERE scheme = 'mod5' AND model = 'B' GROUP BY 1), b AS (SELECT {BA} AS ba FROM c) SELECT round(AVG(ba), 9) AS macro, COUNT(ba) AS groups FROM b")
def group_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = evaluation.count_metrics(predictions(spark, sf_dir).where("scheme = 'mod5' and model = 'B'"), ["source"])
    return by.agg(F.round(F.avg("ba"), 9).alias("macro"), F.count("ba").alias("groups"))


@query("D13_interval_levels", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE event_id % 5 IN (2, 3)) AS open_above FROM events")
def interval_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.intervals import parse_mic

    x = parse_mic(F.col("raw"))
    return readings(spark, sf_dir).agg(F.count(x).alias("n"), F.count_if(x.isNotNull() & x["hi"].isNull()).alias("open_above"))


@query("D04_call_lists", f"WITH {CALLS} SELECT y, COUNT(*) AS calls FROM calls JOIN cohort USING (sample) GROUP BY 1")
def call_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).join(cohort(spark, sf_dir), "sample").groupBy("y").agg(F.count("*").alias("calls"))


@query("scratch_round_trip", "SELECT COUNT(*) AS n FROM supplier")
def scratch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "table")
    table(spark, sf_dir, "supplier").write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features of orders in wide form: presence of five brands, for the label of the order."""
    names = [f"Brand#{k}" for k in range(1, 6)]
    wide = calls(spark, sf_dir).where(F.col("feature").isin(names)).withColumn("one", F.lit(1.0)).groupBy("sample").pivot("feature", names).agg(F.max("one")).fillna(0.0)
    return cohort(spark, sf_dir).join(wide, "sample").select("sample", "y", *(F.col(f"`{n}`").alias(f"b{i}") for i, n in enumerate(names, 1)))


BRANDS = [f"b{i}" for i in range(1, 6)]


def _fitted_scores(spark: SparkSession, sf_dir: str, classifier) -> DataFrame:
    """Mean probability of the positive class by label, from a model fitted on even samples."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=BRANDS, outputCol="features").transform(_features(spark, sf_dir))
    model = classifier.fit(rows.where("sample % 2 = 0"))
    p = vector_to_array("probability")[1]
    return model.transform(rows.where("sample % 2 = 1")).groupBy("y").agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"))


@query("M08_tree_ensembles")
def tree_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    models = {"forest": RandomForestClassifier(labelCol="y", numTrees=10, seed=7), "boosting": GBTClassifier(labelCol="y", maxIter=4, stepSize=0.05, seed=7)}
    parts = [_fitted_scores(spark, sf_dir, m).withColumn("model", F.lit(name)) for name, m in models.items()]
    return parts[0].unionByName(parts[1])


@query("M09_multilayer_perceptron")
def multilayer_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return _fitted_scores(spark, sf_dir, MultilayerPerceptronClassifier(labelCol="y", layers=[5, 8, 2], maxIter=30, seed=7))


@query("M11_linear_attribution", f"WITH {CALLS}, x AS (SELECT c.sample, MAX(CASE WHEN feature = 'Brand#1' THEN 1 ELSE 0 END) AS b1, MAX(CASE WHEN feature = 'Brand#2' THEN 1 ELSE 0 END) AS b2 FROM calls c JOIN cohort USING (sample) WHERE feature IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') GROUP BY 1), m AS (SELECT AVG(CAST(b1 AS DOUBLE)) AS m1, AVG(CAST(b2 AS DOUBLE)) AS m2 FROM x) SELECT round(AVG(abs(CAST(0.7 AS DOUBLE) * (b1 - m1))), 9) AS b1, round(AVG(abs(CAST(-0.3 AS DOUBLE) * (b2 - m2))), 9) AS b2 FROM x, m")
def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute share of each feature in a linear score: coefficient times distance from the mean."""
    rows, coefficients = _features(spark, sf_dir), {"b1": 0.7, "b2": -0.3}
    means = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in coefficients))
    return rows.crossJoin(F.broadcast(means)).agg(*(F.round(F.avg(F.abs(F.lit(w) * (F.col(c) - F.col(f"m_{c}")))), 9).alias(c) for c, w in coefficients.items()))  # one row
