"""Queries over groups, windows, sets, orders and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import association, ordered
from ..operators.ordered import carried_down, join_same, running_totals, with_totals
from ..registry import query
from ..roles import CALLS, SAMPLES, SNAPSHOTS, calls, cohort, samples, snapshots, table


@query("A01_group_count", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("A02_value_shares", "SELECT event_type, COUNT(*) AS n, round(100 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 2) AS percent FROM events GROUP BY 1")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100 * F.col("n").cast("double") / F.col("total"), 2).alias("percent"))  # one row


@query("A03_distinct_counts", "SELECT COUNT(DISTINCT l.quality) AS known, COUNT(DISTINCT l.quality) + MAX(CASE WHEN l.quality IS NULL THEN 1 ELSE 0 END) AS with_null FROM documents d LEFT JOIN labels l USING (doc_id)")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count_distinct("quality").alias("known"), (F.count_distinct("quality") + F.max(F.col("quality").isNull().cast("int"))).alias("with_null"))


@query("A04_named_aggregates", "SELECT p_brand, COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS total, round(AVG(p_retailprice), 6) AS mean, round(quantile_cont(p_retailprice, 0.5), 6) AS median, MIN(p_size) AS low, MAX(p_size) AS high FROM part GROUP BY 1")
def named_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    by = parts.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    middle = ordered.exact_quantiles(parts, ["p_brand"], "p_retailprice", {"median": 0.5})
    return with_totals(by, middle.select("p_brand", F.round("median", 6).alias("median")), ["p_brand"])


@query("A05_conditional_aggregate", "SELECT l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AS early, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned, COUNT(*) FILTER (WHERE l_discount > CAST(0.05 AS DOUBLE)) AS discounted FROM lineitem GROUP BY 1")
def conditional_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("l_shipdate") < F.lit("1998-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "lineitem").groupBy(early.alias("early")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("A06_rates", "SELECT l_linestatus, round(AVG(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent FROM lineitem GROUP BY 1")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("double")) * 100, 6).alias("percent"))


@query("A07_exact_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.5), 6) AS mid, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem GROUP BY 1")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = {"low": 0.025, "mid": 0.5, "high": 0.975}
    found = ordered.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", points)
    return found.select("l_returnflag", *(F.round(n, 6).alias(n) for n in points))


@query("A08_sample_deviation", "SELECT s_nationkey, round(stddev_samp(s_acctbal), 6) AS sd FROM supplier GROUP BY 1")
def sample_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.stddev_samp("s_acctbal"), 6).alias("sd"))


@query("A09_mode", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) u WHERE r = 1")
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("best")).select("user_id", "best.event_type")


@query("A10_joined_sets", "SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand))[1:20], ';') AS brands FROM part GROUP BY 1")
def joined_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 20), ";").alias("brands"))


@query("A11_contingency", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS F, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS O, COUNT(*) FILTER (WHERE o_orderstatus = 'X') AS X FROM orders GROUP BY 1")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "X"]).count().fillna(0)


@query("A12_pivot_presence", f"WITH {CALLS} SELECT sample, MAX(CASE WHEN feature = 'Brand#1' THEN 1 ELSE 0 END) AS b1, MAX(CASE WHEN feature = 'Brand#2' THEN 1 ELSE 0 END) AS b2 FROM calls GROUP BY 1")
def pivot_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = calls(spark, sf_dir).withColumn("one", F.lit(1)).groupBy("sample").pivot("feature", ["Brand#1", "Brand#2"]).agg(F.max("one"))
    return wide.fillna(0).select("sample", F.col("`Brand#1`").alias("b1"), F.col("`Brand#2`").alias("b2"))


@query("A13_wide_to_long", "SELECT r_regionkey, 'name' AS field, r_name AS value FROM region UNION ALL SELECT r_regionkey, 'key', CAST(r_regionkey AS VARCHAR) FROM region")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("key"))
    return rows.unpivot("r_regionkey", ["name", "key"], "field", "value")


COUNTS = f"{CALLS}, t AS (SELECT SUM(y) AS n_pos, SUM(1 - y) AS n_neg FROM cohort), f AS (SELECT feature, CAST(SUM(y) AS DOUBLE) AS a, CAST(SUM(1 - y) AS DOUBLE) AS b, MAX(n_pos) AS p, MAX(n_neg) AS q FROM calls JOIN cohort USING (sample), t GROUP BY 1)"


@query("A26_prevalence_filter", f"WITH {CALLS}, n AS (SELECT COUNT(*) AS n FROM cohort), p AS (SELECT feature, COUNT(DISTINCT sample) AS present FROM calls GROUP BY 1) SELECT feature, present, n - present AS absent, CASE WHEN present < 1300 THEN 'TOO_RARE' WHEN n - present < 1300 THEN 'NEAR_CONSTANT' ELSE 'KEEP' END AS reason FROM p, n")
def prevalence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cohort(spark, sf_dir).agg(F.count("*").alias("n"))
    rows = calls(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("present")).crossJoin(F.broadcast(n))  # one row
    absent = F.col("n") - F.col("present")
    return rows.select("feature", "present", absent.alias("absent"), F.when(F.col("present") < 1300, "TOO_RARE").when(absent < 1300, "NEAR_CONSTANT").otherwise("KEEP").alias("reason"))


@query("A27_threshold_spectrum", "SELECT COUNT(*) FILTER (WHERE n >= 1) AS at_least_1, COUNT(*) FILTER (WHERE n >= 20) AS at_least_20, COUNT(*) FILTER (WHERE n >= 40) AS at_least_40 FROM (SELECT l_partkey, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) u")
def threshold_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return by.agg(*(F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (1, 20, 40)))


@query("A28_chi2_pearson", f"WITH {COUNTS} SELECT feature, round((p + q) * power(a * (q - b) - b * (p - a), 2) / ((a + b) * (p + q - a - b) * p * q), 8) AS chi2 FROM f")
def chi2_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = association.presence_counts(calls(spark, sf_dir), cohort(spark, sf_dir))
    return c.select("feature", F.round(stats.chi2_pearson(*(F.col(x) for x in ("a", "b", "n_pos", "n_neg"))), 8).alias("chi2"))


@query("A29_chi2_presence", f"WITH {COUNTS} SELECT feature, round(power(a - (a + b) * p / (p + q), 2) / ((a + b) * p / (p + q)) + power(b - (a + b) * q / (p + q), 2) / ((a + b) * q / (p + q)), 8) AS chi2 FROM f")
def chi2_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = association.presence_counts(calls(spark, sf_dir), cohort(spark, sf_dir))
    return c.select("feature", F.round(stats.chi2_presence(*(F.col(x) for x in ("a", "b", "n_pos", "n_neg"))), 8).alias("chi2"))


STRATA = f"{CALLS}, t AS (SELECT stratum, SUM(y) AS p, SUM(1 - y) AS q FROM cohort GROUP BY 1), g AS (SELECT DISTINCT feature FROM calls), k AS (SELECT stratum, feature, SUM(y) AS a, SUM(1 - y) AS b FROM calls JOIN cohort USING (sample) GROUP BY 1, 2), s AS (SELECT t.stratum, g.feature, CAST(COALESCE(a, 0) AS DOUBLE) AS a, CAST(COALESCE(b, 0) AS DOUBLE) AS b, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM t CROSS JOIN g LEFT JOIN k USING (stratum, feature))"
LOR = f"{STRATA}, l AS (SELECT stratum, feature, ln((a + h) * (q - b + h) / ((b + h) * (p - a + h))) AS lor, sqrt(1 / (a + h) + 1 / (b + h) + 1 / (p - a + h) + 1 / (q - b + h)) AS se FROM (SELECT *, CASE WHEN a = 0 OR b = 0 OR p - a = 0 OR q - b = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS h FROM s) x)"


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir)
    return association.all_strata(association.presence_counts(calls(spark, sf_dir), people, ["stratum"]), people, ["stratum"])


def _log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, p, q = (F.col(c) for c in ("a", "b", "n_pos", "n_neg"))
    lor, se = stats.log_odds(a, b, p - a, q - b)
    return _strata(spark, sf_dir).select("stratum", "feature", lor.alias("lor"), se.alias("se"))


@query("A30_log_odds", f"WITH {LOR} SELECT stratum, feature, round(lor, 8) AS lor, round(se, 8) AS se FROM l")
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_odds(spark, sf_dir).select("stratum", "feature", F.round("lor", 8).alias("lor"), F.round("se", 8).alias("se"))


@query("A31_meta_analysis", f"WITH {LOR}, w AS (SELECT *, 1 / (se * se) AS w FROM l), m AS (SELECT feature, COUNT(*) AS k, SUM(w) AS sw, SUM(w * w) AS sw2, SUM(w * lor) / SUM(w) AS fixed FROM w GROUP BY 1), h AS (SELECT m.feature, m.k, m.fixed, m.sw, m.sw2, SUM(w.w * power(w.lor - m.fixed, 2)) AS qq FROM w JOIN m USING (feature) GROUP BY 1, 2, 3, 4, 5), tau AS (SELECT *, greatest(0, (qq - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM h), r AS (SELECT tau.feature, SUM(lor / (se * se + tau2)) / SUM(1 / (se * se + tau2)) AS random, sqrt(1 / SUM(1 / (se * se + tau2))) AS random_se FROM w JOIN tau USING (feature) GROUP BY 1) SELECT feature, k, round(fixed, 7) AS fixed, round(qq, 7) AS q, round(tau2, 7) AS tau2, round(random, 7) AS random, round(random_se, 7) AS random_se FROM tau JOIN r USING (feature)")
def meta_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = association.meta_analysis(_log_odds(spark, sf_dir), ["feature"])
    return found.select("feature", "k", *(F.round(c, 7).alias(c) for c in ("fixed", "q", "tau2", "random", "random_se")))


@query("A32_cochran_mantel_haenszel", f"WITH {STRATA}, u AS (SELECT *, p + q AS n, a + b AS m FROM s WHERE p > 0 AND q > 0 AND a + b > 0 AND a + b < p + q) SELECT feature, round(SUM(a * (q - b) / n) / SUM(b * (p - a) / n), 8) AS pooled_or, round(power(SUM(a - m * p / n), 2) / SUM(m * (n - m) * p * q / (n * n * (n - 1))), 7) AS cmh_chi2, COUNT(*) AS informative FROM u GROUP BY 1")
def cochran_mantel_haenszel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _strata(spark, sf_dir).groupBy("feature").agg(*association.cochran_mantel_haenszel(*(F.col(c) for c in ("a", "b", "n_pos", "n_neg"))))
    return found.select("feature", F.round("pooled_or", 8).alias("pooled_or"), F.round("cmh_chi2", 7).alias("cmh_chi2"), F.col("informative"))


@query("A33_fisher_exact")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, p, q = (F.col(c) for c in ("a", "b", "n_pos", "n_neg"))
    c = association.presence_counts(calls(spark, sf_dir), cohort(spark, sf_dir))
    return association.bh_fdr(c.withColumn("p_value", stats.fisher_exact(a, b, p - a, q - b)), [], "p_value").select("feature", "a", "b", F.round("p_value", 8).alias("p_value"), F.round("q", 8).alias("q"))


@query("A32_p_values")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _strata(spark, sf_dir).groupBy("feature").agg(*association.cochran_mantel_haenszel(*(F.col(c) for c in ("a", "b", "n_pos", "n_neg"))))
    return found.select("feature", F.round(stats.chi2_1df_sf("cmh_chi2"), 9).alias("p_value"))


PAIRS = f"{CALLS}, c AS (SELECT * FROM calls), n AS (SELECT feature, COUNT(*) AS n FROM c GROUP BY 1), t AS (SELECT COUNT(*) AS t FROM cohort), j AS (SELECT x.feature AS f, y.feature AS g, CAST(COUNT(*) AS DOUBLE) AS n11 FROM c x JOIN c y USING (sample) WHERE x.feature < y.feature GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    n = c.groupBy("feature").agg(F.count("*").alias("n"))
    return association.pair_counts(c).join(n.select(F.col("feature").alias("f"), F.col("n").alias("nf")), "f").join(n.select(F.col("feature").alias("g"), F.col("n").alias("ng")), "g")


@query("A35_phi_matrix", f"WITH {PAIRS} SELECT f, g, round((t * n11 - a.n * b.n) / sqrt(CAST(a.n AS DOUBLE) * (t - a.n) * b.n * (t - b.n)), 9) AS phi FROM j JOIN n a ON f = a.feature JOIN n b ON g = b.feature, t")
def phi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = cohort(spark, sf_dir).agg(F.count("*").alias("t"))
    return _pairs(spark, sf_dir).crossJoin(F.broadcast(total)).select("f", "g", F.round(association.phi(F.col("n11"), F.col("nf"), F.col("ng"), F.col("t")), 9).alias("phi"))  # one row


@query("A36_pairwise_jaccard", f"WITH {PAIRS} SELECT f, g, round(n11 / (a.n + b.n - n11), 9) AS jaccard FROM j JOIN n a ON f = a.feature JOIN n b ON g = b.feature")
def pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("f", "g", F.round(F.col("n11") / (F.col("nf") + F.col("ng") - F.col("n11")), 9).alias("jaccard"))


JSD = f"{SAMPLES}, b AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS side, least(5, CAST(floor(score_a * 5) AS INTEGER)) AS bin FROM samples), h AS (SELECT bin, CAST(SUM(side) AS DOUBLE) / (SELECT SUM(side) FROM b) AS p, CAST(SUM(1 - side) AS DOUBLE) / (SELECT SUM(1 - side) FROM b) AS q FROM b GROUP BY 1)"


@query("A37_jensen_shannon", f"WITH {JSD} SELECT round(SUM((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 9) AS jsd FROM h")
def jensen_shannon(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.col("lang") == "en"
    bins = samples(spark, sf_dir).groupBy(F.least(F.lit(5), F.floor(F.col("score_a") * 5).cast("int")).alias("bin")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    total = bins.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = bins.crossJoin(F.broadcast(total))  # one row
    return rows.agg(F.round(F.sum(stats.jensen_shannon(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))), 9).alias("jsd"))


@query("A41_outer_fences", "SELECT round(q[1] - 3 * (q[2] - q[1]), 6) AS low, round(q[2] + 3 * (q[2] - q[1]), 6) AS high FROM (SELECT quantile_cont(value, [0.25, 0.75]) AS q FROM events) u")
def outer_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ordered.exact_quantiles(table(spark, sf_dir, "events"), [], "value", {"a": 0.25, "b": 0.75})
    spread = 3 * (F.col("b") - F.col("a"))
    return q.select(F.round(F.col("a") - spread, 6).alias("low"), F.round(F.col("b") + spread, 6).alias("high"))


@query("A42_assembly_metrics", "WITH c AS (SELECT p_brand AS file, p_partkey, length(p_name) AS len, length(p_name) - length(replace(replace(p_name, 'g', ''), 'c', '')) AS gc FROM part), w AS (SELECT *, SUM(len) OVER (PARTITION BY file ORDER BY len DESC, p_partkey) AS run, SUM(len) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY len DESC, p_partkey) AS r FROM c) SELECT file, CAST(MAX(total) AS BIGINT) AS total, COUNT(*) AS contigs, CAST(MAX(CASE WHEN run * 2 >= total THEN len END) AS INTEGER) AS n50, CAST(MIN(CASE WHEN run * 2 >= total THEN r END) AS INTEGER) AS l50, round(CAST(SUM(gc) AS DOUBLE) / MAX(total), 9) AS gc FROM w GROUP BY 1")
def assembly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs are counted by length before their sizes are added up from the longest on, so no file is one task."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.length("p_name").alias("len"), (F.length("p_name") - F.length(F.translate("p_name", "gc", ""))).alias("gc"))
    sizes = rows.groupBy("file", "len").agg(F.count("*").alias("n"), (F.count("*") * F.first("len")).alias("sum"), F.sum("gc").alias("gc"))
    longer = running_totals(sizes.withColumn("shortness", -F.col("len")), ["file"], "shortness", ["n", "sum"])
    total = sizes.groupBy("file").agg(F.sum("sum").alias("total"), F.sum("n").alias("contigs"), F.sum("gc").alias("all_gc"))
    w = with_totals(longer, total, ["file"])
    # the first length with which half is reached, and how many of it that takes
    half = 2 * (F.col("before_sum") + F.col("sum")) >= F.col("total")
    needed = F.greatest(F.lit(1), F.ceil((F.col("total") / 2.0 - F.col("before_sum")) / F.col("len")))
    by = w.groupBy("file").agg(F.max("total").alias("total"), F.max("contigs").alias("contigs"), F.max(F.when(half, F.col("len"))).alias("n50"), F.min(F.when(half, F.col("before_n") + needed)).cast("int").alias("l50"), F.round(F.max("all_gc") / F.max("total"), 9).alias("gc"))
    return by.select("file", "total", "contigs", "n50", "l50", "gc")


@query("A47_changed_contributions", f"WITH {SNAPSHOTS}, o AS (SELECT DISTINCT target, drug FROM old_snapshot WHERE category = 'R'), n AS (SELECT DISTINCT target, drug FROM new_snapshot WHERE category = 'R') SELECT COALESCE(o.target, n.target) AS sample, COALESCE(o.drug, n.drug) AS feature, CASE WHEN n.drug IS NULL THEN -1 ELSE 1 END * length(COALESCE(o.drug, n.drug)) AS delta FROM o FULL JOIN n ON o.target = n.target AND o.drug = n.drug WHERE o.drug IS NULL OR n.drug IS NULL")
def changed_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (s.where("category = 'R'").select(F.col("target").alias("sample"), F.col("drug").alias("feature")).distinct().withColumn(tag, F.lit(1)) for s, tag in zip(snapshots(spark, sf_dir), ("old", "new"), strict=True))
    both = old.join(new, ["sample", "feature"], "full").fillna(0, ["old", "new"])
    coefficient = F.length("feature")
    return both.where("old <> new").select("sample", "feature", ((F.col("new") - F.col("old")) * coefficient).alias("delta"))


@query("A48_cohort_overlap", "SELECT 'nation' AS identifier, (SELECT COUNT(DISTINCT c_nationkey) FROM customer) AS available, COUNT(*) AS overlap FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) u UNION ALL SELECT 'key', (SELECT COUNT(DISTINCT c_custkey) FROM customer), COUNT(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier) u")
def cohort_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, a, b in (("nation", "c_nationkey", "s_nationkey"), ("key", "c_custkey", "s_suppkey")):
        left = table(spark, sf_dir, "customer").select(F.col(a).alias("id")).distinct()
        row = left.join(table(spark, sf_dir, "supplier").select(F.col(b).alias("id")).distinct().withColumn("hit", F.lit(1)), "id", "left").agg(F.lit(name).alias("identifier"), F.count("*").alias("available"), F.count("hit").alias("overlap"))
        out = row if out is None else out.unionByName(row)
    return out


@query("A49_concentration", "WITH g AS (SELECT event_type, user_id, COUNT(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r, SUM(n) OVER (PARTITION BY event_type) AS t FROM g) SELECT event_type, MAX(n) AS largest, round(CAST(MAX(n) AS DOUBLE) / MAX(t), 9) AS share, string_agg(CASE WHEN r <= 3 THEN CAST(user_id AS VARCHAR) || ':' || CAST(n AS VARCHAR) END, ';' ORDER BY r) AS top FROM r GROUP BY 1")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    # a limit on the rank is applied before the shuffle as well, so a type's best rows come from all tasks
    best = g.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("n").desc(), "user_id"))).where("r <= 3")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "user_id", "n"))), lambda x: F.concat_ws(":", x["user_id"].cast("string"), x["n"].cast("string"))), ";")
    sizes = g.groupBy("event_type").agg(F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 9).alias("share"))
    return sizes.join(best.groupBy("event_type").agg(top.alias("top")), "event_type")


@query("A51_replicated_signature", f"WITH {CALLS}, x AS (SELECT sample % 2 AS coh, feature, sample, y FROM calls JOIN cohort USING (sample)), t AS (SELECT sample % 2 AS coh, SUM(y) AS p, SUM(1 - y) AS q FROM cohort GROUP BY 1), d AS (SELECT feature, x.coh, CAST(SUM(y) AS DOUBLE) / MAX(p) - CAST(SUM(1 - y) AS DOUBLE) / MAX(q) AS rd FROM x JOIN t ON x.coh = t.coh GROUP BY 1, 2) SELECT a.feature, sign(a.rd) = sign(b.rd) AS same_sign, round(least(abs(a.rd), abs(b.rd)), 9) AS smaller FROM d a JOIN d b ON a.feature = b.feature AND a.coh = 0 AND b.coh = 1")
def replicated_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = cohort(spark, sf_dir).withColumn("coh", F.col("sample") % 2)
    c = association.presence_counts(calls(spark, sf_dir), people, ["coh"])
    rd = c.select("feature", "coh", (F.col("a") / F.col("n_pos") - F.col("b") / F.col("n_neg")).alias("rd"))
    wide = rd.groupBy("feature").pivot("coh", [0, 1]).agg(F.max("rd")).toDF("feature", "a", "b").dropna()
    return wide.select("feature", (F.signum("a") == F.signum("b")).alias("same_sign"), F.round(F.least(F.abs("a"), F.abs("b")), 9).alias("smaller"))


@query("A53_prevalence_by_error", f"WITH {CALLS}, e AS (SELECT sample, CASE WHEN y = 1 THEN CASE WHEN sample % 3 = 0 THEN 'FN' ELSE 'TP' END ELSE CASE WHEN sample % 4 = 0 THEN 'FP' ELSE 'TN' END END AS err FROM cohort), n AS (SELECT err, COUNT(*) AS n FROM e GROUP BY 1) SELECT feature, round(CAST(COUNT(*) FILTER (WHERE err = 'FN') AS DOUBLE) / (SELECT n FROM n WHERE err = 'FN'), 9) AS fn, round(CAST(COUNT(*) FILTER (WHERE err = 'TP') AS DOUBLE) / (SELECT n FROM n WHERE err = 'TP'), 9) AS tp FROM calls JOIN e USING (sample) GROUP BY 1")
def prevalence_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sample")
    err = F.when(F.col("y") == 1, F.when(s % 3 == 0, "FN").otherwise("TP")).otherwise(F.when(s % 4 == 0, "FP").otherwise("TN"))
    people = cohort(spark, sf_dir).select("sample", err.alias("err"))
    sizes = people.agg(F.count_if(F.col("err") == "FN").alias("nfn"), F.count_if(F.col("err") == "TP").alias("ntp"))
    by = calls(spark, sf_dir).join(people, "sample").groupBy("feature").agg(F.count_if(F.col("err") == "FN").alias("a"), F.count_if(F.col("err") == "TP").alias("b"))
    return by.crossJoin(F.broadcast(sizes)).select("feature", F.round(F.col("a") / F.col("nfn"), 9).alias("fn"), F.round(F.col("b") / F.col("ntp"), 9).alias("tp"))  # one row


@query("A54_unknown_features", f"WITH {CALLS} SELECT sample, COUNT(*) AS total, COUNT(*) FILTER (WHERE feature >= 'Brand#2') AS unknown, COALESCE(array_to_string(list_sort(list(feature) FILTER (WHERE feature >= 'Brand#2')), ';'), '') AS names FROM calls GROUP BY 1")
def unknown_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = calls(spark, sf_dir).select("feature").distinct().where("feature < 'Brand#2'").withColumn("known", F.lit(1))
    rows = calls(spark, sf_dir).join(schema, "feature", "left")
    new = F.when(F.col("known").isNull(), F.col("feature"))
    return rows.groupBy("sample").agg(F.count("*").alias("total"), F.count(new).alias("unknown"), F.array_join(F.array_sort(F.collect_list(new)), ";").alias("names"))


@query("A55_contribution_profile", f"WITH {CALLS}, c AS (SELECT sample, feature, CAST(substr(feature, 7) AS INTEGER) - 13 AS beta FROM calls), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY beta DESC, feature) AS r FROM c WHERE beta > 0) SELECT sample, string_agg(feature || '=' || CAST(beta AS VARCHAR), ';' ORDER BY r) AS top FROM r WHERE r <= 2 GROUP BY 1")
def contribution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    beta = F.substring("feature", 7, 4).cast("int") - 13
    rows = calls(spark, sf_dir).withColumn("beta", beta).where("beta > 0")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("beta")).alias("k"), "feature", "beta"))), 1, 2)
    return rows.groupBy("sample").agg(F.array_join(F.transform(best, lambda x: F.concat_ws("=", x["feature"], x["beta"].cast("string"))), ";").alias("top"))


@query("W01_row_number_W03_top_n", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) u WHERE r <= 3")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("rank")).where("rank <= 3")


@query("W02_first_of_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) u WHERE r = 1")
def first_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")).select("o_custkey", "first.o_orderkey")


@query("W04_average_rank", "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_brand, p_size) - 1) / CAST(2 AS DOUBLE)) AS rank FROM part")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ties = rows.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    ranks = ordered.running_totals(ties, ["p_brand"], "p_size", ["n"]).select("p_brand", "p_size", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))
    return rows.join(ranks, ["p_brand", "p_size"]).select("p_partkey", "rank")


@query("W05_exclusive_cumulative", "SELECT event_id, COALESCE(round(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6), 0) AS before FROM events")
def exclusive_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one time are added up within it, times in ranges, so a user with most rows is many tasks."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    times = running_totals(rows.groupBy("user_id", "at").agg(F.sum("value").alias("value")), ["user_id"], "at", ["value"]).select("user_id", "at", "before_value")
    inside = F.sum("value").over(Window.partitionBy("user_id", "at").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    found = join_same(rows.withColumn("inside", F.coalesce(inside, F.lit(0.0))), times, ["user_id", "at"])
    return found.select("event_id", F.coalesce(F.round(F.col("before_value") + F.col("inside"), 6), F.lit(0.0)).alias("before"))


@query("W06_bh_fdr", "WITH p AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) / 50 AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS r, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM p) SELECT p_partkey, round(least(1, MIN(p * n / r) OVER (PARTITION BY p_brand ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") / 50.0).alias("p"))
    return association.bh_fdr(rows, ["p_brand"], "p").select("p_partkey", F.round("q", 9).alias("q"))


@query("W07_group_centred", "SELECT p_partkey, round(p_retailprice - AVG(p_retailprice) OVER (PARTITION BY p_brand), 6) AS centred FROM part")
def group_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.join(rows.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean")), "p_brand").select("p_partkey", F.round(F.col("p_retailprice") - F.col("mean"), 6).alias("centred"))


@query("W08_tie_blocks", "SELECT value, COUNT(*) AS n FROM events GROUP BY 1 HAVING COUNT(*) > 1")
def tie_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("value").agg(F.count("*").alias("n")).where("n > 1")


@query("W09_share_of_total", "SELECT c_mktsegment, round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 9) AS share FROM customer GROUP BY 1")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("t")))).select("c_mktsegment", F.round(F.col("n") / F.col("t"), 9).alias("share"))  # one row


@query("W10_carry_down", "SELECT event_id, MAX(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_signup FROM events")
def carry_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return carried_down(rows, ["user_id"], "at", signup, "last_signup", ["event_id"]).select("event_id", "last_signup")


@query("T01_mixed_sort", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC NULLS LAST, s_suppkey")
def mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").orderBy(F.col("s_nationkey").desc_nulls_last(), "s_suppkey")


@query("T02_sort_by_key", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")
def sort_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy(F.abs("c_acctbal").desc(), "c_custkey").select("c_custkey")


@query("T03_top_fraction", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r, COUNT(*) OVER () AS n FROM part) u WHERE r <= ceil(n * CAST(0.1 AS DOUBLE))")
def top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    placed = ordered.positions(rows, [F.col("p_retailprice").desc(), F.col("p_partkey")])
    return placed.where(F.col("position") < -(-rows.count() // 10)).select("p_partkey")


@query("T04_largest", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(15).select("o_orderkey")


@query("T05_top_features", f"WITH {CALLS}, x AS (SELECT sample % 5 AS fold, feature, SUM(y) AS a FROM calls JOIN cohort USING (sample) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY a DESC, feature) AS r FROM x) SELECT fold, feature, CAST(a AS BIGINT) AS a, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 4")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = calls(spark, sf_dir).join(cohort(spark, sf_dir), "sample").groupBy((F.col("sample") % 5).alias("fold"), "feature").agg(F.sum("y").alias("a"))
    return association.top_features(scored, ["fold"], "a", 4)


@query("T06_argmax_row", "SELECT c_mktsegment, max_by(c_custkey, c_acctbal) AS best FROM customer WHERE c_acctbal < 9000 GROUP BY 1")
def argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 9000").groupBy("c_mktsegment").agg(F.max_by("c_custkey", "c_acctbal").alias("best"))


@query("T07_representatives", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_partkey) AS k FROM part), m AS (SELECT p_brand, p_type AS t FROM r WHERE r = 1) SELECT r.p_brand, p_partkey, CASE WHEN r = 1 THEN 'main' ELSE 'alternate' END AS role FROM r JOIN m ON r.p_brand = m.p_brand WHERE r = 1 OR (k = 1 AND p_type <> t AND p_type = (SELECT MIN(x.p_type) FROM part x WHERE x.p_brand = r.p_brand AND x.p_type <> t))")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.struct((-F.col("p_size")).alias("size"), "p_partkey")
    by_type = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min(rank).alias("best"))
    main = by_type.groupBy("p_brand").agg(F.min(F.struct("best", "p_type")).alias("m"))
    other = by_type.join(main, "p_brand").where("p_type <> m.p_type").groupBy("p_brand").agg(F.min(F.struct("p_type", "best")).alias("o"))
    first = main.select("p_brand", F.col("m.best.p_partkey").alias("p_partkey"), F.lit("main").alias("role"))
    return first.unionByName(other.select("p_brand", F.col("o.best.p_partkey").alias("p_partkey"), F.lit("alternate").alias("role")))


@query("U01_union_all", "SELECT n_nationkey AS k, n_name AS name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("region").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U02_columns_by_key", "SELECT COALESCE(a.k, b.k) AS k, COALESCE(a.n, 0) AS customers, COALESCE(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def columns_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full").fillna(0, ["customers", "suppliers"])


@query("U03_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("U04_set_algebra", "SELECT 'both' AS part, COUNT(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier) a UNION ALL SELECT 'only', COUNT(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier) b UNION ALL SELECT 'any', COUNT(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier) c")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "only": a.subtract(b), "any": a.union(b).distinct()}
    rows = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("U05_duplicate_count", "SELECT COUNT(*) - COUNT(DISTINCT text) AS duplicates FROM documents")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg((F.count("*") - F.count_distinct("text")).alias("duplicates"))
