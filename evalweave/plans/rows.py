"""Queries over single rows: projections, predicates, gates, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, labels, stats
from ..operators import gates, joins
from ..registry import query
from ..roles import SAMPLES, observations, samples, table


@query("P01_projection", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.projected(table(spark, sf_dir, "customer"), {"id": "c_custkey", "segment": "c_mktsegment"})


@query("P02_alias_columns", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return gates.projected(rows, {"id": gates.first_alias(rows, ["supplier id", "S Supp-Key"]), "balance": gates.first_alias(rows, ["acctbal", "s_acctbal"])})


@query("P03_value_profile", "SELECT 'o_orderstatus' AS best, COUNT(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) AS hits FROM orders")
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"))
    hits = rows.agg(*(F.sum(F.col(c).isin("F", "O", "P").cast("int")).alias(c) for c in rows.columns))
    long = hits.select(F.explode(F.array(*(F.struct(F.lit(c).alias("best"), F.col(c).alias("hits")) for c in rows.columns))).alias("r")).select("r.*")
    return long.orderBy(F.col("hits").desc(), "best").limit(1)


@query("P04_label_normal_form", "SELECT event_type AS raw, CASE event_type WHEN 'purchase' THEN 'R' WHEN 'view' THEN 'S' WHEN 'click' THEN 'I' END AS category, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 END AS y, COUNT(*) AS n FROM events GROUP BY 1, 2, 3")
def label_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.create_map(*(F.lit(x) for x in ("purchase", " resistant", "view", "Susceptible ", "click", "i", "signup", "n/a", "error", "?")))[F.col("event_type")]
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("raw"), labels.category(raw).alias("category"), labels.binary_label(raw).alias("y")).agg(F.count("*").alias("n"))


@query("P05_membership_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT'")
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey")


@query("P06_range_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.04 AS DOUBLE)")
def range_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_discount").between(0.02, 0.04)).select("l_orderkey", "l_linenumber")


@query("P07_regex_filter", "SELECT p_partkey FROM part WHERE regexp_full_match(lower(p_brand), 'brand#1[0-9]?')")
def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.coalesce(F.col("p_brand").rlike(r"(?i)^brand#1[0-9]?$"), F.lit(False))).select("p_partkey")


@query("P08_not_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id")


@query("P09_fill_defaults", "SELECT d.doc_id, COALESCE(CAST(l.quality AS BIGINT), 0) AS quality, '' AS note FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("long"), F.lit(0)).alias("quality"), F.lit("").alias("note"))


@query("P10_conditional_column", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'other' END AS class FROM orders")
def conditional_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "high").when(F.col("o_orderstatus") == "F", "closed").otherwise("other").alias("class"))


def _reasons() -> list[tuple[str, F.Column, str, int]]:
    return [("urgent", F.col("o_orderpriority") == "1-URGENT", "o_orderpriority = '1-URGENT'", 100), ("large", F.col("o_totalprice") > 300000, "o_totalprice > 300000", 35), ("closed", F.col("o_orderstatus") == "F", "o_orderstatus = 'F'", 5)]


@query("P11_reason_list", "SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END], lambda x: x IS NOT NULL)), ';') AS reasons FROM orders")
def reason_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.array(*(F.when(test, name) for name, test, _, _ in _reasons())), lambda x: x.isNotNull())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(found)), ";").alias("reasons"))


@query("P12_priority_score", "SELECT o_orderkey, CAST(100 * CAST(o_orderpriority = '1-URGENT' AS INTEGER) + 35 * CAST(o_totalprice > 300000 AS INTEGER) + 5 * CAST(o_orderstatus = 'F' AS INTEGER) AS INTEGER) AS score FROM orders")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sum((test.cast("int") * weight for _, test, _, weight in _reasons()), F.lit(0)).alias("score"))


@query("P13_unique_keys", "SELECT 'order keys' AS \"check\", (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1 OR o_orderkey IS NULL) u) = 0 AS passed UNION ALL SELECT 'line orders', (SELECT COUNT(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1) u) = 0")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = gates.unique_keys(table(spark, sf_dir, "orders"), ["o_orderkey"], "order keys")
    return a.unionByName(gates.unique_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "line orders")).select("check", "passed")


@query("P14_collapse_duplicates", "SELECT n_regionkey, r_name, COUNT(*) AS copies FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "r_name")
    return gates.collapsed(rows, ["n_regionkey"])


@query("P15_expected_counts", "SELECT 'rows' AS \"check\", COUNT(*) = 25 AS passed FROM nation UNION ALL SELECT 'regions', COUNT(DISTINCT n_regionkey) = 6 FROM nation")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.expected_counts(table(spark, sf_dir, "nation"), {"rows": (F.count("*"), 25), "regions": (F.count_distinct("n_regionkey"), 6)}).select("check", "passed")


@query("P16_set_equality", "SELECT k AS nation, CASE WHEN side = 1 THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT c_nationkey AS k, 1 AS side FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT s_nationkey, 2 FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer)) u")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return gates.set_difference(a, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")), "nation")


@query("P17_audit_table", "SELECT 'labels are binary' AS \"check\", COUNT(*) FILTER (WHERE quality NOT IN (0, 1)) = 0 AS passed FROM labels UNION ALL SELECT 'documents have text', COUNT(*) FILTER (WHERE text IS NULL) = 0 FROM documents")
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda df, test: df.agg(F.count_if(test).alias("bad"))
    rows = [("labels are binary", bad(table(spark, sf_dir, "labels"), ~F.col("quality").isin(0, 1))), ("documents have text", bad(table(spark, sf_dir, "documents"), F.col("text").isNull()))]
    made = [gates.audit_row(name, counted, F.col("bad") == 0, F.col("bad")) for name, counted in rows]
    return made[0].unionByName(made[1]).select("check", "passed")


@query("P18_field_equality", "SELECT 'type' AS field, COUNT(*) FILTER (WHERE a.event_type IS NOT DISTINCT FROM b.event_type) AS matched, COUNT(*) FILTER (WHERE a.event_type IS DISTINCT FROM b.event_type) AS mismatched FROM events a JOIN events b ON a.event_id + 1 = b.event_id UNION ALL SELECT 'user', COUNT(*) FILTER (WHERE a.user_id IS NOT DISTINCT FROM b.user_id), COUNT(*) FILTER (WHERE a.user_id IS DISTINCT FROM b.user_id) FROM events a JOIN events b ON a.event_id + 1 = b.event_id")
def field_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    a = rows.select((F.col("event_id") + 1).alias("id"), F.col("event_type").alias("type_a"), F.col("user_id").alias("user_a"))
    both = a.join(rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("type_b"), F.col("user_id").alias("user_b")), "id")
    same = {f: F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")) for f in ("type", "user")}
    counts = both.agg(*(F.count_if(c).alias(f"{f}_m") for f, c in same.items()), F.count("*").alias("n"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_m").alias("matched"), (F.col("n") - F.col(f"{f}_m")).alias("mismatched")) for f in same))).alias("r")).select("r.*")


@query("P19_domain_gate", "SELECT 'score' AS \"check\", COUNT(*) FILTER (WHERE NOT (CAST(n_chars % 100 AS DOUBLE) / 100 BETWEEN 0 AND 1)) AS bad FROM documents UNION ALL SELECT 'numeric', COUNT(*) FILTER (WHERE TRY_CAST(substr(source, 4) AS INTEGER) IS NULL) FROM documents")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.domain_violations(table(spark, sf_dir, "documents"), {"score": ((F.col("n_chars") % 100).cast("double") / 100).between(0, 1), "numeric": F.expr("try_cast(substr(source, 4) as int) is not null")})


@query("P20_unit_rescale", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100 / 100 ELSE l_discount END AS fraction FROM lineitem WHERE l_quantity > 45")
def unit_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.col("l_linenumber") % 2 == 0
    raw = F.when(percent, F.col("l_discount") * 100).otherwise(F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.when(percent, raw / 100).otherwise(raw).alias("fraction"))


@query("F01_trim_fold", "SELECT n_nationkey, lower(trim(n_name)) AS low, upper(trim(n_name)) AS up FROM nation")
def trim_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.trim("n_name")).alias("low"), F.upper(F.trim("n_name")).alias("up"))


@query("F02_missing_tokens", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'x' END AS value FROM events")
def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, (" n/a ", "x", "", "Unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.missing_to_null(raw).alias("value"))


@query("F03_id_repair", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", labels.repaired_id(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("id"))


@query("F04_id_precision", "SELECT COUNT(*) AS ids, COUNT(*) FILTER (WHERE length(split_part(CAST(c_acctbal AS VARCHAR), '.', 2)) = 1) AS one_decimal FROM customer")
def id_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    decimals = F.length(F.element_at(F.split(F.col("c_acctbal").cast("string"), r"\."), 2))
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("ids"), F.count_if(decimals == 1).alias("one_decimal"))


@query("F05_name_folding", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS folded FROM supplier")
def name_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", labels.folded_name(F.col("s_name")).alias("folded"))


@query("F06_gene_family", "SELECT CAST(s_suppkey AS BIGINT) AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'blaKPC' ELSE 'gyrA' END AS family FROM supplier")
def gene_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", labels.gene_family(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("blaKPC-"), k)).otherwise(F.concat(F.lit("gyrA_S"), k, F.lit("I")))).alias("family")).withColumnRenamed("s_suppkey", "k")


@query("F07_genotype_tokens", "SELECT p_partkey, t AS determinant, CASE WHEN i = 1 THEN 'HMM' ELSE 'COMPLETE' END AS evidence FROM (SELECT p_partkey, string_split(p_name, ' ')[i] AS t, i FROM part, (SELECT unnest([1, 2]) AS i) n) u")
def genotype_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.substring_index("p_name", " ", 1), F.lit("=hmm, "), F.substring_index("p_name", " ", -1))
    name, evidence = labels.genotype_token(F.col("t"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(cell, ",")).alias("t")).select("p_partkey", name.alias("determinant"), evidence.alias("evidence"))


@query("F08_family_classes", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'KPC' WHEN 1 THEN CASE WHEN p_partkey IN {labels.OXA_48_LIKE} THEN 'OXA-48-like' END WHEN 2 THEN 'NDM' ELSE CASE WHEN p_partkey IN {labels.OXA_48_LIKE} THEN 'OXA-48-like' END END AS family FROM part")
def family_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    symbol = F.element_at(F.array(F.concat(F.lit("blaKPC-"), k), F.concat(F.lit("blaOXA-"), k), F.lit("blaNDM"), F.concat(F.lit(" BLAOXA-"), k)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.carbapenemase_family(symbol).alias("family"))


@query("F09_rule_calls", "SELECT l_orderkey AS sample, MAX(CASE WHEN regexp_matches(p_brand, '#1') THEN 1 ELSE 0 END) AS by_brand, MAX(CASE WHEN regexp_matches(p_brand, '#1') OR regexp_matches(lower(p_type || ' | ' || p_name), 'promo|steel') THEN 1 ELSE 0 END) AS broad FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def rule_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.col("p_brand").rlike("#1")
    text = F.lower(F.concat_ws(" | ", "p_type", "p_name")).rlike("promo|steel")
    return rows.groupBy(F.col("l_orderkey").alias("sample")).agg(F.max(brand.cast("int")).alias("by_brand"), F.max((brand | text).cast("int")).alias("broad"))


@query("F10_list_cell", "SELECT user_id, event_type AS drug, array_to_string(list_sort(list(DISTINCT c)), '|') AS categories FROM (SELECT user_id, event_type, CASE WHEN value < 20 THEN 'S' WHEN value < 60 THEN 'I' ELSE 'R' END AS c FROM events) u GROUP BY 1, 2")
def list_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = observations(spark, sf_dir).groupBy("target").agg(F.array_join(F.collect_set(F.concat_ws("=", "drug", "category")), ",").alias("cell"))
    pairs = cells.select("target", F.explode(F.split("cell", ",")).alias("t"))
    pairs = pairs.withColumn("t", F.when(F.col("t").rlike(r"^[^=]+=[^=]+$"), F.col("t")).otherwise(F.raise_error(F.concat(F.lit("malformed token: "), F.col("t"))).cast("string")))
    parsed = pairs.groupBy(F.col("target").cast("long").alias("user_id"), F.substring_index("t", "=", 1).alias("drug"))
    return parsed.agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("t", "=", -1))), "|").alias("categories"))


@query("F11_explode_list", "SELECT w AS word, COUNT(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) u GROUP BY w")
def explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("F12_find_all", "SELECT page_id, len(regexp_extract_all(url, '[0-9]+')) AS numbers, array_to_string(regexp_extract_all(url, '[0-9]+'), ';') AS found FROM pages")
def find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("numbers"), F.array_join(found, ";").alias("found"))


@query("F13_tokens", "SELECT p_partkey, len(list_filter(regexp_split_to_array(p_name || ';;' || p_type, '[;,|\\s]+'), lambda x: x <> '')) AS n FROM part")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(labels.tokens(F.concat_ws(";;", "p_name", "p_type"))).alias("n"))


@query("F14_version_number", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END AS INTEGER) AS version, 'GCA_' || CAST(c_custkey AS VARCHAR) AS base FROM customer")
def version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = F.concat(F.lit("GCA_"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("c_custkey") % 7).cast("string"))))
    return table(spark, sf_dir, "customer").select("c_custkey", labels.version_number(acc).alias("version"), labels.versionless(acc).alias("base"))


SIGNS = ("=", "<=", ">=", ">", "<")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sign, number, raw): a sign by the id and the value rounded to whole numbers, at least 1."""
    sign = F.element_at(F.array(*map(F.lit, SIGNS)), (F.col("event_id") % 5 + 1).cast("int"))
    number = F.greatest(F.lit(1), F.floor("value")).cast("int")
    return table(spark, sf_dir, "events").select("event_id", sign.alias("sign"), number.alias("number"), F.concat(sign, number.cast("string")).alias("raw"))


READINGS = """readings AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '<=' WHEN 2 THEN '>=' WHEN 3 THEN '>' ELSE '<' END AS sign, CAST(greatest(1, floor(value)) AS INTEGER) AS m FROM events)"""
S_MAX, R_LIMIT = 20, 60


@query("F15_mic_interval", f"WITH {READINGS} SELECT event_id, CAST(CASE WHEN sign IN ('<', '<=') THEN 0 ELSE m END AS DOUBLE) AS lo, CAST(CASE WHEN sign IN ('>', '>=') THEN NULL ELSE m END AS DOUBLE) AS hi, sign IN ('=', '>=') AS lo_closed, sign IN ('=', '<=') AS hi_closed FROM readings")
def mic_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = intervals.parse_mic(F.col("raw"))
    return readings(spark, sf_dir).select("event_id", x["lo"].cast("double").alias("lo"), x["hi"].cast("double").alias("hi"), x["lo_closed"].alias("lo_closed"), x["hi_closed"].alias("hi_closed"))


@query("F16_measurement_conflict", f"WITH {READINGS} SELECT CASE WHEN event_id % 11 = 0 THEN 'INVALID' WHEN event_id % 7 = 0 THEN 'CONFLICT' ELSE 'AGREE' END AS status, COUNT(*) AS n FROM readings GROUP BY 1")
def measurement_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 7 == 0, F.concat(F.col("sign"), (F.col("number") + 1).cast("string"))).otherwise(F.col("raw"))
    a, b = intervals.parse_mic(raw), intervals.parse_mic(F.concat("sign", F.col("number").cast("string")))
    status = F.when(a.isNull() | b.isNull(), "INVALID").when(a.eqNullSafe(b), "AGREE").otherwise("CONFLICT")
    return readings(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


POSSIBLE = f"""CASE sign
  WHEN '=' THEN CASE WHEN m <= {S_MAX} THEN 'S' WHEN m <= {R_LIMIT} THEN 'I' ELSE 'R' END
  WHEN '<=' THEN CASE WHEN m <= {S_MAX} THEN 'S' WHEN m <= {R_LIMIT} THEN 'I|S' ELSE 'I|R|S' END
  WHEN '<' THEN CASE WHEN m <= {S_MAX} THEN 'S' WHEN m <= {R_LIMIT} THEN 'I|S' ELSE 'I|R|S' END
  WHEN '>=' THEN CASE WHEN m <= {S_MAX} THEN 'I|R|S' WHEN m <= {R_LIMIT} THEN 'I|R' ELSE 'R' END
  ELSE CASE WHEN m < {S_MAX} THEN 'I|R|S' WHEN m < {R_LIMIT} THEN 'I|R' ELSE 'R' END END"""


def _possible(raw: F.Column) -> F.Column:
    return F.array_join(intervals.allowed_categories(intervals.parse_mic(raw), F.lit(S_MAX), F.lit(R_LIMIT), F.lit(False)), "|")


@query("F17_possible_categories", f"WITH {READINGS} SELECT event_id, {POSSIBLE} AS possible FROM readings")
def possible_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", _possible(F.col("raw")).alias("possible"))


@query("F18_boundary_robustness", f"WITH {READINGS} SELECT CASE WHEN sign IN ('>', '>=') OR m > {S_MAX} THEN 'OBSERVED_INTERVAL_OR_CATEGORY_UNCERTAIN' WHEN 2 * m <= {S_MAX} THEN 'BOUNDARY_ROBUST' ELSE 'BOUNDARY_SENSITIVE' END AS status, COUNT(*) AS n FROM readings GROUP BY 1")
def boundary_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = intervals.boundary_status(F.col("raw"), F.lit("S"), F.lit(S_MAX), F.lit(R_LIMIT), F.lit(False))
    return readings(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


UNITS = ("MG/L", "µg/mL", " μg/ml", "mm", "ｍｇ/Ｌ", "mcg/mL")


@query("F19_unit_normal_form", f"SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 = 3 THEN 'mm' ELSE 'mg/L' END AS unit FROM events")
def unit_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of readings in six spellings, some of them missing."""
    raw = F.get(F.array(*map(F.lit, UNITS)), (F.col("event_id") % 7).cast("int"))
    return labels.normal_units(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", "unit").select("event_id", "unit")


SETS = "bit_or(CASE WHEN value < 20 THEN 4 WHEN value < 60 THEN 2 ELSE 1 END) FILTER (WHERE event_type = '{}')"


@query("F20_set_comparison", f"WITH s AS (SELECT user_id, {SETS.format('click')} AS a, {SETS.format('view')} AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN a IS NULL THEN 'new_only' WHEN b IS NULL THEN 'old_only' WHEN a = b THEN 'same' WHEN (a & 1 = 1 AND a & 4 = 0 AND b & 4 = 4 AND b & 1 = 0) OR (a & 4 = 4 AND a & 1 = 0 AND b & 1 = 1 AND b & 4 = 0) THEN 'reversal' ELSE 'other' END AS status FROM s")
def set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's categories in events of two kinds."""
    rows = observations(spark, sf_dir)
    of = lambda kind, name: rows.where(F.col("drug") == kind).groupBy(F.col("target").cast("long").alias("user_id")).agg(F.array_sort(F.collect_set("category")).alias(name))
    both = rows.select(F.col("target").cast("long").alias("user_id")).distinct().join(of("click", "a"), "user_id", "left").join(of("view", "b"), "user_id", "left")
    return both.select("user_id", joins.set_comparison(F.col("a"), F.col("b")).alias("status"))


@query("F22_review_flag", f"WITH {READINGS} SELECT CASE WHEN sign IN ('<', '<=') AND m > {R_LIMIT} THEN 'LOWER_CENSORED_BUT_RESISTANT' WHEN sign IN ('>', '>=') AND m <= {S_MAX} THEN 'UPPER_CENSORED_BUT_SUSCEPTIBLE' ELSE '' END AS flag, COUNT(*) AS n FROM readings GROUP BY 1")
def review_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("number") > R_LIMIT, "R").when(F.col("number") <= S_MAX, "S").otherwise("I")
    return readings(spark, sf_dir).groupBy(intervals.review_flag(F.col("sign"), label).alias("flag")).agg(F.count("*").alias("n"))


@query("F27_logistic_score", "SELECT o.o_orderkey AS sample, round(1 / (1 + exp(-(CAST(-0.5 AS DOUBLE) + COALESCE(s.z, 0)))), 9) AS p FROM orders o LEFT JOIN (SELECT sample, SUM((CAST(substr(feature, 7) AS INTEGER) - 13) * CAST(0.05 AS DOUBLE)) AS z FROM (SELECT DISTINCT l_orderkey AS sample, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey) c GROUP BY sample) s ON s.sample = o.o_orderkey")
def logistic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..roles import calls, cohort

    coefficients = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct().withColumn("beta", (F.substring("feature", 7, 4).cast("int") - 13) * 0.05)
    z = calls(spark, sf_dir).join(F.broadcast(coefficients), "feature").groupBy("sample").agg(F.sum("beta").alias("z"))  # a row for each brand
    return cohort(spark, sf_dir).select("sample").join(z, "sample", "left").select("sample", F.round(1 / (1 + F.exp(-(F.lit(-0.5) + F.coalesce("z", F.lit(0.0))))), 9).alias("p"))


@query("F28_date_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    short = F.try_to_date(F.when(text.contains("/"), text), "MM/dd/yy")
    # two digits of a year mean the one that is not in the future of the data
    short = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    return rows.select("o_orderkey", F.coalesce(short, F.try_to_date(F.when(~text.contains("/"), text), "yyyy-MM-dd")).alias("day"))


@query("F29_digests", "SELECT n_nationkey, sha256(n_name) AS digest FROM nation")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("digest"))


@query("F30_bound_parameters", "SELECT n_nationkey FROM nation WHERE n_name = 'O''NEIL' OR n_regionkey = 3")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT n_nationkey FROM {nation} WHERE n_name = :name OR n_regionkey = :region", args={"name": "O'NEIL", "region": 3}, nation=table(spark, sf_dir, "nation"))


@query("F31_scaling_exponent", "SELECT round(ln(CAST(b AS DOUBLE) / a) / ln(CAST(4 AS DOUBLE)), 9) AS exponent FROM (SELECT COUNT(DISTINCT CASE WHEN l_orderkey % 4 = 0 THEN l_partkey END) AS a, COUNT(DISTINCT l_partkey) AS b FROM lineitem) u")
def scaling_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").agg(F.count_distinct(F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey"))).alias("a"), F.count_distinct("l_partkey").alias("b"))
    return counts.select(F.round(F.log(F.col("b") / F.col("a")) / F.log(F.lit(4.0)), 9).alias("exponent"))


@query("F32_flatten_nested", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ';') AS nations FROM nation GROUP BY 1")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("nations"))


@query("F33_safe_division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem")
def safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"))


@query("F34_exact_fractions", f"WITH {SAMPLES}, c AS (SELECT SUM(y) AS p, SUM(1 - y) AS n, SUM(CASE WHEN y = 1 AND score_a >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN y = 0 AND score_a < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS tn FROM samples) SELECT CAST(tp * n + tn * p AS BIGINT) AS numerator, CAST(2 * p * n AS BIGINT) AS denominator FROM c")
def exact_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = "decimal(38,0)"
    c = samples(spark, sf_dir).agg(*stats.confusion(F.col("y"), (F.col("score_a") >= 0.5).cast("int")))
    p, n = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return c.select((F.col("tp").cast(whole) * n + F.col("tn").cast(whole) * p).cast("long").alias("numerator"), (p.cast(whole) * n * 2).cast("long").alias("denominator"))


@query("F36_strict_booleans", "SELECT event_id, event_id % 2 = 0 AS flag FROM events")
def strict_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("TRUE", "0", "1", " false "))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.strict_boolean(raw).alias("flag"))
