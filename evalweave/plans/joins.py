"""Queries over joins and identities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import breakpoints, intervals, labels
from ..operators import gates, graph, joins, ordered
from ..operators import intervals as interval_joins
from ..registry import query
from ..roles import CALLS, CUT, SAMPLES, SNAPSHOTS, calls, cohort, samples, snapshots, table
from ..session import materialise
from .rows import READINGS, R_LIMIT, S_MAX, readings


@query("J01_inner_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return orders.join(table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey", "c_mktsegment")


@query("J02_left_join", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("long").alias("quality"))


@query("J03_full_join_provenance", "SELECT side AS _side, COUNT(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT doc_id FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id) u GROUP BY 1")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return joins.with_provenance(docs, table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("_side").agg(F.count("*").alias("n"))


@query("J04_completeness_join", "SELECT COUNT(*) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def completeness_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.with_provenance(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], "left")
    return joined.where("_side <> 'both'").agg(F.count("*").alias("missing"))


@query("J05_validated_join", "SELECT n_name, COUNT(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.validated_join(suppliers, table(spark, sf_dir, "nation"), ["n_nationkey"], validate="many_to_one").groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("J06_join_other_names", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_other_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")


@query("J07_join_suffixes", "SELECT a.user_id, a.n AS n_old, b.n AS n_new FROM (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)")
def join_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return joins.suffixed(count("view"), count("click"), ["user_id"], ("_old", "_new"))


@query("J08_chained_left_joins", "SELECT c_custkey, COALESCE(n, 0) AS orders, first_order FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n, MIN(o_orderkey) AS first_order FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def chained_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "first_order")


@query("J09_lookup_map", "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) m ON s_nationkey = n_nationkey")
def lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nations), "s_nationkey", "left").select("s_suppkey", "nation")  # nations have a fixed number


@query("J10_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("J11_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").where(joins.known(F.col("o_custkey"))).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where(joins.known(F.col("c_custkey"))).select("c_custkey").join(seen, "c_custkey", "left_anti")


FIREWALL = """SELECT c_custkey, reasons FROM (
  SELECT c_custkey, array_to_string(list_sort(list_filter([
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 400 IN (SELECT s_suppkey FROM supplier) AND c_custkey % 400 < 20 THEN 'account' END,
    CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 'nation' END,
    CASE WHEN CAST(floor(c_acctbal / 100) AS BIGINT) IN (SELECT CAST(floor(s_acctbal / 100) AS BIGINT) FROM supplier) THEN 'balance' END], lambda x: x IS NOT NULL)), ';') AS reasons FROM customer) u WHERE reasons <> ''"""


def _firewalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext, ref = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    k = F.col("c_custkey") % 400
    account = F.when((F.col("c_custkey") % 5 != 0) & (k < 20), k.cast("string")).otherwise("")
    step = lambda c: F.floor(F.col(c) / 100).cast("string")
    return joins.firewall(ext, ref, "c_custkey", {"account": (account, F.col("s_suppkey")), "nation": (F.col("c_nationkey"), F.when(F.col("s_acctbal") < 0, F.col("s_nationkey"))), "balance": (step("c_acctbal"), step("s_acctbal"))})


@query("J12_identity_firewall", FIREWALL)
def identity_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firewalled(spark, sf_dir).where("reasons is not null").select("c_custkey", "reasons")


@query("J13_two_reference_firewall", "SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0) AS in_first, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 1) AS in_second FROM customer")
def two_reference_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    for i, name in enumerate(("in_first", "in_second")):
        ref = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 9 == i)
        hit = joins.firewall(out, ref, "c_custkey", {"nation": (F.col("c_nationkey"), F.col("s_nationkey"))})
        out = hit.withColumn(name, F.col("reasons").isNotNull()).drop("reasons")
    return out.drop("c_nationkey")


@query("J14_versionless_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_suppkey = c_custkey")
def versionless_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = lambda c: labels.versionless(F.concat(F.lit("GCA_"), F.col(c).cast("string"), F.lit("."), (F.col(c) % 3 + (2 if c[0] == "s" else 1)).cast("string"))).alias("base")
    return table(spark, sf_dir, "customer").select("c_custkey", acc("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", acc("s_suppkey")), "base").drop("base")


@query("J15_ambiguous_links", "SELECT CASE n WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, COUNT(*) AS links FROM (SELECT o_orderkey, COUNT(DISTINCT t) AS n FROM (SELECT o_orderkey, o_custkey AS t FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END FROM orders) r GROUP BY 1) u GROUP BY 1")
def ambiguous_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    other = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    found = joins.ambiguity([rows.select("o_orderkey", F.col("o_custkey").alias("t")), rows.select("o_orderkey", other.alias("t"))], "o_orderkey", "t")
    return found.groupBy(F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status")).agg(F.count("*").alias("links"))


DIFF = f"""WITH {SNAPSHOTS}, o AS (SELECT target, drug, list_sort(list(DISTINCT category)) AS old_set FROM old_snapshot GROUP BY 1, 2), n AS (SELECT target, drug, list_sort(list(DISTINCT category)) AS new_set FROM new_snapshot GROUP BY 1, 2),
d AS (SELECT target, drug, CASE WHEN old_set IS NULL THEN 'new_only' WHEN new_set IS NULL THEN 'old_only' WHEN old_set = new_set THEN 'same'
  WHEN (list_contains(old_set, 'R') AND NOT list_contains(old_set, 'S') AND list_contains(new_set, 'S') AND NOT list_contains(new_set, 'R')) OR (list_contains(old_set, 'S') AND NOT list_contains(old_set, 'R') AND list_contains(new_set, 'R') AND NOT list_contains(new_set, 'S')) THEN 'reversal' ELSE 'other' END AS status
  FROM o FULL JOIN n USING (target, drug))"""


@query("J16_snapshot_diff", DIFF + " SELECT drug, status, COUNT(*) AS keys FROM d GROUP BY 1, 2")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return joins.snapshot_diff(old, new, ["target", "drug"], "category").groupBy("drug", "status").agg(F.count("*").alias("keys"))


OVERLAP = """(b.hi IS NULL OR a.lo < b.hi OR (a.lo = b.hi AND a.lc AND b.hc)) AND (a.hi IS NULL OR b.lo < a.hi OR (b.lo = a.hi AND b.lc AND a.hc))"""
BOUNDS = f"""WITH {READINGS}, b AS (SELECT event_id AS id, user_id, event_type, CASE WHEN sign IN ('<', '<=') THEN 0 ELSE m END AS lo, CASE WHEN sign IN ('>', '>=') THEN NULL ELSE m END AS hi, sign IN ('=', '>=') AS lc, sign IN ('=', '<=') AS hc FROM readings JOIN events USING (event_id))"""


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of each user and kind of event as intervals with ends in one order."""
    x = intervals.parse_mic(F.col("raw"))
    low, high = interval_joins.endpoints(F.col("x.lo"), F.col("x.hi"), F.col("x.lo_closed"), F.col("x.hi_closed"))
    # parsed once: filters on the ends would otherwise repeat the parser
    rows = materialise(readings(spark, sf_dir).select(F.col("event_id").alias("id"), x.alias("x"))).where("x is not null")
    keys = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "ts")
    return rows.join(keys, "id").select("id", "user_id", "event_type", "ts", low.alias("low"), high.alias("high"))


@query("J17_interval_overlap_join", BOUNDS + f" SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.id < b.id WHERE {OVERLAP}")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of readings of one user and kind that may be the same value."""
    return interval_joins.self_overlaps(bounded(spark, sf_dir), ["user_id", "event_type"])


@query("J17_overlap_of_two_tables", BOUNDS + f""", o AS (SELECT b.* FROM b JOIN events e ON e.event_id = b.id WHERE e.ts < TIMESTAMP '{CUT} 00:00:00'), n AS (SELECT b.* FROM b JOIN events e ON e.event_id = b.id WHERE e.ts >= TIMESTAMP '{CUT} 00:00:00')
SELECT a.event_type, COUNT(*) AS pairs, COUNT(DISTINCT a.id) AS older, COUNT(DISTINCT b.id) AS newer FROM o a JOIN n b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE {OVERLAP} GROUP BY 1""")
def overlap_of_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of event the readings of an earlier snapshot that those of a later one may repeat."""
    rows, cut = bounded(spark, sf_dir), F.lit(f"{CUT} 00:00:00").cast("timestamp")
    pairs = interval_joins.overlap_join(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), ["user_id", "event_type"])
    kinds = rows.select(F.col("id").alias("a"), "event_type")
    return pairs.join(kinds, "a").groupBy("event_type").agg(F.count("*").alias("pairs"), F.count_distinct("a").alias("older"), F.count_distinct("b").alias("newer"))


@query("J18_nearest_interval", "SELECT o_orderkey AS q, MIN(greatest(0, s0 - q1 - 1, q0 - s1 - 1)) AS distance FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS q0, CAST(floor(o_totalprice) AS BIGINT) + 50 AS q1 FROM orders) o JOIN (SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS s0, CAST(floor(l_extendedprice) AS BIGINT) + 500 AS s1 FROM lineitem) l ON l_orderkey = o_orderkey GROUP BY 1")
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = lambda c: F.floor(c)
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contig"), F.col("o_orderkey").alias("id"), price("o_totalprice").alias("q0"), (price("o_totalprice") + 50).alias("q1"))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contig"), F.col("l_linenumber").alias("feature"), price("l_extendedprice").alias("s0"), (price("l_extendedprice") + 500).alias("s1"))
    return interval_joins.nearest(q, f, ["contig"]).select(F.col("id").alias("q"), "distance")


@query("J18_nearest_feature", """WITH q AS (SELECT doc_id AS id, lang, n_chars AS q0, n_chars + 10 AS q1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
f AS (SELECT doc_id AS feature, lang, n_chars AS s0, n_chars + doc_id % 40 AS s1 FROM documents JOIN labels USING (doc_id)),
p AS (SELECT q.*, feature, s0, s1, greatest(0, s0 - q1 - 1, q0 - s1 - 1) AS distance FROM q JOIN f USING (lang))
SELECT id, lang, q0, q1, feature, s0, s1, distance FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, s0 > q1 + 1, CASE WHEN s0 <= q1 + 1 THEN -s1 ELSE 0 END, feature) = 1""")
def nearest_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For documents without labels the labelled one of the same language that is nearest by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("at"))
    known = table(spark, sf_dir, "labels").select("doc_id")
    q = docs.join(known, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "lang", F.col("at").alias("q0"), (F.col("at") + 10).alias("q1"))
    f = docs.join(known, "doc_id").select(F.col("doc_id").alias("feature"), "lang", F.col("at").alias("s0"), (F.col("at") + F.col("doc_id") % 40).alias("s1"))
    return interval_joins.nearest(q, f, ["lang"])


#: Pairs that a task of a join within blocks compares, some; rows of a block that lie in one part of it.
PAIRS_IN_TASK, BLOCK_ROWS = 2e6, 1000


@query("J19_pair_self_join", "SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_name = b.p_name THEN 'equal' ELSE 'contained' END AS relation FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE a.p_name = b.p_name OR contains(a.p_name, split_part(b.p_name, ' ', 2))")
def pair_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    side = lambda n: rows.select(F.col("p_partkey").alias(n), "p_brand", "p_type", "p_size", F.col("p_name").alias(f"name_{n}"))
    equal = F.col("name_a") == F.col("name_b")
    # the table is small beside its pairs: there are as many tasks as pairs call for, and a block's rows are dealt out
    block = ["p_brand", "p_type", "p_size"]
    sizes = materialise(rows.groupBy(*block).agg(F.count("*").alias("n")))
    most = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / PAIRS_IN_TASK))
    sizes = sizes.select(*block, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"))
    left = side("a").join(sizes, block).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    right = side("b").join(sizes, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = left.repartition(tasks, *block, "part").join(right.repartition(tasks, *block, "part"), [*block, "part"]).where("a < b")
    return pairs.where(equal | F.contains("name_a", F.element_at(F.split("name_b", " "), 2))).select("a", "b", F.when(equal, "equal").otherwise("contained").alias("relation"))


@query("J20_setting_product", "SELECT r_name AS region, CAST(t AS DOUBLE) / 10 AS threshold, m AS metric FROM region, range(1, 4) s(t), (SELECT unnest(['ba', 'mcc']) AS m) x")
def setting_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    thresholds = regions.select("region", F.explode(F.array(*(F.lit(t / 10) for t in (1, 2, 3)))).alias("threshold"))
    return thresholds.select("region", "threshold", F.explode(F.array(F.lit("ba"), F.lit("mcc"))).alias("metric"))


@query("J21_dated_history", f"SELECT COUNT(*) AS valid FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND v.value <> p.value WHERE p.event_type = 'purchase' AND p.ts < TIMESTAMP '{CUT} 00:00:00'")
def dated_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes count: all of a user's views up to the case, less those of the same value. Both are
    running counts, so no case meets its views one by one."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    cut = F.lit(f"{CUT} 00:00:00").cast("timestamp")
    view = (F.col("event_type") == "view").cast("long")
    case = ((F.col("event_type") == "purchase") & (F.col("ts") < cut)).cast("long")
    total = None
    for keys, sign in ((["user_id"], 1), (["user_id", "value"], -1)):
        at = e.groupBy(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.sum(view).alias("views"), F.sum(case).alias("cases"))
        counted = ordered.running_totals(at, keys, "t", ["views"]).agg((sign * F.sum(F.col("cases") * (F.col("before_views") + F.col("views")))).alias("valid"))
        total = counted if total is None else total.unionByName(counted)
    return total.agg(F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"))


@query("J21_as_of_latest", "SELECT p.event_id, max(v.event_id) AS view_id FROM events p LEFT JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts < p.ts WHERE p.event_type = 'purchase' GROUP BY 1")
def as_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    found = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", ["view_id"], "week")
    return found.select("event_id", F.col("found.view_id").alias("view_id"))


#: Rules of the query: for purchases a documented one, for clicks two, for views without a citation, for errors of a
#: convention that isn't supported; none for signups.
BREAKPOINTS = [
    ("purchase", "S_LE_R_GT", "https://example.org/v1", "ab" * 32),
    ("click", "S_LE_R_GT", "https://example.org/v1", "ab" * 32),
    ("click", "S_LE_R_GT", "https://example.org/v2", "ab" * 32),
    ("view", "S_LE_R_GT", "", "ab" * 32),
    ("error", "R_GE", "https://example.org/v1", "ab" * 32),
]
BREAKPOINT_SQL = f"""WITH {READINGS}, r AS (SELECT e.event_id, e.event_type, sign, m, e.event_id % 6 AS v, e.event_id % 10 AS w FROM readings JOIN events e USING (event_id)),
  k AS (SELECT *, sign IN ('<', '<=') AS low, sign IN ('>', '>=') AS high FROM r),
  c AS (SELECT *, CASE WHEN NOT high AND m <= {S_MAX} THEN 'S' WHEN high AND m > {R_LIMIT} OR sign = '>' AND m = {R_LIMIT} THEN 'R'
    WHEN sign = '=' THEN CASE WHEN m <= {R_LIMIT} THEN 'I' ELSE 'R' END
    WHEN low THEN CASE WHEN m <= {R_LIMIT} THEN 'S|I' ELSE 'S|I|R' END
    ELSE CASE WHEN m < {S_MAX} OR sign = '>=' AND m = {S_MAX} THEN 'S|I|R' ELSE 'I|R' END END AS possible FROM k),
  s AS (SELECT CASE WHEN v = 1 THEN 'INCOMPLETE_METADATA' WHEN v = 2 AND w = 2 THEN 'INVALID_MIC' WHEN event_type IN ('signup', 'click') THEN 'NO_UNIQUE_DOCUMENTED_BREAKPOINT'
    WHEN event_type = 'view' THEN 'BREAKPOINT_CITATION_INCOMPLETE' WHEN event_type = 'error' THEN 'UNSUPPORTED_BREAKPOINT_CONVENTION'
    WHEN contains(possible, '|') THEN 'CENSORED_AMBIGUOUS' ELSE 'VERSION_CONDITIONAL_INTERPRETATION' END AS status, possible FROM c)
SELECT status, CASE WHEN status IN ('CENSORED_AMBIGUOUS', 'VERSION_CONDITIONAL_INTERPRETATION') THEN possible ELSE '' END AS possible_categories, COUNT(*) AS n FROM s GROUP BY 1, 2"""


@query("J22_breakpoint_lookup", BREAKPOINT_SQL)
def breakpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("drug"))
    value = F.when((F.col("event_id") % 6 == 2) & (F.col("event_id") % 10 == 2), "NaN").otherwise(F.col("number").cast("string"))
    version = F.when(F.col("event_id") % 6 == 1, "").otherwise("V1")
    given = [F.lit(v).alias(k) for k, v in {"organism": "Any Organism", "standard": "TEST", "context": "any", "unit": "mg/L", "method": "mic"}.items()]
    rows = readings(spark, sf_dir).join(types, "event_id").select("drug", value.alias("mic_value"), F.col("sign").alias("mic_sign"), version.alias("version"), *given)
    rules = spark.createDataFrame([(d, "any organism", "test", "any", "mg/l", "v1", f"{S_MAX}", f"{R_LIMIT}", *rest) for d, *rest in BREAKPOINTS], "drug string, organism string, standard string, context string, unit string, version string, s_max string, r_above string, convention string, source_url string, source_sha256 string")
    return breakpoints.interpret(rows, rules).groupBy("status", "possible_categories").agg(F.count("*").alias("n"))


@query("J23_aligned_values", "SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS toxic FROM documents d JOIN labels l USING (doc_id)")
def aligned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, values = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id"), table(spark, sf_dir, "labels")
    gates.assert_empty(order.join(values, "doc_id", "left_anti"), "keys without a value")
    return order.join(values, "doc_id").select("doc_id", F.col("toxic").cast("long").alias("toxic"))


@query("J24_content_duplicates", "WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'E2' ELSE 'E3' END AS cohort, sha256(text) AS digest FROM documents), c AS (SELECT digest, MIN(doc_id) AS class, COUNT(*) FILTER (WHERE cohort = 'E2') AS e2, COUNT(*) FILTER (WHERE cohort = 'E3') AS e3 FROM h WHERE digest IS NOT NULL GROUP BY 1) SELECT doc_id, cohort, class, e2, e3 FROM h JOIN c USING (digest) WHERE e2 > 0 AND e3 > 0")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content occurs in both cohorts, with their class (the least id) and its size in either."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "E2").otherwise("E3").alias("cohort"), F.sha2("text", 256).alias("digest")).where("digest is not null")
    sizes = h.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count_if(F.col("cohort") == "E2").alias("e2"), F.count_if(F.col("cohort") == "E3").alias("e3"))
    return h.join(sizes.where("e2 > 0 and e3 > 0"), "digest").select("doc_id", "cohort", "class", "e2", "e3")


@query("J26_group_overlap", "SELECT status, COUNT(*) AS samples FROM (SELECT c_custkey, CASE WHEN COUNT(o_orderkey) = 0 THEN 'MISSING' WHEN SUM(CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey < 3) THEN 1 ELSE 0 END) > 0 THEN 'SHARED' ELSE 'NO_SHARED' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) u GROUP BY 1")
def group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    fitted = orders.where("o_orderkey < 3").select("o_orderpriority").distinct().withColumn("shared", F.lit(1))
    groups = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").join(fitted, "o_orderpriority", "left")
    by = groups.groupBy("c_custkey").agg(F.max("shared").alias("shared"), F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("shared") == 1, "SHARED").otherwise("NO_SHARED")
    return table(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left").groupBy(status.alias("status")).agg(F.count("*").alias("samples"))


@query("J27_carriers", f"WITH {CALLS}, c AS (SELECT feature, sample, y, stratum, row_number() OVER (PARTITION BY feature ORDER BY y DESC, sample) AS rank FROM calls JOIN cohort USING (sample)) SELECT feature, sample, y, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 3")
def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a limit on the rank is taken before the shuffle as well, so a feature of most samples sends few rows
    rows = calls(spark, sf_dir).join(cohort(spark, sf_dir), "sample")
    order = Window.partitionBy("feature").orderBy(F.col("y").desc(), "sample")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("feature", "sample", "y", "rank")


@query("U06_identity_components", "WITH RECURSIVE e AS (SELECT o_custkey AS k, MIN(o_orderkey) AS m FROM orders GROUP BY 1) SELECT COUNT(DISTINCT m) AS components, COUNT(*) AS nodes, MAX(n) AS largest FROM (SELECT m, COUNT(*) OVER (PARTITION BY m) AS n FROM orders JOIN e ON o_custkey = k) u")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = graph.components(rows, graph.shared_key_edges(rows, "o_orderkey", [F.col("o_custkey")]), "o_orderkey")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.sum("n").alias("nodes"), F.max("n").alias("largest"))


@query("U07_threshold_components")
def threshold_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import association

    c = calls(spark, sf_dir)
    n = c.select("sample").distinct().count()
    counts = c.groupBy("feature").agg(F.count("*").alias("n"))
    pairs = association.pair_counts(c).join(counts.select(F.col("feature").alias("f"), F.col("n").alias("nf")), "f").join(counts.select(F.col("feature").alias("g"), F.col("n").alias("ng")), "g")
    near = pairs.where(F.abs(association.phi(F.col("n11"), F.col("nf"), F.col("ng"), F.lit(n))) >= 0.05)
    found = graph.components(counts, near.select(F.col("f").alias("a"), F.col("g").alias("b")), "feature")
    return found.groupBy("component").agg(F.count("*").alias("size"))
