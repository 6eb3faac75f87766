"""Queries over predictions: counts, ranks, folds, calibration, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import certificates, evaluation
from ..operators.ordered import exact_quantiles, with_totals
from ..registry import query
from ..roles import PREDICTIONS, SAMPLES, predictions, samples

CELLS = """CAST(SUM(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(SUM(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp"""
BA = "(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END + CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END) / 2"
PRODUCT = "(CAST(tp AS DOUBLE) + fp) * (tp + fn) * (tn + fp) * (tn + fn)"
MCC = f"CASE WHEN {PRODUCT} > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt({PRODUCT}) END"


def rank_sql(source: str, keys: str, score: str = "score", y: str = "y") -> str:
    """AUROC and average precision by (keys), from counts by score."""
    return f"""g AS (SELECT {keys}, {score} AS s, SUM({y}) AS pos, SUM(1 - {y}) AS neg FROM {source} GROUP BY {keys}, {score}),
w AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  SUM(pos) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp, SUM(neg) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn,
  SUM(pos) OVER (PARTITION BY {keys}) AS P, SUM(neg) OVER (PARTITION BY {keys}) AS N FROM g),
ranked AS (SELECT {keys}, CAST(MAX(P) AS BIGINT) AS positives, CAST(MAX(N) AS BIGINT) AS negatives,
  round(CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN SUM(CAST(pos AS DOUBLE) * (nb + CAST(neg AS DOUBLE) / 2)) / (CAST(MAX(P) AS DOUBLE) * MAX(N)) END, 9) AS auroc,
  round(CASE WHEN MAX(P) > 0 THEN SUM(CAST(pos AS DOUBLE) * cp / (cp + cn)) / MAX(P) END, 9) AS ap FROM w GROUP BY {keys})"""


def rounded(df: DataFrame, names: list[str], places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


FLAGSHIP = f"""WITH {SAMPLES}, predictions AS (SELECT source, reference, model, y, score, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM (
  SELECT source, 'old' AS reference, 'A' AS model, y, score_a AS score FROM samples UNION ALL SELECT source, 'old', 'B', y, score_b FROM samples
  UNION ALL SELECT source, 'new', 'A', y2, score_a FROM samples UNION ALL SELECT source, 'new', 'B', y2, score_b FROM samples) u),
{rank_sql("predictions", "source, reference, model")},
c AS (SELECT source, reference, model, {CELLS} FROM predictions GROUP BY 1, 2, 3),
m AS (SELECT source, reference, model, tp, fn, tn, fp, round({BA}, 9) AS ba, round({MCC}, 9) AS mcc, auroc, ap FROM c JOIN ranked USING (source, reference, model))
SELECT n.source, n.model, o.ba AS ba_old, n.ba AS ba_new, o.mcc AS mcc_old, n.mcc AS mcc_new, o.auroc AS auroc_old, n.auroc AS auroc_new, o.ap AS ap_old, n.ap AS ap_new, round(n.ba - o.ba, 9) AS ba_delta, round(n.auroc - o.auroc, 9) AS auroc_delta
FROM m n JOIN m o ON n.source = o.source AND n.model = o.model AND n.reference = 'new' AND o.reference = 'old'"""


@query("reference_change", FLAGSHIP)
def reference_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: two fixed scores against two label versions, and what the change of labels does."""
    rows = [F.struct(F.lit(r).alias("reference"), F.lit(m).alias("model"), F.col(y).alias("y"), F.col(s).alias("score")) for r, y in (("old", "y"), ("new", "y2")) for m, s in (("A", "score_a"), ("B", "score_b"))]
    long = samples(spark, sf_dir).select("source", F.explode(F.array(*rows)).alias("p")).select("source", "p.*").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    keys = ["source", "reference", "model"]
    values = ["ba", "mcc", "auroc", "ap"]
    both = evaluation.count_metrics(long, keys).join(evaluation.rank_metrics(long, keys), keys)
    wide = rounded(both, values).groupBy("source", "model").agg(*(F.max(F.when(F.col("reference") == r, F.col(v))).alias(f"{v}_{r}") for v in values for r in ("old", "new")))
    return wide.withColumns({f"{v}_delta": F.round(F.col(f"{v}_new") - F.col(f"{v}_old"), 9) for v in ("ba", "auroc")})


GROUP = "scheme, fold, model"


@query("A17_weighted_confusion", f"WITH {PREDICTIONS} SELECT scheme, model, CAST(SUM(CASE WHEN y = 1 AND pred = 1 THEN w ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN y = 1 AND pred = 0 THEN w ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN y = 0 AND pred = 0 THEN w ELSE 0 END) AS BIGINT) AS tn, CAST(SUM(CASE WHEN y = 0 AND pred = 1 THEN w ELSE 0 END) AS BIGINT) AS fp FROM (SELECT *, doc_id % 4 AS w FROM predictions) p GROUP BY 1, 2")
def weighted_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("w", F.col("doc_id") % 4)
    return rows.groupBy("scheme", "model").agg(*stats.confusion(F.col("y"), F.col("pred"), F.col("w")))


@query("A18_classification_metrics", f"WITH {PREDICTIONS}, c AS (SELECT {GROUP}, {CELLS} FROM predictions GROUP BY 1, 2, 3) SELECT {GROUP}, tp, fn, tn, fp, round({BA}, 9) AS ba, round({MCC}, 9) AS mcc, round(CAST(tp + tn AS DOUBLE) / (tp + fn + tn + fp), 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 9) AS ppv, round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 9) AS f1 FROM c")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.count_metrics(predictions(spark, sf_dir), ["scheme", "fold", "model"])
    return rounded(found.select("scheme", "fold", "model", "tp", "fn", "tn", "fp", "ba", "mcc", "accuracy", "ppv", "f1"), ["ba", "mcc", "accuracy", "ppv", "f1"])


@query("A19_brier_log_loss", f"WITH {PREDICTIONS} SELECT scheme, model, round(AVG((score - y) * (score - y)), 9) AS brier, round(-AVG(y * ln(q) + (1 - y) * ln(1 - q)), 9) AS log_loss FROM (SELECT *, least(greatest(score, CAST(1e-15 AS DOUBLE)), CAST(1 AS DOUBLE) - CAST(1e-15 AS DOUBLE)) AS q FROM predictions) p GROUP BY 1, 2")
def brier_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    brier, log_loss = evaluation.losses(F.col("y"), F.col("score"))
    return predictions(spark, sf_dir).groupBy("scheme", "model").agg(F.round(brier, 9).alias("brier"), F.round(log_loss, 9).alias("log_loss"))


@query("A20_auroc_A21_average_precision", f"WITH {PREDICTIONS}, {rank_sql('predictions', GROUP)} SELECT {GROUP}, positives, negatives, auroc, ap FROM ranked")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.rank_metrics(predictions(spark, sf_dir), ["scheme", "fold", "model"]), ["auroc", "ap"])


@query("A22_curve_points", f"WITH {PREDICTIONS} SELECT model, s AS score, CAST(SUM(pos) OVER (PARTITION BY model ORDER BY s DESC) AS BIGINT) AS tp, CAST(SUM(neg) OVER (PARTITION BY model ORDER BY s DESC) AS BIGINT) AS fp FROM (SELECT model, score AS s, SUM(y) AS pos, SUM(1 - y) AS neg FROM predictions WHERE scheme = 'mod5' GROUP BY 1, 2) g")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.curve_points(predictions(spark, sf_dir).where("scheme = 'mod5'"), ["model"]).select("model", "score", "tp", "fp")


@query("A22_pr_auc_trapezoid", f"WITH {PREDICTIONS}, p AS (SELECT model, s, SUM(pos) OVER d AS tp, SUM(neg) OVER d AS fp, SUM(pos) OVER (PARTITION BY model) AS P FROM (SELECT model, score AS s, SUM(y) AS pos, SUM(1 - y) AS neg FROM predictions WHERE scheme = 'mod5' GROUP BY 1, 2) g WINDOW d AS (PARTITION BY model ORDER BY s DESC)), c AS (SELECT model, s, CAST(tp AS DOUBLE) / P AS r, CAST(tp AS DOUBLE) / (tp + fp) AS q FROM p), l AS (SELECT model, r, q, COALESCE(LAG(r) OVER (PARTITION BY model ORDER BY s DESC), 0) AS r0, COALESCE(LAG(q) OVER (PARTITION BY model ORDER BY s DESC), 1) AS q0 FROM c) SELECT model, round(SUM((r - r0) * (q + q0) / 2), 9) AS pr_auc FROM l GROUP BY 1")
def pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = evaluation.curve_points(predictions(spark, sf_dir).where("scheme = 'mod5'"), ["model"])
    rows = points.select("model", "score", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("r"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("q"))
    order = Window.partitionBy("model").orderBy(F.col("score").desc())  # one row for each distinct score
    rows = rows.select("*", F.coalesce(F.lag("r").over(order), F.lit(0.0)).alias("r0"), F.coalesce(F.lag("q").over(order), F.lit(1.0)).alias("q0"))
    return rows.groupBy("model").agg(F.round(F.sum((F.col("r") - F.col("r0")) * (F.col("q") + F.col("q0")) / 2), 9).alias("pr_auc"))


@query("A23_subgroup_metrics", f"WITH {PREDICTIONS}, c AS (SELECT source, model, COUNT(*) AS n, {CELLS} FROM predictions WHERE scheme = 'mod5' GROUP BY 1, 2 HAVING COUNT(*) >= 10 AND MIN(y) = 0 AND MAX(y) = 1) SELECT source, model, n, round({BA}, 9) AS ba, round({MCC}, 9) AS mcc FROM c")
def subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.count_metrics(predictions(spark, sf_dir).where("scheme = 'mod5'"), ["source", "model"]).withColumn("n", F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp"))
    kept = found.where((F.col("n") >= 10) & (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))
    return rounded(kept.select("source", "model", "n", "ba", "mcc"), ["ba", "mcc"])


FOLDS = f"WITH {PREDICTIONS}, c AS (SELECT {GROUP}, {CELLS} FROM predictions GROUP BY 1, 2, 3), f AS (SELECT {GROUP}, {BA} AS ba FROM c)"


@query("A24_fold_summary", FOLDS + " SELECT scheme, model, round(AVG(ba), 9) AS mean, round(stddev_samp(ba), 9) AS sd, round(MIN(ba), 9) AS low, round(MAX(ba), 9) AS high FROM f GROUP BY 1, 2")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.count_metrics(predictions(spark, sf_dir), ["scheme", "fold", "model"]).groupBy("scheme", "model")
    return rounded(found.agg(F.avg("ba").alias("mean"), F.stddev_samp("ba").alias("sd"), F.min("ba").alias("low"), F.max("ba").alias("high")), ["mean", "sd", "low", "high"])


@query("A24_fold_deltas", FOLDS + " SELECT a.scheme, round(AVG(b.ba - a.ba), 9) AS mean_delta, COUNT(*) FILTER (WHERE b.ba > a.ba) AS higher, COUNT(*) FILTER (WHERE b.ba = a.ba) AS equal, COUNT(*) FILTER (WHERE b.ba < a.ba) AS lower FROM f a JOIN f b ON a.scheme = b.scheme AND a.fold = b.fold AND a.model = 'A' AND b.model = 'B' GROUP BY 1")
def fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.count_metrics(predictions(spark, sf_dir), ["scheme", "fold", "model"])
    gap = evaluation.paired_gap(found, ["scheme", "fold"], "model", "A", "B", ["ba"])
    return gap.groupBy("scheme").agg(F.round(F.avg("ba_delta"), 9).alias("mean_delta"), F.count_if(F.col("ba_delta") > 0).alias("higher"), F.count_if(F.col("ba_delta") == 0).alias("equal"), F.count_if(F.col("ba_delta") < 0).alias("lower"))


@query("A25_grand_total_level", f"WITH {PREDICTIONS} SELECT COALESCE(CAST(fold AS VARCHAR), 'ALL') AS fold, scheme, model, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives FROM predictions GROUP BY GROUPING SETS ((scheme, model, fold), (scheme, model))")
def grand_total_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    sets = rows.groupingSets([["scheme", "model", "fold"], ["scheme", "model"]], "scheme", "model", "fold")
    return sets.agg(F.count("*").alias("n"), F.sum("y").alias("positives")).select(F.coalesce(F.col("fold").cast("string"), F.lit("ALL")).alias("fold"), "scheme", "model", "n", "positives")


@query("A16_leave_one_group_out", f"WITH {PREDICTIONS}, g AS (SELECT source, {CELLS} FROM predictions WHERE scheme = 'mod5' AND model = 'A' GROUP BY 1), t AS (SELECT SUM(tp) AS tp, SUM(fn) AS fn, SUM(tn) AS tn, SUM(fp) AS fp FROM g), r AS (SELECT g.source, t.tp - g.tp AS tp, t.fn - g.fn AS fn, t.tn - g.tn AS tn, t.fp - g.fp AS fp FROM g, t) SELECT source, round({BA} - (SELECT {BA} FROM t), 9) AS ba_delta FROM r")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ["tp", "fn", "tn", "fp"]
    by = predictions(spark, sf_dir).where("scheme = 'mod5' and model = 'A'").groupBy("source").agg(*stats.confusion(F.col("y"), F.col("pred")))
    whole = by.agg(*(F.sum(c).alias(f"all_{c}") for c in cells))
    ba = lambda f: stats.metrics(*(f(c) for c in cells))["ba"]
    rows = by.crossJoin(F.broadcast(whole))  # one row
    return rows.select("source", F.round(ba(lambda c: F.col(f"all_{c}") - F.col(c)) - ba(lambda c: F.col(f"all_{c}")), 9).alias("ba_delta"))


@query("A38_calibration_bins", f"WITH {SAMPLES}, b AS (SELECT y, score_a, greatest(1, CAST(ceil(score_a * 10) AS INTEGER)) AS bin FROM samples), t AS (SELECT bin, COUNT(*) AS n, AVG(score_a) AS m, AVG(CAST(y AS DOUBLE)) AS r FROM b GROUP BY 1) SELECT bin, n, round(m, 9) AS mean_score, round(r, 9) AS rate, round(SUM(n * abs(m - r)) OVER () / SUM(n) OVER (), 9) AS ece FROM t")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = evaluation.calibration_table(samples(spark, sf_dir).withColumnRenamed("score_a", "score"), [])
    ece = bins.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 9).alias("ece"))
    return rounded(bins.drop("gap").crossJoin(F.broadcast(ece)), ["mean_score", "rate"])  # one row


@query("A38_quantile_bins", f"WITH {SAMPLES}, e AS (SELECT quantile_cont(score_a, [0.25, 0.5, 0.75]) AS q FROM samples) SELECT CAST(1 + CAST(score_a > q[1] AS INTEGER) + CAST(score_a > q[2] AS INTEGER) + CAST(score_a > q[3] AS INTEGER) AS INTEGER) AS bin, COUNT(*) AS n, round(AVG(CAST(y AS DOUBLE)), 9) AS rate FROM samples, e GROUP BY 1")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    edges = exact_quantiles(rows, [], "score_a", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(F.array_distinct(F.array("q1", "q2", "q3")).alias("edges"))
    number = (1 + F.size(F.filter("edges", lambda e: e < F.col("score_a")))).cast("int")
    return rows.crossJoin(F.broadcast(edges)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").cast("double")), 9).alias("rate"))  # one row


@query("A39_calibration_refit")
def calibration_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = evaluation.calibration_fit(samples(spark, sf_dir).withColumnRenamed("score_a", "score"))
    return spark.createDataFrame([(a and round(a, 8), b and round(b, 8))], "intercept double, slope double")


@query("A40_entropy", f"WITH {SAMPLES} SELECT source, round(AVG(CASE WHEN score_a > 0 AND score_a < 1 THEN -score_a * log2(score_a) - (1 - score_a) * log2(1 - score_a) ELSE 0 END), 9) AS entropy FROM samples GROUP BY 1")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("source").agg(F.round(F.avg(stats.entropy(F.col("score_a"))), 9).alias("entropy"))


@query("A43_error_overlap", f"WITH {SAMPLES}, e AS (SELECT (CASE WHEN score_a >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) = y AS a, (CASE WHEN score_b >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) = y AS b FROM samples) SELECT COUNT(*) FILTER (WHERE a AND b) AS both_correct, COUNT(*) FILTER (WHERE a AND NOT b) AS only_a, COUNT(*) FILTER (WHERE b AND NOT a) AS only_b, COUNT(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong FROM e")
def error_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ((F.col(f"score_{m}") >= 0.5).cast("int") == F.col("y") for m in "ab")
    return samples(spark, sf_dir).agg(F.count_if(a & b).alias("both_correct"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(~a & ~b).alias("both_wrong"))


MCC_SQL = "({tp} * {tn} - {fp} * {fn}) / sqrt(CAST({tp} + {fp} AS DOUBLE) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))"
BOUNDS_SQL = f"""WITH {SAMPLES}, c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND score_a >= 0.6) AS tp, COUNT(*) FILTER (WHERE y = 1 AND score_a >= 0.4 AND score_a < 0.6) AS up, COUNT(*) FILTER (WHERE y = 1 AND score_a < 0.4) AS fn,
  COUNT(*) FILTER (WHERE y = 0 AND score_a < 0.4) AS tn, COUNT(*) FILTER (WHERE y = 0 AND score_a >= 0.4 AND score_a < 0.6) AS un, COUNT(*) FILTER (WHERE y = 0 AND score_a >= 0.6) AS fp FROM samples),
  g AS (SELECT tp + i AS tp, fn + up - i AS fn, tn + j AS tn, fp + un - j AS fp FROM c, (SELECT unnest(range(up + 1)) AS i FROM c) a, (SELECT unnest(range(un + 1)) AS j FROM c) b),
  m AS (SELECT (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 AS ba, {MCC_SQL.format(tp="tp", fn="fn", tn="tn", fp="fp")} AS mcc FROM g)
SELECT round(MIN(ba), 9) AS ba_min, round(MAX(ba), 9) AS ba_max, round(MIN(mcc), 9) AS mcc_min, round(MAX(mcc), 9) AS mcc_max FROM m"""


@query("A44_bounds_under_unresolved", BOUNDS_SQL)
def bounds_under_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds over every completion of the unresolved calls. Both metrics only grow with each call that
    turns out right, so all wrong and all right are the two ends; the SQL tries every completion."""
    s, y = F.col("score_a"), F.col("y")
    open_ = (s >= 0.4) & (s < 0.6)
    c = samples(spark, sf_dir).agg(F.count_if((y == 1) & (s >= 0.6)).alias("tp"), F.count_if((y == 1) & open_).alias("up"), F.count_if((y == 1) & (s < 0.4)).alias("fn"), F.count_if((y == 0) & (s < 0.4)).alias("tn"), F.count_if((y == 0) & open_).alias("un"), F.count_if((y == 0) & (s >= 0.6)).alias("fp"))
    least = stats.metrics(F.col("tp"), F.col("fn") + F.col("up"), F.col("tn"), F.col("fp") + F.col("un"))
    most = stats.metrics(F.col("tp") + F.col("up"), F.col("fn"), F.col("tn") + F.col("un"), F.col("fp"))
    return c.select(*(F.round(m[k], 9).alias(f"{k}_{end}") for k in ("ba", "mcc") for m, end in ((least, "min"), (most, "max"))))


@query("A45_flip_certificate", f"WITH {SAMPLES}, r AS (SELECT doc_id, (CASE WHEN (score_a >= CAST(0.5 AS DOUBLE)) = (y = 1) THEN 1 ELSE 0 END) AS a, (CASE WHEN (score_b >= CAST(0.5 AS DOUBLE)) = (y = 1) THEN 1 ELSE 0 END) AS b FROM samples), m AS (SELECT SUM(a - b) AS margin, COUNT(*) FILTER (WHERE a <> b) AS flips FROM r) SELECT CAST(abs(margin) AS BIGINT) AS margin, CAST(abs(margin) // 2 + 1 AS BIGINT) AS least_flips FROM m")
def flip_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest labels whose change reverses which of two methods has more right calls: each changed label
    on which the better one is right alone moves the margin by two; the running harm first passes it there."""
    right = lambda m: ((F.col(f"score_{m}") >= 0.5).cast("int") == F.col("y")).cast("int")
    rows = samples(spark, sf_dir).select("doc_id", (right("a") - right("b")).alias("d"))
    margin = rows.agg(F.abs(F.sum("d")).alias("margin"), F.signum(F.sum("d")).cast("int").alias("sign"))
    harm = rows.crossJoin(F.broadcast(margin)).withColumn("harm", 2 * F.col("d") * F.col("sign")).where("harm > 0")  # one row
    sizes = harm.groupBy("margin", "harm").agg(F.count("*").alias("n"))
    return sizes.select("margin", F.when(F.col("n") * F.col("harm") > F.col("margin"), F.floor(F.col("margin") / F.col("harm")) + 1).alias("least_flips"))


CERTIFICATES = f"""WITH {SAMPLES}, r AS (SELECT doc_id AS id, y, score_a AS a, score_b AS b, lang = 'en' AS en, CAST(score_a >= CAST(0.5 AS DOUBLE) AS INTEGER) - CAST(score_b >= CAST(0.5 AS DOUBLE) AS INTEGER) AS d FROM samples),
  k AS (SELECT *, COUNT(*) OVER () * d - SUM(d) OVER () AS wb, 2 * rank() OVER (ORDER BY a) + COUNT(*) OVER (PARTITION BY a) - 2 * rank() OVER (ORDER BY b) - COUNT(*) OVER (PARTITION BY b) AS wr FROM r),
  w AS (SELECT mask, metric, fixed_totals, id, y, CASE metric WHEN 'AUROC' THEN wr ELSE wb END AS w, mask = 'all' OR en AS allowed FROM k, (SELECT unnest(['all', 'en']) AS mask) x, (SELECT unnest(['balanced_accuracy', 'AUROC']) AS metric) y, (SELECT unnest([FALSE, TRUE]) AS fixed_totals) z),
  t AS (SELECT mask, metric, fixed_totals, COUNT(*) AS n, SUM(y) AS positives, COUNT(*) FILTER (WHERE allowed) AS eligible, SUM(y * w) AS margin FROM w GROUP BY ALL),
  h AS (SELECT w.*, margin, -sign(margin) * (1 - 2 * y) * w AS harm FROM w JOIN t USING (mask, metric, fixed_totals) WHERE allowed AND margin <> 0 AND positives > 0 AND positives < n),
  o AS (SELECT *, row_number() OVER (PARTITION BY mask, metric, fixed_totals, CASE WHEN fixed_totals THEN y ELSE 0 END ORDER BY harm DESC, id) AS rank FROM h WHERE fixed_totals OR harm > 0),
  u AS (SELECT mask, metric, fixed_totals, rank, any_value(margin) AS margin, SUM(harm) AS harm, COUNT(*) AS m FROM o GROUP BY ALL HAVING NOT fixed_totals OR COUNT(*) = 2),
  c AS (SELECT *, SUM(harm) OVER (PARTITION BY mask, metric, fixed_totals ORDER BY rank) AS harmed FROM u),
  p AS (SELECT mask, metric, fixed_totals, MIN(rank) AS last, arg_min(harmed, rank) AS harmed, MIN(rank * m) AS flips FROM c WHERE harmed > abs(margin) GROUP BY ALL),
  v AS (SELECT o.*, last FROM o JOIN p USING (mask, metric, fixed_totals) WHERE rank <= last)"""

CERTIFICATES_SQL = CERTIFICATES + """, g AS (SELECT mask, metric, fixed_totals, SUM(1 - 2 * y) AS gained FROM v GROUP BY ALL)
SELECT mask, metric, fixed_totals, n, CAST(positives AS BIGINT) AS positives, CAST(n - positives AS BIGINT) AS negatives, eligible, CAST(margin AS BIGINT) AS integer_margin, CASE WHEN margin > 0 THEN 'method1_above_method2' WHEN margin < 0 THEN 'method1_below_method2' ELSE 'tie' END AS initial_order,
  round(margin / CAST(2 * positives * (n - positives) AS DOUBLE), 12) AS point_difference, flips AS least_flips, CAST(sign(margin) * (abs(margin) - harmed) AS BIGINT) AS witness_margin,
  round(sign(margin) * (abs(margin) - harmed) / CAST(2 * (positives + gained) * (n - positives - gained) AS DOUBLE), 12) AS witness_difference,
  CASE WHEN margin = 0 THEN 'INITIAL_TIE_NO_STRICT_ORDER' WHEN flips IS NOT NULL THEN 'EXACT_MINIMUM_WITH_ATTAINING_COUNTERFACTUAL_WITNESS' ELSE 'NO_STRICT_REVERSAL_POSSIBLE_WITHIN_ALLOWED_MASK' END AS status
FROM t LEFT JOIN p USING (mask, metric, fixed_totals) LEFT JOIN g USING (mask, metric, fixed_totals)"""


def _certificates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = samples(spark, sf_dir).select(F.col("doc_id").alias("id"), "y", F.col("score_a").alias("a"), F.col("score_b").alias("b"), "lang")
    masks = {"all": F.lit(True), "en": F.col("lang") == "en"}
    return certificates.certificates(rows, [certificates.Scenario(name, allowed, metric, fixed) for name, allowed in masks.items() for metric in certificates.METRICS for fixed in (False, True)])


@query("A45_certificates", CERTIFICATES_SQL)
def ranking_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For either metric, free or fixed class totals, and all or only English rows: the fewest labels whose change turns
    the order of the two scores around."""
    report, _ = _certificates(spark, sf_dir)
    whole = {c: F.col(c).cast("long") for c in ("n", "positives", "negatives", "eligible", "integer_margin", "least_flips", "witness_margin")}
    return report.drop("scenario").withColumns(whole | {c: F.round(c, 12) for c in ("point_difference", "witness_difference")})


@query("A45_witnesses", CERTIFICATES + " SELECT mask, metric, fixed_totals, id, rank - 1 AS rank, y, 1 - y AS flipped FROM v")
def ranking_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose change attains each certificate."""
    report, witnesses = _certificates(spark, sf_dir)
    return witnesses.join(F.broadcast(report.select("scenario", "mask", "metric", "fixed_totals")), "scenario").drop("scenario")  # a row for each scenario


@query("A50_weighted_error_scenarios", f"WITH {SAMPLES}, c AS (SELECT SUM(CASE WHEN y = 1 AND score_a < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS fna, SUM(CASE WHEN y = 0 AND score_a >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS fpa, SUM(CASE WHEN y = 1 AND score_b < CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS fnb, SUM(CASE WHEN y = 0 AND score_b >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS fpb FROM samples) SELECT CAST(w AS INTEGER) AS w, CAST(w * fna + fpa AS BIGINT) AS cost_a, CAST(w * fnb + fpb AS BIGINT) AS cost_b, CASE WHEN w * fna + fpa < w * fnb + fpb THEN 'A' WHEN w * fna + fpa > w * fnb + fpb THEN 'B' ELSE 'tie' END AS winner FROM c, (SELECT unnest([1, 2, 5, 10]) AS w) x")
def weighted_error_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = lambda m, y, high: F.count_if((F.col("y") == y) & ((F.col(f"score_{m}") >= 0.5) == F.lit(high)))
    c = samples(spark, sf_dir).agg(*(f.alias(n + m) for m in "ab" for n, f in (("fn", wrong(m, 1, False)), ("fp", wrong(m, 0, True)))))
    rows = c.withColumn("w", F.explode(F.array(*map(F.lit, (1, 2, 5, 10)))))
    cost = lambda m: F.col("w") * F.col(f"fn{m}") + F.col(f"fp{m}")
    return rows.select("w", cost("a").alias("cost_a"), cost("b").alias("cost_b"), F.when(cost("a") < cost("b"), "A").when(cost("a") > cost("b"), "B").otherwise("tie").alias("winner"))


JOINT = "SELECT lang, y, pa, pb, COUNT(*) AS n FROM (SELECT lang, y, CASE WHEN score_a >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pa, CASE WHEN score_b >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pb FROM samples) s GROUP BY 1, 2, 3, 4"


def joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = lambda m: (F.col(f"score_{m}") >= 0.5).cast("int")
    return samples(spark, sf_dir).groupBy("lang", "y", call("a").alias("pa"), call("b").alias("pb")).agg(F.count("*").alias("n"))


@query("A14_joint_cells", f"WITH {SAMPLES} {JOINT}")
def joint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joint(spark, sf_dir)


@query("A15_combined_flipped_sources", f"WITH {SAMPLES}, j AS ({JOINT}) SELECT CASE WHEN lang = 'de' THEN 1 - y ELSE y END AS y, pa, CAST(SUM(n) AS BIGINT) AS n FROM j WHERE lang <> 'fr' GROUP BY 1, 2")
def combined_flipped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("lang") == "de", 1 - F.col("y")).otherwise(F.col("y"))
    return joint(spark, sf_dir).where("lang <> 'fr'").groupBy(y.alias("y"), "pa").agg(F.sum("n").alias("n"))


CONTRAST = f"WITH {SAMPLES}, l AS (SELECT lang, ref, method, y, pred FROM (SELECT lang, 'old' AS ref, 'A' AS method, y, CASE WHEN score_a >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM samples UNION ALL SELECT lang, 'old', 'B', y, CASE WHEN score_b >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END FROM samples UNION ALL SELECT lang, 'new', 'A', y2, CASE WHEN score_a >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END FROM samples UNION ALL SELECT lang, 'new', 'B', y2, CASE WHEN score_b >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END FROM samples) u), c AS (SELECT lang, ref, method, {CELLS} FROM l GROUP BY 1, 2, 3), f AS (SELECT lang, ref, method, {BA} AS ba FROM c)"


def _two_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy by (lang, ref, method)."""
    cases = [F.struct(F.lit(r).alias("ref"), F.lit(m.upper()).alias("method"), F.col(y).alias("y"), (F.col(f"score_{m}") >= 0.5).cast("int").alias("pred")) for r, y in (("old", "y"), ("new", "y2")) for m in "ab"]
    long = samples(spark, sf_dir).select("lang", F.explode(F.array(*cases)).alias("c")).select("lang", "c.*")
    return evaluation.count_metrics(long, ["lang", "ref", "method"])


@query("A46_factorial_contrasts", CONTRAST + " SELECT lang, round(MAX(CASE WHEN ref = 'new' AND method = 'A' THEN ba END) - MAX(CASE WHEN ref = 'old' AND method = 'A' THEN ba END), 9) AS reference_effect, round((MAX(CASE WHEN ref = 'new' AND method = 'B' THEN ba END) - MAX(CASE WHEN ref = 'new' AND method = 'A' THEN ba END)) - (MAX(CASE WHEN ref = 'old' AND method = 'B' THEN ba END) - MAX(CASE WHEN ref = 'old' AND method = 'A' THEN ba END)), 9) AS interaction FROM f GROUP BY 1")
def factorial_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda r, m: F.max(F.when((F.col("ref") == r) & (F.col("method") == m), F.col("ba")))
    wide = _two_references(spark, sf_dir).groupBy("lang").agg(*(cell(r, m).alias(r + m) for r in ("old", "new") for m in "AB"))
    return wide.select("lang", F.round(F.col("newA") - F.col("oldA"), 9).alias("reference_effect"), F.round((F.col("newB") - F.col("newA")) - (F.col("oldB") - F.col("oldA")), 9).alias("interaction"))


@query("A58_method_pair_contrasts", CONTRAST + ", d AS (SELECT a.lang, a.ref, b.ba - a.ba AS gap FROM f a JOIN f b ON a.lang = b.lang AND a.ref = b.ref AND a.method < b.method) SELECT o.lang, round(o.gap, 9) AS gap_old, round(n.gap, 9) AS gap_new, o.gap * n.gap < 0 AS reversed FROM d o JOIN d n ON o.lang = n.lang AND o.ref = 'old' AND n.ref = 'new'")
def method_pair_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = evaluation.paired_gap(_two_references(spark, sf_dir), ["lang", "ref"], "method", "A", "B", ["ba"])
    both = evaluation.paired_gap(gap, ["lang"], "ref", "old", "new", ["ba_delta"])
    return both.select("lang", F.round("ba_delta_a", 9).alias("gap_old"), F.round("ba_delta_b", 9).alias("gap_new"), (F.col("ba_delta_a") * F.col("ba_delta_b") < 0).alias("reversed"))


@query("A52_failure_table", f"WITH {SAMPLES}, g AS (SELECT source, COUNT(*) AS n, COUNT(*) FILTER (WHERE score_a < CAST(0.5 AS DOUBLE)) AS fn, COUNT(*) FILTER (WHERE score_a < CAST(0.1 AS DOUBLE)) AS confident_fn FROM samples WHERE y = 1 GROUP BY 1) SELECT source, n, fn, confident_fn, round(CAST(fn AS DOUBLE) / n, 9) AS rate, n < 10 AS low_n FROM g")
def failure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = samples(spark, sf_dir).where("y = 1").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("score_a") < 0.5).alias("fn"), F.count_if(F.col("score_a") < 0.1).alias("confident_fn"))
    return g.select("source", "n", "fn", "confident_fn", F.round(F.col("fn") / F.col("n"), 9).alias("rate"), (F.col("n") < 10).alias("low_n"))


@query("A34_wilson_interval", f"WITH {SAMPLES}, g AS (SELECT source, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(y) AS DOUBLE) / COUNT(*) AS p FROM samples GROUP BY 1), z AS (SELECT CAST({stats.Z95} AS DOUBLE) AS z) SELECT source, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM g, z")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = stats.wilson(F.col("k"), F.col("n"))
    g = samples(spark, sf_dir).groupBy("source").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    return g.select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("A56_internal_external_gap", f"WITH {PREDICTIONS}, c AS (SELECT scheme, CASE WHEN lang = 'en' THEN 'internal' ELSE 'external' END AS side, model, {CELLS} FROM predictions GROUP BY 1, 2, 3), f AS (SELECT scheme, side, model, {BA} AS ba, {MCC} AS mcc FROM c), l AS (SELECT scheme, side, model, 'ba' AS metric, ba AS value FROM f UNION ALL SELECT scheme, side, model, 'mcc', mcc FROM f) SELECT e.scheme, e.model, e.metric, round(e.value - i.value, 9) AS gap FROM l e JOIN l i ON e.scheme = i.scheme AND e.model = i.model AND e.metric = i.metric AND e.side = 'external' AND i.side = 'internal'")
def internal_external_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("side", F.when(F.col("lang") == "en", "internal").otherwise("external"))
    long = evaluation.count_metrics(rows, ["scheme", "side", "model"]).unpivot(["scheme", "side", "model"], ["ba", "mcc"], "metric", "value")
    gap = evaluation.paired_gap(long, ["scheme", "model", "metric"], "side", "internal", "external", ["value"])
    return gap.select("scheme", "model", "metric", F.round("value_delta", 9).alias("gap"))


@query("A57_exclusion_scenarios", f"WITH {PREDICTIONS}, big AS (SELECT source, row_number() OVER (ORDER BY COUNT(*) DESC, source) AS r FROM samples GROUP BY 1), s AS (SELECT unnest([0, 1, 2, 5]) AS k), c AS (SELECT k, {CELLS} FROM s, predictions p JOIN big b ON p.source = b.source WHERE scheme = 'mod5' AND model = 'A' AND b.r > s.k GROUP BY 1) SELECT CAST(k AS INTEGER) AS dropped, tp + fn + tn + fp AS n, round({BA}, 9) AS ba FROM c")
def exclusion_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).where("scheme = 'mod5' and model = 'A'")
    by = rows.groupBy("source").agg(F.count("*").alias("n"), *stats.confusion(F.col("y"), F.col("pred")))
    ranked = by.withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")))  # a row for each source
    kept = ranked.withColumn("dropped", F.explode(F.array(*map(F.lit, (0, 1, 2, 5))))).where("r > dropped")
    sums = kept.groupBy("dropped").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("tp", "fn", "tn", "fp")))
    return sums.select("dropped", "n", F.round(stats.metrics(*(F.col(c) for c in ("tp", "fn", "tn", "fp")))["ba"], 9).alias("ba"))


@query("A59_error_profile", f"WITH {SAMPLES} SELECT source, COUNT(*) AS n, COUNT(*) FILTER (WHERE wrong) AS errors, round(AVG(score_a), 9) AS mean_score, round(quantile_cont(score_a, 0.5), 9) AS median_score, COUNT(DISTINCT lang) AS types, array_to_string(list_sort(list(DISTINCT lang)), ';') AS langs FROM (SELECT *, (score_a >= CAST(0.5 AS DOUBLE)) <> (y = 1) AS wrong FROM samples) s GROUP BY 1")
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong, rows = (F.col("score_a") >= 0.5) != (F.col("y") == 1), samples(spark, sf_dir)
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.round(F.avg("score_a"), 9).alias("mean_score"), F.count_distinct("lang").alias("types"), F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"))
    middle = exact_quantiles(rows, ["source"], "score_a", {"median_score": 0.5})
    return with_totals(by, middle.select("source", F.round("median_score", 9).alias("median_score")), ["source"])


@query("A60_paired_correctness", f"WITH {SAMPLES} SELECT y, COUNT(*) FILTER (WHERE a AND NOT b) AS a_only, COUNT(*) FILTER (WHERE b AND NOT a) AS b_only FROM (SELECT y, (score_a >= CAST(0.5 AS DOUBLE)) = (y = 1) AS a, (score_b >= CAST(0.5 AS DOUBLE)) = (y = 1) AS b FROM samples) s GROUP BY 1")
def paired_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ((F.col(f"score_{m}") >= 0.5) == (F.col("y") == 1) for m in "ab")
    return samples(spark, sf_dir).groupBy("y").agg(F.count_if(a & ~b).alias("a_only"), F.count_if(b & ~a).alias("b_only"))
