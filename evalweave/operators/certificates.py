"""How few labels must change until the other of two fixed scores has the better metric, with the rows that do it.

Balanced accuracy and AUROC differ between two scores by a sum of whole-number weights over the positives, divided by a factor
of the class sizes. So which score is ahead is the sign of an integer margin, and changing a label moves the margin by that row's weight.
With free class totals the worst changes are the rows of greatest harm; with fixed totals as many positives as negatives
change, and the worst are the most harmful of either class, taken in pairs. Rows are ranked by a distributed sort, rank by rank
their harm is added up in blocks, and the first rank that passes the margin is the answer: no order of all rows lies in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .joins import spread_join
from .ordered import positions, prefix_sums, running_totals

METRICS = ("balanced_accuracy", "AUROC")
WIDE = "decimal(38,0)"
TIE, EXACT, IMPOSSIBLE, ONE_CLASS = "INITIAL_TIE_NO_STRICT_ORDER", "EXACT_MINIMUM_WITH_ATTAINING_COUNTERFACTUAL_WITNESS", "NO_STRICT_REVERSAL_POSSIBLE_WITHIN_ALLOWED_MASK", "BOTH_CLASSES_REQUIRED"


@dataclass(frozen=True)
class Scenario:
    """Which rows may change (a column that is true for them), by which metric the scores compare, and whether class totals are fixed."""

    mask: str
    allowed: Column
    metric: str
    fixed_totals: bool


def doubled_ranks(df: DataFrame, score: str, name: str) -> DataFrame:
    """Adds twice the average rank of ``score`` over all rows, a whole number; ties are counted before anything is joined."""
    counts = df.groupBy(F.col(score).alias("__score")).agg(F.count("*").alias("__n"))
    ranks = running_totals(counts, [], "__score", ["__n"]).select(F.col("__score"), (2 * F.col("before___n") + F.col("__n") + 1).alias(name))
    return spread_join(df.withColumn("__score", F.col(score)), ranks, ["__score"], "id").drop("__score")


def weighted_rows(df: DataFrame, scenarios: list[Scenario], cutoff: float = 0.5) -> DataFrame:
    """(scenario, id, y, w, allowed) for each scenario: y times w adds up to the margin of a over b.

    ``df``: id (unique), y (0 or 1), a, b. Rows with a null or NaN in these are left out.
    """
    flags = [c.allowed.alias(f"__allowed{i}") for i, c in enumerate(scenarios)]
    rows = df.select("id", F.col("y").cast("int").alias("y"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), *flags).dropna(subset=["id", "y", "a", "b"]).where(~F.isnan("a") & ~F.isnan("b"))
    rows = rows.withColumn("d", (F.col("a") >= cutoff).cast("long") - (F.col("b") >= cutoff).cast("long"))
    if any(c.metric == "AUROC" for c in scenarios):
        rows = doubled_ranks(doubled_ranks(rows, "a", "ra"), "b", "rb")
    sizes = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("d"), F.lit(0)).alias("sum_d"))
    rows = rows.crossJoin(F.broadcast(sizes))  # one row
    weights = {"balanced_accuracy": lambda: F.col("n_rows") * F.col("d") - F.col("sum_d"), "AUROC": lambda: F.col("ra") - F.col("rb")}
    parts = [F.struct(F.lit(i).alias("scenario"), weights[c.metric]().cast("long").alias("w"), F.coalesce(F.col(f"__allowed{i}"), F.lit(False)).alias("allowed")) for i, c in enumerate(scenarios)]
    return rows.select("id", "y", F.explode(F.array(*parts)).alias("s")).select("s.scenario", "id", "y", "s.w", "s.allowed")


def certificates(df: DataFrame, scenarios: list[Scenario], cutoff: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(a report with a row for each scenario, its witnesses (scenario, id, rank, y, flipped)).

    Of rows that do the same harm the least ids change. Scenarios of a table without rows report nothing.
    """
    for c in scenarios:
        if c.metric not in METRICS:
            raise ValueError(f"unknown metric {c.metric}")
    spark = df.sparkSession
    rows = materialise(weighted_rows(df, scenarios, cutoff))
    named = spark.createDataFrame([(i, c.mask, c.metric, c.fixed_totals) for i, c in enumerate(scenarios)], "scenario int, mask string, metric string, fixed_totals boolean")
    y, w = F.col("y"), F.col("w").cast(WIDE)
    totals = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.count_if("allowed").alias("eligible"), F.sum(y * w).cast(WIDE).alias("margin"))
    totals = materialise(named.join(totals, "scenario"))  # a row for each scenario
    open_ = (F.col("margin") != 0) & (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    harm = -F.signum("margin").cast("int") * (1 - 2 * y) * F.col("w")
    judged = rows.where("allowed").join(F.broadcast(totals.where(open_)), "scenario").select("scenario", "id", "y", "fixed_totals", harm.alias("harm"))
    # with free totals only harm counts, with fixed ones the most harmful of each class go in pairs
    ranked = judged.where("fixed_totals or harm > 0").withColumn("side", F.when(F.col("fixed_totals"), F.col("y")).otherwise(0))
    ranked = materialise(positions(ranked, [F.col("scenario"), F.col("side"), F.col("harm").desc(), F.col("id")], "at"))
    first = ranked.groupBy("scenario", "side").agg(F.min("at").alias("first"))  # two rows a scenario at most
    ranked = ranked.join(F.broadcast(first), ["scenario", "side"]).withColumn("rank", F.col("at") - F.col("first"))
    units = ranked.groupBy("scenario", "rank").agg(F.sum(F.col("harm").cast(WIDE)).cast(WIDE).alias("harm"), F.count("*").alias("members"), F.max("fixed_totals").alias("paired"))
    units = units.where(~F.col("paired") | (F.col("members") == 2))
    summed = prefix_sums(units, ["scenario"], "rank", "harm", "harmed").join(F.broadcast(totals.select("scenario", "margin")), "scenario")
    passed = summed.where(F.col("harmed") > F.abs("margin")).groupBy("scenario").agg(F.min_by(F.struct("rank", "harmed", "members"), "rank").alias("u"))
    passed = materialise(passed.select("scenario", F.col("u.rank").alias("last"), F.col("u.harmed").alias("harmed"), ((F.col("u.rank") + 1) * F.col("u.members")).alias("flips")))
    chosen = ranked.join(F.broadcast(passed.select("scenario", "last")), "scenario").where("rank <= last")
    witnesses = chosen.select("scenario", "id", "rank", "y", (1 - y).alias("flipped"))
    gained = witnesses.groupBy("scenario").agg(F.sum(1 - 2 * y).alias("gained"))
    found = totals.join(passed, "scenario", "left").join(gained, "scenario", "left")
    classes = lambda p: (2 * p * (F.col("n") - p)).cast("double")
    now, then = F.col("positives"), F.col("positives") + F.col("gained")
    after = F.signum("margin").cast("int") * (F.abs("margin") - F.col("harmed"))
    order = F.when(F.col("margin") > 0, "method1_above_method2").when(F.col("margin") < 0, "method1_below_method2").otherwise("tie")
    both = (now > 0) & (now < F.col("n"))
    status = F.when(~both, ONE_CLASS).when(F.col("margin") == 0, TIE).when(F.col("flips").isNotNull(), EXACT).otherwise(IMPOSSIBLE)
    report = found.select(
        "scenario", "mask", "metric", "fixed_totals", "n", "positives", (F.col("n") - now).alias("negatives"), "eligible", F.col("margin").alias("integer_margin"), order.alias("initial_order"),
        F.when(both, F.col("margin").cast("double") / classes(now)).alias("point_difference"), F.col("flips").alias("least_flips"), after.cast(WIDE).alias("witness_margin"), (after.cast("double") / classes(then)).alias("witness_difference"), status.alias("status"),
    )
    return report, witnesses
