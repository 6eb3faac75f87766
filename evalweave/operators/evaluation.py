"""Metrics of fixed predictions: by counts, by rank, by fold and group, and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .ordered import running_totals, with_totals


def count_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """Confusion counts and their rates for each group."""
    w = F.col(weight) if weight else None
    counts = df.groupBy(*keys).agg(*stats.confusion(F.col(y), F.col(pred), w))
    return counts.select("*", *(c.alias(n) for n, c in stats.metrics(*(F.col(c) for c in ("tp", "fn", "tn", "fp"))).items()))


def by_score(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """(keys, score, pos, neg): one row for each distinct score; rows without weight drop out."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    rows = df.where(F.col(weight) > 0) if weight else df
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg"))


def rank_metrics(df: DataFrame, keys: list[str], y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """AUROC, with ties worth a half, and step-wise average precision; null without both classes (positives).

    Scores are counted once each before anything is ordered, and the running totals are spread over ranges.
    """
    before = running_totals(by_score(df, keys, y, score, weight), keys, "score", ["pos", "neg"])
    totals = before.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = with_totals(before, totals, keys)
    above_pos, above_neg = F.col("P") - F.col("before_pos"), F.col("N") - F.col("before_neg")  # at this score or above
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    precision = F.sum(F.when(F.col("pos") > 0, F.col("pos") * above_pos.cast("double") / (above_pos + above_neg)).otherwise(0.0))
    found = rows.groupBy(*keys).agg(F.first("P").alias("P"), F.first("N").alias("N"), wins.alias("wins"), precision.alias("sum"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return found.select(*keys, F.col("P").alias("positives"), F.col("N").alias("negatives"), F.when(both, F.col("wins") / (F.col("P") * F.col("N"))).alias("auroc"), F.when(F.col("P") > 0, F.col("sum") / F.col("P")).alias("ap"))


def curve_points(df: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """(keys, score, tp, fp, fn, tn) when every score from this one on is called positive."""
    before = running_totals(by_score(df, keys, y, score), keys, "score", ["pos", "neg"])
    totals = before.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = with_totals(before, totals, keys)
    return rows.select(*keys, "score", (F.col("P") - F.col("before_pos")).alias("tp"), (F.col("N") - F.col("before_neg")).alias("fp"), F.col("before_pos").alias("fn"), F.col("before_neg").alias("tn"))


def losses(y: Column, p: Column) -> tuple[Column, Column]:
    """Brier score and log loss (probabilities kept 1e-15 from 0 and 1) as aggregates."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.avg((p - y) * (p - y)), -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def paired_gap(df: DataFrame, keys: list[str], role: str, first: str, second: str, values: list[str]) -> DataFrame:
    """For each key the values of two rows, and second minus first."""
    a, b = (df.where(F.col(role) == r).select(*keys, *(F.col(v).alias(f"{v}_{tag}") for v in values)) for r, tag in ((first, "a"), (second, "b")))
    return a.join(b, keys).select(*keys, *(F.col(f"{v}_a") for v in values), *(F.col(f"{v}_b") for v in values), *((F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_delta") for v in values))


def calibration_table(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", p: str = "score") -> DataFrame:
    """Equal-width bins, closed on the right (the first on both sides): size, mean score, rate, gap."""
    number = F.greatest(F.lit(1), F.ceil(F.col(p) * bins)).cast("int")
    return df.withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("rate")).withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_fit(df: DataFrame, y: str = "y", p: str = "score", steps: int = 25) -> tuple[float, float] | tuple[None, None]:
    """Intercept and slope of a logistic refit on the logit of p, by Newton steps of one aggregate each. Neither is defined, and both
    are None, without rows, with one class, one distinct score, or classes that a score separates."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.select(F.log(q / (1 - q)).alias("x"), F.col(y).cast("double").alias("y")).groupBy("x").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).cache()
    a, b = 0.0, 0.0
    try:
        for _ in range(steps):
            m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
            w = F.col("n") * m * (1 - m)
            r = rows.agg(F.sum(F.col("pos") - F.col("n") * m).alias("g0"), F.sum((F.col("pos") - F.col("n") * m) * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11")).first()
            det = (r.h00 or 0.0) * (r.h11 or 0.0) - (r.h01 or 0.0) ** 2
            if not det > 1e-12 * (r.h00 or 0.0) * (r.h11 or 0.0):
                return None, None
            da, db = (r.h11 * r.g0 - r.h01 * r.g1) / det, (r.h00 * r.g1 - r.h01 * r.g0) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-12:
                break
    finally:
        rows.unpersist()
    return a, b
