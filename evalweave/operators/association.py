"""Association of binary features with a label, in long form: (sample, feature) rows and a cohort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import running_totals, with_range, with_totals


def presence_counts(calls: DataFrame, cohort: DataFrame, strata: list[str] | None = None) -> DataFrame:
    """(strata, feature, a, b, n_pos, n_neg): samples with the feature by label, and class sizes. Each
    (sample, feature) counts once; strata where a feature is absent have no row."""
    strata = strata or []
    sizes = cohort.groupBy(*strata).agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    counts = calls.select("sample", "feature").distinct().join(cohort, "sample").groupBy(*strata, "feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    if strata:
        return counts.join(sizes, strata)
    return counts.crossJoin(F.broadcast(sizes))  # one row


def all_strata(counts: DataFrame, cohort: DataFrame, strata: list[str]) -> DataFrame:
    """The counts with a row of zeros for each stratum that a feature doesn't occur in."""
    sizes = cohort.groupBy(*strata).agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    grid = counts.select("feature").distinct().crossJoin(F.broadcast(sizes))  # a row for each stratum
    own = counts.select(*strata, "feature", "a", "b")
    return grid.join(own, [*strata, "feature"], "left").fillna(0, ["a", "b"])


def top_features(scored: DataFrame, keys: list[str], score: str, k: int, tie: str = "feature") -> DataFrame:
    """The k best of each key by (score descending, tie ascending) with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bh_fdr(df: DataFrame, keys: list[str], p: str, name: str = "q", ranges: int | None = None) -> DataFrame:
    """Step-up q-values within the keys; rows without p keep null and don't count.

    Equal p have one q, so distinct p are counted first; ranks and the least later step are then taken in ranges
    of p and from range to range, so no key is one task. The rows are read several times, so they are stored first.
    """
    df = materialise(df)
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    ranked = with_totals(running_totals(counts, keys, "__p", ["__n"], ranges), totals, keys)
    steps = with_range(ranked.withColumn("__step", F.col("__p") * F.col("__all") / (F.col("before___n") + F.col("__n"))), "__p", ranges)
    least = F.min("__step").over(Window.partitionBy(*keys, "__range").orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, 0))
    later = Window.partitionBy(*keys).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = steps.groupBy(*keys, "__range").agg(F.min("__step").alias("__least")).select(*keys, "__range", F.min("__least").over(later).alias("__ahead"))
    q = steps.withColumn("__q", least).join(ahead, [*keys, "__range"]).select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), F.col("__p").alias("__value"), F.least(F.lit(1.0), "__q", "__ahead").alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)] + [F.col(p) == F.col("__value")]
    return df.join(q, reduce(lambda a, b: a & b, same), "left").select(*df.columns, name)


def cochran_mantel_haenszel(a: Column, b: Column, n_pos: Column, n_neg: Column) -> list[Column]:
    """Aggregates over strata (a, b: present by label): pooled odds ratio and the statistic, and how many
    strata inform. A stratum informs if both classes occur and the feature is neither absent nor everywhere."""
    n, present = n_pos + n_neg, a + b
    use = (n_pos > 0) & (n_neg > 0) & (present > 0) & (present < n) & (n > 1)
    over = lambda x: F.sum(F.when(use, x))
    n_ = n.cast("double")
    expected = present * n_pos / n_
    variance = present * (n - present) * n_pos.cast("double") * n_neg / (n_ * n_ * (n_ - 1))
    up, down = over(a * (n_neg - b) / n_), over(b * (n_pos - a) / n_)
    return [F.when(down > 0, up / down).alias("pooled_or"), F.when(over(variance) > 0, F.pow(over(a - expected), F.lit(2.0)) / over(variance)).alias("cmh_chi2"), F.sum(F.when(use, 1).otherwise(0)).alias("informative")]


def meta_analysis(rows: DataFrame, keys: list[str], effect: str = "lor", se: str = "se") -> DataFrame:
    """Inverse-variance fixed effect, DerSimonian-Laird tau squared and random effect, Q, I squared."""
    w = 1 / (F.col(se) * F.col(se))
    fixed = rows.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), (F.sum(w * F.col(effect)) / F.sum(w)).alias("fixed"))
    q = rows.join(fixed, keys).groupBy(*keys).agg(F.first("k").alias("k"), F.first("sw").alias("sw"), F.first("sw2").alias("sw2"), F.first("fixed").alias("fixed"), F.sum(w * F.pow(F.col(effect) - F.col("fixed"), F.lit(2.0))).alias("q"))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    q = q.withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0)).withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / F.col("q"))).otherwise(0.0))
    r = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    random = rows.join(q.select(*keys, "tau2"), keys).groupBy(*keys).agg((F.sum(r * F.col(effect)) / F.sum(r)).alias("random"), F.sqrt(1 / F.sum(r)).alias("random_se"))
    return q.join(random, keys).select(*keys, "k", "fixed", F.sqrt(1 / F.col("sw")).alias("fixed_se"), "q", "i2", "tau2", "random", "random_se", (F.col("random") - 1.96 * F.col("random_se")).alias("ci_low"), (F.col("random") + 1.96 * F.col("random_se")).alias("ci_high"))


def pair_counts(calls: DataFrame, split: int = 1000) -> DataFrame:
    """(f, g, n11) for features f < g that occur together, by a self join on the sample. A sample with more than
    ``split`` features is dealt into parts of that size, each of which meets all of its features."""
    sizes = calls.groupBy("sample").agg(F.ceil(F.count("*") / split).cast("int").alias("parts"))
    rows = calls.join(sizes, "sample")
    a = rows.select("sample", F.pmod(F.xxhash64("feature"), F.col("parts")).cast("int").alias("part"), F.col("feature").alias("f"))
    b = rows.select("sample", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("feature").alias("g"))
    return a.join(b, ["sample", "part"]).where("f < g").groupBy("f", "g").agg(F.count("*").alias("n11"))


def phi(n11: Column, na: Column, nb: Column, n: Column) -> Column:
    """Correlation of two binary features, 0 where one does not vary."""
    n11, na, nb, n = (c.cast("double") for c in (n11, na, nb, n))
    spread = na * (n - na) * nb * (n - nb)
    return F.when(spread > 0, (n * n11 - na * nb) / F.sqrt(spread)).otherwise(0.0)
