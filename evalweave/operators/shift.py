"""How sources differ: label-free anomaly scores, associations of features with a source, and a classifier of sources.

A source is always compared with all others. What the others hold is what all hold less what the source holds, so sparse counts by
source and their totals are enough, whatever the number of sources; what a source has nothing of is added up from the totals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..session import materialise
from .association import bh_fdr
from .ordered import positions

#: Weights of the three parts of the anomaly score; equal-width bins of the model's score.
WEIGHTS, BINS = {"score": 0.4, "family": 0.4, "gene": 0.2}, 10
#: From which q and which difference of prevalence on a feature marks a source.
MARKER_Q, MARKER_SHIFT = 0.01, 0.20


def source_anomaly(df: DataFrame, genes: dict[str, Column], source: str = "source", score: str = "p", family: str = "family", least_n: int = 10) -> DataFrame:
    """(source, n, score_js, family_js, gene_gap, anomaly, eligible, rank) for each source against all others.

    Divergences (in bits) of the binned scores and of the families, and the mean difference of the genes' prevalences; ranked
    by the weighted sum, ties by name. Null scores and families are cells of their own; a null gene is absent. Labels aren't read. With
    one source there is nothing to compare: its figures are null.
    """
    cell = lambda part, value: F.struct(F.lit(part).alias("part"), value.cast("string").alias("cell"))
    bin_ = F.least(F.lit(BINS - 1), F.floor(F.col(score) * BINS))
    parts = [cell("score", F.coalesce(bin_.cast("string"), F.lit(""))), cell("family", F.coalesce(F.concat(F.lit("="), F.col(family).cast("string")), F.lit("")))]
    parts += [F.when(has, cell("gene", F.lit(name))) for name, has in genes.items()]
    name = F.coalesce(F.col(source), F.lit(""))
    counts = df.select(name.alias("source"), F.explode(F.array_compact(F.array(*parts))).alias("c")).groupBy("source", "c.part", "c.cell").agg(F.count("*").alias("own"))
    sizes = df.groupBy(name.alias("source")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("part", "cell").agg(F.sum("own").alias("all"))
    whole = totals.agg(F.coalesce(F.sum(F.when(F.col("part") == "gene", F.col("all"))), F.lit(0)).alias("genes_all")).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("whole_n"))))  # one row each
    rest = F.col("whole_n") - F.col("n")
    rows = counts.join(totals, ["part", "cell"]).join(sizes, "source").crossJoin(F.broadcast(whole))  # one row
    p, q = F.col("own") / F.col("n"), (F.col("all") - F.col("own")) / F.nullif(rest, F.lit(0))
    # a cell that the source has none of adds half of its share elsewhere, and these shares add up to 1 with the others
    js = lambda part: F.sum(F.when(F.col("part") == part, stats.jensen_shannon(p, q) - q / 2)) + 0.5
    gap = (F.coalesce(F.sum(F.when(F.col("part") == "gene", F.abs(p - q) - F.col("all") / F.nullif(rest, F.lit(0)))), F.lit(0.0)) + F.first("genes_all") / F.nullif(F.first(rest), F.lit(0))) / max(1, len(genes))
    found = rows.groupBy("source").agg(F.first("n").alias("n"), js("score").alias("score_js"), js("family").alias("family_js"), gap.alias("gene_gap"))
    whole_score = sum((F.col(c) * WEIGHTS[w] for w, c in (("score", "score_js"), ("family", "family_js"), ("gene", "gene_gap"))), F.lit(0.0))
    found = found.withColumn("anomaly", whole_score).withColumn("eligible", F.col("n") >= least_n)
    return positions(found, [F.round("anomaly", 12).desc_nulls_last(), F.col("source")], "rank").withColumn("rank", F.col("rank") + 1)


def source_associations(calls: DataFrame, cohort: DataFrame) -> DataFrame:
    """(source, feature, present, absent, other_present, other_absent, prevalence, other_prevalence, shift, p, q, marker): every
    feature's presence within each source against all others, Fisher's test, q-values within the source.

    ``calls``: (sample, feature), ``cohort``: (sample, source). Features that a source has none of are there with zeros. The table has a row for
    each source and feature; sizes are broadcast, a row for each source.
    """
    sizes = cohort.groupBy("source").agg(F.count("*").alias("n"))
    own = calls.select("sample", "feature").distinct().join(cohort, "sample").groupBy("source", "feature").agg(F.count("*").alias("present"))
    totals = own.groupBy("feature").agg(F.sum("present").alias("all"))
    rows = totals.crossJoin(F.broadcast(sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("whole_n")))))).join(own, ["source", "feature"], "left").fillna(0, ["present"])
    a, c = F.col("present"), F.col("all") - F.col("present")
    b, d = F.col("n") - a, F.col("whole_n") - F.col("n") - c
    rows = rows.select("source", "feature", a.alias("present"), b.alias("absent"), c.alias("other_present"), d.alias("other_absent"))
    rows = rows.withColumn("prevalence", stats.ratio(F.col("present").cast("double"), F.col("present") + F.col("absent"))).withColumn("other_prevalence", stats.ratio(F.col("other_present").cast("double"), F.col("other_present") + F.col("other_absent")))
    rows = rows.withColumn("shift", F.col("prevalence") - F.col("other_prevalence")).withColumn("p", stats.fisher_exact("present", "absent", "other_present", "other_absent"))
    return bh_fdr(rows, ["source"], "p").withColumn("marker", (F.col("q") <= MARKER_Q) & (F.abs("shift") >= MARKER_SHIFT))


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int, fold: str = "fold") -> DataFrame:
    """The rows of every fold as the model of all others predicts them. ``fit`` takes the training rows and gives a function that
    adds predictions. One model for each fold, a number set by the caller."""
    parts = []
    for k in range(folds):
        predict = fit(rows.where(F.col(fold) != k))
        parts.append(predict(rows.where(F.col(fold) == k)))
    return reduce(DataFrame.unionByName, parts)


def balanced_classes(rows: DataFrame, label: str = "label", n: str | None = None) -> DataFrame:
    """Adds ``weight``: what makes all classes weigh the same, a row for each class is broadcast. A row stands for ``n`` equal ones."""
    times = F.col(n) if n else F.lit(1)
    counts = rows.groupBy(label).agg(F.sum(times).alias("__c"))
    whole = counts.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    weights = counts.crossJoin(F.broadcast(whole)).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("__w"))
    return rows.join(F.broadcast(weights), label).withColumn("weight", F.col("__w") * times).drop("__w")


def source_classifier(rows: DataFrame, folds: int = 5, reg: float = 0.01) -> DataFrame:
    """``rows`` (label, features, fold) with out-of-fold ``predicted``: a multinomial model with balanced classes for each fold.

    The fold must hold whole groups where samples of a group are alike; a class that a training part lacks is never predicted for it. Rows with
    equal label and features count as one of their number's weight, so a pass grows with the kinds of rows, not with the rows, and
    ``features`` are the predictions' keys: each kind is predicted once for a fold.
    """
    from pyspark.ml.classification import LogisticRegression

    kinds = materialise(rows.groupBy("fold", "label", "features").agg(F.count("*").alias("__n")))

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        alike = train.groupBy("label", "features").agg(F.sum("__n").alias("__n"))
        model = LogisticRegression(labelCol="label", weightCol="weight", family="multinomial", regParam=reg, maxIter=100).fit(balanced_classes(alike, n="__n"))
        return lambda test: model.transform(test.select("fold", "features").distinct()).select("fold", "features", F.col("prediction").alias("predicted"))

    return rows.join(out_of_fold(kinds, fit, folds), ["fold", "features"]).select(*rows.columns, "predicted")


def recall_table(predicted: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, label, n, recall, balanced_accuracy): the last is the mean recall over the classes of a key."""
    by = predicted.groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("recall"))
    return by.withColumn("balanced_accuracy", F.avg("recall").over(Window.partitionBy(*keys)))  # a row for each class
