"""Positions, ranks, quantiles and draws that are counted in parts: against numpy on whole lists."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import association, ordered, resampling
from evalweave.plans import models

RNG = random.Random(4)
DATA = "/root/testdata/sf0.001"


def table(spark, n=400):
    """Half of the rows have one key, and values have many ties."""
    rows = [(i, "hot" if i % 2 else RNG.choice("abc"), RNG.choice([None, 1.0, 2.5, 2.5, float(RNG.randrange(50))])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double").repartition(5)


def test_positions(spark):
    rows, df = table(spark)
    found = ordered.positions(df, [F.col("v").desc_nulls_last(), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert [r.id for r in sorted(found, key=lambda r: r.position)] == [r[0] for r in want]
    assert sorted(r.position for r in found) == list(range(len(rows)))
    assert ordered.positions(df.limit(0), [F.col("id")]).count() == 0


def test_hash_ranks_are_whole(spark):
    rows, df = table(spark)
    found = ordered.hash_ranks(df, ["k"], F.xxhash64("id"), "id", "rank", 7).withColumn("h", F.xxhash64("id")).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.k].append((r.h, r.rank))
    assert all([x[1] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values()) and len(found) == len(rows)


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(spark, keys):
    rows, df = table(spark)
    found = ordered.exact_quantiles(df, keys, "v", {"low": 0.025, "mid": 0.5, "top": 1.0}).collect()
    groups = collections.defaultdict(list)
    for _, k, v in rows:
        if v is not None:
            groups[k if keys else None].append(v)
    assert len(found) == len(groups)
    for r in found:
        assert [r.low, r.mid, r.top] == pytest.approx(np.quantile(groups[r.k if keys else None], [0.025, 0.5, 1.0]).tolist())


def test_pairs_of_split_samples(spark):
    calls = sorted({(RNG.choice([1, 1, 2, 3]), f"f{RNG.randrange(12):02d}") for _ in range(80)})
    df = spark.createDataFrame(calls, "sample long, feature string")
    want = collections.Counter((f, g) for s, f in calls for t, g in calls if s == t and f < g)
    for split in (3, 1000):
        assert {(r.f, r.g): r.n11 for r in association.pair_counts(df, split).collect()} == want


def test_q_values_of_groups(spark):
    rows = [(i, RNG.choice("ab"), RNG.choice([None, RNG.randrange(1, 40) / 40])) for i in range(200)]
    found = {r.i: r.q for r in association.bh_fdr(spark.createDataFrame(rows, "i long, k string, p double"), ["k"], "p", ranges=5).collect()}
    for k in "ab":
        own = sorted((p, i) for i, g, p in rows if g == k and p is not None)
        q, least = {}, 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][0] * len(own) / rank)
            q[own[rank - 1][1]] = least
        assert {i: found[i] for _, i in own} == pytest.approx(q)
    assert all(found[i] is None for i, _, p in rows if p is None) and len(found) == len(rows)


def test_group_folds_are_balanced(spark):
    groups = [(f"g{i:03d}", RNG.randrange(1, 50), RNG.randrange(0, 20)) for i in range(203)]
    found = {r.group: r.fold for r in models.group_folds(spark.createDataFrame(groups, "group string, n long, positives long"), 5).collect()}
    assert set(found) == {g for g, _, _ in groups} and set(found.values()) == set(range(5))
    positives = [sum(p for g, _, p in groups if found[g] == f) for f in range(5)]
    assert max(positives) - min(positives) <= 40



def test_random_rows_and_samples(spark):
    rows, df = table(spark)
    got = resampling.random_rows(df, 9, "id", 3).select("id").collect()
    order = [r.id for r in df.select("id", F.xxhash64(F.lit(3), "id").alias("h")).orderBy("h", "id").collect()]
    assert [r.id for r in got] == order[:9]
    kept = resampling.stratified_sample(df, "k", 40, "id", 3).collect()
    size = collections.Counter(k for _, k, _ in rows)
    assert len(kept) == 40 and all(abs(n - 40 * size[k] / len(rows)) < 1 for k, n in collections.Counter(r.k for r in kept).items())
