"""Queries without SQL work on all samples and features: against plain loops."""

import collections
import itertools
import math

import pyarrow.parquet as pq
import pytest

from evalweave.plans import aggregates, joins


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Orders with ids beyond any prefix, and brands of which most sort after 'Brand#2'."""
    brands = ["Brand#11", "Brand#21", "Brand#32", "Brand#43", "Brand#55"]
    spark.createDataFrame(list(enumerate(brands)), "p_partkey long, p_brand string").toPandas().to_parquet(tmp_path / "part.parquet")
    ids = range(100, 9000, 100)
    lines = [(i, p) for i in ids for p in range(5) if i // 100 % (p + 2) == 0 or (p == 4 and i // 100 % 5 == 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").toPandas().to_parquet(tmp_path / "lineitem.parquet")
    spark.createDataFrame([(i, "F" if i % 300 else "O", "1") for i in ids], "o_orderkey long, o_orderstatus string, o_orderpriority string").toPandas().to_parquet(tmp_path / "orders.parquet")
    return f"{tmp_path}"


def tables(sf_dir):
    name = dict(enumerate(pq.read_table(f"{sf_dir}/part.parquet")["p_brand"].to_pylist()))
    have = collections.defaultdict(set)
    for r in pq.read_table(f"{sf_dir}/lineitem.parquet").to_pylist():
        have[name[r["l_partkey"]]].add(r["l_orderkey"])
    label = {r["o_orderkey"]: r["o_orderstatus"] == "F" for r in pq.read_table(f"{sf_dir}/orders.parquet").to_pylist()}
    return have, label


def test_fisher_exact_counts_every_sample(spark, sf_dir):
    have, label = tables(sf_dir)
    found = {r.feature: (r.a, r.b) for r in aggregates.fisher_exact(spark, sf_dir).collect()}
    assert found == {f: (sum(label[s] for s in x), sum(not label[s] for s in x)) for f, x in have.items()}


def test_threshold_components_have_every_feature(spark, sf_dir):
    have, _ = tables(sf_dir)
    n = len(set().union(*have.values()))
    group = {f: {f} for f in have}
    for f, g in itertools.combinations(have, 2):
        a, b, both = len(have[f]), len(have[g]), len(have[f] & have[g])
        if both and abs((n * both - a * b) / math.sqrt(a * (n - a) * b * (n - b))) >= 0.05:
            merged = group[f] | group[g]
            for x in merged:
                group[x] = merged
    want = sorted(len(x) for x in {min(x): x for x in group.values()}.values())
    assert sorted(r["size"] for r in joins.threshold_components(spark, sf_dir).collect()) == want and sum(want) == 5


def test_pairs_of_one_block_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from evalweave.plans import joins

    monkeypatch.setattr(joins, "BLOCK_ROWS", 30, raising=False)
    monkeypatch.setattr(joins, "PAIRS_IN_TASK", 1000.0, raising=False)
    rows = spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit("red green").alias("p_name"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    by = joins.pair_self_join(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by) == 300 * 299 // 2 and len(by) > 4 and max(r["count"] for r in by) < 300 * 299 // 4
