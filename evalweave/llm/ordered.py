"""Neighbours and running totals in one global order, without sorting all rows in one task.

Rows are dealt by splits of the key into buckets; each bucket is ordered by itself, and only one
row for each bucket (a number that the caller sets) is ordered as a whole.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "__bucket"
#: The largest double, and up to where whole numbers are exact in doubles.
MOST, EXACT = 1.7976931348623157e308, 2**53


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def add_bucket(df: DataFrame, key: str, n: int, tie: str | None = None) -> DataFrame:
    """Adds BUCKET, ascending with ``key``: about ``n`` buckets of like size; null keys come first.

    The splits are quantiles of the whole column, so at most ``n`` numbers reach the driver. An empty table gets
    no split. Equal keys share a bucket; with ``tie``, a key that several quantiles fall on has several, ascending
    with ``tie_hash(tie)``, so that even a key that a third of all rows repeat is spread.
    """
    value = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    found = df.select(value.alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    often = {v: m for v, m in Counter(found).items() if m > 1 and (math.isinf(v) or abs(v) < EXACT)} if tie else {}
    above = [-MOST if math.isinf(v) else math.nextafter(v, math.inf) for v in often]
    splits = [-math.inf, *sorted(set(found + above) - {-math.inf}), math.inf]
    marked = df.withColumn("__key", value)
    if len(splits) < 3:
        return marked.drop("__key").withColumn(BUCKET, F.lit(0))
    bucketizer = Bucketizer(splits=splits, inputCol="__key", outputCol=BUCKET, handleInvalid="keep")
    marked = bucketizer.transform(marked).drop("__key").withColumn(BUCKET, F.col(BUCKET).cast("int"))
    if not often:
        return marked
    parts = [often.get(v, 1) for v in splits[:-1]]
    starts = [sum(parts[:i]) for i in range(len(parts))]
    pick = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col(BUCKET) + 1)
    inside = F.floor((tie_hash(tie) / F.lit(2.0**64) + 0.5) * pick(parts)).cast("int")
    return marked.withColumn(BUCKET, pick(starts) + F.least(inside, pick(parts) - 1))


def tie_hash(tie: str) -> Column:
    return F.xxhash64(tie)
