"""Running totals in one order, spread over ranges of it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Bits of monotonically_increasing_id that count within a partition.
WITHIN = 33


def width(df: DataFrame, ranges: int | None = None) -> int:
    """How many ranges or parts to deal rows into: as many as shuffles have, if not given."""
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_range(df: DataFrame, order: str, ranges: int | None = None, name: str = "__range") -> DataFrame:
    """Adds the number of the range of ``order`` (numeric) that a row falls into; equal values share one."""
    ranges = width(df, ranges)
    found = df.select(F.col(order).cast("double").alias("v")).where("v is not null").approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.5 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    marked = df.withColumn("__order", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    return Bucketizer(splits=splits, inputCol="__order", outputCol=name, handleInvalid="keep").transform(marked).drop("__order")


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join of equal keys in which null equals null, as in the grouping that made the right side."""
    marked = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys])
    return left.join(marked, same).drop(*(f"__same_{k}" for k in keys))


def running_totals(df: DataFrame, keys: list[str], order: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """Adds before_<value>: the sum of ``value`` over rows of the keys with a smaller ``order``.

    ``df`` has one row for each (keys, order). Each range is summed by itself, and the ranges' totals in turn. Null keys are a
    key of their own.
    """
    marked = with_range(df, order, ranges)
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*keys, "__range").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    totals = totals.select(*keys, "__range", *(F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__ahead_{v}") for v in values))
    own = marked.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__inside_{v}") for v in values))
    joined = join_same(own, totals, [*keys, "__range"])
    return joined.select(*df.columns, *((F.col(f"__ahead_{v}") + F.col(f"__inside_{v}")).alias(f"before_{v}") for v in values))


def carried_down(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: list[str] | None = None) -> DataFrame:
    """Adds the last ``value`` that isn't null up to and with each row of its keys, by ``order`` (numeric), then ``ties``: within
    ranges of the order, then from range to range, so a key with most rows is many tasks."""
    marked = with_range(df.withColumn("__entry", F.when(value.isNotNull(), F.struct(F.col(order), *(ties or []), value.alias("__value")))), order)
    upto = Window.partitionBy(*keys, "__range").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy(*keys, "__range").agg(F.max("__entry").alias("__entry")).select(*keys, "__range", F.max("__entry").over(earlier).alias("__before"))
    found = join_same(marked.withColumn("__own", F.max("__entry").over(upto)), ends, [*keys, "__range"])
    return found.select(*df.columns, F.coalesce("__own", "__before")["__value"].alias(name))


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the totals of their keys; without keys the totals are one row."""
    return join_same(rows, totals, keys) if keys else rows.crossJoin(F.broadcast(totals))


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in a total order: a distributed sort, then the partitions' sizes, of which
    there is a row for each partition, are added up."""
    placed = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", WITHIN)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    found = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return found.select(*df.columns, (F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << WITHIN) - 1))).alias(name))


def running_counts(df: DataFrame, order: list[Column], counts: Column, name: str = "before") -> DataFrame:
    """Adds how many rows before each, in a total order of all rows, meet the condition: a distributed sort, running counts
    within its partitions, and the partitions' totals, of which there is a row for each."""
    placed = materialise(df.withColumn("__one", counts.cast("long")).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftrightunsigned("__at", WITHIN))
    totals = placed.groupBy("__part").agg(F.sum("__one").alias("__n"))
    starts = totals.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__one").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.withColumn("__inside", inside).join(F.broadcast(starts), "__part")
    return found.select(*df.columns, (F.col("__start") + F.col("__inside")).alias(name))


def prefix_sums(df: DataFrame, keys: list[str], place: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row. ``place`` numbers the rows of each key densely; blocks of places
    are summed by themselves, and their totals in turn."""
    marked = df.withColumn("__block", F.floor(F.col(place) / block))
    inside = F.sum(value).over(Window.partitionBy(*keys, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    totals = marked.groupBy(*keys, "__block").agg(F.sum(value).alias("__total")).select(*keys, "__block", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    return join_same(marked.withColumn("__inside", inside), totals, [*keys, "__block"]).select(*df.columns, (F.col("__inside") + F.col("__ahead")).alias(name))


def hash_ranks(df: DataFrame, keys: list[str], hashed: Column, tie: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row within its keys by (hash, tie): counted in parts of the hash's range, so a
    key of most rows is spread over as many tasks."""
    parts = width(df, parts)
    marked = df.withColumn("__h", hashed).withColumn("__part", F.least(F.lit(parts - 1), F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * parts).cast("int")))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__h", tie))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = marked.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    return join_same(marked.withColumn("__inside", inside), ahead, [*keys, "__part"]).select(*df.columns, (F.col("__ahead") + F.col("__inside")).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, a column for each point): quantiles with linear interpolation. Equal values are counted first and the counts
    summed in ranges, so neither a group nor a value that many rows repeat is gathered or sorted. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    before = running_totals(counts, keys, "__value", ["__n"])
    rows = with_totals(before, counts.groupBy(*keys).agg(F.sum("__n").alias("__all")), keys)
    place = lambda q: F.lit(float(q)) * (F.col("__all") - 1)
    holds = lambda at: (F.col("before___n") <= at) & (at < F.col("before___n") + F.col("__n"))
    ends = [F.max(F.when(holds(end(place(q))), F.col("__value"))).alias(f"__{name}_{side}") for name, q in points.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    found = rows.groupBy(*keys).agg(F.first("__all").alias("__all"), *ends)
    # low + (high - low) * part, so that equal ends give just that value
    between = lambda name, q: F.col(f"__{name}_low") + (F.col(f"__{name}_high") - F.col(f"__{name}_low")) * (place(q) - F.floor(place(q)))
    return found.select(*keys, *(between(name, q).alias(name) for name, q in points.items()))
