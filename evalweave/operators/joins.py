"""Joins with gates: provenance, cardinality, identity firewalls, snapshot differences, nearest features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .gates import GateError, assert_empty

#: Which sides of a join must have unique keys.
CARDINALITIES = {"one_to_one": (True, True), "one_to_many": (True, False), "many_to_one": (False, True), "many_to_many": (False, False)}


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join whose named sides are checked for repeated keys first."""
    if validate not in CARDINALITIES:
        raise GateError(f"unknown cardinality {validate}")
    for side, name, unique in zip((left, right), ("left", "right"), CARDINALITIES[validate], strict=True):
        if unique:
            assert_empty(repeated(side, keys), f"{name} keys repeat in a {validate} join")
    return left.join(right, keys, how)


def with_provenance(left: DataFrame, right: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """The join with a column ``_side``: both, left_only or right_only."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, how)
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return joined.withColumn("_side", side).drop("__l", "__r")


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """A join whose common other columns get the suffixes."""
    common = {c for c in left.columns if c in right.columns and c not in keys}
    rename = lambda df, s: df.withColumnsRenamed({c: c + s for c in common})
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), keys, how)


def known(col: Column) -> Column:
    """Whether an identity is given: neither null nor blank."""
    return col.isNotNull() & (F.trim(col.cast("string")) != "")


def firewall(external: DataFrame, internal: DataFrame, row_id: str, identities: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``external`` with ``reasons``: names of the identities that some internal row shares, sorted, null if none.

    Each identity is an equi-join of its own, and hits are gathered by row; blank identities never match.
    """
    hits = []
    for name, (own, theirs) in identities.items():
        reference = internal.where(known(theirs)).select(theirs.cast("string").alias("__v")).distinct()
        hits.append(external.where(known(own)).select(row_id, own.cast("string").alias("__v")).join(reference, "__v", "left_semi").select(row_id, F.lit(name).alias("__reason")))
    reasons = reduce(DataFrame.unionByName, hits).groupBy(row_id).agg(F.array_join(F.array_sort(F.collect_set("__reason")), ";").alias("reasons"))
    return external.join(reasons, row_id, "left")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of either snapshot with their value sets and how they compare.

    same: equal sets; reversal: both sides have one of R and S, the opposite ones; non_sir: a side has
    values other than S, I and R only; other: anything else; old_only and new_only.
    """
    pack = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))
    both = pack(old, "old_set").join(pack(new, "new_set"), keys, "full")
    return both.withColumn("status", set_comparison(F.col("old_set"), F.col("new_set")))


def set_comparison(old: Column, new: Column) -> Column:
    sir = F.array(F.lit("S"), F.lit("I"), F.lit("R"))
    plain = lambda c: F.size(F.array_except(c, sir)) == 0
    has = lambda c, v: F.array_contains(c, v)
    only = lambda c, v, w: has(c, v) & ~has(c, w)
    reversal = only(old, "R", "S") & only(new, "S", "R") | only(old, "S", "R") & only(new, "R", "S")
    return F.when(old.isNull(), "new_only").when(new.isNull(), "old_only").when(old == new, "same").when(~plain(old) | ~plain(new), "non_sir").when(reversal, "reversal").otherwise("other")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", parts: int = 256) -> DataFrame:
    """A join in which a key with many rows of ``left`` is dealt over ``parts`` tasks by a hash of ``spread``.

    Hot is a key with more than a ``parts``-th of the left rows, so there are fewer than ``parts`` of them: only these are
    broadcast, and only their right rows are repeated. ``how``: inner or left.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = counts.join(F.broadcast(total), F.col("__n") * parts > F.col("__all")).select(*on, F.lit(True).alias("__hot"))  # one row
    hot = F.broadcast(materialise(hot))  # fewer than ``parts`` rows
    dealt = left.join(hot, on, "left").withColumn("__deal", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    met = right.join(hot, on, "left").withColumn("__deal", F.explode(every)).drop("__hot")
    return dealt.join(met, [*on, "__deal"], how).drop("__deal")


def ambiguity(candidates: list[DataFrame], record: str, target: str) -> DataFrame:
    """(record, targets, n): what several routes link each record to; a sound link has n = 1."""
    routes = reduce(DataFrame.unionByName, [c.select(record, target) for c in candidates])
    return routes.groupBy(record).agg(F.array_sort(F.collect_set(target)).alias("targets")).withColumn("n", F.size("targets"))


def as_of(queries: DataFrame, history: DataFrame, keys: list[str], at: str, since: str, ties: list[str], buckets: str = "month") -> DataFrame:
    """Each query with the latest earlier history row of its keys as ``found`` (null without one).

    Within calendar buckets a running maximum finds it, and the buckets' own maxima are carried on, so a key
    with most of the rows is spread over its buckets.
    """
    cols = [c for c in history.columns if c not in keys and c != since]
    packed = F.struct(F.col(since), *(F.col(c) for c in ties), *(F.col(c) for c in cols if c not in ties))
    events = history.select(*keys, F.col(since).alias("__t"), packed.alias("__h"), F.lit(None).cast(queries.select(F.struct(*queries.columns)).schema[0].dataType).alias("__q"))
    asked = queries.select(*keys, F.col(at).alias("__t"), F.lit(None).cast(events.schema["__h"].dataType).alias("__h"), F.struct(*queries.columns).alias("__q"))
    rows = events.unionByName(asked).withColumn("__b", F.date_trunc(buckets, F.col("__t"))).withColumn("__n", F.unix_micros(F.col("__t").cast("timestamp")))
    near = F.max("__h").over(Window.partitionBy(*keys, "__b").orderBy("__n").rangeBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("__near", near).where("__q is not null")
    spans = rows.groupBy(*keys, "__b").agg(F.max("__h").alias("__last"))
    carried = spans.select(*keys, "__b", F.max("__last").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    return found.join(carried, [*keys, "__b"]).select("__q.*", F.coalesce("__near", "__carried").alias("found"))
