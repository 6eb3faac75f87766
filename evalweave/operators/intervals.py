"""Interval joins whose work grows with the rows and the pairs that they give, not with the rows of a key squared.

Overlaps are found by rank. Of two intervals that overlap, the one that starts later starts inside the other, so an
interval's partners are a run of neighbours in the order of all starts: two places in that order say which. Such a run is cut
into power-of-two nodes (aligned, at most two of a size), every start names the nodes above it, and node and
start meet in an equi-join: each pair once, and no pair that doesn't overlap.

The nearest interval is a pair of look-ups in the same order: the greatest end among intervals that start up to a query's end,
and the least start after it, as running extremes within ranges of positions and then from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import spread_join
from .ordered import running_counts, with_range

#: Levels of nodes: the largest has 2^TOP starts, so a node never gathers more. Longer runs have more nodes, as they have more pairs.
TOP = 12
#: Buckets that contigs are hashed to, and the rows up to which a bucket's contigs are looked up in one task each.
BUCKETS, SMALL = 1 << 16, 100_000


def endpoints(lo: Column, hi: Column, lo_closed: Column, hi_closed: Column) -> tuple[Column, Column]:
    """Both ends as (value, side) in one order: an open lower end is just above its value, an open upper end just
    below. Null ends are unbounded."""
    low = F.struct(F.coalesce(lo.cast("double"), F.lit(float("-inf"))).alias("value"), F.when(lo.isNull() | lo_closed, 0).otherwise(1).alias("side"))
    high = F.struct(F.coalesce(hi.cast("double"), F.lit(float("inf"))).alias("value"), F.when(hi.isNull() | hi_closed, 0).otherwise(-1).alias("side"))
    return low, high


def run_nodes(first: Column, end: Column) -> Column:
    """The nodes (level, node) that make up the places first .. end - 1."""
    parts = []
    for level in range(TOP):
        left, right = F.ceil(first / (1 << level)), F.floor(end / (1 << level))
        odd_left = (left < right) & (left % 2 == 1)
        odd_right = (F.when(odd_left, left + 1).otherwise(left) < right) & (right % 2 == 1)
        node = lambda here, at, level=level: F.when(here, F.array(F.struct(F.lit(level).alias("level"), at.cast("long").alias("node"))))
        parts += [node(odd_left, left), node(odd_right, right - 1)]
    left, right = F.ceil(first / (1 << TOP)).cast("long"), F.floor(end / (1 << TOP)).cast("long")
    whole = F.when(left < right, F.transform(F.sequence(left, right - 1), lambda at: F.struct(F.lit(TOP).alias("level"), at.alias("node"))))
    return F.flatten(F.filter(F.array(*parts, whole), lambda p: p.isNotNull()))


def members(runs: DataFrame, places: DataFrame, run_id: str, place_id: str) -> DataFrame:
    """(run_id, place_id) for every place of each run. ``runs``: (run_id, first, end), ``places``: (place_id, place)."""
    left = runs.where("first < end").select(run_id, F.explode(run_nodes(F.col("first"), F.col("end"))).alias("n")).select(run_id, "n.level", "n.node")
    levels = F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("place", i).alias("node")) for i in range(TOP + 1)))
    right = places.select(place_id, F.explode(levels).alias("n")).select(place_id, "n.level", "n.node")
    return spread_join(left, right, ["level", "node"], run_id).select(run_id, place_id)


def _runs(a: DataFrame, b: DataFrame, keys: list[str], after: bool) -> tuple[DataFrame, DataFrame]:
    """For each interval of ``a`` the run of starts of ``b`` in it (only those after its own start if ``after``), and the places
    of ``b``'s starts."""
    side = lambda df, value, kind, end: df.select(*keys, F.col(value).alias("at"), F.lit(kind).alias("kind"), F.lit(end).alias("side"), "id")
    # starts of b have kind 1 and count for what comes later: an end of a counts starts equal to it, a start of a only if ``after``
    rows = side(b, "low", 1, "start").unionByName(side(a, "low", 2 if after else 0, "low")).unionByName(side(a, "high", 2, "high"))
    counted = running_counts(rows, [*(F.col(k) for k in keys), F.col("at"), F.col("kind"), F.col("side"), F.col("id")], F.col("side") == "start", "before")
    ends = counted.where("side <> 'start'").groupBy("id").agg(F.max(F.when(F.col("side") == "low", F.col("before"))).alias("first"), F.max(F.when(F.col("side") == "high", F.col("before"))).alias("end"))
    return ends, counted.where("side = 'start'").select("id", F.col("before").alias("place"))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): ids of the intervals of equal keys that overlap. Both tables: keys, id (unique), low, high as ``endpoints`` gives
    them. Empty intervals and null keys overlap nothing."""
    a, b = (df.where(F.col("low") <= F.col("high")).dropna(subset=keys).select(*keys, "id", "low", "high") for df in (a, b))
    runs, places = _runs(a, b, keys, after=False)
    first = members(runs.withColumnRenamed("id", "a"), places.withColumnRenamed("id", "b"), "a", "b")
    runs, places = _runs(b, a, keys, after=True)
    return first.unionByName(members(runs.withColumnRenamed("id", "b"), places.withColumnRenamed("id", "a"), "b", "a").select("a", "b"))


def self_overlaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b), a < b: ids of the intervals of one table that overlap, each pair once. ``df`` as in ``overlap_join``."""
    rows = df.where(F.col("low") <= F.col("high")).dropna(subset=keys).select(*keys, "id", "low", "high")
    starts = rows.select(*keys, F.col("low").alias("at"), F.lit(1).alias("kind"), "id")
    ends = rows.select(*keys, F.col("high").alias("at"), F.lit(2).alias("kind"), "id")
    order = [*(F.col(k) for k in keys), F.col("at"), F.col("kind"), F.col("id")]
    counted = running_counts(starts.unionByName(ends), order, F.col("kind") == 1, "before")
    # partners are the starts after one's own, up to one's end
    runs = counted.groupBy("id").agg((F.max(F.when(F.col("kind") == 1, F.col("before"))) + 1).alias("first"), F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("end"))
    places = counted.where("kind = 1").select(F.col("id").alias("y"), F.col("before").alias("place"))
    return members(runs.withColumnRenamed("id", "x"), places, "x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def gap_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Positions between two closed ranges, 0 where they overlap or touch."""
    return F.greatest(F.lit(0), b0 - a1 - 1, a0 - b1 - 1)


def nearest(queries: DataFrame, features: DataFrame, on: list[str], small: int = SMALL) -> DataFrame:
    """(id, q0, q1, on, feature, s0, s1, distance): for each query of whole positions q0..q1 the feature s0..s1 of its contig with
    the least ``gap_distance``; queries of a contig without features are left out.

    ``queries``: on, id, q0, q1; ``features``: on, feature, s0, s1. Of several that are as near, those that start up to
    the query's end (and one) go before later ones; of the former the one with the greatest end, then the least
    feature, of the latter the least feature. Nulls in any of these columns, and ranges that end before they start, drop out.

    Contigs of hash buckets with up to ``SMALL`` rows are shuffled once and looked up as they are. In the others features are reduced to one
    for each start, queries to one point for each end, before any window, so positions that many rows share aren't hot; ranges of
    positions keep a contig with most rows from being one task.
    """
    queries = queries.select(*on, "id", "q0", "q1").dropna().where("q0 <= q1").withColumn("__bucket", F.pmod(F.xxhash64(*on), F.lit(BUCKETS)))
    features = features.select(*on, "feature", "s0", "s1").dropna().where("s0 <= s1").withColumn("__bucket", F.pmod(F.xxhash64(*on), F.lit(BUCKETS)))
    sizes = queries.select("__bucket").unionByName(features.select("__bucket")).groupBy("__bucket").agg(F.count("*").alias("n"))
    large = [r[0] for r in sizes.where(F.col("n") > small).select("__bucket").collect()]  # at most BUCKETS numbers
    if not large:
        return _nearest_small(queries, features, on)
    marks = queries.sparkSession.createDataFrame([(b,) for b in large], "__bucket long")
    split = lambda df, how: df.join(F.broadcast(marks), "__bucket", how)
    found = _nearest_large(split(queries, "left_semi").drop("__bucket"), split(features, "left_semi").drop("__bucket"), on)
    return found.unionByName(_nearest_small(split(queries, "left_anti"), split(features, "left_anti"), on))


def _nearest_small(queries: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """As ``nearest``: features and points of a contig in one order, with running extremes over the whole contig."""
    none = lambda df, names: {c: F.lit(None).cast(df.schema[c].dataType) for c in names}
    starts = features.select(*on, F.col("s0").cast("long").alias("at"), F.lit(0).alias("kind"), "feature", "s0", "s1").withColumns(none(queries, ("id", "q0", "q1")))
    points = queries.select(*on, (F.col("q1") + 1).cast("long").alias("at"), F.lit(1).alias("kind"), "id", "q0", "q1").withColumns(none(features, ("feature", "s0", "s1")))
    rows = starts.unionByName(points)
    is_start = lambda c: F.when(F.col("kind") == 0, c)
    up = Window.partitionBy(*on).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on).orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before = is_start(F.struct((-F.col("s1")).alias("end"), "feature", "s0", "s1"))
    found = rows.withColumn("before", F.min(before).over(up)).withColumn("after", F.min(is_start(F.struct("s0", "feature", "s1"))).over(down))
    return _judged(found.where("kind = 1"), on)


def _nearest_large(queries: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """As ``nearest``, by ranges of positions."""
    before = F.struct((-F.col("s1")).alias("end"), "feature", "s0", "s1")  # the least is the best
    after = F.struct("s0", "feature", "s1")
    starts = features.groupBy(*on, F.col("s0").alias("at")).agg(F.min(before).alias("before"), F.min(after).alias("after")).withColumn("kind", F.lit(0))
    none = {c: F.lit(None).cast(starts.schema[c].dataType) for c in ("before", "after")}
    points = queries.select(*on, (F.col("q1") + 1).alias("at")).distinct().withColumns(none).withColumn("kind", F.lit(1))
    rows = with_range(starts.unionByName(points), "at")
    up = Window.partitionBy(*on, "__range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on, "__range").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("up", F.min("before").over(up)).withColumn("down", F.min("after").over(down)).where("kind = 1")
    ranges = rows.groupBy(*on, "__range").agg(F.min("before").alias("before"), F.min("after").alias("after"))  # a row for each contig and range
    over = Window.partitionBy(*on).orderBy("__range")
    ranges = ranges.select(*on, "__range", F.min("before").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.min("after").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("upper"))
    found = near.join(ranges, [*on, "__range"]).select(*on, "at", F.least("up", "lower").alias("before"), F.least("down", "upper").alias("after"))
    return _judged(spread_join(queries.withColumn("at", F.col("q1") + 1), found, [*on, "at"], "id"), on)


def _judged(asked: DataFrame, on: list[str]) -> DataFrame:
    """Of the candidates on both sides the nearer."""
    left = F.when(F.col("before").isNotNull(), gap_distance(F.col("q0"), F.col("q1"), F.col("before.s0"), F.col("before.s1")))
    right = F.when(F.col("after").isNotNull(), gap_distance(F.col("q0"), F.col("q1"), F.col("after.s0"), F.col("after.s1")))
    use_left = left.isNotNull() & (right.isNull() | (left <= right))
    pick = lambda name: F.when(F.col("use_left"), F.col(f"before.{name}")).otherwise(F.col(f"after.{name}"))
    judged = asked.where("before is not null or after is not null").withColumn("use_left", use_left).withColumn("distance", F.least(left, right))
    return judged.select("id", "q0", "q1", *on, pick("feature").alias("feature"), pick("s0").alias("s0"), pick("s1").alias("s1"), "distance")

