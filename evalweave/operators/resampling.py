"""Cluster bootstrap by multiplicities that are made where they are used, and seeded sampling by hash.

A draw of the cluster bootstrap picks G groups of G with replacement, so the groups' multiplicities are one multinomial.
No table of (draw, group) is ever made. The G picks of all draws are split down a binary tree over the groups' numbers, each node by
a binomial with a seed of its own, so any task can make the multiplicities of any run of groups for all draws at once, and gets the
same ones. Groups with equal cells are alike for every metric of the cells: only their number counts, so they are one type, a run of
numbers whose multiplicities are needed as a sum. A million rows without a group of their own are then a few dozen types.

Tasks add up multiplicity times count for all draws in arrays, blocks of draws are merged in a second step, and only then metrics are
taken, draw by draw.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialise
from .ordered import hash_ranks, positions, prefix_sums

#: Draws that are merged together, and nodes of the tree that a task remembers.
BLOCK, KEPT = 500, 256


def own_group(group: Column, row_id: Column) -> Column:
    """The group, or a block of the row's own where it is unknown."""
    return F.coalesce(F.when(F.trim(group) != "", group), F.concat(F.lit("UNRESOLVED::"), row_id.cast("string")))


class Multiplicities:
    """How often the groups of a run of numbers are picked, in each of ``draws`` draws of ``groups`` picks of ``groups`` groups."""

    def __init__(self, groups: int, draws: int, seed: int):
        self.groups, self.draws, self.seed = groups, draws, seed
        self.height = max(0, groups - 1).bit_length()
        self.known: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def _size(self, level: int, node: int) -> int:
        """How many groups lie below a node that covers 2^level numbers."""
        return max(0, min(self.groups, (node + 1) << level) - (node << level))

    def node(self, level: int, node: int) -> np.ndarray:
        if level == self.height:
            return np.full(self.draws, self.groups, np.int64)
        found = self.known.pop((level, node), None)
        if found is None:
            above = self.node(level + 1, node >> 1)
            left, whole = self._size(level, node & ~1), self._size(level + 1, node >> 1)
            picked = above if left == whole else np.random.default_rng([self.seed, level, node >> 1]).binomial(above, left / whole)
            found = picked if node & 1 == 0 else above - picked
        self.known[level, node] = found
        if len(self.known) > KEPT:
            self.known.popitem(last=False)
        return found

    def run(self, first: int, n: int) -> np.ndarray:
        """The sum over groups first .. first + n - 1, from the fewest nodes."""
        total, left, right = np.zeros(self.draws, np.int64), first, first + n
        level = 0
        while left < right:
            if level == self.height:
                return total + self.node(level, 0)
            if left & 1:
                total += self.node(level, left)
                left += 1
            if right & 1 and left < right:
                right -= 1
                total += self.node(level, right)
            left, right, level = left >> 1, right >> 1, level + 1
        return total


def group_types(cells: DataFrame, cell: list[str], counts: list[str]) -> DataFrame:
    """(cells, first, n): types of groups with the same cells, as runs of group numbers in an order of their hash.

    ``cells``: group, the ``cell`` columns, whole-number ``counts``, one row for each (group, cell). A group has as many entries
    as there are cells, a number that the design sets (folds times models).
    """
    own = F.array_sort(F.collect_list(F.struct(*cell, *counts)))
    types = cells.groupBy("group").agg(own.alias("cells")).groupBy("cells").agg(F.count("*").alias("n"))
    placed = materialise(positions(types, [F.xxhash64("cells"), F.col("cells")], "at"))
    return prefix_sums(placed, [], "at", "n", "upto").select("cells", (F.col("upto") - F.col("n")).alias("first"), "n")


def resampled_totals(cells: DataFrame, cell: list[str], counts: list[str], draws: int, seed: int) -> DataFrame:
    """(cell, draw, counts): the counts of every cell in each draw, summed over the picked groups."""
    types = materialise(group_types(cells, cell, counts))
    groups = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    kinds = {c: cells.schema[c].dataType for c in cell}
    keys = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    schema = StructType.fromDDL(f"{keys}, block int, {', '.join(f'{c} array<bigint>' for c in counts)}")
    fields = to_arrow_schema(schema)

    def rows_of(totals: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row for each cell and block of draws."""
        for key, found in totals.items():
            for block in range(-(-draws // BLOCK)):
                part = found[:, block * BLOCK : (block + 1) * BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, block, *(p.tolist() for p in part)], fields, strict=True)], schema=fields)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks, totals = Multiplicities(groups, draws, seed), {}
        for batch in batches:
            for row in batch.to_pylist():
                w = picks.run(row["first"], row["n"])
                for entry in row["cells"]:
                    key = tuple(entry[c] for c in cell)
                    found = totals.setdefault(key, np.zeros((len(counts), draws), np.int64))
                    for i, c in enumerate(counts):
                        found[i] += w * entry[c]
        yield from rows_of(totals)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                values = np.array([row[c] for c in counts], np.int64)
                key = tuple(row[c] for c in [*cell, "block"])
                totals[key] = totals[key] + values if key in totals else values
        for key, values in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, *values.tolist()], fields, strict=True)], schema=fields)

    # runs of neighbours share the upper nodes of the tree
    parts = types.repartitionByRange("first").sortWithinPartitions("first").mapInArrow(weigh, schema)
    merged = parts.repartition("block", *cell).mapInArrow(merge, schema)
    each = merged.select(*cell, "block", F.posexplode(F.arrays_zip(*counts)).alias("at", "c"))
    return each.select(*cell, (F.col("block") * BLOCK + F.col("at")).alias("draw"), *(F.col(f"c.{c}").alias(c) for c in counts))


def least_valid(draws: int) -> int:
    """How many draws must be valid: four fifths, and at least 25 of fewer than 100 draws, 500 of more."""
    return max(25 if draws < 100 else 500, int(0.8 * draws))


def with_floor(summary: DataFrame, draws: int, valid: str = "valid") -> DataFrame:
    """Adds the share of valid draws and whether they are enough to be summarised."""
    return summary.withColumn("valid_share", F.col(valid) / F.lit(float(draws))).withColumn("enough", F.col(valid) >= least_valid(draws))


def require_floor(summary: DataFrame, draws: int, valid: str = "valid") -> DataFrame:
    """The summary, or an error when it is run if too few draws were valid."""
    message = F.concat(F.lit("too few valid draws: "), F.col(valid).cast("string"), F.lit(f" of {draws}, required {least_valid(draws)}"))
    return summary.withColumn(valid, F.when(F.col(valid) >= least_valid(draws), F.col(valid)).otherwise(F.raise_error(message).cast("long")))


def resampled_ranks(df: DataFrame, draws: int, seed: int, score: str = "score", group: str = "group") -> DataFrame:
    """(draw, positives, negatives, auroc, ap) in every draw: ties count a half, and average precision goes step by step from the top. Rows
    without a score are left out.

    Rows are counted by (score, group), then dealt by ranges of the score. Each task keeps running sums over its own scores for
    all draws. A first pass gives the ranges' totals, the second starts each range from what lies below and above it: a range's totals
    are two numbers for each draw, and there are as many ranges as shuffles have parts.
    """
    df = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    cells = df.groupBy(F.col(score).alias("score"), F.col(group).alias("group")).agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    numbered = materialise(positions(df.select(F.col(group).alias("group")).distinct(), [F.col("group")], "number"))
    groups = numbered.count()
    rows = cells.join(numbered, "group").repartitionByRange("score").sortWithinPartitions("score", "number").select(F.spark_partition_id().alias("part"), "score", "number", "pos", "neg")
    rows = materialise(rows)
    totals_schema = "part int, draw int, pos long, neg long"

    def by_score(batches: Iterator[pa.RecordBatch], picks: Multiplicities) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, positives, negatives in each draw) of one score after the other; rows come in order of part and score."""
        now, pos, neg = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["part"], row["score"]):
                    if now is not None:
                        yield now[0], pos, neg
                    now, pos, neg = (row["part"], row["score"]), np.zeros(draws, np.int64), np.zeros(draws, np.int64)
                w = picks.run(row["number"], 1)
                pos, neg = pos + w * row["pos"], neg + w * row["neg"]
        if now is not None:
            yield now[0], pos, neg

    def long(part: int, **columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array(np.full(draws, part, np.int32)), "draw": pa.array(np.arange(draws, dtype=np.int32)), **{k: pa.array(v) for k, v in columns.items()}})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for part, pos, neg in by_score(batches, Multiplicities(groups, draws, seed)):
            have = found.setdefault(part, [np.zeros(draws, np.int64), np.zeros(draws, np.int64)])
            have[0] += pos
            have[1] += neg
        for part, (pos, neg) in found.items():
            yield long(part, pos=pos, neg=neg)

    totals = materialise(rows.mapInArrow(sums, totals_schema))
    below = Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("draw")
    offsets = totals.select("part", "draw", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("pos", "neg")), *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("pos", "neg")))
    names = ["pos_below", "neg_below", "pos_all", "neg_all"]
    by_draw = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("draw", c))), lambda x: x[c]).alias(c)
    packed = offsets.groupBy("part").agg(*map(by_draw, names))  # ``draws`` entries each
    # what lies below a part comes with its first row
    heads = rows.groupBy("part").agg(F.min(F.struct("score", "number")).alias("h")).select("part", F.col("h.score").alias("score"), F.col("h.number").alias("number")).join(packed, "part")
    started = rows.join(heads, ["part", "score", "number"], "left").repartition("part").sortWithinPartitions("part", "score", "number")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, dict[str, np.ndarray]] = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                heads = np.flatnonzero(batch.column("pos_all").is_valid().to_numpy(zero_copy_only=False))
                for i in heads.tolist():
                    starts[batch.column("part")[i].as_py()] = {c: np.array(batch.column(c)[i].as_py(), np.int64) for c in names}
                yield batch.select(["part", "score", "number", "pos", "neg"])

        now, at, wins, gained = None, {}, None, None
        for part, pos, neg in by_score(seen(), Multiplicities(groups, draws, seed)):
            if part != now:
                if now is not None:
                    yield long(now, wins=wins, gained=gained, pos=at["pos_all"], neg=at["neg_all"])
                now, at, wins, gained = part, starts.pop(part), np.zeros(draws), np.zeros(draws)
            wins += pos * (at["neg_below"] + neg / 2)
            above_pos, above_neg = at["pos_all"] - at["pos_below"], at["neg_all"] - at["neg_below"]  # at this score or above
            gained += np.where(pos > 0, pos * above_pos / np.maximum(1, above_pos + above_neg), 0)
            at["pos_below"], at["neg_below"] = at["pos_below"] + pos, at["neg_below"] + neg
        if now is not None:
            yield long(now, wins=wins, gained=gained, pos=at["pos_all"], neg=at["neg_all"])

    found = started.mapInArrow(ranks, "part int, draw int, wins double, gained double, pos long, neg long").groupBy("draw").agg(F.sum("wins").alias("wins"), F.sum("gained").alias("gained"), F.first("pos").alias("positives"), F.first("neg").alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return found.select("draw", "positives", "negatives", F.when((p > 0) & (n > 0), F.col("wins") / (p * n)).alias("auroc"), F.when(p > 0, F.col("gained") / p).alias("ap"))


def anchor_trials(df: DataFrame, budgets: list[int], trials: int, seed: int, least_rest: int = 5, modes: tuple[str, ...] = ("iid", "group_disjoint")) -> DataFrame:
    """(mode, budget, trial, source, anchors, anchor_wrong, rest, rest_wrong): in each trial ``budget`` anchors a source, and the errors of
    the anchors and of the rest.

    ``df``: id, source, group, wrong (0 or 1). iid: anchors are the rows with the least hashes of (trial, id), the rest are all others.
    group_disjoint: the groups with the least hashes give one row each, and no row of these groups is in the rest. Sources that are
    too small (fewer than 10 rows, or than budget + ``least_rest``, fewer groups than the budget, or a smaller rest) are left out. Ranks
    are counted in parts of the hash, so a source of most rows is many tasks.
    """
    rows = df.select("id", "source", "group", "wrong").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    sizes = df.groupBy("source").agg(F.count("*").alias("size"), F.count_distinct("group").alias("groups"))
    drawn = lambda salt, key: F.xxhash64(F.lit(seed), F.lit(salt), "trial", key)
    parts = []
    if "iid" in modes:
        parts.append(hash_ranks(rows, ["trial", "source"], drawn("row", "id"), "id", "rank").withColumn("mode", F.lit("iid")).withColumn("first", F.lit(True)))
    if "group_disjoint" in modes:
        groups = hash_ranks(rows.select("trial", "source", "group").distinct(), ["trial", "source"], drawn("group", "group"), "group", "rank")
        least = rows.groupBy("trial", "source", "group").agg(F.min(F.struct(drawn("row", "id"), "id")).alias("least"))
        chosen = groups.join(least, ["trial", "source", "group"]).select("trial", "source", "group", "rank", F.col("least.id").alias("least"))
        parts.append(rows.join(chosen, ["trial", "source", "group"]).withColumn("mode", F.lit("group_disjoint")).withColumn("first", F.col("id") == F.col("least")).select(*parts[0].columns if parts else [*rows.columns, "rank", "mode", "first"]))
    marked = reduce(DataFrame.unionByName, parts).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    anchor, rest = (F.col("rank") <= F.col("budget")) & F.col("first"), F.col("rank") > F.col("budget")
    found = marked.groupBy("mode", "budget", "trial", "source").agg(F.count_if(anchor).alias("anchors"), F.sum(F.when(anchor, F.col("wrong"))).alias("anchor_wrong"), F.count_if(rest).alias("rest"), F.sum(F.when(rest, F.col("wrong"))).alias("rest_wrong"))
    large = (F.col("size") >= F.greatest(F.lit(10), F.col("budget") + least_rest)) & ((F.col("mode") == "iid") | (F.col("groups") >= F.col("budget"))) & (F.col("rest") >= least_rest)
    return found.join(sizes, "source").where(large).drop("size", "groups")


def flagged_sources(trials: DataFrame, high: float = 0.2) -> DataFrame:
    """(mode, budget, trials, mean_sources, mean_rest_error, mean_capture, high_rate): in each trial the source whose anchors are wrong most
    often is flagged (ties by name); then how wrong its rest is, and what part of all sources' errors in the rest that is. Trials with fewer
    than three sources don't count."""
    rate = F.col("anchor_wrong") / F.col("anchors")
    best = F.min_by(F.struct("rest", "rest_wrong"), F.struct(-rate, "source")).alias("f")
    by = trials.groupBy("mode", "budget", "trial").agg(F.count("*").alias("sources"), F.sum("rest_wrong").alias("all_wrong"), best).where("sources >= 3")
    error = F.col("f.rest_wrong") / F.col("f.rest")
    return by.groupBy("mode", "budget").agg(F.count("*").alias("trials"), F.avg("sources").alias("mean_sources"), F.avg(error).alias("mean_rest_error"), F.avg(F.when(F.col("all_wrong") > 0, F.col("f.rest_wrong") / F.col("all_wrong"))).alias("mean_capture"), F.avg((error >= high).cast("double")).alias("high_rate"))


def stratified_sample(df: DataFrame, label: str, n: int, row_id: str, seed: int) -> DataFrame:
    """n rows, proportional by class, topped up by the largest remainders; rows by hash order."""
    total = df.count()
    shares = df.groupBy(label).agg(F.count("*").alias("size")).withColumn("exact", F.col("size") * F.lit(float(min(n, total))) / F.lit(float(max(1, total))))
    shares = shares.withColumn("base", F.floor("exact")).withColumn("rest", F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), label)))  # a row for each class
    missing = shares.agg((F.lit(min(n, total)) - F.sum("base")).alias("more"))
    quota = shares.crossJoin(F.broadcast(missing)).select(label, (F.col("base") + F.when(F.col("rest") <= F.col("more"), 1).otherwise(0)).alias("quota"))
    ranked = hash_ranks(df, [label], F.xxhash64(F.lit(seed), row_id), row_id, "__k")
    return ranked.join(F.broadcast(quota), label).where("__k <= quota").drop("__k", "quota")  # a row for each class


def random_rows(df: DataFrame, n: int, row_id: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(n)
