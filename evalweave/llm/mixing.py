"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected so that the weights meet a target: either an entropy, as a part of the largest
possible, or a limit on how often the most repeated source is seen. The weights times the budget are tokens
for each source. Each source fills its budget with permutations of its documents, one after the other: whole
ones, and a last one that ends when the budget is met. Every permutation is ordered by a hash of its number
and the document, and what part of its source's budget comes before a document sets the block it is dealt to,
so each block of the mix holds the sources by their weights.

The budget defaults to the least for which no source is seen less than once, so no document is lost.

A source's running totals are summed in sub-buckets of the permutation's hash and the sub-buckets' totals are
summed in turn: a source with a third of all rows is spread over as many tasks as any.

Defined cases: a null source is a source of its own; null and empty texts count one token, so that every
document has a place; repeated rows are documents of their own; an empty table gives an empty one; other
columns are carried by ``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, unused
from .ordered import shuffle_width

#: Halvings of the exponent's range, of which so many are done by one pass over the shares.
HALVINGS, AT_ONCE = 40, 4
#: Up to so many sources, their weights are sent to all tasks; more are joined by a shuffle.
FEW_SOURCES = 10_000
#: How often the most repeated source may be seen, and blocks of the mix.
LIMIT, BLOCKS, SEED = 2.0, 64, 20240229


def n_tokens(text: Column) -> Column:
    """Words between white space, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("long")


def shares(docs: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of a table (source, tokens)."""
    by = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    total = by.agg(F.sum("tokens").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("source", "tokens", "docs", (F.col("tokens") / F.col("all")).alias("share"))  # the total is one row


def measure(table: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy over the largest, repetition of the most repeated source over the least repeated) at each exponent."""
    sums = [F.count("*").alias("n")]
    for i, e in enumerate(exponents):
        power = F.pow("share", F.lit(e))
        # tokens a source gets over those it has, up to a factor that all sources share
        ratio = F.pow("share", F.lit(e - 1.0))
        sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("share")).alias(f"l{i}"), F.max(ratio).alias(f"h{i}"), F.min(ratio).alias(f"w{i}")]
    row = table.agg(*sums).first()
    out = []
    for i, e in enumerate(exponents):
        entropy = math.log(row[f"z{i}"]) - e * row[f"l{i}"] / row[f"z{i}"] if row["n"] else 0.0
        out.append((entropy / math.log(row["n"]) if row["n"] > 1 else 1.0, row[f"h{i}"] / row[f"w{i}"] if row["n"] else 1.0))
    return out


def bisect_exponent(table: DataFrame, entropy: float | None = None, limit: float | None = LIMIT) -> float:
    """The least exponent that keeps to ``limit``, or the one whose entropy is ``entropy`` of the largest.

    Both the entropy and the repetition fall as the exponent rises. Each pass over the shares measures the
    midpoints of AT_ONCE halvings, whichever way they go. An entropy below that of the shares gives 1, since
    exponents stay in [0, 1].
    """

    def too_flat(found: tuple[float, float]) -> bool:
        return found[0] > entropy if entropy is not None else found[1] > limit

    low, high = 0.0, 1.0
    at_low, = measure(table, [low])
    if not too_flat(at_low):
        return low
    for _ in range(0, HALVINGS, AT_ONCE):
        parts = 1 << AT_ONCE
        points = [low + (high - low) * i / parts for i in range(1, parts)]
        known = dict(zip(range(1, parts), measure(table, points), strict=True))
        a, b = 0, parts
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if too_flat(known[middle]) else (a, middle)
        low, high = low + (high - low) * a / parts, low + (high - low) * b / parts
    return high


def weights(docs: DataFrame, entropy: float | None = None, limit: float | None = LIMIT, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, share, weight, budget) of (source, tokens) with sources not null; weights add up to 1.

    ``budget``: tokens in all; unset: the least with which no source is seen less than once.
    """
    table = materialise(shares(docs))
    exponent = bisect_exponent(table, entropy, limit)
    power = F.pow("share", F.lit(exponent))
    total = table.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("most"))
    every = F.lit(float(budget)) if budget is not None else F.col("most") * F.col("z")
    return table.crossJoin(F.broadcast(total)).select("source", "tokens", "docs", "share", (power / F.col("z")).alias("weight"), F.greatest(F.lit(1), F.round(power / F.col("z") * every)).cast("long").alias("budget"))


def mix(docs: DataFrame, entropy: float | None = None, limit: float | None = LIMIT, budget: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(doc, source, tokens, epoch, weight, budget, before, block, order): the dealt documents.

    ``docs``: (doc, source, tokens) and maybe tie, a hash of what else tells rows of one doc apart (so that an id that
    many rows repeat, or none, is spread); it is read several times, so it should be a table. ``before``: tokens
    that the source has dealt before this document. A permutation that the budget cuts ends with the
    document that reaches it; the result is ordered by (block, order) where it is written in order.
    """
    table = materialise(weights(docs.select(_key(), "tokens"), entropy, limit, budget))
    small = table.select("source", F.col("tokens").alias("all"), "weight", "budget")
    if table.count() <= FEW_SOURCES:
        small = F.broadcast(small)
    passes = F.ceil(F.col("budget") / F.col("all")).cast("int")
    tie = F.col("tie") if "tie" in docs.columns else F.lit(0)
    rows = docs.select("doc", F.col("source").alias("name"), _key(), "tokens", tie.alias("tie")).join(small, "source")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("order", F.xxhash64(F.lit(seed), "epoch", "doc", "tie"))
    parts = max(16, 4 * shuffle_width(docs))
    rows = rows.withColumn("part", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    keys = ["source", "epoch", "part"]
    within = Window.partitionBy(*keys).orderBy("order", "doc", "tokens", "tie").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.sum("tokens").alias("part_tokens"))
    totals = totals.select(*keys, F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    found = rows.join(totals, keys).withColumn("before", F.col("epoch") * F.col("all") + F.col("ahead") + F.col("inside")).where("before < budget")
    block = F.floor(F.col("before") * F.lit(float(blocks)) / F.col("budget")).cast("int")
    return found.select("doc", F.col("name").alias("source"), "tokens", "epoch", "weight", "budget", "before", block.alias("block"), "order")


def _key() -> Column:
    """The source as a key that is never null and stands for one source only."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("source")


def source_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").alias("source"), n_tokens(F.col(f"`{text_col}`")).alias("tokens"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix deals it, in the order of the mix; columns as they are.

    Rows that repeat an id, a source and a text are dealt as one, each of them as often as the mix deals that one at
    most. Any column names will do.
    """
    key = F.to_json(F.struct(F.col(f"`{id_col}`").alias("i"), F.col(f"`{source_col}`").alias("s"), F.xxhash64(F.col(f"`{text_col}`")).alias("t")))
    doc, epoch, block, order = (unused(df, n) for n in ("__doc", "__epoch", "__block", "__order"))
    dealt = mix(materialise(source_tokens(df, id_col, text_col, source_col).withColumn("doc", F.to_json(F.struct(F.col("doc").alias("i"), F.col("source").alias("s"), F.col("tie").alias("t"))))))
    places = dealt.groupBy(F.col("doc").alias(doc), F.col("epoch").alias(epoch)).agg(F.min("block").alias(block), F.min("order").alias(order))
    rows = df.withColumn(doc, key).join(places, doc)
    return rows.repartitionByRange(block, order).sortWithinPartitions(block, order).select(*(F.col(f"`{c}`") for c in df.columns))
