"""What filters do to each other: every order of a set of filters, step by step, for each part of a corpus.

A document is first reduced to a mask with one bit for each filter that it fails, and documents to counts of
(part, mask). These cells are unpivoted against the steps of all orders. A running bit-or over the steps tells
which filters of an order a cell failed earlier, conditional sums over the cells give the figures of a step,
and totals over all orders of a filter give its share (its Shapley value times the number of orders).

What keeps hot keys small: exact copies are found by the least id of each text's SHA-256, a minimum that is
combined before the shuffle; a document then asks by (digest, id) whether it is that row, a key that copies don't
share; and rows are counted by (id, part, mask) before labels are joined, so an id has at most one row for each part and mask.

Defined cases: a null text counts as empty; a null part as the empty string; rows with a null id have no label and
are copies of nothing (no id is smaller than null), nor is anything a copy of them; repeated rows count each, and
rows of one id and one text aren't copies of each other; of labels that repeat an id the greatest counts; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The maximal runs of characters other than the six ASCII white spaces."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


#: Conditions under which a text fails, from the columns text, words and n_words.
CONDITIONS: dict[str, Column | str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_code_points",
    "D": "text rlike '[#$%&*|]'",
}
#: The filter that fails copies of a text with a smaller id.
COPIES = "E"


def failures(docs: DataFrame, conditions: dict[str, Column | str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, digest, mask): bit i of the mask is set if the text fails the i-th condition."""
    named = lambda name: F.col(f"`{name}`")
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text"))).withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_distinct": F.size(F.array_distinct("words")).cast("long"),
            "n_upper": (F.length("text") - F.length(F.translate("text", UPPER, ""))).cast("long"),
            "n_code_points": F.length("text").cast("long"),
        }
    )
    as_column = lambda c: F.expr(c) if isinstance(c, str) else c
    mask = F.lit(0)
    for i, condition in enumerate((conditions or CONDITIONS).values()):
        mask = mask + F.when(as_column(condition), 1 << i).otherwise(0)
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mark_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(id, part, mask, n): ``bit`` is set where a smaller id has the same digest; n rows are alike."""
    known = rows.where("id is not null")
    least = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    alike = known.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(bit)
    marked = alike.join(least, ["digest", "id"], "left").groupBy("id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))
    unnamed = rows.where("id is null").groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    return marked.unionByName(unnamed)


def mask_cells(marked: DataFrame, labels: DataFrame, good_col: str = "quality", toxic_col: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and how many of them are labelled good or toxic."""
    flag = lambda name: F.coalesce(F.max((F.col(f"`{name}`") == 1).cast("int")), F.lit(0))
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    named = marked.where("id is not null").join(known, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unnamed = marked.where("id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(unnamed).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def order_steps(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, letter, bit): the steps of all orders of the filters, a number set by the filters alone."""
    rows = [("".join(order), i + 1, letter, 1 << letters.index(letter)) for order in permutations(letters) for i, letter in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, bit int")


def evaluate_orders(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    part of the cells and every step of every order."""
    steps = F.broadcast(order_steps(cells.sparkSession, letters))  # letters! x letters rows
    long = cells.join(steps, F.lit(True)).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    figures = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column | str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The figures of every order of the conditions and the filter of copies; texts are read once."""
    conditions = conditions or CONDITIONS
    rows = materialise(failures(docs, conditions, id_col, text_col, part_col))
    cells = materialise(mask_cells(mark_copies(rows, 1 << len(conditions)), labels))
    return evaluate_orders(cells, "".join(conditions) + COPIES)
