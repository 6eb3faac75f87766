"""Long work by tasks that can be stopped and taken up again.

The rows of every task are a partition of a table. A ledger, a table of its own, says of each finished task how many rows and columns its part
has, what its digest is and for which input it was made. When work is taken up, parts are counted and digested where they lie, and
only those that agree with the ledger and with the present request are kept: missing, short, changed or foreign parts are made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialise

LEDGER = "task string, n long, width int, digest decimal(38,0), input string, written timestamp"


def part_digests(rows: DataFrame) -> DataFrame:
    """(task, n, width, digest): counts and a sum of row hashes, whatever the order of rows. Hashes include the task, so a part that
    lies under another task's name differs."""
    columns = [c for c in rows.columns if c != "task"]
    digest = F.sum(F.xxhash64("task", *columns).cast("decimal(38,0)")).cast("decimal(38,0)")
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.lit(len(columns)).alias("width"), digest.alias("digest"))


def stored_parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all parts; files that can't be read count as not there, so their task is found short."""
    whole = StructType([*schema.fields, StructField("task", StringType())])
    try:
        return spark.read.schema(whole).option("ignoreCorruptFiles", "true").parquet(f"{path}/parts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each task."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)
    last = rows.groupBy("task").agg(F.max_by(F.struct("n", "width", "digest", "input"), "written").alias("l"))
    return last.select("task", "l.*")


def finished(spark: SparkSession, path: str, tasks: DataFrame, schema: StructType) -> DataFrame:
    """The asked tasks (task, input, expected) whose parts are whole: as the ledger says, made for this input, and of the expected number of
    rows where one is given."""
    found = part_digests(stored_parts(spark, path, schema))
    same = found.join(ledger(spark, path), ["task", "n", "width", "digest"]).where(F.col("width") == len(schema))
    return tasks.join(same, ["task", "input"]).where(F.col("expected").isNull() | (F.col("expected") == F.col("n"))).select("task", "n")


def resume(tasks: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(the rows of all asked tasks, a report (task, state, n)); state is reused, computed or failed.

    ``tasks``: task (text, unique), input (what it is made from, as text), expected (rows, or null). ``compute`` takes the
    tasks that are to be made and gives rows of ``schema`` with their ``task``. A task whose new part isn't as expected is
    failed and not entered in the ledger. Parts are replaced whole; the ledger is only added to.
    """
    spark, fields = tasks.sparkSession, StructType.fromDDL(schema)
    tasks = materialise(tasks.select("task", "input", F.col("expected").cast("long").alias("expected")))
    kept = materialise(finished(spark, path, tasks, fields))
    todo = materialise(tasks.join(kept, "task", "left_anti"))
    if not todo.isEmpty():
        fresh = compute(todo).select(*fields.names, "task")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task").parquet(f"{path}/parts")
        made = part_digests(stored_parts(spark, path, fields).join(todo.select("task"), "task", "left_semi"))
        whole = made.join(todo, "task").where(F.col("expected").isNull() | (F.col("expected") == F.col("n")))
        whole.select("task", "n", "width", "digest", "input", F.current_timestamp().alias("written")).write.mode("append").parquet(f"{path}/ledger")
    now = materialise(finished(spark, path, tasks, fields))
    states = tasks.join(now, "task", "left").join(kept.select("task", F.lit(True).alias("old")), "task", "left")
    report = states.select("task", F.when(F.col("old"), "reused").when(F.col("n").isNotNull(), "computed").otherwise("failed").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))
    return stored_parts(spark, path, fields).join(now.select("task"), "task", "left_semi").select("task", *fields.names), report
