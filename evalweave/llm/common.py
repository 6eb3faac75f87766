"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: Rows and text bytes that a task holds at a time, whatever Spark's own batches are.
SLICE_ROWS = 2048
SLICE_BYTES = 2 << 20


#: What this worker process keeps between tasks.
_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The one object that a worker process keeps between tasks. Workers live on from stage to stage, so a task that asks for another one
    drops what the stage before kept, its caches included, before it makes its own."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.unfreeze()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of SLICE_ROWS rows, fewer where ``text`` is long."""
    for batch in batches:
        size = SLICE_ROWS
        if text is not None and batch.num_rows:
            longest = max(1, batch.column(text).nbytes // batch.num_rows)
            size = max(1, min(SLICE_ROWS, SLICE_BYTES // longest))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str | None = None) -> DataFrame:
    """``fn`` over slices of the rows, batch in and batch out; empty partitions yield nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield fn(part)

    return df.mapInArrow(run, schema)


def batch_of(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    """A record batch of named (values, type) pairs."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one; other columns can't clash. Ids are whole numbers; others are
    refused by name."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"column {id_col} is {kind.simpleString()}, ids must be whole numbers")
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def text_digests(texts: list[str]) -> pa.Array:
    """The SHA-256 of each text's UTF-8."""
    return pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one is set only in local mode where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and set_already.isDefined():
        found = set_already.get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "/tmp/checkpoints"
    if not set_already.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage ends here and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the library's own in the shared folder, in whatever store that is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def crc32(col: str | Column) -> Column:
    """Unsigned crc32 of a column's decimal text."""
    return F.crc32(F.encode(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")), "UTF-8"))
