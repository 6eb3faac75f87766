"""Files as files: named sinks, digests of any size, manifests, and bit matrices read by byte range.

Tasks open files through ``pyarrow.fs`` by their address, whatever store that is; the driver only lists names and sizes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType

#: Bytes that are read at a time.
PIECE = 8 << 20
#: Bytes of bits that a task unpacks at a time, each to a byte and a set one to two numbers.
SPAN = 1 << 17


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; a plain path is a local one."""
    if re.match("^file:/+", address):
        address = re.sub("^file:/+", "file:///", address)
    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


def store(address: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all: under another name first, so a task that is repeated does no harm."""
    where, folder = opened(address)
    where.create_dir(folder, recursive=True)
    spare = f"{folder}/.{name}.{hashlib.sha256(data).hexdigest()[:16]}"
    with where.open_output_stream(spare) as out:
        out.write(data)
    where.move(spare, f"{folder}/{name}")


def write_files(df: DataFrame, address: str) -> DataFrame:
    """Writes ``content`` of every row (file, content) to a file of that name; (file, bytes) of what was written. A content is
    one cell, so it must fit a task; larger files are cut by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column("file").to_pylist(), []
            for name, content in zip(names, batch.column("content").to_pylist(), strict=True):
                data = content if isinstance(content, bytes) else content.encode()
                store(address, name, data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return df.select("file", "content").mapInArrow(run, "file string, bytes long")


def json_report(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a line of JSON. A NaN or an infinity, which JSON doesn't have, is an error when it is run."""
    kinds = {f.name: f.dataType for f in df.schema}
    checked = []
    for c in columns:
        value = F.col(c)
        if isinstance(kinds[c], (DoubleType, FloatType)):
            value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.concat(F.lit(f"{c} isn't finite: "), value.cast("string"))).cast(kinds[c])).otherwise(value)
        checked.append(value.alias(c))
    return F.concat(F.to_json(F.struct(*checked), {"ignoreNullFields": "false"}), F.lit("\n"))


def listed(address: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files of a folder, in order of their names; names that begin with a dot or underscore are
    not files of the data."""
    where, path = opened(address)
    info = where.get_file_info(path)
    found = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_"))]
    scheme = address.partition("://")[0] + "://" if "://" in address else "file://"
    return [(f"{scheme}{f.path}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def file_digests(spark: SparkSession, address: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder, empty ones too, read in pieces: a file of any size is a stream in one task."""
    names = spark.createDataFrame(listed(address), "path string, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for address in batch.column("path").to_pylist():
                where, path = opened(address)
                digest = hashlib.sha256()
                with where.open_input_stream(path) as file:
                    while piece := file.read(PIECE):
                        digest.update(piece)
                found.append((address.rpartition("/")[2], digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), batch.column("length"), pa.array([d for _, d in found], pa.string())], names=["file", "bytes", "sha256"])

    return names.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "file string, bytes long, sha256 string")


def verified(spark: SparkSession, address: str, manifest: DataFrame) -> DataFrame:
    """(file, bytes, sha256, verdict) of a folder's files against a pinned manifest (file, sha256): PASS, CHANGED,
    MISSING (listed only) or UNLISTED (there only)."""
    files = file_digests(spark, address).withColumnRenamed("sha256", "actual")
    both = files.join(manifest.select("file", F.lower("sha256").alias("expected")), "file", "full")
    verdict = F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "UNLISTED").when(F.col("actual") == F.col("expected"), "PASS").otherwise("CHANGED")
    return both.select("file", "bytes", F.coalesce("actual", "expected").alias("sha256"), verdict.alias("verdict"))


def require_verified(checked: DataFrame) -> DataFrame:
    """The files, or an error when it is run at the first that didn't pass."""
    fault = F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("verdict"))).cast("string")
    return checked.withColumn("verdict", F.when(F.col("verdict") == "PASS", F.col("verdict")).otherwise(fault))


def write_bits(df: DataFrame, address: str, samples: int, features: int, per_file: int) -> DataFrame:
    """Writes set cells (feature, sample) as a feature-major matrix of bits, the lowest bit of a byte first: files of ``per_file``
    features each, numbered in order; (file, bytes). A feature without cells is a row of zeros. A task holds one piece of a file."""
    width, last = -(-samples // 8), -(-features // per_file)
    blocks = df.sparkSession.range(last).select(F.col("id").alias("block"), F.lit(None).cast("long").alias("feature"), F.lit(None).cast("int").alias("sample"))
    cells = df.select(F.floor(F.col("feature") / per_file).alias("block"), F.col("feature").cast("long"), F.col("sample").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = opened(address)
        where.create_dir(folder, recursive=True)
        now, file = None, None
        try:
            for batch in batches:
                block, feature, sample = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for b in np.unique(block).tolist():
                    if b != now:
                        if file is not None:
                            yield file.done()
                        now, file = b, BitFile(where, folder, f"block-{b:012d}.bits", min(per_file, features - b * per_file) * width)
                    own = (block == b) & ~np.isnan(feature.astype(float))
                    file.add((feature[own].astype(np.int64) - b * per_file) * width * 8 + sample[own].astype(np.int64))
            if file is not None:
                yield file.done()
        finally:
            if file is not None:
                file.out.close()

    # in the order of their bits, so that a task holds one piece of a file
    return blocks.unionByName(cells).repartition("block").sortWithinPartitions("block", "feature", "sample").mapInArrow(run, "file string, bytes long")


class BitFile:
    """A file of bits that is written piece by piece under another name, then renamed."""

    def __init__(self, where: fs.FileSystem, folder: str, name: str, size: int):
        self.where, self.folder, self.name, self.size = where, folder, name, size
        self.spare = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.piece, self.bits = where.open_output_stream(self.spare), 0, None

    def _write_up_to(self, piece: int) -> None:
        while self.piece < piece:
            n = min(SPAN, self.size - self.piece * SPAN)
            self.out.write(bytes(n) if self.bits is None else np.packbits(self.bits[: n * 8], bitorder="little").tobytes())
            self.piece, self.bits = self.piece + 1, None

    def add(self, places: np.ndarray) -> None:
        """Sets bits; places ascend over all calls."""
        pieces = places // (SPAN * 8)
        for piece in np.unique(pieces).tolist():
            self._write_up_to(piece)
            if self.bits is None:
                self.bits = np.zeros(SPAN * 8, np.uint8)
            self.bits[places[pieces == piece] - piece * SPAN * 8] = 1

    def done(self) -> pa.RecordBatch:
        self._write_up_to(-(-self.size // SPAN))
        self.out.close()
        self.where.move(self.spare, f"{self.folder}/{self.name}")
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.size], pa.int64())], names=["file", "bytes"])


class BitMatrixSource(DataSource):
    """Presence (feature, sample) of files of bits as ``write_bits`` writes them, or of one file of any size.

    Options: path, samples, split (features in a split), features (a JSON list of numbers: only these features' bytes are
    read). Splits are byte ranges on feature boundaries; offsets are 64-bit. Features are numbered through all files, by name.
    """

    @classmethod
    def name(cls) -> str:
        return "bits"

    def schema(self) -> str:
        return "feature long, sample int"

    def reader(self, schema) -> DataSourceReader:
        return BitMatrixReader(self.options)


class Split(InputPartition):
    """Features ``first`` and on of a file: the runs (place in the file, features) to read."""

    def __init__(self, address: str, first: int, runs: list[tuple[int, int]]):
        self.address, self.first, self.runs = address, first, runs


class BitMatrixReader(DataSourceReader):
    def __init__(self, options):
        self.address, self.samples = options["path"], int(options["samples"])
        self.width, self.split = -(-self.samples // 8), int(options.get("split", 1 << 16))
        self.wanted = sorted(set(json.loads(options["features"]))) if options.get("features") else None

    def partitions(self) -> list[InputPartition]:
        found, start = [], 0
        for address, size in listed(self.address):
            if size % self.width:
                raise ValueError(f"{address}: {size} bytes are no whole number of features of {self.width} bytes")
            n = size // self.width
            if self.wanted is None:
                found += [Split(address, start, [(at, min(self.split, n - at))]) for at in range(0, n, self.split)]
            else:
                own = [f - start for f in self.wanted if start <= f < start + n]
                # neighbours are read at once
                runs: list[list[int]] = []
                for f in own:
                    if runs and runs[-1][0] + runs[-1][1] == f and runs[-1][1] < self.split:
                        runs[-1][1] += 1
                    else:
                        runs.append([f, 1])
                found += [Split(address, start, [tuple(r) for r in runs[i : i + 1000]]) for i in range(0, len(runs), 1000)]
            start += n
        if self.wanted is not None and (outside := [f for f in self.wanted if not 0 <= f < start]):
            raise ValueError(f"features out of range 0..{start - 1}: {outside[:5]}")
        return found or [Split(self.address, 0, [])]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.runs:
            return
        where, path = opened(split.address)
        with where.open_input_file(path) as file:
            for at, n in split.runs:
                step = max(1, PIECE // max(1, self.width * 8))
                for first in range(at, at + n, step):
                    count = min(step, at + n - first)
                    # features whose bits don't fit are read alone, in pieces
                    for start in range(0, self.width, SPAN if count == 1 else max(1, self.width)):
                        size = min(SPAN, self.width - start) if count == 1 else self.width
                        data = file.read_at(count * size, first * self.width + start)
                        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(count, size), axis=1, bitorder="little")[:, : self.samples - start * 8]
                        feature, sample = np.nonzero(bits)
                        yield pa.RecordBatch.from_arrays([pa.array(feature + split.first + first, pa.int64()), pa.array(sample + start * 8, pa.int32())], names=["feature", "sample"])


def scan_bits(spark: SparkSession, address: str, samples: int, features: list[int] | None = None, split: int = 1 << 16) -> DataFrame:
    """(feature, sample) of every set bit, of all features or of the given ones."""
    spark.dataSource.register(BitMatrixSource)
    reader = spark.read.format("bits").option("samples", samples).option("split", split)
    if features is not None:
        reader = reader.option("features", json.dumps(sorted(set(features))))
    return reader.load(address)
