"""Truncated SVD of a sparse matrix given as (row, feature, value), by a randomised range finder on blocks.

The matrix is cut into tiles of at most BLOCK rows and BLOCK features, a dense factor into blocks of as many rows. A product is a
join of tiles with the factor's blocks, a multiplication in the task and a sum by block; orthonormal factors come from a tall QR, local
factors merged until one is left. Between passes only that one small triangle is on the driver. No matrix of features by features is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, small_batches
from .ordered import positions

BLOCK, SPARE, FACTORS = 512, 10, 16
DENSE = "block long, m binary"


@dataclass
class Decomposition:
    """``left``: (row, u), ``right``: (feature, v) as arrays of doubles, the singular ``values`` in descending order, and each
    component's share of the variance of the matrix' columns. The embedding of a row is u times the values."""

    left: DataFrame
    right: DataFrame
    values: np.ndarray
    explained: np.ndarray


def l2_normalised(entries: DataFrame) -> DataFrame:
    """(row, feature, value) with rows of length 1; repeated cells are added up first, zeros and nulls drop out."""
    cells = entries.groupBy("row", "feature").agg(F.sum(F.col("value").cast("double")).alias("value")).where("row is not null and feature is not null and value <> 0")
    norms = cells.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return cells.join(norms, "row").select("row", "feature", (F.col("value") / F.col("norm")).alias("value"))


def equal_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, feature), (row, weight)): equal sets of features are one row that stands for their number. ``sets``: features, ascending arrays."""
    found = materialise(sets.groupBy("features").agg(F.count("*").alias("weight")).withColumn("row", F.monotonically_increasing_id()))
    return found.select("row", F.explode("features").alias("feature")), found.select("row", "weight")


def _numbered(entries: DataFrame, name: str) -> DataFrame:
    return materialise(positions(entries.select(name).distinct(), [F.col(name)], f"{name}_at"))


def _blocks(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for block, m in rows:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.ascontiguousarray(m, np.float64).tobytes()], pa.binary())], names=["block", "m"])


def _tiles(entries: DataFrame) -> DataFrame:
    """(i, j, r, c, v): a row for each tile, with its cells in lists of at most BLOCK x BLOCK."""
    place = lambda name: F.col(name) % BLOCK
    cells = entries.select(F.floor(F.col("row_at") / BLOCK).alias("i"), F.floor(F.col("feature_at") / BLOCK).alias("j"), F.struct(place("row_at").cast("int").alias("r"), place("feature_at").cast("int").alias("c"), F.col("value").alias("v")).alias("e"))
    return cells.groupBy("i", "j").agg(F.collect_list("e").alias("e")).select("i", "j", "e.r", "e.c", "e.v")


def tile_product(r: np.ndarray, c: np.ndarray, v: np.ndarray, factor: np.ndarray, block: int) -> np.ndarray:
    """A block of the product: the tile is made no larger than its cells reach, so few features are not multiplied as ``block``."""
    tile = np.zeros((r.max() + 1, c.max() + 1))
    tile[r, c] = v
    found = np.zeros((block, factor.shape[1]))
    found[: len(tile)] = tile @ factor[: tile.shape[1]]
    return found


def _product(tiles: DataFrame, dense: DataFrame, width: int, transposed: bool) -> DataFrame:
    """The matrix (or its transpose) times a dense factor, as blocks."""
    out, by = ("j", "i") if transposed else ("i", "j")
    met = tiles.join(dense.withColumnRenamed("block", by), by).select(out, "r", "c", "v", "m")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    r, c, v = (batch.column(n)[k].values.to_numpy(zero_copy_only=False) for n in ("r", "c", "v"))
                    factor = np.frombuffer(batch.column("m")[k].as_py()).reshape(-1, width)
                    yield batch.column(out)[k].as_py(), tile_product(*((c, r) if transposed else (r, c)), v, factor, BLOCK)

        return _blocks(parts())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[tuple[int, np.ndarray]]:
            now, total = None, None
            for batch in batches:
                for block, m in zip(batch.column("block").to_pylist(), batch.column("m"), strict=True):
                    part = np.frombuffer(m.as_py()).reshape(-1, width)
                    if block != now:
                        if now is not None:
                            yield now, total
                        now, total = block, np.zeros((BLOCK, width))
                    total = total + part
            if now is not None:
                yield now, total

        return _blocks(sums())

    return met.mapInArrow(multiply, DENSE).repartition("block").sortWithinPartitions("block").mapInArrow(add, DENSE)


def _triangle(dense: DataFrame, width: int) -> np.ndarray:
    """The triangular factor of a tall QR: of each task's blocks, then of FACTORS tasks' factors at a time. One reaches the driver."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for m in batch.column("m"):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(m.as_py()).reshape(-1, width)]), mode="r")
        if len(r):
            yield from _blocks(iter([(0, r)]))

    found = dense
    parts = found.rdd.getNumPartitions()
    while True:
        found = found.mapInArrow(factor, DENSE)
        if parts <= FACTORS:
            break
        parts = -(-parts // FACTORS)
        found = found.repartition(parts)
    rs = [np.frombuffer(row.m).reshape(-1, width) for row in found.collect()]  # FACTORS at most
    return np.linalg.qr(np.vstack(rs), mode="r") if rs else np.zeros((0, width))


def _times(dense: DataFrame, right: np.ndarray) -> DataFrame:
    """Every block times a small matrix."""
    width = right.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks((block, np.frombuffer(m.as_py()).reshape(-1, width) @ right) for batch in batches for block, m in zip(batch.column("block").to_pylist(), batch.column("m"), strict=True))

    return dense.mapInArrow(run, DENSE)


def _inverse(r: np.ndarray) -> np.ndarray:
    """The pseudo-inverse of a triangle: directions that the factor lacks become zero."""
    return np.linalg.pinv(r, rcond=1e-12)


def _orthonormal(dense: DataFrame, width: int) -> DataFrame:
    dense = materialise(dense)
    return _times(dense, _inverse(_triangle(dense, width)))


def _rows_of(dense: DataFrame, width: int, names: DataFrame, name: str, column: str) -> DataFrame:
    """(name, an array of ``width`` numbers) from blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, m in zip(batch.column("block").to_pylist(), batch.column("m"), strict=True):
                rows = np.frombuffer(m.as_py()).reshape(-1, width)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + np.arange(len(rows))), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["at", column])

    found = dense.mapInArrow(run, f"at long, {column} array<double>")
    return names.join(found, names[f"{name}_at"] == found["at"]).select(name, column)


def truncated_svd(entries: DataFrame, k: int = 50, iterations: int = 7, seed: int = 42, weights: DataFrame | None = None) -> Decomposition:
    """The ``k`` largest singular values and vectors of the matrix ``entries`` (row, feature, value), cells unique.

    With ``weights`` (row, weight: a whole number) a row stands for so many equal ones, and ``left`` has what each of these has. In the products it is one
    row, the root of its weight as long: the same values and right vectors.

    A random factor of 2 k + SPARE columns (flat spectra need many) is made from the features' numbers, then multiplied by the matrix and its transpose
    in turn, orthonormal after every product. ``k`` is bounded by the lesser side of the matrix, less one. A tile and its block of the
    factor take up to some megabytes, so the session's batches are made small: a task holds a few tiles, however many it has.
    """
    spark = entries.sparkSession
    small_batches(spark)
    row_names, feature_names = _numbered(entries, "row"), _numbered(entries, "feature")
    entries = entries.withColumn("weight", F.lit(1)) if weights is None else materialise(entries.join(weights, "row"))
    n = row_names.count() if weights is None else row_names.join(weights, "row").agg(F.sum("weight")).first()[0] or 0
    m = feature_names.count()
    k = min(k, n - 1, m - 1)
    if k < 1:
        raise ValueError("a decomposition needs two rows and two features")
    width = min(2 * k + SPARE, n, m)
    tiles = materialise(_tiles(entries.withColumn("value", F.col("value") * F.sqrt("weight")).join(row_names, "row").join(feature_names, "feature")))

    def random(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks((b, np.random.default_rng([seed, b]).normal(size=(BLOCK, width))) for batch in batches for b in batch.column("id").to_pylist())

    right = spark.range(-(-m // BLOCK)).mapInArrow(random, DENSE)
    left = _orthonormal(_product(tiles, right, width, False), width)
    for _ in range(iterations):
        right = _orthonormal(_product(tiles, left, width, True), width)
        left = _orthonormal(_product(tiles, right, width, False), width)
    # matrix ~ left (matrix' left)': the small triangle of the latter gives values and rotations
    left = materialise(left)
    back = materialise(_product(tiles, left, width, True))
    triangle = _triangle(back, width)
    u, values, vt = np.linalg.svd(triangle, full_matrices=False)
    left = _times(left, np.ascontiguousarray(vt[:k].T))
    right = _times(back, _inverse(triangle) @ u[:, :k])
    lefts, rights = _rows_of(left, k, row_names, "row", "u"), _rows_of(right, k, feature_names, "feature", "v")
    weight = F.lit(1)
    if weights is not None:
        lefts, weight = lefts.join(weights, "row").withColumn("u", F.transform("u", lambda x: x / F.sqrt("weight"))), F.col("weight")
    # shares of the variance: of the columns of u times the values, and of all features
    total = lambda x, w: (F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q"))
    spread = entries.groupBy("feature").agg(*total(F.col("value"), F.col("weight"))).agg(F.sum(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n))).first()[0]
    moments = lefts.select(weight.alias("weight"), F.posexplode("u").alias("at", "u")).groupBy("at").agg(*total(F.col("u"), F.col("weight"))).collect()  # k rows
    explained = np.zeros(k)
    for r in moments:
        explained[r["at"]] = values[r["at"]] ** 2 * (r.q / n - (r.s / n) ** 2) / spread
    return Decomposition(lefts.select("row", "u"), rights, values[:k], explained)
