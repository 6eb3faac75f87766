"""Centroid clustering of integer vectors by delta Lloyd.

Assignments are kept in a written table, the sums and sizes of all clusters on the driver (a number set by k and the dimensions). A
round moves the centroids, and then compares as little as it can: a vector whose centroid stayed meets only the centroids that
changed, and only vectors whose own centroid moved meet all. Vectors that go over are signed integer transfers from one sum to
another; tasks add them up for each centroid and write them beside the assignments, so that a lost task repeats both or none.

All numbers are integers, so results don't depend on how rows are dealt: components are floor(256 x), sums are exact, centroids
are floors, distances are exact (in doubles where they stay below 2^53, else in longs).

Defined cases: only vectors with exactly ``dims`` components, none null or not finite, are kept; components beyond
2^27 count as 2^27, so that distances fit a long (a sum of distances that doesn't fit is null); repeated rows are vectors each; vectors with a null id are assigned but start a
cluster only if there are fewer than k others; equal hashes are ordered by the components; fewer than k vectors give as many centroids; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_table

CENTROIDS, DIMS, ROUNDS, SCALE, SALT = 40, 64, 5, 256.0, "2:"
#: Bound of a component, and up to where products are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 21
#: Vectors compared at a time; bounds memory, not results.
BLOCK = 4096

STATE = "vec_id {id}, x array<int>, cluster int, distance long, owner int, transfer array<long>"


def kept_vectors(df: DataFrame, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the well-formed vectors, as doubles."""
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("v") == dims) & F.coalesce(finite, F.lit(False)))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)


def starts(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least hashes of their ids, in that order: k rows reach the driver."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return integers(np.array([r.v for r in found], float)) if found else np.empty((0, 0), np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    if not len(centroids):
        return np.empty((len(x), 0), np.int64)
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if largest <= EXACT:  # 4 * dims * 2^42 is below 2^53 up to 512 dimensions
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new (cluster, distance) of each row; ``cluster`` is -1 before the first round. Ties go to the smaller number."""
    cluster, distance = cluster.copy(), distance.copy()
    moved = (cluster < 0) | np.isin(cluster, changed)
    if moved.any():
        d = distances(x[moved], centroids)
        cluster[moved] = d.argmin(1)
        distance[moved] = d.min(1)
    if not moved.all() and len(changed):
        rows = np.flatnonzero(~moved)
        d = distances(x[rows], centroids[changed])
        best = d.argmin(1)
        least, number = d[np.arange(len(rows)), best], changed[best]
        over = (least < distance[rows]) | ((least == distance[rows]) & (number < cluster[rows]))
        cluster[rows[over]], distance[rows[over]] = number[over], least[over]
    return cluster, distance


def transfers(x: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """For each centroid the change of its size and of its components' sums."""
    total = np.zeros((k, 1 + x.shape[1]), np.int64)
    rows = np.flatnonzero(old != new)
    gone = rows[old[rows] >= 0]
    own = np.hstack([np.ones((len(rows), 1), np.int64), x[rows]])
    np.add.at(total, new[rows], own)
    np.subtract.at(total, old[gone], own[old[rows] >= 0])
    return total


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _compare(state: DataFrame, centroids: np.ndarray, changed: np.ndarray, path: str) -> DataFrame:
    """Writes the state after one comparison: a row for each vector, and from each task the transfers of each centroid."""
    k, dims = centroids.shape
    id_type = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fields = np.zeros((k, 1 + dims), np.int64), None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                if "v" in batch.schema.names:
                    x = integers(_matrix(batch.column("v"), dims, float))
                    old, far = np.full(len(x), -1), np.zeros(len(x), np.int64)
                else:
                    x = _matrix(batch.column("x"), dims, np.int64)
                    old, far = (batch.column(c).to_numpy().astype(np.int64) for c in ("cluster", "distance"))
                new, near = nearest(x, old, far, centroids, changed)
                total += transfers(x, old, new, k)
                ids = batch.column("vec_id")
                fields = pa.schema([("vec_id", ids.type), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("owner", pa.int32()), ("transfer", pa.list_(pa.int64()))])
                none = [pa.nulls(len(x), fields.field(i).type) for i in (4, 5)]
                yield pa.RecordBatch.from_arrays([ids, _lists(x, pa.int32()), pa.array(new, pa.int32()), pa.array(near, pa.int64()), *none], schema=fields)
        rows = np.flatnonzero(total.any(1))
        if len(rows):
            none = [pa.nulls(len(rows), fields.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(rows, pa.int32()), _lists(total[rows], pa.int64())], schema=fields)

    state.mapInArrow(run, STATE.format(id=id_type)).write.parquet(path)
    return state.sparkSession.read.parquet(path)


def _summed(table: DataFrame, k: int, dims: int) -> np.ndarray:
    """The transfers of all tasks added up: at most k x (1 + dims) numbers reach the driver."""
    total = np.zeros((k, 1 + dims), np.int64)
    cells = table.where("owner is not null").select("owner", F.posexplode("transfer").alias("at", "n")).groupBy("owner", "at").agg(F.sum("n").alias("n"))
    for row in cells.collect():
        total[row.owner, row["at"]] = row.n
    return total


def cluster_vectors(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, x, cluster, distance) of every kept vector, the final centroids) after ``rounds`` rounds and a last assignment."""
    spark: SparkSession = df.sparkSession
    vectors = kept_vectors(df, dims, id_col, vector_col)
    centroids = starts(vectors, k, salt)
    if not len(centroids):
        id_type = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {id_type}, x array<int>, cluster int, distance long"), np.empty((0, dims), np.int64)
    k = len(centroids)
    path = shared_table(spark, "centroids")
    table = _compare(vectors, centroids, np.arange(k), path)
    sums = _summed(table, k, dims)
    for _ in range(rounds):
        moved = centroids.copy()
        full = sums[:, 0] > 0
        moved[full] = sums[full, 1:] // sums[full, :1]
        changed = np.flatnonzero((moved != centroids).any(1))
        centroids = moved
        if not len(changed):
            break  # every further round would repeat this one
        before, path = path, shared_table(spark, "centroids")
        table = _compare(table.where("owner is null"), centroids, changed, path)
        sums += _summed(table, k, dims)
        remove(spark, before)
    return table.where("owner is null").select("vec_id", "x", "cluster", "distance"), centroids


def assignments(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    found, centroids = cluster_vectors(df, k, rounds, dims, salt, id_col, vector_col)
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = df.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    within = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = within.agg(F.try_sum("cluster_inertia").alias("inertia"))
    sizes = named.join(within, "cluster", "left").join(F.broadcast(whole), F.lit(True))  # k rows, and one
    return found.join(F.broadcast(sizes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
