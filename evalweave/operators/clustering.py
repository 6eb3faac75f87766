"""K-means for many numbers of clusters at once, and the choice among them by silhouette under limits of size.

All candidates are fitted over the same cached vectors: a pass assigns every vector to a cluster of each candidate and adds up sums by
(candidate, cluster) in the tasks, so that only sums reach the driver, (sum of all k) x (dims + 2) numbers. Silhouettes are those of squared
Euclidean distance, for which a vector's mean distance to a cluster follows from the cluster's size, sum and sum of squared lengths: one more
pass gives them for every candidate, exactly and without pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The candidates, and the limits: a cluster of fewer than SMALL is small, at least this share must lie in others, none may hold over MOST.
CANDIDATES, SMALL, IN_OTHERS, MOST = (20, 30, 40, 50, 60, 80, 100), 5, 0.95, 0.25
#: Vectors that first centres are drawn from.
SAMPLE = 5000
PART = "k int, cluster int, n long, sums array<double>, squares double"


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.empty((0, 0))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ over a sample: each centre is drawn with a weight of its squared distance from those before."""
    rng = np.random.default_rng([seed, k])
    chosen = [int(rng.integers(len(sample)))]
    far = _squared(sample, sample[chosen])[:, 0]
    for _ in range(k - 1):
        total = far.sum()
        chosen.append(int(rng.choice(len(sample), p=far / total)) if total > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, _squared(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _sums(df: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each candidate the sizes, sums and sums of squared lengths of its clusters."""
    dims = next(iter(centres.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((k, dims + 2)) for k in centres}
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            own = np.hstack([np.ones((len(x), 1)), x, (x * x).sum(1)[:, None]])
            for k, c in centres.items():
                nearest = _squared(x, c).argmin(1)
                order = np.argsort(nearest, kind="stable")
                heads = np.flatnonzero(np.diff(nearest[order], prepend=-1))
                total[k][nearest[order][heads]] += np.add.reduceat(own[order], heads, axis=0)
        for k, t in total.items():
            some = np.flatnonzero(t[:, 0])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(t[some, 0].astype(np.int64)), pa.array(t[some, 1:-1].tolist(), pa.list_(pa.float64())), pa.array(t[some, -1])], names=["k", "cluster", "n", "sums", "squares"])

    parts = df.select("x").mapInArrow(run, PART)
    cells = parts.select("k", "cluster", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "sums", F.array("squares"))).alias("at", "v")).groupBy("k", "cluster").pivot("at", list(range(dims + 2))).sum("v")
    found = {k: np.zeros((k, dims + 2)) for k in centres}
    for row in cells.collect():  # sum of all k
        found[row.k][row.cluster] = row[2:]
    return {k: (t[:, 0], t[:, 1:-1], t[:, -1]) for k, t in found.items()}


def fit_all(df: DataFrame, candidates: tuple[int, ...] = CANDIDATES, rounds: int = 30, seed: int = 42) -> dict[int, np.ndarray]:
    """Centres for each number of clusters below the number of vectors. ``df``: (id, x), x an array of doubles, scaled to length 1.

    First centres come from SAMPLE vectors by a hash of the id; a candidate is left alone once its centres stay; an empty
    cluster keeps its centre.
    """
    sample = unit(np.array([r.x for r in df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).collect()], float))
    n = df.count()
    centres = {k: first_centres(sample, k, seed) for k in candidates if k < n and k <= len(sample)}
    if not centres:
        raise ValueError("no number of clusters is below the number of vectors")
    open_ = dict(centres)
    for _ in range(rounds):
        sums = _sums(df, open_)
        for k in list(open_):
            size, total, _ = sums[k]
            new = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], open_[k])
            if np.abs(new - open_[k]).max() < 1e-9:
                del open_[k]
            else:
                open_[k] = new
            centres[k] = new
        if not open_:
            break
    return centres


def silhouettes(df: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """Mean silhouette and cluster sizes of each candidate; a vector alone in its cluster has 0, as has one of one cluster."""
    sums = _sums(df, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(centres, 0.0)
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            length = (x * x).sum(1)
            for k, c in centres.items():
                size, added, squares = sums[k]
                own = _squared(x, c).argmin(1)
                # the sum of squared distances to all members of each cluster
                far = np.maximum(0, size * length[:, None] - 2 * x @ added.T + squares)
                rows = np.arange(len(x))
                alone = size[own] < 2
                a = far[rows, own] / np.maximum(1, size[own] - 1)
                mean = np.where(size > 0, far / np.maximum(1, size), np.inf)
                mean[rows, own] = np.inf
                b = mean.min(1)
                most = np.maximum(a, b)
                value = np.where(alone | ~np.isfinite(b) | (most == 0), 0.0, (b - a) / np.where((most > 0) & np.isfinite(most), most, 1))
                total[k] += float(value.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], names=["k", "s"])

    n = {k: s[0].sum() for k, s in sums.items()}
    found = df.select("x").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # a row for each candidate
    return {r.k: float(r.s / n[r.k]) for r in found}, {k: s[0] for k, s in sums.items()}


def sweep(df: DataFrame, candidates: tuple[int, ...] = CANDIDATES, rounds: int = 30, seed: int = 42) -> tuple[list[dict], dict[int, np.ndarray]]:
    """(a record for each candidate, the centres): silhouette, sizes, and which is selected by what rule: the greatest silhouette
    of those within the limits, or of all if none is; ties go to the smaller k."""
    centres = fit_all(df, candidates, rounds, seed)
    quality, sizes = silhouettes(df, centres)
    records = []
    for k in sorted(centres):
        size = sizes[k]
        n = size.sum()
        records.append({"k": k, "silhouette": quality[k], "least": int(size.min()), "median": float(np.median(size)), "largest": int(size.max()), "largest_share": float(size.max() / n), "in_others": float(size[size >= SMALL].sum() / n)})
    fit = [r for r in records if r["in_others"] >= IN_OTHERS and r["largest_share"] <= MOST]
    best = max(fit or records, key=lambda r: (r["silhouette"], -r["k"]))
    rule = "max_silhouette_among_size_eligible_candidates" if fit else "max_silhouette_no_candidate_met_size_constraints"
    return [r | {"selected": r is best, "rule": rule} for r in records], centres


def assign(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster): the nearest centre of each vector, ties to the smaller number."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_squared(x, centres).argmin(1), pa.int32())], names=["id", "cluster"])

    return df.select("id", "x").mapInArrow(run, f"id {kind}, cluster int")
