"""Decomposition, clusters and source shift against plain numpy and loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions import stats
from evalweave.operators import clustering, decomposition, shift
from evalweave.plans import structure

DATA = "/root/testdata/sf0.001"


def dense_of(entries):
    rows, features = sorted({r for r, _, _ in entries}), sorted({f for _, f, _ in entries})
    m = np.zeros((len(rows), len(features)))
    for r, f, v in entries:
        m[rows.index(r), features.index(f)] += v
    return rows, features, m / np.linalg.norm(m, axis=1, keepdims=True)


def angle(a, b):
    """Sine of the greatest angle between two column spaces."""
    a, b = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.norm(a - b @ (b.T @ a), 2)


def test_svd_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(decomposition, "BLOCK", 64)
    rng = np.random.default_rng(1)
    core = rng.normal(size=(200, 6)) * np.array([9, 7, 5, 4, 3, 2]) @ rng.normal(size=(6, 90)) + 0.05 * rng.normal(size=(200, 90))
    core[rng.random(core.shape) < 0.7] = 0
    entries = [(f"r{i}", j, float(core[i, j])) for i in range(200) for j in range(90) if core[i, j]]
    rows, features, m = dense_of(entries)
    df = spark.createDataFrame([*entries, ("r0", 5, 0.0), (None, 1, 1.0), ("r1", None, 1.0)], "row string, feature long, value double")
    normalised = decomposition.l2_normalised(df)
    found = decomposition.truncated_svd(normalised, k=5)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(found.values, s[:5], rtol=1e-4)  # a flat spectrum, after seven passes
    left = {r.row: r.u for r in found.left.collect()}
    right = {r.feature: r.v for r in found.right.collect()}
    a, b = np.array([left[r] for r in rows]), np.array([right[f] for f in features])
    assert len(left) == len(rows) and len(right) == len(features)
    assert angle(a, u[:, :5]) < 0.02 and angle(b, vt[:5].T) < 0.02
    assert np.allclose(a.T @ a, np.eye(5), atol=1e-8) and np.allclose(b.T @ b, np.eye(5), atol=1e-8)
    z = a * found.values
    assert np.allclose(found.explained, z.var(0) / m.var(0).sum(), rtol=1e-8)
    with pytest.raises(ValueError, match="two rows"):
        decomposition.truncated_svd(normalised.where("row = 'r0'"))


def test_svd_of_a_matrix_of_low_rank(spark):
    entries = [(i, j, float((i % 3 == j % 3) + 0.0)) for i in range(30) for j in range(12) if i % 3 == j % 3]
    found = decomposition.truncated_svd(spark.createDataFrame(entries, "row long, feature long, value double"), k=8)
    want = np.linalg.svd(dense_of(entries)[2] * 2, compute_uv=False)  # rows of length 2
    assert np.allclose(found.values, want[:8], atol=1e-6)


def test_embeddings_against_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    found = decomposition.truncated_svd(structure.vector_entries(spark, DATA))
    assert np.allclose(found.values, s[:50], rtol=1e-6)
    left = {r.row: r.u for r in found.left.collect()}
    assert angle(np.array([left[r.vec_id] for r in rows]), u[:, :50]) < 1e-3


def plain_silhouette(x, own):
    """Squared distances between all pairs."""
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    total = []
    for i in range(len(x)):
        mine = own == own[i]
        if mine.sum() < 2:
            total.append(0.0)
            continue
        a = d[i][mine].sum() / (mine.sum() - 1)
        b = min((d[i][own == c].mean() for c in set(own.tolist()) if c != own[i]), default=math.inf)
        total.append((b - a) / max(a, b) if math.isfinite(b) and max(a, b) > 0 else 0.0)
    return float(np.mean(total))


def test_sweep_against_numpy(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 6)) * 3
    x = np.vstack([centres[i % 8] + rng.normal(scale=0.4, size=6) for i in range(240)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    records, found = clustering.sweep(df, (3, 8, 20, 400), rounds=15)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r["k"] for r in records] == [3, 8, 20]
    for r in records:
        own = clustering._squared(unit, found[r["k"]]).argmin(1)
        assert {q.id: q.cluster for q in clustering.assign(df, found[r["k"]]).collect()} == dict(enumerate(own.tolist()))
        sizes = np.bincount(own, minlength=r["k"])
        assert (r["least"], r["median"], r["largest"]) == (sizes.min(), np.median(sizes), sizes.max())
        assert abs(r["largest_share"] - sizes.max() / 240) < 1e-12 and abs(r["in_others"] - sizes[sizes >= 5].sum() / 240) < 1e-12
        assert abs(r["silhouette"] - plain_silhouette(unit, own)) < 1e-9
    fit = [r for r in records if r["in_others"] >= 0.95 and r["largest_share"] <= 0.25]
    best = max(fit or records, key=lambda r: r["silhouette"])
    assert [r["k"] for r in records if r["selected"]] == [best["k"]] and len({r["rule"] for r in records}) == 1
    # plain Lloyd from the same first centres
    start = clustering.first_centres(clustering.unit(np.array([r.x for r in df.orderBy(F.xxhash64(F.lit(42), "id"), "id").collect()])), 8, 42)
    for _ in range(15):
        own = clustering._squared(unit, start).argmin(1)
        start = np.array([unit[own == c].mean(0) if (own == c).any() else start[c] for c in range(8)])
    assert np.allclose(found[8], start, atol=1e-9)


def test_associations_against_loops(spark):
    rng = np.random.default_rng(3)
    sources = {i: "abc"[rng.integers(3)] for i in range(90)}
    calls = [(i, f"f{j}") for i in range(90) for j in range(8) if rng.random() < (0.7 if (j == 0 and sources[i] == "a") else 0.1 + 0.05 * j)]
    found = shift.source_associations(spark.createDataFrame(calls + calls[:5], "sample long, feature string"), spark.createDataFrame(list(sources.items()), "sample long, source string")).collect()
    assert len(found) == 3 * len({f for _, f in calls})
    by = defaultdict(list)
    for r in found:
        a = sum(sources[i] == r.source for i, f in calls if f == r.feature)
        c = sum(sources[i] != r.source for i, f in calls if f == r.feature)
        n = sum(s == r.source for s in sources.values())
        assert (r.present, r.absent, r.other_present, r.other_absent) == (a, n - a, c, 90 - n - c)
        assert abs(r["shift"] - (a / n - c / (90 - n))) < 1e-12 and abs(r.p - stats._fisher(a, n - a, c, 90 - n - c)) < 1e-12
        by[r.source].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.p)
        for i, r in enumerate(rows):
            q = min(1.0, *(s.p * len(rows) / (j + 1) for j, s in enumerate(rows) if j >= i))
            q = min(q, *(s.p * len(rows) / (max(k for k, t in enumerate(rows) if t.p == s.p) + 1) for s in rows if s.p >= r.p))
            assert abs(r.q - q) < 1e-9
            assert r.marker == (r.q <= 0.01 and abs(r["shift"]) >= 0.2)
    assert any(r.marker for r in found if (r.source, r.feature) == ("a", "f0"))


def test_classifier_is_out_of_fold(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    rows = [(i, i % 40, float(i % 3), (rng.normal(size=4) + np.eye(4)[i % 3] * 3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "sample long, group long, label double, x array<double>").withColumn("features", array_to_vector("x")).withColumn("fold", (F.col("group") % 5).cast("int"))
    seen = []

    def fit(train):
        seen.append({r["group"] for r in train.select("group").distinct().collect()})
        return lambda test: test.withColumn("predicted", F.lit(float(len(seen))))

    parts = shift.out_of_fold(df, fit, 5).collect()
    assert sorted(r.sample for r in parts) == list(range(400)) and all(r["group"] not in seen[int(r.predicted) - 1] for r in parts)
    found = shift.source_classifier(df)
    out = found.collect()
    table = shift.recall_table(found.withColumn("scheme", F.lit("s")), ["scheme"]).collect()
    recall = {c: np.mean([r.predicted == c for r in out if r.label == c]) for c in (0.0, 1.0, 2.0)}
    assert sorted(r.sample for r in out) == list(range(400)) and min(recall.values()) > 0.8
    for r in table:
        assert r.n == sum(q.label == r.label for q in out) and abs(r.recall - recall[r.label]) < 1e-12 and abs(r.balanced_accuracy - np.mean(list(recall.values()))) < 1e-12


def plain_js(a, b):
    total = 0.0
    for k in set(a) | set(b):
        p, q = a[k] / sum(a.values()), b[k] / sum(b.values())
        m = (p + q) / 2
        total += sum(x * math.log2(x / m) for x in (p, q) if x > 0) / 2
    return total


def test_anomaly_against_a_loop_over_sources(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if rng.random() < 0.6 else f"s{rng.integers(12)}", float(rng.integers(101)) / 100, "xyz"[rng.integers(3)], bool(rng.random() < 0.3), None if i % 9 == 0 else bool(i % 2)) for i in range(300)]
    rows += [("lonely", 0.05, "w", True, True)] * 3 + [(None, 0.5, "x", False, False)]
    found = shift.source_anomaly(spark.createDataFrame(rows, "source string, p double, family string, g boolean, h boolean"), {"g": F.col("g"), "h": F.col("h")}).collect()
    assert [r.source for r in sorted(found, key=lambda r: r.rank)] == [r.source for r in sorted(found, key=lambda r: (-round(r.anomaly, 12), r.source))]
    assert {r.source for r in found} == {r[0] or "" for r in rows}
    for r in found:
        own, rest = [x for x in rows if (x[0] or "") == r.source], [x for x in rows if (x[0] or "") != r.source]
        score = plain_js(*(Counter(min(9, math.floor(x[1] * 10)) for x in part) for part in (own, rest)))
        family = plain_js(*(Counter(x[2] for x in part) for part in (own, rest)))
        gap = np.mean([abs(np.mean([bool(x[k]) for x in own]) - np.mean([bool(x[k]) for x in rest])) for k in (3, 4)])
        assert r.n == len(own) and r.eligible == (len(own) >= 10)
        assert np.allclose([r.score_js, r.family_js, r.gene_gap, r.anomaly], [score, family, gap, 0.4 * score + 0.4 * family + 0.2 * gap], atol=1e-9)
    one = shift.source_anomaly(spark.createDataFrame([("a", 0.1, "x", True, False)] * 2, "source string, p double, family string, g boolean, h boolean"), {"g": F.col("g")}).collect()
    assert [(r.n, r.anomaly) for r in one] == [(2, None)]


def test_a_tile_is_multiplied_only_as_far_as_its_cells_reach(monkeypatch):
    made, zeros = [], np.zeros
    r, c, v, factor = np.array([0, 3, 511]), np.array([2, 24, 7]), np.array([1.0, -2.0, 0.5]), np.arange(512.0 * 14).reshape(512, 14)
    monkeypatch.setattr(decomposition.np, "zeros", lambda shape, *rest: made.append(shape) or zeros(shape, *rest))
    found = decomposition.tile_product(r, c, v, factor, 512)
    monkeypatch.undo()
    whole = np.zeros((512, 512))
    whole[r, c] = v
    assert np.array_equal(found, whole @ factor) and made[0] == (512, 25)


def test_the_classifier_sees_equal_rows_once(spark, monkeypatch):
    """Rows that repeat are weights of one row, and the predictions are those of the repeated rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    seen, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    rows = [(i, i % 5, float(c), [float(c == 0), float(c == 1), 1.0]) for i in range(300) for c in [i % 3 if i % 7 else 2]]
    df = spark.createDataFrame(rows, "sample long, fold int, label double, x array<double>").withColumn("features", array_to_vector("x"))
    found = shift.source_classifier(df).collect()
    assert seen == [3] * 5 and sorted(r.sample for r in found) == list(range(300)) and all(r.predicted == r.label for r in found)


def test_tiles_come_to_python_a_few_at_a_time(spark, monkeypatch):
    """However many tiles a task has, a batch of them is of bounded size."""
    rows, kept = spark.range(10_000).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("feature")), "spark.sql.execution.arrow.maxBytesPerBatch"
    rows, before, seen = rows.withColumn("value", F.rand(1)).coalesce(1), spark.conf.get(kept), spark.sparkContext.accumulator(0)
    spark.conf.set(kept, "64m")
    own = decomposition._product

    def product(tiles, dense, width, transposed):
        sizes = tiles.coalesce(1).mapInArrow(lambda batches: (b.select([]).from_arrays([[b.nbytes]], ["bytes"]) for b in batches), "bytes long").agg(F.max("bytes")).first()[0]
        seen.add(1)
        assert sizes <= 6 << 20
        return own(tiles, dense, width, transposed)

    monkeypatch.setattr(decomposition, "_product", product)
    try:
        decomposition.truncated_svd(rows, k=2, iterations=1)
        assert seen.value == 4 and int(spark.conf.get(kept)) == 4 << 20
    finally:
        spark.conf.set(kept, before)


def test_equal_sets_are_one_row_of_their_weight(spark):
    """Values, vectors and shares are those of the matrix with every row, which is decomposed over a few rows."""
    rng = np.random.default_rng(3)
    kinds = [sorted({f"f{j}" for j in rng.choice(9, size=rng.integers(1, 5))}) for _ in range(40)]
    sets = {i: kinds[int(40 * rng.random() ** 2)] for i in range(500)}
    df = spark.createDataFrame([(i, f) for i, fs in sets.items() for f in fs], "row long, feature string")
    plain = decomposition.truncated_svd(decomposition.l2_normalised(df.withColumn("value", F.lit(1.0))), k=3)
    cells, weights = decomposition.equal_sets(df.groupBy("row").agg(F.array_sort(F.collect_set("feature")).alias("features")))
    weight = {r.row: r.weight for r in weights.collect()}
    assert sum(weight.values()) == 500 and len(weight) == len({tuple(fs) for fs in sets.values()}) < 41
    found = decomposition.truncated_svd(decomposition.l2_normalised(cells.withColumn("value", F.lit(1.0))), k=3, weights=weights)
    assert np.allclose(found.values, plain.values, rtol=1e-10) and np.allclose(found.explained, plain.explained, rtol=1e-8)
    right = [{r.feature: np.array(r.v) for r in d.right.collect()} for d in (found, plain)]
    signs = np.sign(sum(right[0][f] * right[1][f] for f in right[0]))
    assert right[0].keys() == right[1].keys() and all(np.allclose(right[0][f] * signs, right[1][f], atol=1e-7) for f in right[0])
    named = {r.row: tuple(sorted(r.features)) for r in cells.groupBy("row").agg(F.collect_list("feature").alias("features")).collect()}
    left = {named[r.row]: np.array(r.u) for r in found.left.collect()}
    assert all(np.allclose(left[tuple(sets[r.row])] * signs, r.u, atol=1e-7) for r in plain.left.collect())


def test_calls_are_decomposed_by_their_sets(spark, monkeypatch, tmp_path):
    """However many samples have the same features; samples and features that are null don't count."""
    made = []
    own = decomposition.truncated_svd
    monkeypatch.setattr(decomposition, "truncated_svd", lambda entries, **more: made.append((entries.count(), more["weights"].agg(F.sum("weight")).first()[0])) or own(entries, **more))
    sets = [(1,), (1, 2), (2, 3), (1, 2, 3), (4,), (3, 4)]
    lines = [(i, j) for i in range(600) for j in sets[i * i % 6] * 2] + [(None, 1), (None, 2), (5, 9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(j, f"brand {j}") for j in range(5)] + [(9, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.feature: (r.first, r.second) for r in structure.svd_of_calls(spark, str(tmp_path)).collect()}
    kinds = {sets[i * i % 6] for i in range(600)}
    assert made == [(sum(map(len, kinds)), 600)]
    rows, features, m = dense_of([(i, f"brand {j}", 1.0) for i in range(600) for j in sets[i * i % 6]])
    v = np.linalg.svd(m, full_matrices=False)[2][:2]
    v *= np.sign(v[np.arange(2), np.abs(v).argmax(1)])[:, None]
    assert list(found) and np.allclose([found[f] for f in features], v.T, atol=2e-4)
