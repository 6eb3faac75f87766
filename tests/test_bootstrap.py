"""The cluster bootstrap against a replay in plain Python with the same multiplicities."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import resampling
from evalweave.plans import models

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("groups", [1, 2, 3, 7, 64, 100])
def test_multiplicities(groups):
    draws = 4000
    picks = resampling.Multiplicities(groups, draws, 5)
    each = np.stack([picks.run(i, 1) for i in range(groups)])
    assert (each.sum(0) == groups).all() and (each >= 0).all()
    assert (resampling.Multiplicities(groups, draws, 5).run(0, groups) == groups).all()
    for first, n in ((0, groups // 2), (groups // 3, groups - groups // 3), (groups - 1, 1)):
        # another task makes the same ones, as a sum
        assert (resampling.Multiplicities(groups, draws, 5).run(first, n) == each[first : first + n].sum(0)).all()
    if groups > 1:
        p = 1 / groups
        spread = groups * p * (1 - p)
        assert np.abs(each.mean(1) - 1).max() < 6 * (spread / draws) ** 0.5
        assert np.abs(each.var(1) / spread - 1).max() < 0.25
        covariance = np.cov(each)[np.triu_indices(groups, 1)]
        assert abs(covariance.mean() + 1 / groups) < 0.02
    other = resampling.Multiplicities(groups, draws, 6).run(0, 1)
    assert groups == 1 or (other != each[0]).any()


def replayed(rows, cell, draws, seed):
    """(cell, draw) -> confusion counts, row by row; types are numbered as the library numbers them."""
    cells = rows.groupBy("group", *cell).agg(*models.stats.confusion(F.col("y"), F.col("pred")))
    types = resampling.group_types(cells, cell, models.COUNTS).collect()
    numbers = {tuple(t.cells): (t.first, t.n) for t in types}
    own = collections.defaultdict(list)
    for r in cells.collect():
        own[r.group].append(tuple(r[c] for c in [*cell, *models.COUNTS]))
    total = sum(t.n for t in types)
    assert total == len(own) == rows.select("group").distinct().count()
    assert sorted((f, n) for f, n in numbers.values())[0][0] == 0 and sum(n for _, n in numbers.values()) == total
    picks, taken = resampling.Multiplicities(total, draws, seed), collections.Counter()
    found = collections.defaultdict(lambda: np.zeros((draws, 4), np.int64))
    added = np.zeros(draws, np.int64)
    for entries in own.values():
        key = tuple(sorted(entries))
        first, n = numbers[key]
        w = picks.run(first + taken[key], 1)  # each group of a type by itself
        taken[key] += 1
        assert taken[key] <= n
        added += w
        for e in entries:
            found[e[: len(cell)]] += w[:, None] * np.array(e[len(cell) :])
    assert (added == total).all()
    return found


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(models, "DRAWS", 60)
    monkeypatch.setattr(resampling, "BLOCK", 25)


def predictions(spark):
    rows = models.predictions(spark, DATA).where("scheme = 'mod5'")
    # some rows are groups of their own
    source = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source"))
    return rows.withColumn("group", resampling.own_group(source, F.col("doc_id")))


def test_totals_and_macro_means(spark, few):
    rows = predictions(spark)
    plain = replayed(rows, ["fold", "model"], 60, models.SEED)
    by = models.resampled_metrics(rows, ["fold", "model"]).collect()
    totals = resampling.resampled_totals(rows.groupBy("group", "fold", "model").agg(*models.stats.confusion(F.col("y"), F.col("pred"))), ["fold", "model"], models.COUNTS, 60, models.SEED)
    got = {(r.fold, r.model, r.draw): (r.tp, r.fn, r.tn, r.fp) for r in totals.collect()}
    assert got == {(*k, d): tuple(v[d].tolist()) for k, v in plain.items() for d in range(60)}
    assert len(by) == len(got)


def test_bootstrap_queries_against_replay(spark, few):
    data = models.predictions(spark, DATA).where("scheme = 'mod5'").withColumn("group", resampling.own_group(F.col("source"), F.col("doc_id")))
    plain = replayed(data, ["fold", "model"], 60, models.SEED)
    values = collections.defaultdict(list)
    for d in range(60):
        for m in "AB":
            folds = [plain[f, m][d] for f in range(5)]
            if all(tp + fn > 0 and tn + fp > 0 for tp, fn, tn, fp in folds):
                values[m].append(np.mean([(tp / (tp + fn) + tn / (tn + fp)) / 2 for tp, fn, tn, fp in folds]))
    found = {r.model: r for r in models.cluster_bootstrap(spark, DATA).collect()}
    for m, r in found.items():
        assert r.valid == len(values[m]) and abs(r.valid_share - r.valid / 60) < 1e-12 and r.enough == (r.valid >= resampling.least_valid(60))
        assert np.allclose([r.low, r.median, r.high, r["mean"]], [*np.quantile(values[m], [0.025, 0.5, 0.975]), np.mean(values[m])], atol=1e-8)
    whole = replayed(data, ["model"], 60, models.SEED)
    ba = {m: [(tp / (tp + fn) + tn / (tn + fp)) / 2 if tp + fn and tn + fp else np.nan for tp, fn, tn, fp in whole[(m,)]] for m in "AB"}
    gap = np.array(ba["B"]) - np.array(ba["A"])
    gap = gap[np.isfinite(gap)]
    r = models.paired_contrasts(spark, DATA).first()
    assert r.valid == len(gap) and np.allclose([r.above, r.below, r.low, r.high], [(gap > 0).mean(), (gap < 0).mean(), *np.quantile(gap, [0.025, 0.975])], atol=1e-8)


def test_floor(spark, few):
    assert [resampling.least_valid(n) for n in (20, 60, 99, 100, 1000, 10_000)] == [25, 48, 79, 500, 800, 8000]
    summary = spark.createDataFrame([("a", 50), ("b", 47)], "k string, valid long")
    assert [(r.k, r.enough) for r in resampling.with_floor(summary, 60).orderBy("k").collect()] == [("a", True), ("b", False)]
    assert resampling.require_floor(summary.where("k = 'a'"), 60).first().valid == 50
    with pytest.raises(Exception, match="too few valid draws: 47 of 60, required 48"):
        resampling.require_floor(summary, 60).collect()


def test_no_rows(spark, few):
    cells = spark.createDataFrame([], "group string, fold long, tp long, fn long, tn long, fp long")
    assert resampling.resampled_totals(cells, ["fold"], models.COUNTS, 60, 1).collect() == []
    assert resampling.resampled_ranks(spark.createDataFrame([], "group string, score double, y int"), 60, 1).collect() == []


def test_rank_metrics_in_every_draw(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{rng.integers(9)}", float(rng.integers(12)) / 4, int(rng.integers(2))) for _ in range(300)] + [("g1", None, 1), ("g10", 5.0, 1)]
    df = spark.createDataFrame(rows, "group string, score double, y int")
    found = {r.draw: r for r in resampling.resampled_ranks(df, 40, 9).collect()}
    names = sorted({g for g, s, _ in rows if s is not None})
    picks = resampling.Multiplicities(len(names), 40, 9)
    weights = {g: picks.run(i, 1) for i, g in enumerate(names)}
    assert sorted(found) == list(range(40))
    for d in range(40):
        at = collections.defaultdict(lambda: [0, 0])
        for g, s, y in rows:
            if s is not None:
                at[s][y] += int(weights[g][d])
        p, n = sum(v[1] for v in at.values()), sum(v[0] for v in at.values())
        wins = sum(at[s][1] * (sum(at[t][0] for t in at if t < s) + at[s][0] / 2) for s in at)
        gained = sum(at[s][1] * sum(at[t][1] for t in at if t >= s) / max(1, sum(sum(at[t]) for t in at if t >= s)) for s in at if at[s][1])
        r = found[d]
        assert (r.positives, r.negatives) == (p, n) and abs(r.auroc - wins / (p * n)) < 1e-12 and abs(r.ap - gained / p) < 1e-12


def test_anchor_trials_against_loops(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "hot" if i % 2 else f"s{i % 5}", f"g{rng.integers(14)}", int(rng.random() < 0.3)) for i in range(160)] + [(900 + i, "tiny", f"t{i}", 1) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, source string, group string, wrong int")
    budgets, trials, seed = [2, 6], 4, 3
    hashed = lambda salt, key: {(r.trial, r[1]): r.h for r in df.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), key).distinct().select("trial", key, F.xxhash64(F.lit(seed), F.lit(salt), "trial", key).alias("h")).collect()}
    by_row, by_group = hashed("row", "id"), hashed("group", "group")
    want = {}
    for mode in ("iid", "group_disjoint"):
        for k in budgets:
            for t in range(trials):
                for source in {r[1] for r in rows}:
                    own = [r for r in rows if r[1] == source]
                    groups = sorted({r[2] for r in own}, key=lambda g: (by_group[t, g], g))
                    if len(own) < max(10, k + 5) or mode != "iid" and len(groups) < k:
                        continue
                    if mode == "iid":
                        ordered = sorted(own, key=lambda r: (by_row[t, r[0]], r[0]))
                        anchors, rest = ordered[:k], ordered[k:]
                    else:
                        anchors = [min((r for r in own if r[2] == g), key=lambda r: (by_row[t, r[0]], r[0])) for g in groups[:k]]
                        rest = [r for r in own if r[2] not in groups[:k]]
                    if len(rest) >= 5:
                        want[mode, k, t, source] = (len(anchors), sum(r[3] for r in anchors), len(rest), sum(r[3] for r in rest))
    found = resampling.anchor_trials(df, budgets, trials, seed)
    got = {(r["mode"], r.budget, r.trial, r.source): (r.anchors, r.anchor_wrong, r.rest, r.rest_wrong) for r in found.collect()}
    assert got == want
    for r in resampling.flagged_sources(found).collect():
        own = collections.defaultdict(dict)
        for (mode, k, t, source), v in want.items():
            if (mode, k) == (r["mode"], r.budget):
                own[t][source] = v
        picked = [(min(v.items(), key=lambda x: (-x[1][1] / x[1][0], x[0])), sum(x[3] for x in v.values())) for v in own.values() if len(v) >= 3]
        assert r.trials == len(picked)
        assert abs(r.mean_rest_error - np.mean([f[1][3] / f[1][2] for f, _ in picked])) < 1e-12
        assert abs(r.mean_capture - np.mean([f[1][3] / n for f, n in picked if n])) < 1e-12


def test_calibration_fit_without_a_slope(spark):
    from evalweave.operators import evaluation

    rows = lambda *r: spark.createDataFrame(list(r), "y int, score double")
    for df in (rows((1, 0.4), (0, 0.4)), rows((1, 0.4)), rows((1, 0.4)).limit(0)):
        assert evaluation.calibration_fit(df) == (None, None)
