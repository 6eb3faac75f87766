"""Sketch pairs against all pairs: none within the cut-off is missed, distances and confirmations are those of plain sets."""

import math
import random

import pytest

from evalweave.operators import sketches


def kmers(text, k):
    k = min(k, len(text))
    return {text[i : i + k] for i in range(len(text) - k + 1)} if text else set()


def corpus():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    base, line = prose(120), prose(12)
    rows = []
    for i in range(40):
        words = base.split()
        for _ in range(rng.choice([0, 0, 1, 3, 8, 30])):
            words[rng.randrange(120)] = "changed"
        rows.append((" ".join(words)))
    rows += [prose(rng.randint(5, 90)) + " " + line for _ in range(40)] + [base] * 5 + ["short", "short", "", None, "abc" * 200, "abc" * 300]
    return [(i, ("a", "b", "c")[rng.randrange(3)] if i % 17 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "size", "most"), [(21, 1000, 0.05), (11, 60, 0.1), (5, 16, 0.02)])
def test_pairs_against_all_pairs(spark, k, size, most):
    rows = corpus()
    found = sketches.sketch_pairs(spark.createDataFrame(rows, "id long, cohort string, text string").repartition(4), k, size, most)
    got = {(r.cohort_a, r.a, r.cohort_b, r.b): r for r in found.collect()}
    classes = {}
    for i, c, t in rows:
        if c and t:
            classes.setdefault((c, t), []).append(i)
    hashed = {t: sketches.kmer_hashes(t, k).tolist() for _, t in classes}
    assert all(len(h) == len(kmers(t, k)) and h == sorted(h) for t, h in hashed.items())
    want = {}
    for (c, t), own in classes.items():
        for (d, u), other in classes.items():
            if c >= d:
                continue
            x, y = set(hashed[t][:size]), set(hashed[u][:size])
            union = sorted(x | y)[:size]
            j = len(x & y & set(union)) / len(union)
            if j and max(0.0, -math.log(2 * j / (1 + j)) / k) <= most:
                want[c, min(own), d, min(other)] = (j, t, u, len(own), len(other))
    assert set(got) == set(want) and len(want) > 10
    for key, (j, t, u, n, m) in want.items():
        r, x, y = got[key], kmers(t, k), kmers(u, k)
        assert (r.copies_a, r.copies_b) == (n, m) and abs(r.distance - max(0.0, -math.log(2 * j / (1 + j)) / k)) < 1e-12
        assert abs(r.jaccard - len(x & y) / len(x | y)) < 1e-12 and abs(r.coverage - len(x & y) / min(len(x), len(y))) < 1e-12
        assert r.confirmed == (r.jaccard >= sketches.least_similarity(0.05, k) and r.coverage >= 0.6)


def test_recall_against_whole_sets(spark):
    """Of the pairs that the whole sets put within the cut-off, by a margin for the sketch's error, nine tenths are found."""
    rows = corpus()
    found = {(r.a, r.b) for r in sketches.sketch_pairs(spark.createDataFrame(rows, "id long, cohort string, text string"), size=200).collect()}
    least, classes = sketches.least_similarity(sketches.MOST, 21), {}
    for i, c, t in rows:
        if c and t:
            classes.setdefault((c, t), i)
    near = {(i, j) for (c, t), i in classes.items() for (d, u), j in classes.items() if c < d and len(kmers(t, 21) & kmers(u, 21)) >= least * len(kmers(t, 21) | kmers(u, 21))}
    assert len(near) > 50 and len(near & found) >= 0.9 * len(near)


def test_no_pairs(spark):
    none = spark.createDataFrame([], "id long, cohort string, text string")
    assert sketches.sketch_pairs(none).collect() == []
    one = spark.createDataFrame([(1, "a", "the same"), (2, "a", "the same"), (3, None, "the same"), (4, "b", None)], "id long, cohort string, text string")
    assert sketches.sketch_pairs(one).collect() == []


def test_a_hash_is_shuffled_once(spark):
    """Of an entry of a sketch a number and the hash move, once: under 24 bytes."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    rng = random.Random(4)
    rows = [(i, "abc"[i % 3], "".join(rng.choice("abcdefghijklmnop") for _ in range(1200))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, cohort string, text string")
    before = written()
    assert sketches.sketch_pairs(df).collect() == []
    assert written() - before < 600 * 1200 * 2 + 600 * 1000 * 24


def test_sets_against_all_pairs(spark):
    """No pair is missed, and texts that only share a frequent line don't meet at it."""
    rng, line = random.Random(6), list(range(40))
    sets = []
    for _ in range(60):
        own = [rng.randrange(1 << 40) for _ in range(rng.randint(1, 160))] + line
        sets += [own, own[: len(own) * 9 // 10], own + [rng.randrange(1 << 40) for _ in range(len(own) // 4)]]
    found = sketches.similar_sets(spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "row long, sketch array<long>"), 0.2).collect()
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): share(sets[i], sets[j]) for j in range(len(sets)) for i in range(j) if 1 - share(sets[i], sets[j]) < 0.2}
    assert {(r.a, r.b): r.jaccard for r in found} == want and len(want) > 100


def records(spark):
    """Rows that all shuffles so far have written."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_entries_move_in_runs(spark):
    """Entries of sketches are no rows of Spark's: 600,000 of them move in some thousand rows."""
    rng = random.Random(4)
    rows = [(i, "abc"[i % 3], "".join(rng.choice("abcdefghijklmnop") for _ in range(1200))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, cohort string, text string").repartition(4)
    before = records(spark)
    assert sketches.sketch_pairs(df).collect() == []
    assert 0 < records(spark) - before < 30_000


def test_near_texts_meet_as_blocks(spark, monkeypatch):
    """150 texts that are near each other are 3 blocks, so 6 tiles instead of 11,175 pairs; judged tile by tile or at once, the pairs are the same."""
    rng = random.Random(8)
    base = [rng.choice("abcdefghijklmnop") for _ in range(1500)]
    rows = []
    for i in range(150):
        own = list(base)
        own[9 * i] = "z"
        rows += [(i, "".join(own)), (1000 + i, "".join(rng.choice("abcdefghijklmnop") for _ in range(300)))]
    texts = spark.createDataFrame(rows, "row long, text string").repartition(4)
    lead = sketches.leads(sketches.sketches(texts), sketches.least_similarity(0.05, 21))
    places, found = sketches.tiles(lead)
    assert places.count() == 150 and {(r.block, r.other) for r in found.collect()} == {(i, j) for j in range(3) for i in range(j + 1)}
    members = texts.selectExpr("row", "array('a', 'b', 'c')[int(row % 3)] AS cohort")
    once = {tuple(r) for r in sketches.judged_pairs(texts, lead, members).collect()}
    monkeypatch.setattr(sketches, "RUN", 1)
    assert {tuple(r) for r in sketches.judged_pairs(texts, lead, members).collect()} == once and len(once) == 150 * 100 // 2
