"""The filter audit and the clusters against plain loops, with defined cases."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from evalweave.llm import audit, centroids

SCHEMA = "doc_id long, text string, source string, mask string, n int"


def plain_audit(rows, labels):
    """(part, order, step) -> figures, document by document."""
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(text or "", []).append(i)
    docs = []
    for i, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)}
        fails |= {"D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i for j in ids[text])}
        quality, toxic = labels.get(i, (0, 0))
        docs.append((source or "", fails, quality == 1, toxic == 1))
    out = {}
    for part in {d[0] for d in docs}:
        own, shares = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = list(own)
            for step, f in enumerate(order, 1):
                removed = [d for d in alive if d[1][f]]
                gone = [d for d in own if not any(d is a for a in alive)]
                alive = [d for d in alive if not d[1][f]]
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, order, step] = [len(alive), len(removed), sum(d[1][f] for d in gone), only, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shares[f] += len(removed)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shares[f])
    return out


def test_audit_against_loops(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["word", "Other", "THIRD", "x$", "é", "fifth", f"n{rng.randrange(99)}"]) for _ in range(rng.choice([0, 3, 49, 50, 80]))) for _ in range(12)]
    texts += ["", None, " \t\n", "a\x0bb\x0cc\rd", "ÀÉ É", "z " * 60, " ".join(f"u{i}" for i in range(70))]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["a", "b", "", None]), "own", 7) for _ in range(80)]
    labels = {i: (rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(0, 30, 2)}
    known = spark.createDataFrame([(i, q, t, "x") for i, (q, t) in labels.items()] + [(None, 1, 1, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, part string")
    found = audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), known).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(got) == len(found) == 600 * len({r[2] or "" for r in rows})
    assert got == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", "s", "", 0), (2, "a b", "s", "", 0)], SCHEMA)
    assert audit.audit(docs.limit(0), labels).collect() == []
    found = audit.audit(docs, labels, {"A": "n_words > 5"}).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in found) == [("AE", 1, 2, 0, 0), ("AE", 2, 1, 1, 2), ("EA", 1, 1, 1, 2), ("EA", 2, 1, 0, 0)]


def plain_lloyd(rows, k, rounds, dims, salt):
    """Lists of whole numbers, every vector against every centroid."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [v for _, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    deal = lambda: [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
    for _ in range(rounds):
        own = deal()
        for j in range(len(now)):
            members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if members:
                now[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = deal()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    within = [sum(d for d, c in own if c == j) for j in range(len(now))]
    return sorted((i if i is not None else -1, c, d, within[c], sum(within), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_plain_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.6, size=5)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(100)]  # one vector, many times
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("-inf")] * 5), (905, [])]
    df = spark.createDataFrame([(i, v, "c", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(6)
    found = centroids.assignments(df, k=9, dims=5)
    assert sorted((r.vec_id if r.vec_id is not None else -1, *r[1:]) for r in found.collect()) == plain_lloyd(rows, 9, 5, 5, "2:")


def test_few_large_and_no_vectors(spark):
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 3e4]), (3, [1e6, 0.004])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clipped = [(i, [max(-(2**19), min(2**19, x)) for x in v]) for i, v in rows]  # 2^27 / 256
    assert sorted(tuple(r) for r in centroids.assignments(df, k=40, dims=2).collect()) == plain_lloyd(clipped, 40, 5, 2, "2:")
    assert centroids.assignments(df.limit(0)).collect() == []
    assert centroids.assignments(df, dims=64).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
