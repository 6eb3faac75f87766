"""Nearest-neighbour quality: terms and votes against plain loops, held-out labels, scores independent of partitions."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import quality

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"


def one_bucket(key):
    return int(quality._bucket(np.array([key % 2**64], np.uint64))[0])


def plain_terms(text):
    """The terms of one text, one by one."""
    found, data, odd = Counter(), text.encode(), int(quality.ODD)
    kinds = [int(quality.CLASSES[b]) for b in data]
    for n in quality.RUNS:
        for at in range(len(data) - n + 1):
            key = 0
            for c in kinds[at : at + n]:
                key = (key * 257 + c + 1) % 2**64
            found[one_bucket(key * 31 + n)] += 1
    words = []
    for word in data.split():
        total = 0
        for i, b in enumerate(word):
            mixed = (b + 7) * (i * odd + 0x100000001B3) % 2**64
            total += mixed ^ (mixed >> 29)
        words.append(total % 2**64)
    found.update(map(one_bucket, words))
    for lag in range(1, quality.LAGS + 1):
        found[one_bucket(lag * 0xABCDEF)] += sum(a == b for a, b in zip(words[lag:], words, strict=False))
    return +found


TEXTS = ["", " ", "a", "One two  two three\ttwo\nTWO two", "ää$$$ ÄÖ 12 | 3", "x" * 50, "same same same same", "tail "]


def test_terms_against_loops():
    counts = quality.term_counts(pa.array(TEXTS))
    for row, text in zip(counts, TEXTS, strict=True):
        assert {i: int(row[i]) for i in np.flatnonzero(row)} == dict(plain_terms(text)), text
    assert (quality.term_counts(pa.array(["front", *TEXTS]).slice(1)) == counts).all()
    assert quality.term_counts(pa.array([], pa.string())).shape == (0, quality.BUCKETS)


def test_votes_against_loops():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)])
    texts = [" ".join(rng.choice(words[:40] if i % 2 else words[20:], 30)) for i in range(700)]
    counts = quality.term_counts(pa.array(texts))
    idf = quality.inverse_frequencies(np.append((counts > 0).sum(0), len(texts)))
    label = np.arange(600) % 2
    model = quality.fit(counts[:600], label, idf, (3000, 1000), rank=20)
    found = model.text_scores(pa.array(texts[600:] + [texts[3], ""]))
    own = model.embed(counts)
    for i in range(100):
        ranked = sorted(range(600), key=lambda j: (-int(own[600 + i] @ model.vectors[j]), j))[: quality.NEIGHBOURS]
        votes = [max(0, int(own[600 + i] @ model.vectors[j])) * (10 / 3 if label[j] else 10) for j in ranked]
        want = sum(v for v, j in zip(votes, ranked, strict=True) if label[j]) / sum(votes)
        assert math.isclose(found[i], want, abs_tol=1e-12)
    assert found[-1] == 0.25  # no terms: the share of label 1
    # the directions span what numpy's decomposition of the same weights spans
    rows = quality.weighted(counts[:600], idf)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    _, values, right = np.linalg.svd(rows, full_matrices=False)
    known = np.linalg.qr(model.directions)[0]
    assert np.linalg.svd(known[:, :].T @ right[:20].T)[1].min() > 0.999


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the supplied tables")
def test_held_out_labels_and_partitions(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(found) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[r.doc_id].predicted, r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    low, good = [p for p, y in held if y == 0], [p for p, y in held if y == 1]
    assert low and low.count(0) >= 0.8 * len(low) and good.count(0) <= 0.02 * len(good)
    other = quality.judge(docs.repartition(7).select(F.lit("x").alias("label"), "text", "doc_id"), labels.repartition(3))
    assert {r.doc_id: r.score for r in other.collect()} == {i: r.score for i, r in found.items()}
    # labels of remainder 0 aren't learnt from
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.judge(docs, turned).collect()} == {i: r.score for i, r in found.items()}


def test_defined_cases(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = [(i, "fine words in prose " * 5 if i % 2 else "$$$ ### %%% " * 5, "en", "s") for i in range(1, 40)]
    rows += [(50, None, None, None), (50, None, None, None), (51, "", "", ""), (None, "fine words", "en", "s"), (52, "$$$ " * 50_000, "en", "s"), (1, "fine words in prose again", "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(9)).withColumn("label", F.lit("z"))
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(rows)
    share = sum(i % 2 for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5) / sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(1, 40))
    assert {r.score for r in found if r.doc_id in (50, 51)} == {share}
    assert {r.predicted for r in found if r.doc_id == 52} == {0} and {r.predicted for r in found if r.doc_id in (1, None)} == {1}
    assert quality.judge(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.judge(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.0}
