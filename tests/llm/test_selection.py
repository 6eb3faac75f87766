"""SimHash classes, toxicity, mixing and the pipeline: against plain versions, held-out labels and planted cases."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import components, mixing, shingles, simhash, toxicity
from evalweave.llm.common import crc32

RNG = random.Random(11)
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, letters="abcdefghij"):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 7))) for _ in range(n))


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(fps):
    """Fingerprint -> representative, linking at three bits, all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_simhash_against_all_pairs(spark):
    base = prose(300)
    rows = [(i, prose(RNG.randint(0, 40))) for i in range(10, 60)]
    for i in range(100, 160):
        words = base.split()
        for _ in range(RNG.randint(0, 4)):
            words[RNG.randrange(300)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "ÄB Cd"), (5, "äb cd"), (6, "one"), (7, "x y z w" * 20000), (None, base), (8, base), (8, base)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    fp = [plain_fingerprint(t or "") for _, t in rows]
    classes = plain_classes(fp)
    least = {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[classes[f]] = min(least.get(classes[f], 1 << 60), i)
    want = sorted((str(i), f"{f:016x}", least.get(classes[f])) for (i, _), f in zip(rows, fp, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == want


def test_all_links_across_groups_are_found(spark):
    """Random fingerprints around a few centres, every distance from 0 to 5, every bit."""
    fps = set()
    for _ in range(12):
        centre = RNG.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in RNG.sample(range(64), RNG.randint(0, 4))))
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash._across_groups(nodes.withColumn("group", F.col("fp"))).collect()
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in links}
    listed = sorted(fps)
    assert got == {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[:i] if (a ^ b).bit_count() <= 3}


def test_component_labels(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 200) for i in range(1, 50)] + [(300, 300)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(200, 250)} == {200} and 300 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_class_stays(spark):
    base = prose(400)
    rows = [(5, base), (3, base), (3, base), (9, prose(50)), (None, base), (None, base)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id for r in simhash.keep_one_of_each(df).collect()), key=str) == [3, 9, None, None]
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_repeated_ids_with_other_texts_stay(spark):
    texts = [prose(60) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[0]), (0, texts[3]), (4, texts[3])]
    df = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    for classes in (simhash.row_classes, shingles.classes):
        found = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(df, classes=classes).collect()]
        assert sorted(found) == sorted([(0, texts[3]), (1, texts[0]), (1, texts[1]), (2, texts[2])])


def test_one_row_many_times(spark):
    rows = [(7, "the same text again", "en", "s", 1)] * 40 + [(i, prose(30), "en", "s", 1) for i in range(10, 30)] + [(8, "the same text again", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for parts in (4, 256):
        assert sorted(r.doc_id for r in simhash.keep_one_of_each(df, parts=parts).collect()) == [7, *range(10, 30)]


def test_ids_that_are_no_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for use in (simhash.near_duplicates, simhash.keep_one_of_each):
        with pytest.raises(TypeError, match="column doc_id is string"):
            use(df)


# toxicity

BAD = ["kwzplumt", "vrtuxqss", "xylozrkk"]


def toxic_table(n):
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(RNG.randint(5, 120)).split(), i % 5 == 1
        if bad:
            for _ in range(RNG.randint(1, 3)):
                words.insert(RNG.randrange(len(words)), RNG.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_unseen_misspellings(spark):
    rows, labels = toxic_table(1500)
    rows += [(90001, f"{prose(40)} kwzplumtt {prose(40)}"), (90002, f"{prose(3000)} vrtuxqsses {prose(3000)}"), (90003, prose(2000)), (90004, None), (90005, ""), (90005, ""), (90006, "house " * 3000), (None, BAD[0])]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, score double")
    found = toxicity.judge(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    got = {r.doc_id: r.predicted for r in found}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)
    assert (got[90004], got[90006], got[None]) == (0, 0, 1)
    # unseen forms stand above nearly all clean documents
    score = {r.doc_id: r.score for r in found}
    clean = sorted(score[i] for i, y in labels if not y)
    assert min(score[90001], score[90002]) > clean[int(0.97 * len(clean))]
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0), ([(i, 1) for i in range(1, 40)], 1)):
        assert {r.predicted for r in toxicity.judge(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()} == {want}
    assert toxicity.judge(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_held_out_labels_are_not_used(spark):
    rows, labels = toxic_table(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.judge(docs, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_scores_do_not_depend_on_partitions(spark):
    rows, labels = toxic_table(400)
    rows += [rows[7], rows[7], (9000, None), (9001, prose(4000))]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = [sorted(map(tuple, toxicity.judge(docs.repartition(n), known.repartition(n)).collect())) for n in (1, 2, 16)]
    assert found[0] == found[1] == found[2]


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    rows, labels = toxic_table(60)
    rows += [(1, "a repeat")] * 50 + [(100, "long " * 60_000), (101, prose(30_000))]
    labels += [(100, 1), (101, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.training_sample(docs, known, left_out=(9,)).collect()}
    assert set(found) == {i for i, _ in labels} - {100} and found[1].text == min(t for i, t in rows if i == 1)
    assert found[101].text == rows[-1][1]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    some = toxicity.training_sample(docs, known, left_out=(9,)).collect()
    for label in (0, 1):
        assert 0 < sum(len(r.text) for r in some if r.label == label) <= 3000


def test_drop_toxic_with_other_names(spark):
    rows, labels = toxic_table(200)
    docs = spark.createDataFrame([(t, i, 3) for i, t in rows] + [(None, None, 4)], "body string, id long, n int")
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), id_col="id", text_col="body")
    assert kept.columns == docs.columns and {r.n for r in kept.collect()} == {3, 4}
    odd = docs.select("*", F.lit("x").alias("a.b"), F.lit(1).alias("c0"), F.lit(2).alias("score"))
    again = toxicity.drop_toxic(odd, spark.createDataFrame(labels, "doc_id long, toxic int"), id_col="id", text_col="body")
    assert again.columns == odd.columns and again.count() == kept.count() and {tuple(r)[3:] for r in again.collect()} == {("x", 1, 2)}


def test_windows_cover_every_word():
    starts = np.array([0, 0, 5, 21, 60])
    text, first, end = toxicity.window_bounds(starts)
    for t in range(4):
        seen = {w for a, b in zip(first[text == t], end[text == t], strict=True) for w in range(a, b)}
        assert seen == set(range(starts[t], starts[t + 1])) and (text == t).any()


def test_scores_equal_plain_sums():
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32), -0.5)
    texts = [prose(RNG.randint(0, 50)) for _ in range(20)] + [""]
    got = model.text_logits(pa.array(texts), toxicity.Cache())
    for text, logit in zip(texts, got, strict=True):
        words = [w for k, w in enumerate(text.split()) if k == 0 or w != text.split()[k - 1]]
        scores = model.word_scores(words)
        size, step = toxicity.WINDOW, toxicity.STRIDE
        at = [max(0, min(a, len(words) - size)) for a in range(0, max(1, len(words) - step), step)]
        spans = [(a, a + size) for a in at]
        assert logit == pytest.approx(max(scores[a:b].sum() / toxicity.WINDOW for a, b in spans) - 0.5)


# mixing


def mixed(spark, sizes, **options):
    rows = [(f"{s}{i}", None if s == "none" else s, RNG.randint(1, 30)) for s, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "doc string, source string, tokens long")
    return rows, mixing.mix(table, **options).collect()


def test_mix_meets_limit_and_keeps_every_document(spark):
    rows, found = mixed(spark, {"a": 800, "b": 60, "none": 30, "c": 5})
    total = {}
    for _, s, t in rows:
        total[s] = total.get(s, 0) + t
    budget = {r.source: r.budget for r in found}
    seen = {s: budget[s] / total[s] for s in total}
    assert max(seen.values()) / min(seen.values()) == pytest.approx(mixing.LIMIT, rel=0.05) and min(seen.values()) == pytest.approx(1, abs=0.01)
    assert {r.doc for r in found} == {d for d, _, _ in rows}
    for s in total:
        own = sorted((r for r in found if r.source == s), key=lambda r: r.before)
        at = 0
        for r in own:  # one after the other, without gaps, until the budget is met
            assert r.before == at and r.before < r.budget and r.block == r.before * mixing.BLOCKS // r.budget
            at += r.tokens
        assert at >= budget[s] and len({(r.doc, r.epoch) for r in own}) == len(own)
    assert sum({r.source: r.weight for r in found}.values()) == pytest.approx(1)


def test_mix_meets_entropy(spark):
    _, found = mixed(spark, {"a": 500, "b": 100, "c": 20}, entropy=0.9, limit=None, budget=3000)
    weights = np.array(list({r.source: r.weight for r in found}.values()))
    assert -(weights * np.log(weights)).sum() / np.log(3) == pytest.approx(0.9, abs=1e-6)
    assert sum({r.source: r.budget for r in found}.values()) == pytest.approx(3000, abs=3)


def test_mix_without_rows_and_with_one_source(spark):
    assert mixed(spark, {})[1] == []
    rows, found = mixed(spark, {"a": 20})
    assert len(found) == 20 and {r.weight for r in found} == {1.0}


def test_mixed_documents_keep_columns(spark):
    rows = [(i, f"w {i}", "en", RNG.choice(["a", "a", "a", None]), 3) for i in range(60)] + [(None, None, None, "b", None), (7, "again", "en", "a", 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", block int")
    found = mixing.mixed_documents(df)
    assert found.columns == df.columns and {r.block for r in found.collect()} == set(range(len(rows)))
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    plan = mixing.mix(mixing.source_tokens(df))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# the pipeline


def shingles_of(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def plain_pipeline(docs, model):
    """The first two stages on lists of rows (id, text): not judged toxic, then one row of each class of five-word shingles with
    a Jaccard similarity of 0.8, all pairs compared: the one with the least id, then the least digest; rows without an id stay."""
    clean = [(i, t or "") for i, t in docs if model.text_logits(pa.array([t or ""]), toxicity.Cache())[0] < 0]
    sets = [shingles_of(t) for _, t in clean]
    root = list(range(len(clean)))
    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            if root[k] != root[j] and (a == b or (a or b) and 5 * len(a & b) >= 4 * len(a | b)):
                old, new = root[k], root[j]
                root = [new if r == old else r for r in root]
    best = {}
    for k, (i, t) in enumerate(clean):
        if i is not None:
            best.setdefault(root[k], []).append((i, hashlib.sha256(t.encode()).hexdigest(), t))
    return sorted([min(rows)[::2] for rows in best.values()] + [(i, t) for i, t in clean if i is None], key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the supplied tables")
def test_pipeline_against_plain_version(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit_model(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_pipeline(rows, model)
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in got.collect()} == {i for i, _ in want}
    # repeated ids with other texts, repeated rows and rows without an id
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(rows[0][0], "a text of its own with more than five words"), rows[3], (None, rows[5][1]), (None, rows[5][1])], "doc_id long, text string"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash"](spark, stages["toxicity"](spark, odd, DATA), DATA)
    model = toxicity.fit_model(odd, labels)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == plain_pipeline([tuple(r) for r in odd.collect()], model)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).schema.names == docs.schema.names, name


def test_pipeline_on_odd_tables(spark, tmp_path):
    base = prose(60)
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, None, None, None, None), (None, base, "en", "a", 1), (None, None, None, None, None), (3, "", "en", "b", 0), (4, prose(5000), "en", "b", 1)]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, SCHEMA).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()
    # without labels nothing is toxic; of the empty texts and of the copies the least id stays, and rows without an id
    assert {r.doc_id for r in found} == {1, 2, 4, None}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_clashing_names_are_kept(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, __doc string, __rank int, __kept long, __block string"
    df = spark.createDataFrame([(i, f"text {i}", "en", "a", 1, f"d{i}", i, 5, "b") for i in range(9)] + [(None, "x", "en", "a", 1, "d9", 9, 5, "b")], names)
    for found in (mixing.mixed_documents(df), simhash.keep_one_of_each(df)):
        assert found.columns == df.columns and {(r["__doc"], r["__rank"]) for r in found.collect()} == {(f"d{i}", i) for i in range(10)}


def test_crc_of_ids(spark):
    ids = [0, 5, -3, 10**15]
    found = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", crc32("doc_id").alias("c")).collect()
    assert {r.doc_id: r.c for r in found} == {i: zlib.crc32(str(i).encode()) for i in ids}
