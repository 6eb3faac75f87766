"""Bit matrices by byte range, manifests, and work that is taken up again, on real files."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import tasks
from evalweave.sources import files


@pytest.mark.parametrize("samples", [1, 8, 13, 70])
def test_bits_round_trip(spark, tmp_path, samples):
    rng = np.random.default_rng(samples)
    matrix = rng.random((41, samples)) < 0.3
    matrix[[4, 40]] = False  # features without samples
    cells = [(int(f), int(s)) for f, s in zip(*np.nonzero(matrix), strict=True)]
    path = f"file://{tmp_path}/bits"
    df = spark.createDataFrame(cells + cells[:3], "feature long, sample int").repartition(5)
    written = files.write_bits(df, path, samples, 41, per_file=9).collect()
    width = -(-samples // 8)
    assert sorted(r.bytes for r in written) == sorted([9 * width] * 4 + [5 * width])
    # the files hold what numpy packs
    data = b"".join(open(f"{tmp_path}/bits/{n}", "rb").read() for n in sorted(os.listdir(f"{tmp_path}/bits")) if n.endswith(".bits"))
    assert data == np.packbits(matrix, axis=1, bitorder="little").tobytes()
    for split in (1, 4, 100):
        assert sorted(tuple(r) for r in files.scan_bits(spark, path, samples, split=split).collect()) == sorted(cells)
    some = [0, 8, 9, 10, 39, 40]
    assert sorted(tuple(r) for r in files.scan_bits(spark, path, samples, features=some).collect()) == sorted(c for c in cells if c[0] in some)
    # one file of all features, as other programs write it
    (tmp_path / "whole.bin").write_bytes(data)
    assert sorted(tuple(r) for r in files.scan_bits(spark, f"file://{tmp_path}/whole.bin", samples, features=[7]).collect()) == sorted(c for c in cells if c[0] == 7)


def test_bits_are_read_by_range(tmp_path, monkeypatch):
    (tmp_path / "m.bin").write_bytes(bytes(range(256)) * 40)
    reader = files.BitMatrixReader({"path": f"file://{tmp_path}/m.bin", "samples": "80", "split": "100"})
    splits = reader.partitions()
    assert [s.runs for s in splits][:2] == [[(0, 100)], [(100, 100)]] and sum(n for s in splits for _, n in s.runs) == 1024
    reader = files.BitMatrixReader({"path": f"file://{tmp_path}/m.bin", "samples": "80", "features": "[1000, 3, 4, 5, 900]"})
    assert [s.runs for s in reader.partitions()] == [[(3, 3), (900, 1), (1000, 1)]]
    asked = []
    real = files.opened

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            asked.append((at, n))
            return self.file.read_at(n, at)

    class Store:
        def __init__(self, where):
            self.where = where

        def open_input_file(self, path):
            return Watched(self.where.open_input_file(path))

    splits = reader.partitions()
    monkeypatch.setattr(files, "opened", lambda address: (Store(real(address)[0]), real(address)[1]))
    list(reader.read(splits[0]))
    assert asked == [(30, 30), (9000, 10), (10000, 10)]  # ten bytes a feature


def test_wide_bits_are_unpacked_in_pieces(tmp_path):
    """A row of 40 million samples is never held as a byte a sample."""
    import tracemalloc

    with open(tmp_path / "wide.bin", "wb") as out:
        out.truncate(5_000_000)
        out.seek(4_999_999)
        out.write(b"\x80")
    reader = files.BitMatrixReader({"path": f"file://{tmp_path}/wide.bin", "samples": "40000000"})
    tracemalloc.start()
    found = [(f, s) for b in reader.read(reader.partitions()[0]) for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 39_999_999)] and peak < 16 << 20


def test_bits_are_written_in_pieces(spark, tmp_path, monkeypatch):
    cells = [(f, s) for f in (0, 2, 4) for s in (0, 7, 8, 8 * files.SPAN - 1, 8 * files.SPAN, 20 * files.SPAN)]
    path, samples = f"file://{tmp_path}/pieces", 20 * files.SPAN + 1
    files.write_bits(spark.createDataFrame(cells, "feature long, sample int"), path, samples, 6, per_file=4).collect()
    assert sorted(tuple(r) for r in files.scan_bits(spark, path, samples).collect()) == cells


def test_bits_that_do_not_fit(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number of features"):
        files.scan_bits(spark, f"file://{tmp_path}/odd.bin", 16).collect()
    with pytest.raises(Exception, match="out of range"):
        files.scan_bits(spark, f"file://{tmp_path}/odd.bin", 8, features=[5]).collect()
    # offsets beyond two gigabytes
    with open(tmp_path / "long.bin", "wb") as out:
        out.truncate(3 << 30)
        out.seek((3 << 30) - 4)
        out.write(b"\x01\x00\x00\x80")
    last = (3 << 30) // 4 - 1
    assert [tuple(r) for r in files.scan_bits(spark, f"file://{tmp_path}/long.bin", 32, features=[0, last]).collect()] == [(last, 0), (last, 31)]


def test_manifest_verdicts(spark, tmp_path, monkeypatch):
    contents = {"a.txt": "same", "b.txt": "as listed", "c.txt": "gone", "e.txt": ""}
    manifest = spark.createDataFrame([(n, hashlib.sha256(c.encode()).hexdigest().upper()) for n, c in contents.items()], "file string, sha256 string")
    written = {"a.txt": "same", "b.txt": "changed", "d.txt": "not listed", "e.txt": ""}
    path = f"file://{tmp_path}/out"
    sizes = files.write_files(spark.createDataFrame(list(written.items()), "file string, content string"), path).collect()
    assert {r.file: r.bytes for r in sizes} == {n: len(c) for n, c in written.items()}
    found = files.verified(spark, path, manifest)
    assert {r.file: (r.bytes, r.verdict) for r in found.collect()} == {"a.txt": (4, "PASS"), "b.txt": (7, "CHANGED"), "c.txt": (None, "MISSING"), "d.txt": (10, "UNLISTED"), "e.txt": (0, "PASS")}
    with pytest.raises(Exception, match="CHANGED|MISSING|UNLISTED"):
        files.require_verified(found).collect()
    assert files.require_verified(found.where("file = 'a.txt'")).count() == 1


def test_digests_in_pieces(spark, tmp_path):
    os.makedirs(tmp_path / "big")
    data = os.urandom(1 << 20) * 19 + b"end"
    (tmp_path / "big" / "x.bin").write_bytes(data)
    r = files.file_digests(spark, f"file://{tmp_path}/big").first()
    assert (r.file, r.bytes, r.sha256) == ("x.bin", len(data), hashlib.sha256(data).hexdigest())


SCHEMA = "id long, value double"


def test_resume_after_damage(spark, tmp_path):
    path, made = f"file://{tmp_path}/work", []

    def compute(todo):
        made.append(sorted(r.task for r in todo.collect()))
        return todo.select("task", F.explode(F.sequence(F.lit(0), F.col("expected") - 1)).alias("i")).select(F.col("i").alias("id"), (F.col("i") * F.length("task")).cast("double").alias("value"), "task")

    def asked(*rows):
        return spark.createDataFrame([(t, i, n) for t, i, n in rows], "task string, input string, expected long")

    def states(report):
        return {r.task: (r.state, r.n) for r in report.collect()}

    def folder(task):
        return tmp_path / "work" / "parts" / f"task={task}"

    def damage(task, rows, keep=False):
        for name in os.listdir(folder(task)):
            if not keep:
                os.remove(folder(task) / name)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder(task)}")

    one = [("a", "v1", 3), ("bb", "v1", 4), ("ccc", "v1", 5), ("d", "v1", 2)]
    rows, report = tasks.resume(asked(*one[:2]), compute, path, SCHEMA)
    assert states(report) == {"a": ("computed", 3), "bb": ("computed", 4)} and rows.count() == 7
    rows, report = tasks.resume(asked(*one), compute, path, SCHEMA)
    assert states(report) == {"a": ("reused", 3), "bb": ("reused", 4), "ccc": ("computed", 5), "d": ("computed", 2)} and rows.count() == 14
    want = sorted(map(tuple, rows.collect()))
    # short, foreign (the rows of another task), changed, and unreadable
    damage("a", [(0, 0.0), (1, 1.0)])
    damage("bb", [(0, 0.0), (1, 3.0), (2, 6.0), (3, 9.0)])
    for name in os.listdir(folder("d")):
        if name.endswith(".parquet"):
            (folder("d") / name).write_bytes(b"no parquet at all")
        os.path.exists(folder("d") / f".{name}.crc") and os.remove(folder("d") / f".{name}.crc")
    rows, report = tasks.resume(asked(*one), compute, path, SCHEMA)
    assert states(report) == {"a": ("computed", 3), "bb": ("computed", 4), "ccc": ("reused", 5), "d": ("computed", 2)}
    assert sorted(map(tuple, rows.collect())) == want
    # missing
    for name in os.listdir(folder("ccc")):
        os.remove(folder("ccc") / name)
    rows, report = tasks.resume(asked(*one), compute, path, SCHEMA)
    assert states(report)["ccc"] == ("computed", 5) and sorted(map(tuple, rows.collect())) == want
    # rows more than there should be, and another input
    damage("a", [(9, 9.0)], keep=True)
    rows, report = tasks.resume(asked(*one[:3], ("d", "v2", 2)), compute, path, SCHEMA)
    assert states(report) == {"a": ("computed", 3), "bb": ("reused", 4), "ccc": ("reused", 5), "d": ("computed", 2)}
    assert sorted(map(tuple, rows.collect())) == want
    assert made == [["a", "bb"], ["ccc", "d"], ["a", "bb", "d"], ["ccc"], ["a", "d"]]
    # nothing to do, nothing is made
    tasks.resume(asked(*one[:3]), compute, path, SCHEMA)
    assert len(made) == 5


def test_a_task_that_falls_short_is_not_entered(spark, tmp_path):
    path = f"file://{tmp_path}/work"
    df = spark.createDataFrame([("a", "v1", 3)], "task string, input string, expected long")
    short = lambda todo: todo.select(F.lit(1).cast("long").alias("id"), F.lit(0.5).alias("value"), "task")
    rows, report = tasks.resume(df, short, path, SCHEMA)
    assert [tuple(r) for r in report.collect()] == [("a", "failed", 0)] and rows.count() == 0
    rows, report = tasks.resume(df.withColumn("expected", F.lit(None).cast("long")), short, path, SCHEMA)
    assert [tuple(r) for r in report.collect()] == [("a", "computed", 1)] and rows.count() == 1


def test_reports_refuse_what_json_lacks(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, float("nan"), "x")], "n int, mean double, note string")
    columns = ["n", "mean", "note"]
    assert df.where("n = 1").select(files.json_report(df, columns).alias("r")).first().r == '{"n":1,"mean":0.5,"note":null}\n'
    for bad in (df.where("n = 2"), df.withColumn("mean", F.lit(float("-inf")))):
        with pytest.raises(Exception, match="mean isn't finite"):
            bad.select(files.json_report(bad, columns)).collect()


def test_units_are_normalised_by_spelling(spark):
    from evalweave.functions import labels

    spellings = {"ｍｇ/Ｌ": "mg/L", "MG/L ": "mg/L", "µg/mL": "mg/L", "μg/ml": "mg/L", "mcg/ml": "mg/L", "ＭＭ": "mm", "Straße": "strasse", None: None, "": ""}
    found = labels.normal_units(spark.createDataFrame([(k,) for k in spellings] * 3, "raw string"), "raw", "unit").collect()
    assert len(found) == 27 and {r.raw: r.unit for r in found} == spellings
