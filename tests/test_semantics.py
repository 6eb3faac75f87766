"""Known answers for intervals, metrics under ties, gates, and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions import breakpoints, evidence, intervals, labels, sequences, stats
from evalweave.operators import association, evaluation, gates, graph, joins, ordered, resampling
from evalweave.sources import text
from evalweave.streaming import snapshots


@pytest.mark.parametrize(
    "raw, want",
    [("=2", "S"), ("==2", "S"), ("<=2", "S"), (">2", "I|R"), (">=2", "I|R|S"), ("=8", "I"), (">8", "R"), (">=8", "I|R"), ("<8", "I|S"), ("=9", "R"), ("<2", "S"), ("<=8", "I|S")],
)
def test_allowed_categories(spark, raw, want):
    x = intervals.parse_mic(F.lit(raw))
    got = spark.range(1).select(F.array_join(intervals.allowed_categories(x, F.lit(2), F.lit(8), F.lit(False)), "|")).first()[0]
    assert got == want


@pytest.mark.parametrize(
    "raw, label, want",
    [
        ("1", "S", "BOUNDARY_ROBUST"),
        ("2", "S", "BOUNDARY_SENSITIVE"),
        ("8", "I", "BOUNDARY_SENSITIVE"),
        ("16", "R", "BOUNDARY_SENSITIVE"),
        ("32", "R", "BOUNDARY_ROBUST"),
        (">16", "R", "BOUNDARY_ROBUST"),
        (">=16", "R", "BOUNDARY_SENSITIVE"),
        (">8", "R", "BOUNDARY_SENSITIVE"),
        ("<64", "R", "OBSERVED_INTERVAL_OR_CATEGORY_UNCERTAIN"),
        ("≤0.06", "S", "BOUNDARY_ROBUST"),
        ("</=0.125", "S", "UNSUPPORTED_MIC"),
    ],
)
def test_boundary_status(spark, raw, label, want):
    status = intervals.boundary_status(F.lit(raw), F.lit(label), F.lit(2), F.lit(8), F.lit(False))
    assert spark.range(1).select(status).first()[0] == want


@pytest.mark.parametrize("a, b, want", [("<=1", "1", True), ("<1", "1", False), (">8", "8", False), (">=8", "8", True), ("<=0.5", "8", False)])
def test_overlap(spark, a, b, want):
    assert spark.range(1).select(intervals.overlap(intervals.parse_mic(F.lit(a)), intervals.parse_mic(F.lit(b)))).first()[0] is want


@pytest.mark.parametrize("raw", ["", "NaN", "0", "-1", "<", "4 5", None])
def test_no_interval(spark, raw):
    assert spark.range(1).select(intervals.parse_mic(F.lit(raw).cast("string"))).first()[0] is None


def test_reference_substitution(spark):
    """Reversed labels turn an AUROC of 0.25 to 1."""
    rows = spark.createDataFrame([("old", y, p) for y, p in zip((0, 1, 1, 0), (0.9, 0.1, 0.8, 0.2), strict=True)] + [("new", y, p) for y, p in zip((1, 0, 1, 0), (0.9, 0.1, 0.8, 0.2), strict=True)], "ref string, y int, score double")
    found = {r.ref: r.auroc for r in evaluation.rank_metrics(rows, ["ref"]).collect()}
    assert found == {"old": 0.25, "new": 1.0}


def test_ties_count_half(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, score double")
    found = evaluation.rank_metrics(rows, []).first()
    assert found.auroc == 0.875 and found.ap == pytest.approx(5 / 6)


def test_rank_metrics_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, s, w = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40, rng.integers(0, 4, 300)
    rows = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, s, w, strict=True)], "y int, score double, w long")
    found = evaluation.rank_metrics(rows, [], weight="w").first()
    wins = sum(int(w[i]) * int(w[j]) * ((s[i] > s[j]) + 0.5 * (s[i] == s[j])) for i in np.flatnonzero(y) for j in np.flatnonzero(1 - y))
    assert found.auroc == pytest.approx(wins / (w[y == 1].sum() * w[y == 0].sum()))


def test_one_class_has_no_rank_metrics(spark):
    assert evaluation.rank_metrics(spark.createDataFrame([(0, 0.1), (0, 0.5)], "y int, score double"), []).first().asDict() == {"positives": 0, "negatives": 2, "auroc": None, "ap": None}


@pytest.mark.parametrize("cells, ba, mcc", [((109, 54, 221, 141), 0.639604, 0.258667), ((236, 30, 245, 14), 0.916582, 0.834036), ((138, 25, 192, 170), 0.688506, 0.354241)])
def test_known_confusion_tables(spark, cells, ba, mcc):
    found = spark.range(1).select(*(c.alias(n) for n, c in stats.metrics(*map(F.lit, cells)).items())).first()
    assert found.ba == pytest.approx(ba, abs=1e-6) and found.mcc == pytest.approx(mcc, abs=1e-6)


def test_undefined_metrics_are_null(spark):
    found = spark.range(1).select(*(c.alias(n) for n, c in stats.metrics(*map(F.lit, (0, 0, 3, 2))).items())).first()
    assert found.ba is None and found.mcc is None and found.specificity == 0.6


def test_fisher_matches_enumeration(spark):
    rows = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (7, 7, 7, 7)]
    got = [r[0] for r in spark.createDataFrame(rows, "a int, b int, c int, d int").select(stats.fisher_exact("a", "b", "c", "d")).collect()]

    def brute(a, b, c, d):
        n, k, m = a + b + c + d, a + b, a + c
        p = {x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(max(0, m - n + k), min(k, m) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))

    assert got == pytest.approx([brute(*r) for r in rows])


def test_fisher_of_large_tables_holds_little(spark):
    """The work grows with the spread of the distribution, not with the number of tables of the same margins."""
    import tracemalloc

    tracemalloc.start()
    p = stats._fisher(2_000_700, 2_000_000, 2_000_000, 2_000_700)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # of so many rows the normal approximation is good to some 1e-4
    assert peak < 8 << 20 and abs(p - math.erfc(math.sqrt(stats_chi2(2_000_700, 2_000_000) / 2))) < 1e-3


def stats_chi2(a, b):
    """Pearson's statistic, with Yates' correction, of the table ((a, b), (b, a))."""
    n = 2 * (a + b)
    return n * (abs(a * a - b * b) - n / 2) ** 2 / float(a + b) ** 4


def test_fdr_reads_its_rows_once(spark):
    """A p-value that costs much is worked out once for each row."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        seen.add(1)
        return i / 40

    got = association.bh_fdr(spark.range(1, 31).select("id", counted("id").alias("p")), [], "p").collect()
    assert len(got) == 30 and seen.value == 30


def test_bh_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.03), (3, 0.04), (4, 0.2), (5, None)], "i int, p double")
    got = {r.i: r.q for r in association.bh_fdr(rows, [], "p").collect()}
    assert got[5] is None and [got[i] for i in (1, 2, 3, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_gates(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert gates.unique_keys(rows, ["k"]).first().passed is False
    assert gates.collapsed(rows.where("k is not null"), ["k"]).count() == 2
    conflict = rows.unionByName(spark.createDataFrame([(2, "x")], "k int, v string"))
    assert [r.k for r in gates.conflicting_keys(conflict, ["k"]).collect()] == [2]
    with pytest.raises(Exception, match="different rows"):
        gates.collapsed(conflict, ["k"]).collect()
    with pytest.raises(gates.GateError):
        gates.projected(rows, {"x": "missing"})
    assert gates.first_alias(rows, ["none", " K "]) == "k"


def test_validated_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert joins.validated_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(gates.GateError):
        joins.validated_join(a, b, ["k"], validate="one_to_one")


def test_blank_identities_never_match(spark):
    ext = spark.createDataFrame([(1, "a", ""), (2, "", "p"), (3, None, "q")], "i int, x string, y string")
    ref = spark.createDataFrame([("", ""), ("a", "p")], "x string, y string")
    found = joins.firewall(ext, ref, "i", {"x": (F.col("x"), F.col("x")), "y": (F.col("y"), F.col("y"))})
    assert {r.i: r.reasons for r in found.collect()} == {1: "x", 2: "y", 3: None}


def test_running_totals_match_one_window(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(k), int(o), int(v)) for k, o, v in zip(np.repeat([1, 2], 200), list(range(200)) * 2, rng.integers(0, 9, 400), strict=True)], "k int, o int, v long")
    got = {(r.k, r.o): r.before_v for r in ordered.running_totals(rows, ["k"], "o", ["v"]).collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect()):
        want[r.k, r.o] = seen.get(r.k, 0)
        seen[r.k] = want[r.k, r.o] + r.v
    assert got == want


def test_components_of_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 150), 999]], "n long")
    found = {r.n: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "a long, b long"), "n").collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 150)} == {100} and found[999] == 999


def test_labels(spark):
    got = [tuple(r) for r in spark.createDataFrame([(" resistant ",), ("i",), ("n/a",), (None,)], "v string").select(labels.category(F.col("v")), labels.binary_label(F.col("v")), labels.missing_to_null(F.col("v"))).collect()]
    assert got == [("R", 1, "resistant"), ("I", None, "i"), (None, None, None), (None, None, None)]
    with pytest.raises(Exception, match="not a category"):
        spark.createDataFrame([("x",)], "v string").select(labels.strict_label(F.col("v"))).collect()


def test_strands(spark):
    row = spark.range(1).select(sequences.both_strands(F.lit("AAATTT"), F.lit("AA")), sequences.both_strands(F.lit("GAATTC"), F.lit("GAATTC")), sequences.hamming(F.lit("ACGT"), F.lit("AGGA"))).first()
    assert [tuple(x) for x in row[0]] == [(1, "+"), (2, "+"), (4, "-"), (5, "-")] and [tuple(x) for x in row[1]] == [(1, "+")] and row[2] == 2


CASE = {"sample": "s1", "drug": "meropenem"}
HISTORY = {**CASE, "old_value": "2", "new_value": "4", "day": "08/11/22", "source_url": "https://example.invalid/x", "artifact_sha256": "a" * 64}


def audited(spark, old, new, history=()):
    """The evidence of one case; observations are (mic, unit, category)."""
    seen = "sample string, drug string, mic string, unit string, category string"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cases = frame([(*CASE.values(), "2026-11-10")], "sample string, drug string, d string").select("sample", "drug", F.to_date("d").alias("as_of"))
    rows = [[(*CASE.values(), *o) for o in side] for side in (old, new)]
    past = frame([tuple(h[k] for k in HISTORY) for h in history], ", ".join(f"{k} string" for k in HISTORY))
    (found,) = evidence.audit(cases, frame(rows[0], seen), frame(rows[1], seen), past).collect()
    return found


@pytest.mark.parametrize(
    "old, new, history, state",
    [
        ([("==2.0", "mg/L", "S")], [("2", "µg/mL", "S")], [], "SAME_REPORTED_REFERENCE"),
        ([("1", "mg/L", "S")], [("2", "mg/L", "S")], [], "DISJOINT_MIC_WITH_SAME_CATEGORY"),
        ([("2", "mg/L", "S")], [("4", "mg/L", "I")], [], "DISJOINT_MIC_WITH_CATEGORY_CHANGE"),
        ([("2", "mg/L", "ND")], [("4", "mg/L", "R")], [], "CATEGORY_UNAVAILABLE_CAUSE_UNRESOLVED"),
        ([("2", "mg/L", "S")], [("4", "mg/mL", "I")], [], "UNSUPPORTED_OR_MISSING_MIC_OR_UNIT"),
        ([("n/a", "mg/L", "S")], [("4", "mg/L", "I")], [], "UNSUPPORTED_OR_MISSING_MIC_OR_UNIT"),
        ([], [("4", "mg/L", "I")], [], "INSUFFICIENT_PAIRED_REFERENCE"),
        ([("2", "mg/L", "S"), ("8", "mg/L", "R")], [("4", "mg/L", "I")], [HISTORY], "AMBIGUOUS_MULTIPLE_REFERENCE_STATES"),
        ([("8", "mg/L", "R"), ("2", "mg/L", "S")], [("4", "mg/L", "I")], [HISTORY], "AMBIGUOUS_MULTIPLE_REFERENCE_STATES"),
        ([("2", "mg/L", "S")], [("2", "mg/L", "I")], [], "CATEGORY_ONLY_REFERENCE_DIFFERENCE"),
        ([("<=2", "mg/L", "S")], [("2", "mg/L", "S")], [], "OVERLAPPING_REPORTING_INTERVALS"),
        ([("2", "mg/L", "S")] * 2, [("4", "mg/L", "I")], [HISTORY], "DOCUMENTED_MIC_UPDATE_LINK"),
        ([("2", "mg/L", "S")], [("4", "mg/L", "I")], [{**HISTORY, "drug": "MEROPENEM "}], "DOCUMENTED_MIC_UPDATE_LINK"),
        *(([("2", "mg/L", "S")], [("4", "mg/L", "I")], [{**HISTORY, k: v}], "DISJOINT_MIC_WITH_CATEGORY_CHANGE") for k, v in (("old_value", "1"), ("drug", "imipenem"), ("sample", "other"), ("day", "12/01/27"), ("artifact_sha256", ""), ("source_url", ""))),
    ],
)
def test_evidence_states(spark, old, new, history, state):
    found = audited(spark, old, new, history)
    assert found.evidence_state == state and bool(found.history_link) == (state == "DOCUMENTED_MIC_UPDATE_LINK")
    assert (found.old_rows, found.new_rows) == (len(old), len(new))


def test_history_that_does_not_link(spark):
    found = audited(spark, [("2", "mg/L", "S")], [("4", "mg/L", "I")], [{**HISTORY, "old_value": "1"}])
    assert (found.native_history, found.history_link, found.category_difference, found.mic_disjoint) == (True, False, True, True)
    assert audited(spark, [("2", "mg/L", "ND")], [("4", "mg/L", "R")]).category_difference is None


RULE = {"organism": "test organism", "drug": "test drug", "standard": "TEST", "version": "v1", "context": "test context", "unit": "u", "s_max": "2", "r_above": "8", "convention": "S_LE_R_GT", "source_url": "https://example.invalid/t", "source_sha256": "a" * 64}
READING = {k: RULE[k] for k in breakpoints.CONTEXT} | {"method": "MIC", "mic_sign": "=", "mic_value": "2"}


def interpreted(spark, reading, rules):
    make = lambda rows, names: spark.createDataFrame([tuple(r[k] for k in names) for r in rows], ", ".join(f"{k} string" for k in names))
    row = breakpoints.interpret(make([READING | reading], list(READING)), make(rules, list(RULE))).first()
    return row.status, row.possible_categories


@pytest.mark.parametrize("sign, value, want", [("=", "2", "S"), ("==", "2", "S"), ("<=", "2", "S"), (">", "2", "I|R"), (">=", "2", "S|I|R"), ("=", "8", "I"), (">", "8", "R"), (">=", "8", "I|R"), ("<", "8", "S|I"), ("=", "9", "R"), ("<", "2", "S"), ("<=", "8", "S|I"), ("≥", "8", "I|R")])
def test_breakpoint_categories(spark, sign, value, want):
    status = "CENSORED_AMBIGUOUS" if "|" in want else "VERSION_CONDITIONAL_INTERPRETATION"
    assert interpreted(spark, {"mic_sign": sign, "mic_value": value, "drug": "TEST Drug"}, [RULE]) == (status, want)


@pytest.mark.parametrize(
    "reading, rules, want",
    [
        ({}, [], "NO_UNIQUE_DOCUMENTED_BREAKPOINT"),
        ({}, [RULE, RULE], "NO_UNIQUE_DOCUMENTED_BREAKPOINT"),
        ({"version": ""}, [RULE], "INCOMPLETE_METADATA"),
        ({"organism": None}, [RULE], "INCOMPLETE_INTERPRETIVE_CONTEXT"),
        ({"method": "disk"}, [RULE], "NOT_MIC"),
        ({"mic_value": "NaN"}, [RULE], "INVALID_MIC"),
        ({"mic_value": "-1"}, [RULE], "INVALID_MIC"),
        ({"mic_sign": "~"}, [RULE], "UNKNOWN_SIGN"),
        ({}, [{**RULE, "source_sha256": "ab"}], "BREAKPOINT_CITATION_INCOMPLETE"),
        ({}, [{**RULE, "s_max": "two"}], "INVALID_BREAKPOINT"),
        ({}, [{**RULE, "s_max": "9"}], "UNSUPPORTED_BREAKPOINT"),
        ({}, [{**RULE, "convention": "R_GE"}], "UNSUPPORTED_BREAKPOINT_CONVENTION"),
    ],
)
def test_breakpoint_failures(spark, reading, rules, want):
    assert interpreted(spark, reading, rules) == (want, "")


def test_family_alleles(spark):
    """The alleles of the OXA-48-like group."""
    alleles = [48, 162, 163, 181, 204, 232, 244, 245, 370, 405, 438, 484, 505, 517, 519, 535, 537]
    rows = spark.range(700).select("id", labels.carbapenemase_family(F.concat(F.lit("blaOXA-"), F.col("id").cast("string"))).alias("family"))
    assert [r.id for r in rows.where("family = 'OXA-48-like'").orderBy("id").collect()] == alleles


def test_membership_faults(spark, tmp_path):
    for name, line in (("bad", "f | a:1 b:2"), ("twice", "f | a:1 a:1")):
        (tmp_path / name).write_text(line + "\n")
        with pytest.raises(Exception, match="bad token|repeated sample"):
            text.scan_membership(spark, f"file://{tmp_path}/{name}").collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-{1 + i % 9:02d} 10:00:00", float(i)) for i in range(90)], "event_id long, t string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        snapshots.run_once(spark, f"file://{tmp_path}/in", "event_id long, ts timestamp, value double", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
    want = sorted(tuple(r) for r in snapshots.category_counts(rows).collect())
    assert got and set(got) <= set(want) and {r[0] for r in want} - {r[0] for r in got} <= {max(r[0] for r in want)}
