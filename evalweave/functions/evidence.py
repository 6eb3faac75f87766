"""The state of a label's evidence: two sources of observations and a dated history of changes.

A case is a sample and a drug. Each source's observations of it count as one state if interval, unit and category
agree after normalisation; only the least and the largest state of a case are kept, so a case with many rows is
aggregated like any other. History counts if it is traceable (an https source and a SHA-256), dated not after the
case's day, and changes the value; it explains a difference only if both of its values are the two sources' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .intervals import overlap, parse_mic
from .labels import canonical_unit

CASE = ["sample", "drug"]


def folded_drug(col: Column) -> Column:
    return F.lower(F.trim(col))


def normal_state(mic: Column, unit: Column, category: Column) -> Column:
    """(mic interval, unit, category) in comparable form."""
    plain = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(parse_mic(F.regexp_replace(mic, r"\s+", "")).alias("mic"), plain(canonical_unit(unit)).alias("unit"), F.upper(F.trim(plain(category))).alias("category"))


def side(observations: DataFrame, name: str) -> DataFrame:
    """(sample, drug, <name>, <name>_other, <name>_rows) of (sample, drug, mic, unit, category)."""
    state = normal_state(F.col("mic"), F.col("unit"), F.col("category"))
    rows = observations.select("sample", folded_drug(F.col("drug")).alias("drug"), state.alias("s"))
    return rows.groupBy(*CASE).agg(F.min("s").alias(name), F.max("s").alias(f"{name}_other"), F.count("*").alias(f"{name}_rows"))


def history_day(col: Column) -> Column:
    """A day as month/day/year with two digits of the year; 69 to 99 are of the last century."""
    day = F.try_to_date(F.when(col.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), col), "M/d/yy")
    return F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)


def audit(cases: DataFrame, old: DataFrame, new: DataFrame, history: DataFrame) -> DataFrame:
    """The evidence of every case.

    ``cases``: sample, drug, as_of (unique); ``old`` and ``new``: sample, drug, mic, unit, category; ``history``: sample,
    drug, old_value, new_value, day, source_url, artifact_sha256. Returns the case with evidence_state, old_rows, new_rows,
    category_difference, mic_difference, mic_disjoint (null where they can't be told), native_history, history_link.
    """
    sides = cases.select("sample", F.col("drug").alias("named"), folded_drug(F.col("drug")).alias("drug"), "as_of").join(side(old, "old"), CASE, "left").join(side(new, "new"), CASE, "left")
    sides = materialise(sides)  # read twice: by the history, and by the cases that it is joined to
    single = F.col("old").eqNullSafe(F.col("old_other")) & F.col("new").eqNullSafe(F.col("new_other"))
    a, b, unit = F.col("old.mic"), F.col("new.mic"), F.lit("mg/L")
    measured = a.isNotNull() & b.isNotNull() & (F.col("old.unit") == unit) & (F.col("new.unit") == unit)
    known = F.col("old.category").isin("S", "I", "R") & F.col("new.category").isin("S", "I", "R")
    traced = F.col("artifact_sha256").rlike("^[0-9a-f]{64}$") & F.startswith("source_url", F.lit("https://"))
    before, after = (parse_mic(F.regexp_replace(c, r"\s+", "")) for c in ("old_value", "new_value"))
    changes = history.where(traced).select("sample", folded_drug(F.col("drug")).alias("drug"), history_day(F.col("day")).alias("day"), before.alias("before"), after.alias("after")).where("before <> after")
    dated = sides.select(*CASE, "as_of", a.alias("a"), b.alias("b")).join(changes, CASE).where("day <= as_of")
    dated = dated.groupBy(*CASE).agg(F.max(F.coalesce((F.col("before") == F.col("a")) & (F.col("after") == F.col("b")), F.lit(False))).alias("link"))
    rows = sides.join(dated, CASE, "left")
    paired = F.col("old_rows").isNotNull() & F.col("new_rows").isNotNull()
    told = paired & single & measured
    differs, disjoint, changed = a != b, ~overlap(a, b), F.when(known, F.col("old.category") != F.col("new.category"))
    state = (
        F.when(~paired, "INSUFFICIENT_PAIRED_REFERENCE")
        .when(~single, "AMBIGUOUS_MULTIPLE_REFERENCE_STATES")
        .when(~measured, "UNSUPPORTED_OR_MISSING_MIC_OR_UNIT")
        .when(F.col("link"), "DOCUMENTED_MIC_UPDATE_LINK")
        .when(changed.isNull(), "CATEGORY_UNAVAILABLE_CAUSE_UNRESOLVED")
        .when(disjoint & changed, "DISJOINT_MIC_WITH_CATEGORY_CHANGE")
        .when(disjoint, "DISJOINT_MIC_WITH_SAME_CATEGORY")
        .when(changed, "CATEGORY_ONLY_REFERENCE_DIFFERENCE")
        .when(differs, "OVERLAPPING_REPORTING_INTERVALS")
        .otherwise("SAME_REPORTED_REFERENCE")
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "sample", F.col("named").alias("drug"), state.alias("evidence_state"), count(F.col("old_rows")).alias("old_rows"), count(F.col("new_rows")).alias("new_rows"),
        F.when(told, changed).alias("category_difference"), F.when(told, differs).alias("mic_difference"), F.when(told, disjoint).alias("mic_disjoint"),
        F.when(told, F.col("link").isNotNull()).alias("native_history"), F.when(told, F.coalesce("link", F.lit(False))).alias("history_link"),
    )
