"""Readings against documented breakpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import NUMBER, allowed_categories, parse_mic

#: What names a breakpoint, and what else a reading has to state.
CONTEXT = ["organism", "drug", "standard", "version", "context", "unit"]
STATED = ["mic_value", "mic_sign", "unit", "method", "standard", "version"]
#: Fixed value: susceptible up to the lower limit, resistant above the upper one.
CONVENTION = "S_LE_R_GT"


def _blank(names: list[str]) -> Column:
    return F.greatest(*(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in names))


def interpret(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with status and possible_categories (``S|I|R`` or a part of it, empty without an interpretation).

    ``rows``: organism, drug, standard, version, context, unit, method, mic_sign, mic_value as text; ``rules``: the first six,
    s_max, r_above, convention, source_url, source_sha256 as text. Exactly one rule has to agree in all six, without regard to case.
    """
    keys = [F.lower(F.col(c)).alias(f"__{c}") for c in CONTEXT]
    names = [f"__{c}" for c in CONTEXT]
    limits = ["s_max", "r_above", "convention", "source_url", "source_sha256"]
    # of several rules for one key any is kept, since only their number counts then
    one = rules.select(*keys, F.struct(*limits).alias("rule")).groupBy(*names).agg(F.count("*").alias("rules"), F.min("rule").alias("rule"))
    found = rows.select("*", *keys).join(one, names, "left")
    sign = F.replace(F.replace(F.col("mic_sign"), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    sign = F.when(sign == "==", "=").otherwise(sign)
    number = lambda c: F.when(c.rlike(r"^\s*\+?\d+(\.\d*)?\s*$"), F.trim(c)).try_cast(NUMBER)
    s_max, above = number(F.col("rule.s_max")), number(F.col("rule.r_above"))
    cited = F.coalesce((F.col("rule.source_url") != "") & F.col("rule.source_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    any_number = lambda c: F.coalesce(F.trim(c).rlike(r"(?i)^[+-]?(\d+(\.\d*)?|inf(inity)?|nan)$"), F.lit(False))
    value = number(F.col("mic_value"))
    x = parse_mic(F.concat(sign, value.cast("string")))
    allowed = allowed_categories(x, s_max, above, F.lit(False))
    sure = F.filter(F.array(F.lit("S"), F.lit("I"), F.lit("R")), lambda c: F.array_contains(allowed, c))
    failure = (
        F.when(_blank(STATED), "INCOMPLETE_METADATA")
        .when(F.upper("method") != "MIC", "NOT_MIC")
        .when(~F.coalesce(value > 0, F.lit(False)), "INVALID_MIC")
        .when(~sign.isin("=", "<", "<=", ">", ">="), "UNKNOWN_SIGN")
        .when(_blank(CONTEXT), "INCOMPLETE_INTERPRETIVE_CONTEXT")
        .when(F.coalesce("rules", F.lit(0)) != 1, "NO_UNIQUE_DOCUMENTED_BREAKPOINT")
        .when(~cited, "BREAKPOINT_CITATION_INCOMPLETE")
        .when(~any_number(F.col("rule.s_max")) | ~any_number(F.col("rule.r_above")), "INVALID_BREAKPOINT")
        .when(~F.coalesce((s_max > 0) & (s_max <= above), F.lit(False)), "UNSUPPORTED_BREAKPOINT")
        .when(~F.col("rule.convention").eqNullSafe(F.lit(CONVENTION)), "UNSUPPORTED_BREAKPOINT_CONVENTION")
    )
    status = F.coalesce(failure, F.when(F.size(sure) == 1, "VERSION_CONDITIONAL_INTERPRETATION").otherwise("CENSORED_AMBIGUOUS"))
    return found.select(*rows.columns, status.alias("status"), F.when(failure.isNull(), F.array_join(sure, "|")).otherwise("").alias("possible_categories"))
