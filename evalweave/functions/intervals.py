"""Censored measurements as intervals, and the categories they allow.

An interval is a struct (lo, hi, lo_closed, hi_closed) of decimals; a null ``hi`` is infinity. A reading
``<=m`` is (0, m], ``<m`` is (0, m), ``>m`` is (m, inf), ``>=m`` is [m, inf), and ``m`` or ``=m`` is [m, m].
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(18,6)"


def parse_mic(raw: Column) -> Column:
    """The interval of a reading; null if it isn't a sign and a positive number."""
    text = F.trim(raw)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^≤", "<="), "^≥", ">="), "^==", "="), "^=\\s*", "")
    number = lambda t: F.regexp_extract(t, r"^(?:<=|>=|<|>)?\s*(\d+(?:\.\d+)?)$", 1)
    parts = _once(text, lambda t: F.struct(F.regexp_extract(t, r"^(<=|>=|<|>)?", 1).alias("sign"), number(t).alias("number")))
    return _once(parts, lambda p: _interval(p["sign"], p["number"]))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it stands in it: Spark writes columns out in each place."""
    return F.transform(F.array(value), use)[0]


def _interval(sign: Column, number: Column) -> Column:
    value = F.when(number != "", number.cast(NUMBER))
    zero, none = F.lit(0).cast(NUMBER), F.lit(None).cast(NUMBER)
    upper = sign.isin("<", "<=")
    found = F.struct(
        F.when(upper, zero).otherwise(value).alias("lo"),
        F.when(sign.isin(">", ">="), none).otherwise(value).alias("hi"),
        F.when(upper | (sign == ">"), F.lit(False)).otherwise(F.lit(True)).alias("lo_closed"),
        F.when(sign.isin("<", ">", ">="), F.lit(False)).otherwise(F.lit(True)).alias("hi_closed"),
    )
    return F.when(value > 0, found)


def overlap(a: Column, b: Column) -> Column:
    """Whether two intervals share a value; where they only touch, both ends must be closed."""

    def below(x: Column, y: Column) -> Column:
        """x starts no later than y ends."""
        return y["hi"].isNull() | (x["lo"] < y["hi"]) | (x["lo"] == y["hi"]) & x["lo_closed"] & y["hi_closed"]

    return below(a, b) & below(b, a)


def widened(x: Column, factor: int = 2) -> Column:
    """The interval with its lower end divided and its upper end multiplied by ``factor``."""
    return F.struct((x["lo"] / factor).cast(NUMBER).alias("lo"), (x["hi"] * factor).cast(NUMBER).alias("hi"), x["lo_closed"].alias("lo_closed"), x["hi_closed"].alias("hi_closed"))


def allowed_categories(x: Column, s_max: Column, r_limit: Column, r_closed: Column) -> Column:
    """Sorted array of S, I, R that the interval can mean: S up to ``s_max``, R above ``r_limit`` (from it on
    if ``r_closed``), I between."""
    zero, none, no, yes = F.lit(0).cast(NUMBER), F.lit(None).cast(NUMBER), F.lit(False), F.lit(True)
    region = lambda lo, hi, lc, hc: F.struct(lo.alias("lo"), hi.alias("hi"), lc.alias("lo_closed"), hc.alias("hi_closed"))
    s, r = region(zero, s_max.cast(NUMBER), no, yes), region(r_limit.cast(NUMBER), none, r_closed, no)
    i = region(s_max.cast(NUMBER), r_limit.cast(NUMBER), no, ~r_closed)
    some = (s_max < r_limit) & overlap(x, i)
    return F.filter(F.array(F.when(some, "I"), F.when(overlap(x, r), "R"), F.when(overlap(x, s), "S")), lambda c: c.isNotNull())


def boundary_status(raw: Column, label: Column, s_max: Column, r_limit: Column, r_closed: Column) -> Column:
    """Whether a label is safe from an error of one doubling step of the reading."""
    x = parse_mic(raw)
    now, near = allowed_categories(x, s_max, r_limit, r_closed), allowed_categories(widened(x), s_max, r_limit, r_closed)
    only = F.array(label)
    return F.when(x.isNull(), "UNSUPPORTED_MIC").when(~(now == only), "OBSERVED_INTERVAL_OR_CATEGORY_UNCERTAIN").when(near == only, "BOUNDARY_ROBUST").otherwise("BOUNDARY_SENSITIVE")


def review_flag(sign: Column, label: Column) -> Column:
    """Readings whose direction of censoring is at odds with the label."""
    return F.when(sign.isin("<", "<=") & (label == "R"), "LOWER_CENSORED_BUT_RESISTANT").when(sign.isin(">", ">=") & (label == "S"), "UPPER_CENSORED_BUT_SUSCEPTIBLE").otherwise("")
