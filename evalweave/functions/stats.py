"""Statistics as column expressions over counts, and the few that need a special function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def confusion(y: Column, pred: Column, w: Column | None = None) -> list[Column]:
    """Aggregates tp, fn, tn, fp, weighted if ``w`` is given."""
    one = F.lit(1).cast("long") if w is None else w
    cell = lambda a, b: F.coalesce(F.sum(F.when((y == a) & (pred == b), one)), F.lit(0))
    return [cell(1, 1).alias("tp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp")]


def metrics(tp: Column, fn: Column, tn: Column, fp: Column, mcc_undefined: float | None = None) -> dict[str, Column]:
    """Rates of a confusion table; those with a zero denominator are null, MCC as told."""
    tp, fn, tn, fp = (c.cast("double") for c in (tp, fn, tn, fp))
    se, sp = ratio(tp, tp + fn), ratio(tn, tn + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fn + tn + fp),
        "sensitivity": se,
        "specificity": sp,
        "ba": (se + sp) / 2,
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(F.lit(mcc_undefined).cast("double")),
        "missed_among_negative_calls": ratio(fn, fn + tn),
    }


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Ends of the 95 % score interval of k of n, within 0 and 1; null for n = 0."""
    z2 = Z95 * Z95
    p = ratio(k, n)
    middle, spread = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)


def chi2_pearson(a: Column, b: Column, n_pos: Column, n_neg: Column) -> Column:
    """Pearson's statistic of presence (a of n_pos, b of n_neg); 0 if a margin is empty."""
    a, b, p, q = (c.cast("double") for c in (a, b, n_pos, n_neg))
    c, d = p - a, q - b
    margins = (a + b) * (c + d) * p * q
    return F.when(margins > 0, (p + q) * (a * d - b * c) * (a * d - b * c) / margins).otherwise(0.0)


def chi2_presence(a: Column, b: Column, n_pos: Column, n_neg: Column) -> Column:
    """The statistic on presence sums only: observed and expected presence in either class."""
    a, b, p, q = (c.cast("double") for c in (a, b, n_pos, n_neg))
    ep, eq = (a + b) * p / (p + q), (a + b) * q / (p + q)
    return F.when((ep > 0) & (eq > 0), (a - ep) * (a - ep) / ep + (b - eq) * (b - eq) / eq).otherwise(0.0)


def log_odds(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Log odds ratio and its standard error; half a count more in each cell if some cell is 0."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    a, b, c, d = (x.cast("double") + add for x in (a, b, c, d))
    return F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def entropy(p: Column) -> Column:
    """Binary entropy in bits."""
    term = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return term(p) + term(1 - p)


def jensen_shannon(p: Column, q: Column) -> Column:
    """One bin's part of the divergence in bits; its sum over bins is the divergence."""
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (term(p) + term(q)) / 2


@F.pandas_udf(DoubleType())
def chi2_1df_sf(x: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom."""
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(v / 2)))


#: Logarithm below which a double is zero; tables whose ratios are worked out at a time.
UNDERFLOW, RUN = -746.0, 1 << 12


def _from_mode(row: int, other: int, column: int, mode: int, step: int, end: int) -> np.ndarray:
    """Logarithms of how much likelier each table from ``mode`` on, in one direction, is than the one at ``mode``: to ``end``, or until they are zero as doubles."""
    found, last, at = [], 0.0, mode
    while at != end and last > UNDERFLOW:
        k = np.arange(at, at + step * min(RUN, abs(end - at)), step, dtype=float)
        up = k if step > 0 else k - 1  # both directions are ratios of a table and the next larger one
        ratio = np.log(row - up) + np.log(column - up) - np.log(up + 1) - np.log(other - column + up + 1)
        logs = last + np.cumsum(step * ratio)
        found.append(logs)
        last, at = float(logs[-1]), at + step * len(k)
    return np.concatenate(found) if found else np.empty(0)


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables with the same margins that are at most as likely as the one seen.

    Ratios of neighbours are followed from the likeliest table outwards until likelihoods are zero as doubles, so the work grows with the
    spread of the distribution, which is of the order of the root of the counts.
    """
    row, other, column = a + b, c + d, a + c
    low, high = max(0, column - other), min(row, column)
    if high < low:
        return 1.0
    mode = min(high, max(low, (row + 1) * (column + 1) // (row + other + 2)))
    down, up = _from_mode(row, other, column, mode, -1, low), _from_mode(row, other, column, mode, 1, high)
    p = np.exp(np.concatenate([down[::-1], [0.0], up]))
    at = a - mode + len(down)
    seen = p[at] if 0 <= at < len(p) else 0.0
    return float(min(1.0, p[p <= seen * (1 + 1e-7)].sum() / p.sum()))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of the table ((a, b), (c, d)); equal tables are worked out once a batch."""
    known: dict[tuple, float] = {}
    return pd.Series([known.setdefault(t, _fisher(*t)) if t not in known else known[t] for t in zip(a.astype(int), b.astype(int), c.astype(int), d.astype(int), strict=True)], dtype=float)
