"""Gates: checks that either give rows for an audit table or stop the query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class GateError(ValueError):
    """A gate was not passed."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise GateError(f"missing columns: {missing}")
    return df


def projected(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns by destination name; a source that isn't there is an error."""
    require_columns(df, list(mapping.values()))
    return df.select(*(F.col(f"`{src}`").alias(dst) for dst, src in mapping.items()))


def first_alias(df: DataFrame, aliases: list[str]) -> str | None:
    """The column that the first known alias names, letters and digits compared only."""
    fold = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    known = {fold(c): c for c in reversed(df.columns)}
    return next((known[fold(a)] for a in aliases if fold(a) in known), None)


def audit_row(name: str, counted: DataFrame, ok: Column, detail: Column) -> DataFrame:
    """One row of an audit table from a one-row aggregate."""
    return counted.select(F.lit(name).alias("check"), ok.alias("passed"), detail.cast("string").alias("detail"))


def unique_keys(df: DataFrame, keys: list[str], name: str = "unique keys") -> DataFrame:
    """Passes if no key repeats or is null or blank."""
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    found = counts.agg(F.coalesce(F.sum(F.when((F.col("n") > 1) | blank, 1)), F.lit(0)).alias("bad"))
    return audit_row(name, found, F.col("bad") == 0, F.concat(F.col("bad").cast("string"), F.lit(" bad keys")))


def conflicting_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows are not all the same."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*rest)).alias("versions"), F.count("*").alias("rows")).where("versions > 1")


def collapsed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with exact repeats once; a key with different rows fails the query when it is run."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("v"), F.count_distinct(F.struct(*rest)).alias("n"), F.count("*").alias("copies"))
    checked = packed.withColumn("v", F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("different rows of one key"))))
    return checked.select(*keys, "v.*", "copies")


def expected_counts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """An audit row for each named aggregate."""
    found = df.agg(*(agg.alias(name) for name, (agg, _) in expected.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), (F.col(name) == n).alias("passed"), F.concat(F.col(name).cast("string"), F.lit(f" of {n}")).alias("detail")) for name, (_, n) in expected.items()))
    return found.select(F.explode(rows).alias("r")).select("r.*")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left_only"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right_only"))
    return left.unionByName(right)


def domain_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, bad): how many rows fail each predicate; null counts as failing."""
    found = df.agg(*(F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(name) for name, ok in checks.items()))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("bad")) for n in checks))).alias("r")).select("r.*")


def assert_empty(df: DataFrame, message: str) -> None:
    """Stops with an example if there is any row."""
    if found := df.take(1):
        raise GateError(f"{message}: {found[0].asDict()}")
