"""Normal forms of labels, identifiers and free text. Unknown values become null, never another class."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands for a missing entry, and the accepted spellings of the three categories.
MISSING = ("", "NA", "N/A", "NONE", "NAN", "NULL", "UNKNOWN", "-")
CATEGORIES = {"R": "R", "RESISTANT": "R", "S": "S", "SUSCEPTIBLE": "S", "I": "I", "INTERMEDIATE": "I"}


def missing_to_null(col: Column) -> Column:
    value = F.trim(col)
    return F.when(~F.upper(value).isin(*MISSING), value)


def category(col: Column) -> Column:
    """S, I or R; null for anything else."""
    folded = F.upper(F.trim(col))
    out = F.lit(None).cast("string")
    for spelling, name in CATEGORIES.items():
        out = F.when(folded == spelling, name).otherwise(out)
    return out


def binary_label(col: Column) -> Column:
    """1 for R, 0 for S; I and unknown values are null."""
    found = category(col)
    return F.when(found == "R", 1).when(found == "S", 0)


def strict_label(col: Column) -> Column:
    """As ``category``, but a value that isn't one fails the query."""
    return F.coalesce(category(col), F.raise_error(F.concat(F.lit("not a category: "), F.coalesce(col, F.lit("null")))).cast("string"))


def repaired_id(col: Column) -> Column:
    """``123.0``, an id that went through a float, as ``123``."""
    return F.regexp_replace(F.trim(col), r"^(\d+)\.0$", "$1")


def folded_name(col: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def versionless(col: Column) -> Column:
    """An accession without its version."""
    return F.substring_index(F.trim(col), ".", 1)


def version_number(col: Column) -> Column:
    """What follows the last dot, 0 without a number there."""
    return F.coalesce(F.expr("cast(null as int)"), F.when(F.regexp_extract(col, r"\.(\d+)$", 1) != "", F.regexp_extract(col, r"\.(\d+)$", 1).cast("int")), F.lit(0))


def tokens(col: Column, delimiters: str = r"[;,|\s]+") -> Column:
    """The non-empty parts between any of the delimiters."""
    return F.filter(F.split(col, delimiters), lambda x: x != "")


def strict_boolean(col: Column) -> Column:
    """true/false/1/0; anything else but null fails the query."""
    folded = F.lower(F.trim(col))
    return F.when(folded.isin("true", "1"), True).when(folded.isin("false", "0"), False).when(col.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), col)).cast("boolean"))


@F.pandas_udf(StringType())
def normal_form(values: pd.Series) -> pd.Series:
    """Compatibility forms alike (full width, both micro signs), without white space around and case."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip().casefold())


def normal_units(df: DataFrame, unit: str, name: str) -> DataFrame:
    """Adds the canonical form of a unit; every distinct spelling is normalised once."""
    spellings = df.select(F.col(unit).alias("__unit")).where("__unit is not null").distinct()
    known = spellings.select("__unit", canonical_unit(normal_form("__unit")).alias(name))
    return df.join(known, F.col(unit) == F.col("__unit"), "left").drop("__unit")


def canonical_unit(col: Column) -> Column:
    """Micro signs of both code points alike, and milligrams a litre as micrograms a millilitre."""
    folded = F.translate(F.lower(F.trim(col)), "µ", "μ")
    return F.when(folded.isin("mg/l", "μg/ml", "ug/ml", "mcg/ml"), "mg/L").otherwise(folded)


def gene_family(col: Column) -> Column:
    """A determinant without mutation suffix, copy number and allele number."""
    no_mutation = F.regexp_replace(F.trim(col), r"_[A-Z]\d+[A-Z*]$", "")
    no_copy = F.regexp_replace(no_mutation, r"(_dup|\.)\d+$", "")
    return F.regexp_replace(no_copy, r"-\d+$", "")


def genotype_token(col: Column) -> tuple[Column, Column]:
    """(determinant, evidence) of ``name=EVIDENCE``; without ``=`` the evidence is COMPLETE."""
    name = F.trim(F.substring_index(col, "=", 1))
    evidence = F.when(F.instr(col, "=") > 0, F.upper(F.trim(F.substring_index(col, "=", -1)))).otherwise("COMPLETE")
    return name, evidence


#: Numbers of the alleles of the OXA-48-like group.
OXA_48_LIKE = (48, 162, 163, 181, 204, 232, 244, 245, 370, 405, 438, 484, 505, 517, 519, 535, 537)


def carbapenemase_family(col: Column) -> Column:
    """KPC, NDM, VIM, IMP or OXA-48-like by a symbol's name and allele number; null for others."""
    symbol = F.upper(F.trim(col))
    plain = F.regexp_extract(symbol, r"^BLA(KPC|NDM|VIM|IMP)(-\d+)?$", 1)
    allele = F.regexp_extract(symbol, r"^BLAOXA-(\d+)$", 1)
    return F.when(plain != "", plain).when(allele.isin(*map(str, OXA_48_LIKE)), "OXA-48-like")
