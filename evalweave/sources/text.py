"""Delimited text, with ids always as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gates import require_columns


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_csv(spark: SparkSession, path: str, columns: list[str], keep_blank: bool = False) -> DataFrame:
    """Every column as text. Blanks become null, or stay blank with ``keep_blank``."""
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False)
    if keep_blank:
        return reader.option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    rows = reader.csv(path)
    return rows.select(*(F.when(F.trim(c) != "", F.col(c)).alias(c) for c in columns))


def scan_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Literal tabs and no quoting: a quote in free text swallows nothing. A row of another width fails."""
    return spark.read.schema(text_schema(columns)).option("header", True).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)


def scan_tsv_folder(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All files of a folder with their name without suffix as ``sample``; more columns are tolerated."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    require_columns(rows, required)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^/.]*)?$", 1)
    return rows.select(name.alias("sample"), *(F.col(f"`{c}`") for c in required))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a line; malformed lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_membership(spark: SparkSession, path: str) -> DataFrame:
    """(feature, sample) of lines ``feature | sample:1 sample:1``; a bad token or a repeated sample fails.

    Gzip files can't be split, so the lines are dealt out again after reading.
    """
    lines = spark.read.text(path).repartition(spark.sparkContext.defaultParallelism).where(F.trim("value") != "")
    feature, rest = F.trim(F.substring_index("value", "|", 1)), F.split(F.trim(F.substring_index("value", "|", -1)), r"\s+")
    bad = F.exists(rest, lambda t: ~t.rlike(r"^[^:]+:1$"))
    names = F.transform(rest, lambda t: F.substring_index(t, ":", 1))
    fault = F.when(bad, "bad token").when(F.size(names) != F.size(F.array_distinct(names)), "repeated sample")
    checked = F.when(fault.isNull(), names).otherwise(F.raise_error(F.concat(fault, F.lit(" in "), feature)).cast("array<string>"))
    return lines.select(feature.alias("feature"), F.explode(checked).alias("sample"))


def scan_xml_samples(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def antibiogram_rows(samples: DataFrame) -> DataFrame:
    """(accession, column, value, row) of ``Table/Header/Cell`` and ``Table/Body/Row/Cell``: cells by position."""
    rows = samples.select(F.col("_accession").alias("accession"), F.col("Table.Header.Cell").alias("names"), F.posexplode("Table.Body.Row").alias("row", "r"))
    cells = rows.select("accession", "row", F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("r.Cell").alias("value"))).alias("c"))
    return cells.select("accession", "row", F.col("c.name").alias("column"), F.col("c.value").alias("value"))
