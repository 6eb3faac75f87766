"""Queries over sources and sinks: tables are written in a format and read back through its scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import gates, tasks
from ..operators.ordered import positions
from ..registry import query
from ..roles import calls, table
from ..session import materialise, scratch
from ..sources import documents as docs
from ..sources import files, text


def _written(df: DataFrame, name: str, fmt: str = "csv", **options) -> str:
    path = scratch(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return path


NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


@query("S01_csv_as_text", NATION)
def csv_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(table(spark, sf_dir, "nation"), "csv", header=True)
    return text.scan_csv(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query("S02_tsv_unquoted", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events")
def tsv_unquoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with quotes in it, written and read with literal tabs."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return text.scan_tsv(spark, _written(rows, "tsv", sep="\t", header=True, quote=""), ["event_id", "event_type", "props"])


@query("S03_tsv_required_columns", "SELECT CAST(p_partkey AS VARCHAR) AS part, p_brand AS symbol, p_type AS type FROM part")
def tsv_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("type"), "p_size")
    return text.scan_tsv_folder(spark, _written(rows, "annotation", sep="\t", header=True), ["part", "symbol", "type"]).drop("sample")


@query("S04_partitioned_explode_scan", "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, w AS word FROM (SELECT conv_id, turn, unnest(string_split(role || ' ' || CAST(turn AS VARCHAR), ' ')) AS w FROM conversations) u WHERE w <> 'system'")
def explode_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("words"))
    path = _written(rows, "chunks", header=True)
    read = spark.read.schema("conv_id long, turn long, words string").option("header", True).csv(path)
    return read.select("conv_id", "turn", F.explode(F.split("words", " ")).alias("word")).where("word <> 'system'")


@query("S05_parquet_scan", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 40")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size >= 40").select("p_partkey", "p_brand")


@query("S07_nested_json", "SELECT CAST(r_regionkey AS BIGINT) AS region, n_name AS nation FROM region JOIN nation ON r_regionkey = n_regionkey")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name")).alias("cases"))
    path = scratch(spark, "json")
    nested.repartition("n_regionkey").write.partitionBy("n_regionkey").json(path)
    cases = text.scan_json(spark, path, "n_regionkey long, cases array<struct<n_name:string>>")
    return cases.select(F.col("n_regionkey").alias("region"), F.explode("cases").alias("c")).select("region", F.col("c.n_name").alias("nation"))


@query("S08_jsonl_checkpoint", "SELECT COUNT(*) FILTER (WHERE event_id % 10 <> 3) AS valid, COUNT(*) FILTER (WHERE event_id % 10 = 3) AS malformed FROM events")
def jsonl_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 3, '{"event_id": 1, "k').otherwise(F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    path = scratch(spark, "jsonl")
    lines.write.text(path)
    rows = text.scan_jsonl(spark, path, "event_id long, event_type string").select("event_id", "_corrupt_record")
    return rows.where("event_id is not null or _corrupt_record is not null").agg(F.count_if(F.col("_corrupt_record").isNull()).alias("valid"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"))


@query("S09_xml_antibiogram", "SELECT CAST(n_nationkey AS VARCHAR) AS accession, n_name AS antibiotic, CASE WHEN n_regionkey < 2 THEN 'R' ELSE 'S' END AS phenotype FROM nation")
def xml_antibiogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<Cell>"), c, F.lit("</Cell>"))
    phenotype = F.when(F.col("n_regionkey") < 2, "R").otherwise("S")
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit('<BioSample accession="'), F.col("n_nationkey").cast("string"), F.lit('"><Table class="Antibiogram.1.0"><Header><Cell>Antibiotic</Cell><Cell>Phenotype</Cell></Header><Body><Row>'), cell(F.col("n_name")), cell(phenotype), F.lit("</Row></Body></Table></BioSample>")).alias("value")
    )
    path = scratch(spark, "xml")
    # one document with one root; the table of nations has a fixed size
    rows.agg(F.concat(F.lit("<Set>"), F.array_join(F.collect_list("value"), ""), F.lit("</Set>")).alias("value")).write.text(path)
    schema = "_accession string, Table struct<Header:struct<Cell:array<string>>,Body:struct<Row:array<struct<Cell:array<string>>>>>"
    cells = text.antibiogram_rows(text.scan_xml_samples(spark, path, "BioSample", schema))
    return cells.groupBy("accession", "row").agg(F.max(F.when(F.col("column") == "Antibiotic", F.col("value"))).alias("antibiotic"), F.max(F.when(F.col("column") == "Phenotype", F.col("value"))).alias("phenotype")).drop("row")


@query("S10_xml_selectors", "SELECT CAST(r_regionkey AS VARCHAR) AS acc, r_name AS name FROM region")
def xml_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("<rec id='"), F.col("r_regionkey").cast("string"), F.lit("'><n>"), F.col("r_name"), F.lit("</n></rec>"))
    rows = table(spark, sf_dir, "region").select(value.alias("doc"))
    safe = F.when(F.col("doc").rlike("(?i)<!(DOCTYPE|ENTITY)"), F.raise_error(F.lit("declarations are not allowed")).cast("string")).otherwise(F.col("doc"))
    selectors = {"acc": "/rec/@id", "name": "/rec/n/text()"}
    return rows.select(*(F.xpath_string(safe, F.lit(path)).alias(name) for name, path in selectors.items()))


@query("S11_html_elements", r"SELECT page_id AS id, COUNT(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=')) AS x FROM pages) u GROUP BY page_id")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs.html_elements(table(spark, sf_dir, "pages"), "page_id", "html", ["a"])
    return found.groupBy("id").agg(F.count("*").alias("links"))


@query("S12_fasta_scan", "SELECT 'part' || CAST(p_partkey AS VARCHAR) AS contig, upper(replace(p_name, ' ', '')) AS seq FROM part")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit(">part"), F.col("p_partkey").cast("string"), F.lit(" x\n"), F.regexp_replace("p_name", " ", "\n")).alias("value"))
    path = scratch(spark, "fasta")
    rows.write.option("compression", "gzip").text(path)
    return docs.scan_fasta(spark, path).select("contig", "seq")


@query("S13_membership_scan", "SELECT DISTINCT 'b' || replace(p_brand, '#', '') AS feature, CAST(p_size AS VARCHAR) AS sample FROM part")
def membership_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array_join(F.transform(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), lambda s: F.concat(s, F.lit(":1"))), " ")
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(members.alias("m")).select(F.concat(F.lit("b"), F.regexp_replace("p_brand", "#", ""), F.lit(" | "), F.col("m")).alias("value"))
    path = scratch(spark, "membership")
    rows.write.option("compression", "gzip").text(path)
    return text.scan_membership(spark, path)


BITS_SQL = """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS feature FROM (SELECT DISTINCT p_brand FROM part) d)
SELECT DISTINCT feature, CAST(l_orderkey AS INTEGER) AS sample FROM lineitem JOIN part ON l_partkey = p_partkey JOIN b USING (p_brand)"""


def stored_bits(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Which orders have which brand, written as files of bits: their folder and the number of samples."""
    found = calls(spark, sf_dir)
    brands = materialise(positions(found.select("feature").distinct(), [F.col("feature")], "number"))
    samples = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    path = scratch(spark, "bits")
    cells = found.join(brands, "feature").select(F.col("number").alias("feature"), "sample")
    files.write_bits(cells, path, samples, brands.count(), per_file=7).count()
    return path, samples


@query("S14_bit_matrix", BITS_SQL)
def bit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set bits of a matrix that lies in several files, in splits of a few features."""
    path, samples = stored_bits(spark, sf_dir)
    return files.scan_bits(spark, path, samples, split=3)


@query("S14_selected_features", BITS_SQL + " WHERE feature IN (0, 5, 6, 7, 20)")
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the bytes of the asked features are read."""
    path, samples = stored_bits(spark, sf_dir)
    return files.scan_bits(spark, path, samples, features=[0, 5, 6, 7, 20])


@query("S15_sparse_rows", "SELECT vec_id, CAST(i AS BIGINT) AS feature, CAST(embedding[CAST(i AS INTEGER)] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, (SELECT MAX(len(embedding)) + 1 FROM embeddings))) AS i) t WHERE embedding[CAST(i AS INTEGER)] > 0")
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return rows.where("v > 0").select("vec_id", (F.col("p") + 1).cast("long").alias("feature"), F.col("v").cast("double").alias("value"))


@query("S19_registered_sql", "SELECT s_nationkey AS nation, COUNT(*) AS suppliers FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2)) GROUP BY s_nationkey")
def registered_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return spark.sql(
        "SELECT s_nationkey AS nation, count(*) AS suppliers FROM {supplier} LEFT SEMI JOIN {nation} ON s_nationkey = n_nationkey AND array_contains(:regions, n_regionkey) GROUP BY s_nationkey",
        args={"regions": [1, 2]}, supplier=supplier, nation=nation,
    )


CHUNKS = """WITH c AS (SELECT c_custkey // 100 AS chunk, string_agg(c_custkey || ',' || c_name, chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY 1)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, file, content): customers as text, a file for each hundred."""
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), F.col("c_name"))
    rows = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    return rows.select("chunk", F.concat(F.lit("customers-"), F.col("chunk").cast("string"), F.lit(".csv")).alias("file"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


@query("S20_hash_verified_scan", CHUNKS + """ SELECT 'customers-' || chunk || '.csv' AS file, CASE WHEN chunk % 5 = 2 THEN NULL ELSE CAST(strlen(content) + CASE WHEN chunk % 5 = 1 THEN 1 ELSE 0 END AS BIGINT) END AS bytes,
  sha256(CASE WHEN chunk % 5 = 1 THEN content || ' ' ELSE content END) AS sha256, CASE chunk % 5 WHEN 1 THEN 'CHANGED' WHEN 2 THEN 'MISSING' WHEN 3 THEN 'UNLISTED' ELSE 'PASS' END AS verdict FROM c""")
def hash_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest is pinned from what the files should hold; then some are written otherwise, some not at all, and some aren't listed."""
    rows, kind = materialise(chunks(spark, sf_dir)), F.col("chunk") % 5
    manifest = materialise(rows.where(kind != 3).select("file", F.sha2("content", 256).alias("sha256")))
    path = scratch(spark, "pinned")
    files.write_files(rows.where(kind != 2).select("file", F.when(kind == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content")), path).count()
    return files.verified(spark, path, manifest)


@query("S21_column_discovery", "SELECT 'c_mktsegment' AS found")
def column_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(gates.first_alias(table(spark, sf_dir, "customer"), ["segment", "C_MktSegment"]),)], "found string")


@query("S24_identifier_harvest", "SELECT DISTINCT id FROM (SELECT CAST(c_nationkey AS VARCHAR) AS id FROM customer UNION ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation) u")
def identifier_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [table(spark, sf_dir, t).select(F.col(c).cast("string").alias("id")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select(labels.missing_to_null(F.col("id")).alias("id")).where("id is not null").distinct()


@query("K01_csv_gzip_sink", "SELECT COUNT(*) AS n, CAST(SUM(r_regionkey) AS BIGINT) AS keys FROM region")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sink")
    table(spark, sf_dir, "region").write.mode("errorifexists").option("compression", "gzip").option("header", True).csv(path)
    return spark.read.schema("r_regionkey int, r_name string").option("header", True).csv(path).agg(F.count("*").alias("n"), F.sum("r_regionkey").alias("keys"))


@query("K02_json_report", "SELECT n_regionkey || '.json' AS file, '{\"region\":' || n_regionkey || ',\"n\":' || COUNT(*) || ',\"mean\":' || CAST(AVG(s_suppkey) AS DOUBLE) || '}' AS report FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each region as a file of JSON, read back."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.avg("s_suppkey").alias("mean"))
    path = scratch(spark, "reports")
    files.write_files(found.select(F.concat(F.col("region").cast("string"), F.lit(".json")).alias("file"), files.json_report(found, ["region", "n", "mean"]).alias("content")), path).count()
    return spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.rtrim(F.regexp_replace("value", "\n", "")).alias("report"))


@query("K03_task_checkpoint", "SELECT o_orderpriority AS task, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'reused' ELSE 'computed' END AS state, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def task_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that was stopped after three of five tasks is taken up: verified parts stay, the rest is made."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("task")), scratch(spark, "tasks")
    asked = materialise(orders.groupBy("task").agg(F.count("*").alias("expected"), F.sum(F.xxhash64("o_orderkey").cast("decimal(38,0)")).cast("string").alias("input")))
    compute = lambda todo: orders.join(todo.select("task"), "task", "left_semi")
    tasks.resume(asked.where(F.col("task").isin("1-URGENT", "2-HIGH", "3-MEDIUM")), compute, path, "o_orderkey long")
    rows, report = tasks.resume(asked, compute, path, "o_orderkey long")
    return rows.groupBy("task").agg(F.sum("o_orderkey").cast("long").alias("keys")).join(report, "task").select("task", "state", "n", "keys")


@query("K04_no_overwrite", "SELECT TRUE AS refused")
def no_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "once")
    rows = table(spark, sf_dir, "region")
    rows.write.mode("errorifexists").parquet(path)
    try:
        rows.write.mode("errorifexists").parquet(path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.createDataFrame([(refused,)], "refused boolean")


@query("K05_output_manifest", CHUNKS + " SELECT 'customers-' || chunk || '.csv' AS file, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM c")
def output_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and digest of every file that a job wrote."""
    path = scratch(spark, "outputs")
    files.write_files(chunks(spark, sf_dir), path).count()
    return files.file_digests(spark, path)
