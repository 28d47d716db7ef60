"""The driver's tables in the roles of this engine's inputs, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import table

# Records: lineitem with its order. SQL with the meaning of ``records``.
RECORDS = """(SELECT o_orderpriority AS study, o_orderkey AS sample, o_custkey AS patient, 'G' || CAST(l_partkey % 16 AS VARCHAR) AS gene, l_partkey % 16 AS gene_id,
  l_linenumber AS line, CASE l_linenumber % 7 WHEN 0 THEN 'K' || CAST(l_partkey % 16 + 10 AS VARCHAR) || 'R' WHEN 1 THEN 'Q' || CAST(l_partkey % 16 + 10 AS VARCHAR) || '*'
    WHEN 2 THEN 'R' || CAST(l_partkey % 16 + 10 AS VARCHAR) || 'Vfs*7' WHEN 3 THEN 'E' || CAST(l_partkey % 16 + 10 AS VARCHAR) || 'del'
    WHEN 4 THEN 'X' || CAST(l_partkey % 16 + 10 AS VARCHAR) || '_splice' WHEN 5 THEN NULL ELSE 'promoter' END AS change,
  CASE l_returnflag WHEN 'A' THEN 'Missense_Mutation' WHEN 'N' THEN 'Nonsense_Mutation' ELSE 'Frame_Shift_Del' END AS mutation_type,
  CAST(floor(l_quantity) AS BIGINT) % 10 AS alt_count,
  CASE l_linenumber % 4 WHEN 0 THEN 'hg19' WHEN 1 THEN ' GRCh37 ' WHEN 2 THEN 'hg38' ELSE '.' END AS build, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

HREFS = """(SELECT page_id, pos, lower(href) AS href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS h FROM pages)))"""

CALLS = """(SELECT event_id AS ord, user_id AS trace_id, event_type AS tool, props AS args, event_type <> 'error' AS ok, value AS latency,
  CAST(floor(value) AS BIGINT) % 5 AS n_results, CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id AS VARCHAR) END AS error FROM events)"""

CONFIDENT = """(SELECT doc_id, least(0.99, n_chars / 5000.0) AS confidence, quality = 1 AS correct, source FROM documents JOIN labels USING (doc_id))"""


#: Records that a task of their join may hold; with more of them for each of Spark's shuffle partitions, both sides are dealt to more partitions.
TASK_RECORDS = 500_000

#: The same where a record's row becomes wide (its mentions of therapies, its steps with their citations), so that a task sorts such rows in memory.
TASK_WIDE = 150_000


def record_parts(spark: SparkSession, sf_dir: str, task_records: int | None = None) -> int | None:
    """The partitions that the records are dealt to, None if Spark's own number is enough."""
    parts = -(-table(spark, sf_dir, "lineitem").count() // (task_records or TASK_RECORDS))  # from the files' footers
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def records(spark: SparkSession, sf_dir: str, task_records: int | None = None) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = record_parts(spark, sf_dir, task_records)
    if parts:
        line, orders = line.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    n = F.expr("cast(l_partkey % 16 + 10 as string)")
    kind = F.col("l_linenumber") % 7
    change = (
        F.when(kind == 0, F.concat(F.lit("K"), n, F.lit("R"))).when(kind == 1, F.concat(F.lit("Q"), n, F.lit("*"))).when(kind == 2, F.concat(F.lit("R"), n, F.lit("Vfs*7")))
        .when(kind == 3, F.concat(F.lit("E"), n, F.lit("del"))).when(kind == 4, F.concat(F.lit("X"), n, F.lit("_splice"))).when(kind == 5, None).otherwise("promoter")
    )
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("study"), F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("patient"),
        F.expr("concat('G', cast(l_partkey % 16 as string))").alias("gene"), F.expr("l_partkey % 16").alias("gene_id"), F.col("l_linenumber").alias("line"), change.alias("change"),
        F.when(F.col("l_returnflag") == "A", "Missense_Mutation").when(F.col("l_returnflag") == "N", "Nonsense_Mutation").otherwise("Frame_Shift_Del").alias("mutation_type"),
        F.expr("bigint(floor(l_quantity)) % 10").alias("alt_count"),
        F.expr("case l_linenumber % 4 when 0 then 'hg19' when 1 then ' GRCh37 ' when 2 then 'hg38' else '.' end").alias("build"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"),
    )


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, href): the links of each page in lower case."""
    h = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(h).alias("pos", "href")).withColumn("href", F.lower("href"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("trace_id"), F.col("event_type").alias("tool"), F.col("props").alias("args"), (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("latency"), F.expr("bigint(floor(value)) % 5").alias("n_results"), F.expr("case when event_type = 'error' then concat('E', event_id) end").alias("error"),
    )


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.least(F.lit(0.99), F.col("n_chars") / 5000.0).alias("confidence"), (F.col("quality") == 1).alias("correct"), "source")


def resolvable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): the words of the benchmark, as the ids that exist."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("id")).distinct()


RESOLVABLE = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS id FROM benchmark)"
