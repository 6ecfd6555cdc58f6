"""Relations of the test tables that several queries share, with the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import graph, reports
from lexmill.sources.tables import table

CITATIONS_SQL = "cit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY ingested_at DESC) AS rn FROM citations) WHERE rn = 1)"
LAWS_SQL = "law AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY processed_at DESC) AS rn FROM laws) WHERE rn = 1)"
ARTICLE_EDGE_COLUMNS = ("source_law", "source_article", "target_law_id", "target_article", "resolution_confidence", "char_offset")
RANK_SQL = "CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
EDGES_SQL = f"""{CITATIONS_SQL}, kept AS (
  SELECT source_law AS src, target_law_id AS dst, source_article, {RANK_SQL.format(c='confidence')} AS rank FROM cit
  WHERE target_law_id <> 'unresolved' AND source_law <> target_law_id AND confidence IN ('high', 'medium')),
edges AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS citation_count, max(rank) AS rank, list_sort(list(DISTINCT source_article)) AS arts FROM kept GROUP BY 1, 2)"""
ARTICLE_EDGES_SQL = f"""{CITATIONS_SQL}, ae AS (
  SELECT source_law || '::' || coalesce(nullif(trim(source_article, ' '), ''), '?') AS src, target_law_id || '::' || coalesce(nullif(trim(target_article, ' '), ''), '?') AS dst,
    coalesce(resolution_confidence, 'low') AS c, char_offset, citation_id FROM cit
  WHERE target_law_id <> 'unresolved' AND coalesce(resolution_confidence, 'low') <> 'unresolved'),
aedges AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS weight, arg_min(c, (char_offset, citation_id)) AS confidence FROM ae GROUP BY 1, 2)"""
LINES_SQL = """lines AS (SELECT l_orderkey, l_linenumber, l_suppkey AS src, l_partkey, l_returnflag,
  lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS dst FROM lineitem),
pairs AS (SELECT * FROM lines WHERE dst IS NOT NULL AND dst <> src),
links AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS weight FROM pairs GROUP BY 1, 2)"""
VERTICES_SQL = "vs AS (SELECT src AS id FROM links UNION SELECT dst FROM links)"
#: What suppliers call their parts, as definitions.
SUPPLIER_DEFINITIONS_SQL = "sdef AS (SELECT DISTINCT l_suppkey AS law_id, p_name AS term, p_brand || ' ' || p_type AS definition_text FROM lineitem JOIN part ON p_partkey = l_partkey)"


def current_citations(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last delivery of each citation; with `columns` only those, so that texts aren't shuffled where nobody reads them."""
    rows = table(spark, folder, "citations")
    return reports.latest(rows.select("citation_id", "ingested_at", *columns) if columns else rows, "citation_id", "ingested_at")


def current_laws(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last parse of each law; with `columns` only those."""
    rows = table(spark, folder, "laws")
    return reports.latest(rows.select("id", "processed_at", *columns) if columns else rows, "id", "processed_at")


def law_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_aggregation(current_citations(spark, folder, "source_law", "source_article", "target_law_id", "confidence"))


def article_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.article_edges(current_citations(spark, folder, *ARTICLE_EDGE_COLUMNS))


def supplier_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive suppliers of an order as citations of one another."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"), "l_partkey", "l_returnflag", F.lead("l_suppkey").over(order).alias("dst"))
    return rows.where("dst is not null and dst <> src")


def supplier_edges(spark: SparkSession, folder: str) -> DataFrame:
    return supplier_lines(spark, folder).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def supplier_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """What suppliers call their parts, as definitions: law_id, term, definition_text."""
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("law_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("term"), F.concat_ws(" ", "p_brand", "p_type").alias("definition_text"))
    return lines.join(part, "p_partkey").select("law_id", "term", "definition_text").distinct()
