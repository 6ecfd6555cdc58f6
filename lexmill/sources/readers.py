"""Readers: JSON folders with explicit schemas, index and norm pages, and binary documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.functions import patterns as P
from lexmill.functions.text import absolute_url, checksum, code_slug, file_format, slugify
from lexmill.sources.binary import decode_text, text_of_document
from lexmill.sources.html import index_rows, norm_text, norm_title

ARTICLE = "struct<number:string,title:string,text:string>"
LAW = (
    f"id string, file_id string, name string, short_name string, year_enacted int, year_last_reform int, category string, source_url string, pdf_url string, full_text string, "
    f"articles array<{ARTICLE}>, num_articles int, char_count int, is_abrogated boolean, abrogation_note string, extraction_method string, doc_checksum string, processed_at string"
)
NORM = (
    f"id string, nom_code string, name string, short_name string, ministry string, year int, publication_date string, source_url string, full_text string, "
    f"sections array<{ARTICLE}>, num_sections int, char_count int, node_type string, processed_at string"
)
CITATION = (
    "source_law string, source_article string, target_law_raw string, target_law_id string, target_article string, citation_text string, pattern_name string, pattern_group string, "
    "confidence string, char_offset int, resolution_confidence string, resolution_score double, resolution_matched_alias string, resolution_method string"
)
DEFINITION = "law_id string, law_name string, article string, term string, definition_text string, raw_snippet string, extraction_method string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, LAW)


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, NORM)


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """One row per citation of files that hold a list each; optional keys come as nulls."""
    return _json(spark, path, f"law_id string, citations array<struct<{_fields(CITATION)}>>").select(F.inline("citations"))


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, f"law_id string, definitions array<struct<{_fields(DEFINITION)}>>").select(F.inline("definitions"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a graph file with `nodes` and `links`."""
    node = "id string, name string, short string, sector string, num_articles int, pagerank double, community int, in_degree long, out_degree long"
    link = "source string, target string, confidence string, citation_count long"
    both = _json(spark, path, f"nodes array<struct<{_fields(node)}>>, links array<struct<{_fields(link)}>>")
    edges = both.select(F.inline("links")).withColumnsRenamed({"source": "src", "target": "dst"})
    return both.select(F.inline("nodes")), edges


def read_graph_folder(spark: SparkSession, path: str, link: str = "source string, target string, citation_count long, confidence string") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of folders `nodes` and `links`."""
    edges = spark.read.schema(link).json(f"{path}/links").withColumnsRenamed({"source": "src", "target": "dst"})
    return spark.read.schema("id string").json(f"{path}/nodes"), edges


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", ")))


_INDEX = T.ArrayType(
    T.StructType([T.StructField(f, T.BooleanType() if f == "is_abrogated" else T.StringType()) for f in ("number", "file_id", "name", "dof_published", "dof_last_reform", "is_abrogated", "abrogation_note", "ref_href", "doc_href", "pdf_href")])
)
_INDEX_ARROW = pa.list_(pa.struct([(f.name, pa.bool_() if f.name == "is_abrogated" else pa.string()) for f in _INDEX.elementType.fields]))


@arrow_udf(_INDEX)
def _index_rows(pages: pa.Array) -> pa.Array:
    return pa.array([index_rows(p) if p else [] for p in pages.to_pylist()], _INDEX_ARROW)


def parse_index(pages: DataFrame, html: str, base: str) -> DataFrame:
    """Law index rows of pages with a table of links; ids are slugs of the names, links absolute against `base`. Null pages give no row."""
    rows = pages.select(F.inline(_index_rows.asNondeterministic()(F.col(html))))
    same = (F.col("name") == "") | (F.col("name") == F.col("file_id"))
    return rows.select(
        "file_id", F.when(same, F.lower("file_id")).otherwise(slugify(F.col("name"))).alias("id"), "name", "number", "dof_published", "dof_last_reform", "is_abrogated", "abrogation_note",
        absolute_url(F.col("ref_href"), base).alias("ref_url"), absolute_url(F.col("doc_href"), base).alias("doc_url"), absolute_url(F.col("pdf_href"), base).alias("pdf_url"),
    )


_TITLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("full_text", T.StringType())])


@arrow_udf(_TITLE)
def _norm_parts(pages: pa.Array) -> pa.Array:
    titles = [norm_title(p) if p else ("", "") for p in pages.to_pylist()]
    texts = [norm_text(p) if p else None for p in pages.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in titles], pa.string()), pa.array([b for _, b in titles], pa.string()), pa.array(texts, pa.string())], _TITLE.names)


def parse_norms(pages: DataFrame, html: str, codp: str, least_year: int = 2013) -> DataFrame:
    """Norms in force of pages by key: code, title, ministry, year, text and date; the page with the largest key of each code.

    Pages without a code, with a sign of cancellation in their first 3,000 characters, or of an earlier year give no row.
    """
    rows = pages.select(F.col(codp).alias("codp"), _norm_parts.asNondeterministic()(F.col(html)).alias("p")).select("codp", "p.*")
    code = F.upper(F.regexp_extract(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("body")), P.FLAGS + P.NORM_CODE_IN_TITLE, 1))
    named = rows.withColumn("nom_code", code).where("nom_code <> ''").withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("nom_code")))
    kept = named.where(F.col("title").rlike(P.FLAGS + P.NORM_TITLE) & ~F.substring("body", 1, 3000).rlike(P.FLAGS + P.CANCELLED))
    parts = F.split("nom_code", "-")
    date = F.nullif(F.regexp_extract(F.substring("full_text", 1, 2000), P.FLAGS + r"(\d{1,2}\s+de\s+\w+\s+de\s+\d{4})", 1), F.lit(""))
    out = kept.select(
        "codp", code_slug(F.col("nom_code")).alias("id"), "nom_code", "title", F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise(F.lit("unknown")).alias("ministry"),
        F.element_at(parts, -1).cast("int").alias("year"), date.alias("publication_date"), "full_text",
    )
    return out.where(F.col("year") >= least_year).groupBy("nom_code").agg(F.max_by(F.struct(*out.columns), "codp").alias("r")).select("r.*")


def open_keys(spark: SparkSession, done: DataFrame, key: str, first: int = 4000, last: int = 9700) -> DataFrame:
    """Page keys from `first` to `last` that aren't in `done`, for a scan that goes on where it stopped."""
    return spark.range(first, last + 1).withColumnRenamed("id", key).join(done.select(F.col(key).cast("long").alias(key)), key, "left_anti")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Binary documents: path, size, `checksum`, `format` by the first bytes, `text` and the `method` that gave it (none where nothing did)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), checksum(F.col("content")).alias("checksum"), file_format(F.col("content")).alias("format"), document_text(F.col("content")).alias("t")).select(
        "path", "size", "checksum", "format", "t.text", "t.method"
    )


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("method", T.StringType())])


@arrow_udf(_TEXT)
def _document_text(contents: pa.Array) -> pa.Array:
    found = [text_of_document(c) if c else ("", "none") for c in contents.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([m for _, m in found], pa.string())], _TEXT.names)


def document_text(content: Column) -> Column:
    return _document_text.asNondeterministic()(content)


@arrow_udf(T.StringType())
def _decoded(contents: pa.Array) -> pa.Array:
    return pa.array([None if c is None else decode_text(c) for c in contents.to_pylist()], pa.string())


def decoded(content: Column) -> Column:
    """Bytes as text in the first encoding of the ladder that fits: UTF-8 (with or without mark), Windows-1252, Latin-1."""
    return _decoded(content)
