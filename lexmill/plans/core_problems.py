"""Queries of the orphan and packed-value operators over the citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.orphans import find_orphans, orphans_by_period
from lexmill.operators.packed_values import ORDINALS, PARTS, split_articles
from lexmill.sources.tables import table

#: Stands in citations for a law that nobody could name.
UNRESOLVED = "unresolved"


def citation_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of citations: `citation_id`, `ref_field`, `extracted_at`, a row for each missing law or article.

    A citation of a law that nobody could name refers to nothing that could be missing.
    """
    keep = ["citation_id", "extracted_at"]
    refs = table(spark, folder, "citations").select(*keep, "target_law_id", "target_article").where(F.col("target_law_id") != UNRESOLVED)
    laws, articles = table(spark, folder, "law_registry"), table(spark, folder, "registry_articles")
    lost_laws = find_orphans(refs, laws, ["target_law_id"], ["law_id"], "extracted_at", "registered_at", "withdrawn_at")
    each = split_articles(refs.where(F.col("target_article").isNotNull()), "target_article")
    lost = find_orphans(each, articles, ["target_law_id", "article"], ["law_id", "article"], "extracted_at", "in_force_from", "repealed_at")
    return lost_laws.select(*keep, F.lit("target_law_id").alias("ref_field")).unionByName(
        lost.select(*keep, F.lit("target_article").alias("ref_field"))
    )


def _first_field(lost: DataFrame) -> DataFrame:
    """One row per citation: the law where it is missing, else the article. Partial maxima keep the shuffle to one row per citation and task."""
    return lost.groupBy("citation_id", "extracted_at").agg(F.max("ref_field").alias("ref_field"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _first_field(citation_orphans(spark, folder)).select("citation_id", "ref_field").distinct()


def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans by field and month (its first day)."""
    counts = orphans_by_period(_first_field(citation_orphans(spark, folder)), "citation_id", "ref_field", "extracted_at")
    return counts.withColumn("period", F.col("period").cast("date"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = split_articles(table(spark, folder, "citations").select("citation_id", "target_article"), "target_article", least=2)
    return found.select("citation_id", "pos", "article").distinct()


def p4_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Values by the flag of their writing."""
    found = split_articles(table(spark, folder, "citations").select("citation_id", "target_article"), "target_article")
    return found.groupBy("article_flag").agg(F.count("*").alias("n_values"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_by_month": p3_by_month, "p4_found": p4_found, "p4_flags": p4_flags}


def _articles_sql() -> str:
    """`named(citation_id, target_law_id, extracted_at, pos, article)`: the field cut into tokens by one expression, tokens of numbers and ordinals kept."""
    ordinals, places = "|".join(ORDINALS), "|".join([*ORDINALS, "últim[oa]", "final", "penúltimo", "primer", "tercer", "segunda", "primera", "tercera"])
    nouns = "|".join(sorted(PARTS, key=len, reverse=True))
    link = r"\s*(?:,\s*(?:[yeo]\s+)?|\s[yeo]\s)\s*"
    kinds = (r"\b[IVXLC]+\b", r"(?:[A-Za-z]\)|\b[A-Z]\b)", r"[0-9]+[º°]?")
    lists = "|".join(f"{k}(?:{link}{k})*" for k in kinds)
    several = rf"(?i:fracciones|apartados|párrafos|incisos|numerales|subincisos|bases|puntos)\s+(?:{lists})"
    one = rf"(?i:{nouns})\.?\s+(?:\b[IVXLC]+\b|[A-Za-z]\)|\b[A-Z]\b|(?i:{places})\b|[0-9]+[º°]?)"
    mark, bis = r"(?:\s?[º°ª]|[oa]\.?)?", "(?i:bis|ter|quáter|quater|quinquies)"
    number = rf"[0-9]+{mark}(?:-[A-Za-z]\b)?(?:\s*{bis}\b)?"
    ordinal = rf"(?:{ordinals})\b(?:\s+(?i:transitorio)s?\b)?|(?i:{ordinals})\s+(?i:transitorio)s?\b"
    token = rf"{several}|(?i:{places})\s+(?i:{nouns})\b|{one}|{number}|{ordinal}|\p{{L}}[\p{{L}}\p{{M}}\p{{N}}]*"
    title = "upper({0}[1]) || lower({0}[2:])".format
    kept = rf"list_filter(regexp_extract_all(target_article, '{token}'), lambda t: regexp_matches(t, '^[0-9]') OR regexp_full_match(t, '{ordinal}'))"
    letter, suffix = rf"regexp_extract(t, '^[0-9]+{mark}-([A-Za-z])', 1)", rf"regexp_extract(t, '({bis})$', 1)"
    name = rf"""CASE WHEN regexp_matches(t, '^[0-9]') THEN regexp_extract(t, '^[0-9]+') || CASE WHEN {letter} <> '' THEN '-' || upper({letter}) ELSE '' END
      || CASE WHEN {suffix} <> '' THEN ' ' || {title(suffix)} ELSE '' END ELSE {title(r"regexp_extract(t, '^[^ ]+')")} END"""
    return f"""fields AS (SELECT citation_id, target_law_id, extracted_at, {kept} AS ts FROM citations WHERE target_article IS NOT NULL),
named AS (SELECT citation_id, target_law_id, extracted_at, CAST(pos AS INTEGER) AS pos, len(ts) AS n, {name} AS article FROM (SELECT *, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM fields))"""


_ORPHANS_SQL = """missing_law AS (SELECT DISTINCT citation_id, 'target_law_id' AS ref_field, extracted_at FROM citations c WHERE target_law_id <> 'unresolved' AND NOT EXISTS (
  SELECT 1 FROM law_registry r WHERE r.law_id = c.target_law_id AND r.registered_at <= c.extracted_at AND (r.withdrawn_at IS NULL OR r.withdrawn_at > c.extracted_at))),
missing_article AS (SELECT DISTINCT citation_id, 'target_article' AS ref_field, extracted_at FROM named n WHERE target_law_id <> 'unresolved' AND NOT EXISTS (
  SELECT 1 FROM registry_articles a WHERE a.law_id = n.target_law_id AND a.article = n.article AND a.in_force_from <= n.extracted_at AND (a.repealed_at IS NULL OR a.repealed_at > n.extracted_at))),
orphans AS (SELECT * FROM missing_law UNION ALL SELECT * FROM missing_article WHERE citation_id NOT IN (SELECT citation_id FROM missing_law))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_articles_sql()}, {_ORPHANS_SQL} SELECT citation_id, ref_field FROM orphans",
        "p3_by_month": f"WITH {_articles_sql()}, {_ORPHANS_SQL} SELECT ref_field, CAST(date_trunc('month', make_timestamp(epoch_us(extracted_at))) AS DATE) AS period, count(DISTINCT citation_id) AS n_orphans FROM orphans GROUP BY 1, 2",
        "p4_found": f"WITH {_articles_sql()} SELECT DISTINCT citation_id, pos, article FROM named WHERE n >= 2",
    }
