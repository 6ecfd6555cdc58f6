"""Queries of what comes before citations: extraction, pages, norms, definitions, sections, and tables written and read again.

The test tables hold no norms, no pages and no lists of definitions; texts of these kinds are put together from the parts and the definitions, alike in both ways.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import extract, reports, segment
from lexmill.plans.catalogue import contexts, law_articles, re2
from lexmill.plans.register import query
from lexmill.plans.relations import CITATIONS_SQL, EDGES_SQL, LAWS_SQL, RANK_SQL, current_citations, current_laws, law_edges
from lexmill.session import shared_folder
from lexmill.sources import readers, writers
from lexmill.sources.tables import table

# --- citations by the patterns: expressions without look-around, offsets from the text between the matches

_TEXTS_SQL = f"""{CITATIONS_SQL}, {LAWS_SQL}, texts AS (SELECT source_law, source_article, citation_text AS text FROM cit
  UNION ALL SELECT id, a.number, a.text FROM (SELECT id, unnest(articles) AS a FROM law WHERE len(coalesce(articles, [])) > 0)
  UNION ALL SELECT id, '0', full_text FROM law WHERE len(coalesce(articles, [])) = 0 AND full_text IS NOT NULL)"""


def _consuming(expression: str) -> str:
    """The expression as RE2 takes it: the end is matched and not only looked at, and so is the character before a word that must begin there."""
    plain = expression.split("(?!")[0].replace("(?=", "(?:")
    return plain.replace(r"\b(?:la|el)", r"(?:^|[^\p{L}\p{M}\p{N}_])(?:la|el)").replace(r"\b(?:la|La)", r"(?:^|[^\p{L}\p{M}\p{N}_])la").replace(r"[\d\w", r"[\d\p{L}\p{M}\p{N}_")


def _pattern_sql(order: int, name: str, group: str, confidence: str, expression: str) -> str:
    e = re2(_consuming(expression)).replace("'", "''")
    captured = "''" if name == "constitucion_bare" else f"regexp_extract_all(text, '{e}', 1)[i]"
    bare = r"""WHERE NOT regexp_matches(after, '(?i)^\s+pol[ií]tica\s+de\s+') OR regexp_matches(after, '(?i)^\s+pol[ií]tica\s+de\s+los\s+estados\s+unidos\s+mexicanos')""" if name == "constitucion_bare" else ""
    return f"""SELECT source_law, source_article, text, '{name}' AS pattern_name, '{group}' AS pattern_group, '{confidence}' AS confidence, {order} AS ord, g1, found, char_offset FROM (
      SELECT *, substring(text, char_offset + length(found) + 1, 80) AS after FROM (
        SELECT source_law, source_article, text, g1, CAST(before + lead AS INTEGER) AS char_offset, regexp_replace(substring(m, lead + 1), '[,;.()\\n]$', '') AS found FROM (
          SELECT *, CASE WHEN regexp_matches(m, '^[^\\p{{L}}]') THEN 1 ELSE 0 END AS lead FROM (
            SELECT source_law, source_article, text, f[i] AS m, {captured} AS g1, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS before FROM (
              SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{e}', 0) AS f, regexp_split_to_array(text, '{e}') AS s FROM texts WHERE regexp_matches(text, '{e}'))))))) {bare}"""


def _extract_sql() -> str:
    parts = " UNION ALL ".join(_pattern_sql(i, *p) for i, p in enumerate(P.CITATION_PATTERNS))
    name = "trim(coalesce(g1, ''), ' ')"
    for tail in P.NAME_TAILS:
        name = f"regexp_replace({name}, '{re2(tail)}', '', 'g')"
    name = f"rtrim({name}, '.,;: ' || chr(9) || chr(10))"
    article = re2(P.ARTICLE_REFERENCE.replace("(?=", "(?:").replace(r"[\d][\d\w\-,\s]", r"[\d][\d\p{L}\p{M}\p{N}_\-,\s]"))
    false = " OR ".join(f"regexp_matches({c}, '{re2(p)}')" for c, p in (("citation_text", P.DEROGATION), ("citation_text", P.AMENDMENT), ("citation_text", P.ENUMERATION), ("target_law_raw", P.GENERIC_NAME)))
    return f"""WITH {_TEXTS_SQL}, m AS ({parts}), n AS (SELECT source_law, source_article, CASE WHEN pattern_group = 'constitutional' THEN 'Constitución' ELSE {name} END AS target_law_raw,
  CASE WHEN pattern_group = 'constitutional' THEN 'constitucion' END AS target_law_id,
  CASE WHEN pattern_group = 'constitutional' THEN trim(g1, ' ') ELSE trim(nullif(regexp_extract(found, '{article}', 1), ''), ' ') END AS target_article,
  replace(substring(text, greatest(char_offset - 150, 0) + 1, least(char_offset + length(found) + 150, length(text)) - greatest(char_offset - 150, 0)), chr(10), ' ') AS citation_text,
  pattern_name, pattern_group, confidence, char_offset, ord FROM m),
found AS (SELECT * FROM n WHERE length(target_law_raw) >= 5 AND NOT (pattern_name = 'direct_mention' AND ({false})))"""


@query(f"{_extract_sql()} SELECT * EXCLUDE (ord) FROM found")
def extract_citations(spark, folder):
    return extract.extract_citations(contexts(spark, folder).unionByName(law_articles(spark, folder))).drop("pattern_order")


@query(f"""{_extract_sql()}, once AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY source_law, source_article, substring(lower(target_law_raw), 1, 50) ORDER BY {RANK_SQL.format(c='confidence')} DESC, ord, char_offset, citation_text) = 1)
SELECT * EXCLUDE (ord) FROM once WHERE NOT EXISTS (SELECT 1 FROM law WHERE law.id = once.source_law AND lower(once.target_law_raw) IN (lower(law.name), lower(law.short_name)))""")
def extract_pipeline(spark, folder):
    """Extraction, deduplication and removal of self references, one after the other."""
    found = extract.extract_citations(contexts(spark, folder).unionByName(law_articles(spark, folder)))
    once = extract.deduplicate_citations(found, ["pattern_order", "char_offset", "citation_text"]).drop("pattern_order")
    return extract.drop_self_references(once, current_laws(spark, folder, "name", "short_name"))


# --- norms

_YEAR = "CAST(2005 + p_partkey % 18 AS INTEGER)"
_MINISTRY = "replace(upper(p_brand), '#', '')"
_NUMBER = "lpad(CAST(p_partkey % 300 AS VARCHAR), 3, '0')"
_CODE = f"'NOM-' || {_NUMBER} || '-' || {_MINISTRY} || '-' || {_YEAR}"
_OTHER = f"'NOM-' || {_NUMBER} || '-' || {_MINISTRY} || '-' || ({_YEAR} + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)"


def _spark(sql: str) -> Column:
    """The same expression for Spark."""
    return F.expr(sql.replace("VARCHAR", "STRING").replace("INTEGER", "INT"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", _spark(_MINISTRY).alias("ministry"), _spark(_CODE).alias("code"), _spark(_OTHER).alias("cited"), _spark(_YEAR).alias("year"))


_PARTS_SQL = f"parts AS (SELECT p_partkey, p_name, {_MINISTRY} AS ministry, {_CODE} AS code, {_OTHER} AS cited, {_YEAR} AS year FROM part)"


@query(f"""WITH {_PARTS_SQL}, n AS (SELECT p_partkey AS codp, lower(code) AS id, code AS nom_code, ministry, year, '12 de mayo de ' || year AS publication_date FROM parts WHERE p_partkey % 7 <> 0 AND year >= 2013)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY nom_code ORDER BY codp DESC) = 1""")
def norm_pages(spark, folder):
    """Norms of pages: code, ministry, year and date; cancelled and old ones left out, the last page of each code."""
    end = F.when(F.col("p_partkey") % 7 == 0, " Esta norma fue cancelada.").otherwise("")
    page = F.concat(
        F.lit("<html><head><style>x</style></head><body><nav>menu</nav><h1>"), "code", F.lit(" "), "p_name", F.lit("</h1><div id='contenidoNorma'>"),
        F.repeat(F.lit("Fija los requisitos del producto. "), 5), F.lit("12 de mayo de "), F.col("year").cast("string"), F.lit("."), end, F.lit("</div></body></html>"),
    )
    pages = _parts(spark, folder).select(F.col("p_partkey").alias("codp"), page.alias("page"))
    return readers.parse_norms(pages, "page", "codp").select("codp", "id", "nom_code", "ministry", "year", "publication_date")


_NORM_TEXT = "'Conforme a la ' || cited || ' y a las Normas Oficiales Mexicanas aplicables.'"
_REGISTRY_SQL = """reg AS (SELECT code, lower(code) AS nom_id FROM parts WHERE p_partkey % 2 = 0), fl AS (SELECT code AS k, max(nom_id) AS nom_id FROM reg GROUP BY 1),
names AS (SELECT * FROM fl UNION ALL SELECT k, nom_id FROM (SELECT regexp_replace(code, '-[^-]*$', '') AS k, min(nom_id) AS nom_id FROM reg GROUP BY 1) WHERE k NOT IN (SELECT k FROM fl))"""
_NORM_CITATIONS_SQL = f"""{_PARTS_SQL}, {_REGISTRY_SQL}, ex AS (SELECT p_name AS source_law, CAST(p_partkey AS VARCHAR) AS source_article, cited AS target_nom_raw, coalesce(a.nom_id, b.nom_id) AS found, {_NORM_TEXT} AS citation_text
  FROM parts LEFT JOIN names a ON a.k = cited LEFT JOIN names b ON b.k = regexp_replace(cited, '-[^-]*$', '')),
nc AS (SELECT source_law, source_article, target_nom_raw, coalesce(found, 'unresolved') AS target_nom_id, citation_text, 'explicit_nom_code' AS pattern_name, CASE WHEN found IS NULL THEN 'medium' ELSE 'high' END AS confidence, 14 AS char_offset FROM ex
  UNION ALL SELECT source_law, source_article, 'Normas Oficiales Mexicanas', 'generic', citation_text, 'generic_nom_reference', 'low', CAST(14 + length(target_nom_raw) + 9 AS INTEGER) FROM ex)"""


def _norm_citations(spark: SparkSession, folder: str) -> DataFrame:
    parts = _parts(spark, folder)
    articles = parts.select(F.col("p_name").alias("source_law"), F.col("p_partkey").cast("string").alias("source_article"), _spark(_NORM_TEXT).alias("text"))
    return extract.extract_norm_citations(articles, _norm_registry(parts))


def _norm_registry(parts: DataFrame) -> DataFrame:
    return parts.where("p_partkey % 2 = 0").select("code", F.lower("code").alias("nom_id"))


@query(f"WITH {_NORM_CITATIONS_SQL} SELECT * FROM nc")
def extract_norm_citations(spark, folder):
    return _norm_citations(spark, folder)


@query(f"WITH {_PARTS_SQL}, {_REGISTRY_SQL} SELECT k AS key, nom_id FROM names")
def norm_registry(spark, folder):
    return extract.norm_registry(_norm_registry(_parts(spark, folder)))


@query(f"""WITH {_PARTS_SQL}, {_REGISTRY_SQL}, t AS (SELECT lower(x.code) AS src, y.code AS cited FROM parts x JOIN parts y ON y.p_partkey = x.p_partkey + 1)
SELECT DISTINCT src, coalesce(a.nom_id, b.nom_id) AS dst FROM t LEFT JOIN fl a ON a.k = cited LEFT JOIN names b ON b.k = cited WHERE coalesce(a.nom_id, b.nom_id) <> src""")
def norm_references(spark, folder):
    """Norms that name another norm: each names that of the next part."""
    parts = _parts(spark, folder)
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("code").alias("next"))
    norms = parts.join(after, "p_partkey", "left").select(F.lower("code").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("code")).otherwise("").alias("code"), F.concat(F.lit("Véase la "), "next", F.lit(".")).alias("full_text"))
    return extract.norm_to_norm(norms)


@query(f"""WITH {_NORM_CITATIONS_SQL}, x AS (SELECT * FROM nc WHERE pattern_name = 'explicit_nom_code'), ed AS (SELECT DISTINCT source_law, target_nom_id FROM x WHERE target_nom_id <> 'unresolved'),
mi AS (SELECT DISTINCT lower(code) AS id, ministry FROM parts)
SELECT 'explicit' AS kind, CAST(NULL AS VARCHAR) AS name, CAST(count(*) AS BIGINT) AS n FROM x UNION ALL SELECT 'resolved', NULL, CAST(count(*) FILTER (target_nom_id <> 'unresolved') AS BIGINT) FROM x
UNION ALL SELECT 'unresolved', NULL, CAST(count(*) FILTER (target_nom_id = 'unresolved') AS BIGINT) FROM x
UNION ALL SELECT * FROM (SELECT 'norm', target_nom_id, CAST(count(*) AS BIGINT) FROM ed GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20) UNION ALL SELECT * FROM (SELECT 'law', source_law, CAST(count(*) AS BIGINT) FROM ed GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
UNION ALL SELECT 'ministry', coalesce(ministry, 'unknown'), CAST(count(*) AS BIGINT) FROM ed LEFT JOIN mi ON target_nom_id = id GROUP BY 2""")
def norm_summary(spark, folder):
    norms = _parts(spark, folder).select(F.lower("code").alias("id"), "ministry").distinct()
    return reports.norm_summary(_norm_citations(spark, folder), norms)


# --- sections and definitions

_SECTIONS = "CASE WHEN p_partkey % 5 = 0 THEN 'Sin apartados: ' || p_name ELSE 'Prefacio' || chr(10) || '1. Objetivo' || chr(10) || p_name || chr(10) || '1.1 Alcance ' || p_type || chr(10) || chr(10) || '2 - Vigencia' END"


@query("""SELECT p_partkey AS id, s.pos, s.number, s.title, s.segment_text FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 5 = 0 THEN [{'pos': 1, 'number': '0', 'title': '', 'segment_text': 'Sin apartados: ' || p_name}]
  ELSE [{'pos': 1, 'number': '1', 'title': 'Objetivo', 'segment_text': '1. Objetivo' || chr(10) || p_name}, {'pos': 2, 'number': '1.1', 'title': 'Alcance ' || p_type, 'segment_text': '1.1 Alcance ' || p_type}, {'pos': 3, 'number': '2', 'title': 'Vigencia', 'segment_text': '2 - Vigencia'}] END) AS s FROM part)""")
def segment_sections(spark, folder):
    return segment.segmented(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), _spark(_SECTIONS).alias("t")), "id", "t", "sections")


_LEAD = "CASE WHEN definition_id % 2 = 0 THEN 'Para los efectos de esta Ley, los términos son:' ELSE 'Para efectos de esta Ley, los términos son:' END"
_DEFINED = f"{_LEAD} || chr(10) || 'I. ' || term || ': ' || definition_text || chr(10) || 'II. Otro término: aquello que la lista no nombra'"
_BLANK = r"[\t-\r \x{85}\p{Z}]"
_ITEM_SQL = rf"(?m)(?:^|\n){_BLANK}*(?:[IVXivx]+\.|[0-9]+\.|[a-z]\)){_BLANK}+([A-Za-záéíóúüñÁÉÍÓÚÜÑ][\p{{L}}\p{{M}}\p{{N}}_\t-\r \x{{85}}\p{{Z}},\-]{{2,80}}?){_BLANK}*[:;]{_BLANK}*((?s:.){{10,500}}?)$"


@query(f"""WITH a AS (SELECT law_id AS source_law, article AS source_article, definition_id, {_DEFINED} AS text, {_LEAD} AS lead FROM definitions),
b AS (SELECT source_law, source_article, substring(text, 1, length(regexp_extract(lead, '^[^,]*,')) + 2000) AS block, regexp_extract(lead, '^[^,]*,') AS raw_snippet, unnest(range(CASE WHEN definition_id % 2 = 0 THEN 1 ELSE 2 END)) AS k FROM a),
i AS (SELECT source_law, source_article, raw_snippet, unnest(list_zip(regexp_extract_all(block, '{_ITEM_SQL}', 1), regexp_extract_all(block, '{_ITEM_SQL}', 2))) AS m FROM b),
d AS (SELECT source_law, source_article, lower(trim(m[1], ' ')) AS term, substring(trim(m[2], ' '), 1, 500) AS definition_text, raw_snippet, 'definition_block' AS extraction_method FROM i)
SELECT * FROM d WHERE length(term) BETWEEN 3 AND 80 AND definition_text <> ''""")
def extract_definitions(spark, folder):
    rows = table(spark, folder, "definitions").select(F.col("law_id").alias("source_law"), F.col("article").alias("source_article"), _spark(_DEFINED).alias("text"))
    return extract.extract_definitions(rows).where("extraction_method = 'definition_block'")


# --- files and keys

# First bytes of files in hexadecimal, and the kinds they show.
_SIGNATURES = (("D0CF11E0A1B11AE1", "ole2"), ("504B0304", "zip_ooxml"), ("25504446", "pdf"), ("7B5C727466", "rtf"), ("3C68746D6C", "html"), ("EFBBBF", "utf8_bom"), ("FFFE", "utf16_le"), ("00", "unknown"))


@query(f"SELECT n_name AS name, {[k for _, k in _SIGNATURES]!r}[1 + n_nationkey % {len(_SIGNATURES)}] AS format FROM nation")
def file_formats(spark, folder):
    bytes_of = F.unhex(F.element_at(F.array(*[F.lit(s) for s, _ in _SIGNATURES]), (1 + F.col("n_nationkey") % len(_SIGNATURES)).cast("int")))
    files = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.concat(bytes_of, F.encode("n_name", "UTF-8")).alias("content"))
    return files.select("name", X.file_format(F.col("content")).alias("format"))


@query("SELECT CAST(k AS BIGINT) AS codp FROM range(4000, 9701) t(k) WHERE k NOT IN (SELECT l_orderkey FROM lineitem)")
def open_keys(spark, folder):
    return readers.open_keys(spark, table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("codp")).distinct(), "codp")


@query(f"WITH {LAWS_SQL} SELECT id, coalesce(sha256(full_text) = replace(doc_checksum, 'sha256:', ''), false) AS same, CAST(coalesce(strlen(full_text), 0) AS BIGINT) AS size, full_text IS NULL AS stub FROM law")
def processed_laws(spark, folder):
    """What a parsed law says of its text: whether the checksum is that of the text as it stands, bytes, and whether there is none."""
    laws = current_laws(spark, folder, "full_text", "doc_checksum")
    same = F.coalesce(X.checksum(F.col("full_text")) == F.concat(F.lit("sha256:"), F.replace("doc_checksum", F.lit("sha256:"), F.lit(""))), F.lit(False))
    return laws.select("id", same.alias("same"), F.coalesce(F.octet_length("full_text"), F.lit(0)).cast("long").alias("size"), F.col("full_text").isNull().alias("stub"))


_CITED = ("citation_id", "source_law", "source_article", "target_law_id", "citation_text")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {CITATIONS_SQL} SELECT {', '.join(_CITED)} FROM cit")
def citations_written_and_read(spark, folder):
    """Citations as JSON in a folder per law, read again with their schema."""
    path, rows = _place(spark, "citations"), current_citations(spark, folder, *_CITED[1:]).select(*_CITED)
    writers.write_by_law(rows, path, "source_law", "json")
    return spark.read.schema(rows.schema).json(path).select(*_CITED)


@query(f"WITH {EDGES_SQL} SELECT src, dst, citation_count, CASE rank WHEN 3 THEN 'high' ELSE 'medium' END AS confidence FROM edges")
def graph_written_and_read(spark, folder):
    """The law graph as folders of nodes and links, read again."""
    path, edges = _place(spark, "graph"), law_edges(spark, folder).select("src", "dst", "citation_count", "confidence")
    writers.write_graph(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges, path)
    return readers.read_graph_folder(spark, path)[1].select("src", "dst", "citation_count", "confidence")


@query(f"WITH {CITATIONS_SQL} SELECT citation_id, source_law, citation_text FROM cit ORDER BY citation_id LIMIT 500")
def review_sample(spark, folder):
    """The first citations for people to look at, written as a table with a header and read again."""
    path = _place(spark, "sample")
    rows = writers.review_sample(current_citations(spark, folder, "source_law", "citation_text").select("citation_id", "source_law", "citation_text"), ["citation_id"])
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, rows.schema)
