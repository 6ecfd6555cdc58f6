"""Views that several reports are joined in: laws and articles with their names, typed edges, top lists and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import graph, reports, resolve
from lexmill.plans.catalogue import ALIASES_SQL, DEPENDENCIES_SQL, aliases, dependencies, pagerank_sql, raw_names
from lexmill.plans.register import query
from lexmill.plans.relations import (
    ARTICLE_EDGES_SQL,
    CITATIONS_SQL,
    EDGES_SQL,
    LAWS_SQL,
    LINES_SQL,
    VERTICES_SQL,
    article_edges,
    current_citations,
    current_laws,
    law_edges,
    supplier_edges,
)
from lexmill.sources.tables import table

_DEP_SQL = DEPENDENCIES_SQL.removeprefix(f"{CITATIONS_SQL}, ")


# --- vertices and edges with what is known of them


@query(f"""WITH {LAWS_SQL}, {EDGES_SQL}, known AS (
  SELECT id, name, coalesce(short_name, substring(id, 1, 20)) AS short, coalesce(nullif(category, ''), 'unknown') AS sector, false AS stub FROM law
  UNION ALL SELECT law_id, name, coalesce(short, substring(law_id, 1, 20)), coalesce(nullif(sector, ''), 'unknown'), true FROM law_registry WHERE law_id NOT IN (SELECT id FROM law))
SELECT * FROM known UNION ALL SELECT id, CAST(NULL AS VARCHAR), substring(id, 1, 20), 'unknown', true FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM known)""")
def law_vertices(spark, folder):
    laws = current_laws(spark, folder, "name", "short_name", "category").withColumnRenamed("category", "sector")
    return reports.law_vertices(laws, table(spark, folder, "law_registry"), graph.vertices_of(law_edges(spark, folder)))


@query(f"""WITH {EDGES_SQL}, {_DEP_SQL}, n AS (SELECT source_law, target_law_id, dependency_type, count(*) AS n FROM dep GROUP BY ALL),
t AS (SELECT source_law AS src, target_law_id AS dst, arg_min(dependency_type, (-n, dependency_type)) AS dependency_type FROM n GROUP BY 1, 2)
SELECT src, dst, citation_count, coalesce(dependency_type, 'generic_unresolved') AS dependency_type FROM edges LEFT JOIN t USING (src, dst)""")
def typed_edges(spark, folder):
    kinds = reports.dependency_by_pair(dependencies(spark, folder)).withColumnsRenamed({"source_law": "src", "target_law_id": "dst"})
    return reports.typed(law_edges(spark, folder).select("src", "dst", "citation_count"), kinds)


_ENDS_SQL = "source_law || '::' || coalesce(nullif(trim(source_article, ' '), ''), '?') AS src, target_law_id || '::' || coalesce(nullif(trim(target_article, ' '), ''), '?') AS dst"


@query(f"""WITH {ARTICLE_EDGES_SQL}, {_DEP_SQL}, d AS (SELECT {_ENDS_SQL}, dependency_type, citation_id FROM dep), t AS (SELECT src, dst, arg_max(dependency_type, citation_id) AS dependency_type FROM d GROUP BY 1, 2),
m AS (SELECT src, dst, string_agg(dependency_type || '=' || n, ',' ORDER BY dependency_type || '=' || n) AS type_mix FROM (SELECT src, dst, dependency_type, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1, 2)
SELECT src, dst, weight, coalesce(dependency_type, 'generic_unresolved') AS dependency_type, coalesce(type_mix, '') AS type_mix FROM aedges LEFT JOIN t USING (src, dst) LEFT JOIN m USING (src, dst)""")
def typed_article_edges(spark, folder):
    """Article edges with the class of their last citation, and the mix of classes."""
    kinds = reports.article_types(dependencies(spark, folder))
    return reports.typed(article_edges(spark, folder).select("src", "dst", "weight"), kinds).fillna("", ["type_mix"])


_TOP_LAWS = 16


@query(pagerank_sql(10, f"{EDGES_SQL}, links AS (SELECT src, dst FROM edges), {VERTICES_SQL}", f""", top AS (SELECT id FROM r10 ORDER BY round(r, 9) DESC, id LIMIT {_TOP_LAWS}),
ac AS (SELECT {_ENDS_SQL}, source_law FROM cit WHERE target_law_id IN (SELECT id FROM top) AND confidence IN ('high', 'medium'))
SELECT src, dst, CAST(count(*) AS BIGINT) AS weight, bool_or(source_law IN (SELECT id FROM top)) AS source_in_top FROM ac WHERE src <> dst GROUP BY 1, 2"""))
def top_laws_articles(spark, folder):
    """The article graph of the laws with the highest PageRank: who cites their articles, and whether from among them."""
    ranks = graph.pagerank(law_edges(spark, folder), iterations=10)
    top = ranks.orderBy(F.desc(F.round("pagerank", 9)), "id").limit(_TOP_LAWS).select("id")
    rows = current_citations(spark, folder, "source_law", "source_article", "target_law_id", "target_article", "confidence")
    return graph.articles_of_laws(rows, top)


@query(f"""WITH {ARTICLE_EDGES_SQL}, i AS (SELECT dst, CAST(sum(weight) AS BIGINT) AS cited FROM aedges WHERE NOT suffix(dst, '::?') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
SELECT dst AS node_id, law_id, coalesce(name, split_part(dst, '::', 1)) AS law_name, coalesce(short, substring(split_part(dst, '::', 1), 1, 12)) AS law_short, coalesce(sector, 'unknown') AS sector, cited,
  CAST(round_even(100.0::DOUBLE * cited / (SELECT max(cited) FROM i), 0) AS BIGINT) AS percent_of_most FROM (SELECT *, split_part(dst, '::', 1) AS law_id FROM i) LEFT JOIN (SELECT law_id, name, short, sector FROM law_registry) USING (law_id)""")
def article_tab(spark, folder):
    return reports.article_tab(article_edges(spark, folder), table(spark, folder, "law_registry"))


@query(f"""WITH {ARTICLE_EDGES_SQL} SELECT CAST((SELECT count(*) FROM (SELECT src FROM aedges UNION SELECT dst FROM aedges)) AS BIGINT) AS article_nodes, CAST(sum(weight) AS BIGINT) AS citations,
  count(DISTINCT split_part(dst, '::', 1)) AS cited_laws, count(DISTINCT split_part(src, '::', 1)) AS citing_laws FROM aedges""")
def article_totals(spark, folder):
    return reports.article_totals(article_edges(spark, folder))


# --- summaries


@query(f"""WITH {DEPENDENCIES_SQL}, i AS (SELECT target_law_id AS id, count(*) AS n FROM dep GROUP BY 1), o AS (SELECT source_law AS id, count(*) AS m FROM dep GROUP BY 1),
a AS (SELECT 'reform_impact' AS kind, id AS name, CAST(2 * n + coalesce(m, 0) AS BIGINT) AS n FROM i LEFT JOIN o USING (id) ORDER BY i.n DESC, id LIMIT 1),
b AS (SELECT 'definitions' AS kind, target_law_id AS name, CAST(count(*) AS BIGINT) AS n FROM dep WHERE dependency_type = 'definitional' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 'unresolved', NULL, CAST(count(*) AS BIGINT) FROM cit WHERE target_law_id = 'unresolved'""")
def workflow_summary(spark, folder):
    return reports.workflow_summary(dependencies(spark, folder), current_citations(spark, folder, "target_law_id"))


@query(f"WITH {CITATIONS_SQL} SELECT coalesce(resolution_method, 'unresolved') AS resolution_method, CAST(count(*) AS BIGINT) AS n FROM cit GROUP BY 1")
def resolution_by_method(spark, folder):
    return current_citations(spark, folder, "resolution_method").groupBy(F.coalesce("resolution_method", F.lit("unresolved")).alias("resolution_method")).agg(F.count("*").alias("n"))


@query("""SELECT term, CAST(count(*) AS BIGINT) AS n_laws, count(DISTINCT lower(trim(regexp_replace(substring(definition_text, 1, 100), '\\s+', ' ', 'g'), ' '))) AS n_variants
FROM definitions GROUP BY 1 HAVING n_laws > 1 AND n_variants > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50""")
def conflicts_top(spark, folder):
    rows = reports.definition_conflicts(table(spark, folder, "definitions"))
    return rows.orderBy(F.desc("n_laws"), F.desc("n_variants"), "term").limit(50)


# --- graph measures by plain SQL


@query(f"""WITH RECURSIVE {LINES_SQL}, {VERTICES_SQL}, reach(id, reached) AS (SELECT src, dst FROM links UNION SELECT r.id, s.dst FROM reach r JOIN links s ON r.reached = s.src),
t AS (SELECT vs.id, CAST(count(r.id) AS BIGINT) AS cascade FROM vs LEFT JOIN (SELECT * FROM reach WHERE id <> reached) r ON r.reached = vs.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30),
d AS (SELECT dst AS id, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM (SELECT DISTINCT src, dst FROM links WHERE src <> dst))
SELECT id, cascade, CAST(count(src) AS BIGINT) AS direct, string_agg(CAST(src AS VARCHAR), ', ' ORDER BY n) FILTER (n <= 5) AS samples FROM t LEFT JOIN d USING (id) GROUP BY 1, 2""")
def cascade_top(spark, folder):
    return graph.cascade_top(supplier_edges(spark, folder))


def _betweenness_sql(relations: str, sources: str, used: str, depth: int = 5) -> str:
    """Shortest paths counted forward level by level, dependencies summed backward."""
    out = f"WITH {relations}, e AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst), l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS p FROM ({sources}))"
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM l{j}" for j in range(k))
        out += f", l{k} AS MATERIALIZED (SELECT a.s, a.v, a.p FROM (SELECT s, dst AS v, sum(p) AS p FROM l{k - 1} JOIN e ON v = src GROUP BY 1, 2) a LEFT JOIN ({seen}) b ON a.s = b.s AND a.v = b.v WHERE b.s IS NULL)"
    out += f", b{depth} AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS share FROM l{depth})"
    for k in range(depth - 1, 0, -1):
        out += f""", b{k} AS MATERIALIZED (SELECT l.s, l.v, l.p, coalesce(g.share, 0) AS share FROM l{k} l LEFT JOIN
          (SELECT x.s, x.v, sum(x.p / w.p * (1 + w.share)) AS share FROM l{k} x JOIN e ON x.v = e.src JOIN b{k + 1} w ON w.s = x.s AND w.v = e.dst GROUP BY 1, 2) g ON g.s = l.s AND g.v = l.v)"""
    rows = " UNION ALL ".join(f"SELECT v, share FROM b{k}" for k in range(1, depth + 1))
    return out + f""", c AS (SELECT count(*)::DOUBLE AS n FROM vs) SELECT vs.id, round(coalesce(b, 0) * n / ({used}) / greatest((n - 1) * (n - 2), 1), 8) AS betweenness
      FROM vs CROSS JOIN c LEFT JOIN (SELECT v, sum(share) AS b FROM ({rows}) GROUP BY 1) t ON t.v = vs.id"""


@query(_betweenness_sql(f"{LINES_SQL}, {VERTICES_SQL}", "SELECT id FROM vs", "n"))
def betweenness(spark, folder):
    return graph.betweenness(supplier_edges(spark, folder)).select("id", F.round("betweenness", 8).alias("betweenness"))


@query(_betweenness_sql(f"{LINES_SQL}, {VERTICES_SQL}", "SELECT id FROM vs ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50", "least(n, 50)"))
def betweenness_sampled(spark, folder):
    return graph.betweenness(supplier_edges(spark, folder), sources=50).select("id", F.round("betweenness", 8).alias("betweenness"))


_WEIGHTED_LINKS_SQL = f"{ARTICLE_EDGES_SQL}, links AS (SELECT src, dst, weight FROM aedges), {VERTICES_SQL}"


@query(pagerank_sql(20, _WEIGHTED_LINKS_SQL, "SELECT id AS node_id, round(r, 8) AS pagerank FROM r20", "weight"))
def article_pagerank_fixed_iters(spark, folder):
    return graph.pagerank(article_edges(spark, folder), weighted=True, iterations=20).select(F.col("id").alias("node_id"), F.round("pagerank", 8).alias("pagerank"))


_CONVERGED_SQL = f"{EDGES_SQL}, links AS (SELECT src, dst, weight FROM (SELECT *, citation_count AS weight FROM edges)), {VERTICES_SQL}"
_STEPS = 130


@query(pagerank_sql(_STEPS, _CONVERGED_SQL, f"SELECT id, round(r, 6) AS pagerank FROM r{_STEPS}", "weight"))
def pagerank_converged(spark, folder):
    """The weighted law graph, until the ranks hardly change."""
    return graph.pagerank(law_edges(spark, folder), weighted=True, tolerance=1e-13).select("id", F.round("pagerank", 6).alias("pagerank"))


@query(pagerank_sql(_STEPS, _CONVERGED_SQL, f"SELECT id, round(r, 6) AS pagerank FROM r{_STEPS} ORDER BY 2 DESC, 1 LIMIT 20", "weight"))
def hub_top(spark, folder):
    return pagerank_converged(spark, folder).orderBy(F.desc("pagerank"), "id").limit(20)


@query(pagerank_sql(_STEPS, _WEIGHTED_LINKS_SQL, f"SELECT id AS node_id, round(r, 8) AS pagerank FROM r{_STEPS}", "weight"))
def article_pagerank(spark, folder):
    """The weighted article graph, until the ranks hardly change."""
    return graph.pagerank(article_edges(spark, folder), weighted=True, tolerance=1e-14).select(F.col("id").alias("node_id"), F.round("pagerank", 8).alias("pagerank"))


# --- resolution in parts


@query(f"""WITH {LAWS_SQL}, a AS (SELECT lower(trim(name, ' ')) AS alias, id FROM law WHERE coalesce(name, '') <> '' UNION ALL SELECT lower(trim(short_name, ' ')), id FROM law WHERE coalesce(short_name, '') <> '')
SELECT alias, max(id) AS law_id FROM a GROUP BY 1""")
def corpus_aliases(spark, folder):
    return resolve.corpus_map(current_laws(spark, folder, "name", "short_name")).select("alias", "law_id")


@query(f"""WITH {CITATIONS_SQL}, {ALIASES_SQL}, x AS (SELECT citation_id, target_law_raw AS raw, lower(trim(target_law_raw, ' ')) AS c, nullif(target_law_id, 'unresolved') AS held FROM cit)
SELECT citation_id, coalesce(held, law_id, 'unresolved') AS target_law_id, CASE WHEN held IS NULL THEN CASE WHEN law_id IS NULL THEN 'unresolved' ELSE 'high' END END AS new_confidence FROM x LEFT JOIN am ON c = alias""")
def resolve_apply(spark, folder):
    """Exact resolutions put on the citations that have none yet; earlier ones stay."""
    rows = current_citations(spark, folder, "target_law_raw", "target_law_id").withColumn("target_law_id", F.nullif("target_law_id", F.lit("unresolved"))).drop("ingested_at")
    found = resolve.resolve_exact(raw_names(spark, folder), aliases(spark, folder))
    resolved = found.select("raw", "law_id", F.lit("high").alias("confidence"), F.lit(1.0).alias("score"), "matched_alias", F.lit("exact").alias("method"))
    return resolve.apply_resolution(rows, resolved).select("citation_id", "target_law_id", "new_confidence")


_KEYWORDS = [("agua", ["agua", "riberas", "embalses"]), ("constitucional", ["constitucion"]), ("faros", ["faros", "balizas"])]


@query(f"""WITH n AS (SELECT DISTINCT target_law_id AS id FROM citations WHERE target_law_id <> 'unresolved') SELECT id, coalesce(r.sector,
  CASE {" ".join(f"WHEN {' OR '.join(f'contains(id, {w!r})' for w in words)} THEN {sector!r}" for sector, words in _KEYWORDS)} ELSE 'unknown' END) AS sector FROM n LEFT JOIN law_registry r ON r.law_id = id""")
def sector_by_keyword(spark, folder):
    """Sectors of the laws cited: the registry's, else by the words of the id."""
    nodes = table(spark, folder, "citations").select(F.col("target_law_id").alias("id")).where("id <> 'unresolved'").distinct()
    known = table(spark, folder, "law_registry").select(F.col("law_id").alias("id"), "sector")
    return nodes.join(known, "id", "left").select("id", F.coalesce("sector", resolve.keyword_sector(F.col("id"), _KEYWORDS), F.lit("unknown")).alias("sector"))


# --- text


@query(f"""WITH {LAWS_SQL} SELECT id, TRY_CAST(right(nullif(regexp_extract(substring(full_text, 1, 3000), '(?i)[úu]ltima\\s+reforma\\s+publicada[^0-9]*([0-9]{{1,2}}\\s+de\\s+[\\p{{L}}\\p{{N}}_]+\\s+de\\s+[0-9]{{4}})', 1), ''), 4) AS INTEGER) AS year FROM law""")
def year_reform(spark, folder):
    return current_laws(spark, folder, "full_text").select("id", X.year_reformed(F.col("full_text")).alias("year"))


@query("SELECT DISTINCT p_brand || ' ' || p_type AS code, replace(lower(p_brand || ' ' || p_type), ' ', '-') AS slug FROM part")
def code_slugs(spark, folder):
    code = F.concat_ws(" ", "p_brand", "p_type")
    return table(spark, folder, "part").select(code.alias("code"), X.code_slug(code).alias("slug")).distinct()


_BASE = "https://a.example/leyes"


@query(f"""WITH l AS (SELECT unnest(['https://b.example/' || n_name, '//c.example/' || n_name, '/raiz/' || n_name, './' || n_name, 'ref/' || n_name]) AS href FROM nation)
SELECT href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://a.example' || href ELSE '{_BASE}/' || regexp_replace(href, '^(\\./)+', '') END AS url FROM l""")
def absolute_urls(spark, folder):
    forms = [F.concat(F.lit(p), F.col("n_name")) for p in ("https://b.example/", "//c.example/", "/raiz/", "./", "ref/")]
    return table(spark, folder, "nation").select(F.explode(F.array(*forms)).alias("href")).select("href", X.absolute_url(F.col("href"), _BASE).alias("url"))
