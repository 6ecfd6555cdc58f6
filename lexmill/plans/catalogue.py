"""All queries of the library outside the training-text subpackage, with the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import extract, graph, reports, resolve, segment
from lexmill.plans import core_problems
from lexmill.plans.register import QUERIES, SQL, Query, query
from lexmill.plans.relations import (
    ARTICLE_EDGE_COLUMNS,
    ARTICLE_EDGES_SQL,
    CITATIONS_SQL,
    EDGES_SQL,
    LAWS_SQL,
    LINES_SQL,
    RANK_SQL,
    SUPPLIER_DEFINITIONS_SQL,
    VERTICES_SQL,
    article_edges,
    current_citations,
    current_laws,
    law_edges,
    supplier_definitions,
    supplier_edges,
    supplier_lines,
)
from lexmill.session import checkpointed
from lexmill.sources.tables import table

# --- edges, degrees and other counts on graphs


@query(f"""WITH {EDGES_SQL} SELECT src, dst, citation_count, CASE rank WHEN 3 THEN 'high' ELSE 'medium' END AS confidence,
  array_to_string(arts[1:3], ', ') AS sample_article, CAST(citation_count AS DOUBLE) AS weight FROM edges""")
def edge_aggregation(spark, folder):
    return law_edges(spark, folder)


_DEGREES_SQL = f"""{EDGES_SQL}, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges),
degrees AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS total_degree FROM ends GROUP BY 1)"""


@query(f"WITH {_DEGREES_SQL} SELECT * FROM degrees")
def degree_metrics(spark, folder):
    return graph.degree_metrics(law_edges(spark, folder))


@query(f"WITH {_DEGREES_SQL} SELECT * FROM degrees WHERE total_degree <= 2")
def isolated_nodes(spark, folder):
    return graph.degree_metrics(law_edges(spark, folder)).where("total_degree <= 2")


@query(f"WITH {_DEGREES_SQL} SELECT id, in_degree FROM degrees ORDER BY in_degree DESC, id LIMIT 20")
def authority_top(spark, folder):
    return graph.degree_metrics(law_edges(spark, folder)).select("id", "in_degree").orderBy(F.desc("in_degree"), "id").limit(20)


@query(f"""WITH {EDGES_SQL}, n AS (SELECT count(*) AS nodes FROM (SELECT src FROM edges UNION SELECT dst FROM edges)), m AS (SELECT count(*) AS edges FROM edges)
SELECT CAST(nodes AS BIGINT) AS nodes, CAST(m.edges AS BIGINT) AS edges, round(m.edges / CAST(nodes * (nodes - 1) AS DOUBLE), 6) AS density FROM n, m""")
def density_summary(spark, folder):
    return graph.density(law_edges(spark, folder))


@query(f"""WITH {LINES_SQL} SELECT x.src AS a, x.dst AS b, x.weight AS a_to_b, y.weight AS b_to_a FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst""")
def mutual_pairs(spark, folder):
    return graph.mutual_pairs(supplier_edges(spark, folder))


_LINE_CITATIONS_SQL = """lc AS (SELECT src, dst, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence,
  l_linenumber AS char_offset, l_orderkey AS citation_id, l_returnflag || '-' || CAST(l_partkey AS VARCHAR) AS t FROM pairs)"""


@query(f"""WITH {LINES_SQL}, {_LINE_CITATIONS_SQL}, m AS (SELECT x.src, x.dst FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src),
r AS (SELECT lc.*, {RANK_SQL.format(c='confidence')} AS k FROM lc JOIN m USING (src, dst)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, t ORDER BY k DESC, char_offset, citation_id) AS n FROM r) WHERE n = 1),
top AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src, dst ORDER BY k DESC, char_offset, citation_id) AS INTEGER) AS rank, citation_id, confidence FROM once)
SELECT * FROM top WHERE rank <= 3""")
def mutual_pairs_evidence_top3(spark, folder):
    flag = F.col("l_returnflag")
    lines = supplier_lines(spark, folder).select(
        F.col("src").alias("source_law"), F.col("dst").alias("target_law_id"), F.when(flag == "R", "high").when(flag == "A", "medium").otherwise("low").alias("confidence"),
        F.col("l_linenumber").alias("char_offset"), F.col("l_orderkey").alias("citation_id"), F.concat_ws("-", flag, F.col("l_partkey").cast("string")).alias("citation_text"),
    )
    return graph.mutual_evidence(graph.mutual_pairs(supplier_edges(spark, folder)), lines)


@query(f"""WITH {EDGES_SQL} SELECT src, dst, citation_count, CASE WHEN name IS NULL THEN 'unknown' ELSE 'withdrawn' END AS kind
FROM edges LEFT JOIN law_registry r ON dst = r.law_id WHERE r.withdrawn_at IS NOT NULL OR r.name IS NULL""")
def orphan_references(spark, folder):
    return reports.orphan_edges(law_edges(spark, folder), table(spark, folder, "law_registry"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, CAST(count(*) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2")
def bipartite_edges(spark, folder):
    return reports.bipartite_edges(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
SELECT p_brand AS "group", CAST(count(*) AS BIGINT) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM e JOIN part ON dst = p_partkey GROUP BY 1""")
def bipartite_summary(spark, folder):
    return reports.bipartite_summary(bipartite_edges(spark, folder), table(spark, folder, "part").select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("group")))


# --- articles


@query(f"WITH {ARTICLE_EDGES_SQL} SELECT * FROM aedges")
def article_edge_aggregation(spark, folder):
    return article_edges(spark, folder)


@query(f"""WITH {ARTICLE_EDGES_SQL}, o AS (SELECT src AS node_id, count(*) AS out_degree, sum(weight) AS out_weight, count(DISTINCT split_part(dst, '::', 1)) AS cited FROM aedges GROUP BY 1),
i AS (SELECT dst AS node_id, count(*) AS in_degree, sum(weight) AS in_weight, count(DISTINCT split_part(src, '::', 1)) AS citing FROM aedges GROUP BY 1)
SELECT node_id, CAST(coalesce(out_degree, 0) AS BIGINT) AS out_degree, CAST(coalesce(out_weight, 0) AS BIGINT) AS out_weight, CAST(coalesce(cited, 0) AS BIGINT) AS unique_laws_cited,
  CAST(coalesce(in_degree, 0) AS BIGINT) AS in_degree, CAST(coalesce(in_weight, 0) AS BIGINT) AS in_weight, CAST(coalesce(citing, 0) AS BIGINT) AS unique_laws_citing FROM o FULL JOIN i USING (node_id)""")
def article_metrics(spark, folder):
    return graph.article_metrics(article_edges(spark, folder))


@query()
def article_betweenness(spark, folder):
    """From 100 sources, with weights as lengths."""
    return graph.betweenness(article_edges(spark, folder), sources=100, weighted=True).select(F.col("id").alias("node_id"), F.round("betweenness", 8).alias("betweenness"))


@query(f"""WITH {ARTICLE_EDGES_SQL}, d AS (SELECT split_part(n, '::', 1) AS law_id, d FROM (SELECT src AS n, count(*) AS d FROM aedges GROUP BY 1 UNION ALL SELECT dst, count(*) FROM aedges GROUP BY 1))
SELECT law_id, CAST(sum(d) AS BIGINT) AS complexity FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def complexity_top(spark, folder):
    return reports.complexity(graph.article_metrics(article_edges(spark, folder)))


@query(f"""WITH {ARTICLE_EDGES_SQL}, i AS (SELECT dst, split_part(src, '::', 1) AS law, sum(weight) AS n FROM aedges WHERE NOT suffix(dst, '::?') GROUP BY 1, 2),
t AS (SELECT dst, CAST(sum(n) AS BIGINT) AS cited FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100),
r AS (SELECT i.*, cited, row_number() OVER (PARTITION BY dst ORDER BY n DESC, law) AS r FROM i JOIN t USING (dst))
SELECT dst, cited, string_agg(law || '=' || CAST(n AS BIGINT), ',' ORDER BY r) AS citing FROM r WHERE r <= 8 GROUP BY 1, 2""")
def article_stats_top(spark, folder):
    return reports.article_stats_top(article_edges(spark, folder))


@query(f"""WITH {ARTICLE_EDGES_SQL}, i AS (SELECT split_part(dst, '::', 1) AS law, split_part(dst, '::', 2) AS article, CAST(sum(weight) AS BIGINT) AS cited FROM aedges GROUP BY 1, 2),
t AS (SELECT law, sum(cited) AS total FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60),
r AS (SELECT i.*, row_number() OVER (PARTITION BY law ORDER BY cited DESC, article) AS r FROM i JOIN t USING (law))
SELECT law, article, cited, CAST(row_number() OVER (PARTITION BY law ORDER BY article = '?', coalesce(TRY_CAST(article AS INTEGER), 0), article) AS INTEGER) AS pos FROM r WHERE r <= 80""")
def article_drilldown(spark, folder):
    return reports.article_drilldown(article_edges(spark, folder))


@query(f"""WITH {ARTICLE_EDGES_SQL}, b AS (SELECT law, article, side, partner, CAST(sum(weight) AS BIGINT) AS n FROM (
  SELECT split_part(src, '::', 1) AS law, split_part(src, '::', 2) AS article, 'out' AS side, split_part(dst, '::', 1) AS partner, weight FROM aedges
  UNION ALL SELECT split_part(dst, '::', 1), split_part(dst, '::', 2), 'in', split_part(src, '::', 1), weight FROM aedges) GROUP BY 1, 2, 3, 4),
t AS (SELECT law FROM b GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 60), o AS (SELECT b.* FROM b JOIN t USING (law)),
a AS (SELECT law, article, CAST(coalesce(sum(n) FILTER (side = 'in'), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(n) FILTER (side = 'out'), 0) AS BIGINT) AS out_degree,
  CAST(row_number() OVER (PARTITION BY law ORDER BY sum(n) DESC, article = '?', CASE WHEN regexp_full_match(article, '[0-9]{{1,9}}') THEN TRY_CAST(article AS INTEGER) ELSE 0 END, article) AS INTEGER) AS pos FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY law, article, side ORDER BY n DESC, partner) AS r FROM o),
l AS (SELECT law, article, coalesce(string_agg(partner || '=' || n, ',' ORDER BY r) FILTER (side = 'out'), '') AS cites, coalesce(string_agg(partner || '=' || n, ',' ORDER BY r) FILTER (side = 'in'), '') AS cited_by FROM r WHERE r <= 10 GROUP BY 1, 2)
SELECT law, article, in_degree, out_degree, pos, cites, cited_by FROM a JOIN l USING (law, article) WHERE pos <= 80""")
def article_drilldown_both(spark, folder):
    return reports.article_activity(article_edges(spark, folder))


@query(f"""WITH {ARTICLE_EDGES_SQL}, e AS (SELECT * FROM aedges WHERE src <> dst), d AS (SELECT id, sum(weight) AS degree FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1),
k AS (SELECT id FROM d ORDER BY degree DESC, id LIMIT 5000), h AS (SELECT * FROM e ORDER BY weight DESC, src, dst LIMIT 40000)
SELECT src, dst, weight FROM h WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) ORDER BY weight DESC, src, dst LIMIT 20000""")
def article_graph_capped(spark, folder):
    return graph.article_graph_capped(current_citations(spark, folder, *ARTICLE_EDGE_COLUMNS))


_FOCUS = "constitucion-politica-de-la-federacion-de-ondaria"


@query(f"""WITH {ARTICLE_EDGES_SQL}, own AS (SELECT * FROM aedges WHERE split_part(src, '::', 1) = '{_FOCUS}' OR split_part(dst, '::', 1) = '{_FOCUS}'),
k AS (SELECT id FROM (SELECT src AS id, weight FROM own UNION ALL SELECT dst, weight FROM own) GROUP BY 1 ORDER BY sum(weight) DESC, id LIMIT 50)
SELECT src, dst, weight FROM own WHERE src <> dst AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def view_graph(spark, folder):
    return graph.view_graph(article_edges(spark, folder), _FOCUS)


@query("""SELECT law_id AS id, name FROM law_registry WHERE contains(lower(name), 'fluviales') OR contains(lower(law_id), 'fluviales') ORDER BY law_id LIMIT 8""")
def search(spark, folder):
    return reports.search(table(spark, folder, "law_registry").select(F.col("law_id").alias("id"), "name"), "Fluviales", ["name", "id"])


@query(f"""WITH {EDGES_SQL} SELECT DISTINCT id FROM (SELECT unnest([src, dst]) AS id FROM edges WHERE src = '{_FOCUS}' OR dst = '{_FOCUS}')""")
def neighbourhood(spark, folder):
    return graph.neighbourhood(law_edges(spark, folder), _FOCUS)


# --- summaries


@query(f"""WITH {CITATIONS_SQL}, g AS (SELECT grouping(pattern_name, confidence, target_law_raw) AS g, pattern_name, confidence, target_law_raw, CAST(count(*) AS BIGINT) AS n FROM cit
  GROUP BY GROUPING SETS ((pattern_name), (confidence), (target_law_raw)))
SELECT 'pattern' AS kind, pattern_name AS name, n FROM g WHERE g = 3 UNION ALL SELECT 'confidence', confidence, n FROM g WHERE g = 5
UNION ALL SELECT * FROM (SELECT 'raw_name', target_law_raw, n FROM g WHERE g = 6 ORDER BY n DESC, target_law_raw NULLS FIRST LIMIT 20)""")
def citation_summary(spark, folder):
    return reports.citation_summary(current_citations(spark, folder, "pattern_name", "confidence", "target_law_raw"))


@query(f"""WITH {CITATIONS_SQL}, r AS (SELECT coalesce(resolution_confidence, 'unresolved') AS resolution_confidence, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (target_law_id <> 'unresolved') AS BIGINT) AS resolved FROM cit GROUP BY 1) SELECT *, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share FROM r""")
def resolution_report(spark, folder):
    return reports.resolution_report(current_citations(spark, folder, "resolution_confidence", "target_law_id"))


@query(f"WITH {CITATIONS_SQL} SELECT target_law_id, CAST(count(*) AS BIGINT) AS n FROM cit WHERE target_law_id <> 'unresolved' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def top_targets(spark, folder):
    return reports.top_targets(current_citations(spark, folder, "target_law_id"))


@query("""SELECT term, CAST(count(*) AS BIGINT) AS n_laws, count(DISTINCT lower(trim(regexp_replace(substring(definition_text, 1, 100), '\\s+', ' ', 'g'), ' '))) AS n_variants
FROM definitions GROUP BY 1 HAVING n_laws > 1 AND n_variants > 1""")
def definition_conflicts(spark, folder):
    return reports.definition_conflicts(table(spark, folder, "definitions"))


# --- dependency classes


def _rules_sql() -> str:
    edge, out = r"[^\p{L}\p{N}_]", []
    for kind, _, _, words, _ in P.DEPENDENCY_RULES:
        out.append(f"WHEN regexp_matches(t, '(?i)(^|{edge})(?:{words.replace(chr(92) + 's', ' ')})($|{edge})') THEN '{kind}'")
    return "CASE " + " ".join(out) + " ELSE 'generic_unresolved' END"


DEPENDENCIES_SQL = f"""{CITATIONS_SQL}, x AS (SELECT *, regexp_replace(trim(citation_text || ' ' || target_law_raw || ' ' || pattern_name, ' '), '[\\s\\p{{Z}}]+', ' ', 'g') AS t FROM cit WHERE target_law_id <> 'unresolved'),
dep AS (SELECT *, {_rules_sql()} AS dependency_type FROM x)"""


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return reports.classified(current_citations(spark, folder, "source_law", "source_article", "target_law_id", "target_article", "target_law_raw", "citation_text", "pattern_name", "confidence", "resolution_method"))


@query(f"WITH {DEPENDENCIES_SQL} SELECT citation_id, dependency_type FROM dep")
def dependency_classification(spark, folder):
    return dependencies(spark, folder).select("citation_id", "dependency_type")


@query(f"WITH {DEPENDENCIES_SQL} SELECT dependency_type, CAST(count(*) AS BIGINT) AS n FROM dep GROUP BY 1")
def dependency_type_counts(spark, folder):
    return dependencies(spark, folder).groupBy("dependency_type").agg(F.count("*").alias("n"))


@query(f"""WITH {DEPENDENCIES_SQL}, n AS (SELECT source_law, target_law_id, dependency_type, count(*) AS n FROM dep GROUP BY ALL)
SELECT source_law, target_law_id, arg_min(dependency_type, (-n, dependency_type)) AS dependency_type FROM n GROUP BY 1, 2""")
def dependency_by_pair(spark, folder):
    return reports.dependency_by_pair(dependencies(spark, folder))


@query(f"""WITH {LAWS_SQL}, l AS (SELECT lower(coalesce(name, '')) || ' ' || lower(coalesce(short_name, '')) AS f FROM law)
SELECT CASE WHEN contains(f, 'constituci') OR contains(f, 'reglamento') OR contains(f, 'código') OR contains(f, 'ley') THEN 'layer_1_normative_core'
  WHEN contains(f, 'decreto') OR contains(f, 'transitorio') OR contains(f, 'acuerdo') THEN 'layer_2_change_layer' ELSE 'layer_3_interpretive_prepared' END AS layer, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1""")
def corpus_layers(spark, folder):
    return current_laws(spark, folder, "name", "short_name").groupBy(X.corpus_layer(F.col("name"), F.col("short_name")).alias("layer")).agg(F.count("*").alias("n"))


@query(f"""WITH {DEPENDENCIES_SQL}, u AS (SELECT trim(target_law_raw, ' ') AS raw_name, CAST(count(*) AS BIGINT) AS n FROM cit WHERE target_law_id = 'unresolved' AND coalesce(target_law_raw, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 150)
SELECT 'raw_name' AS kind, raw_name AS name, n FROM u UNION ALL SELECT 'unresolved', NULL, CAST(count(*) AS BIGINT) FROM cit WHERE coalesce(target_law_id, 'unresolved') = 'unresolved'
UNION ALL SELECT 'low_confidence', NULL, CAST(count(*) AS BIGINT) FROM dep WHERE dependency_type = 'generic_unresolved'""")
def fragility(spark, folder):
    """Unresolved names by frequency, and the numbers of unresolved citations and of weak dependencies."""
    return reports.fragility(current_citations(spark, folder, "target_law_id", "target_law_raw"), dependencies(spark, folder))


@query(f"""WITH {DEPENDENCIES_SQL} SELECT citation_id, source_law, target_law_id, dependency_type FROM dep WHERE dependency_type = 'generic_unresolved' ORDER BY citation_id LIMIT 300""")
def fragility_sample(spark, folder):
    return reports.weak_dependencies(dependencies(spark, folder)).select("citation_id", "source_law", "target_law_id", "dependency_type").orderBy("citation_id").limit(300)


@query(f"""WITH {DEPENDENCIES_SQL}, i AS (SELECT target_law_id AS law_id, count(*) AS inbound, count(DISTINCT source_article) AS touchpoints FROM dep GROUP BY 1),
o AS (SELECT source_law AS law_id, count(*) AS outbound FROM dep GROUP BY 1), c AS (SELECT target_law_id AS law_id, dependency_type, count(*) AS n FROM dep GROUP BY 1, 2),
m AS (SELECT law_id, string_agg(dependency_type || '=' || n, ',' ORDER BY dependency_type) AS type_mix FROM c GROUP BY 1)
SELECT law_id, CAST(inbound AS BIGINT) AS inbound, CAST(touchpoints AS BIGINT) AS touchpoints, type_mix, CAST(coalesce(outbound, 0) AS BIGINT) AS outbound,
  CAST(2 * inbound + coalesce(outbound, 0) AS BIGINT) AS spillover FROM i JOIN m USING (law_id) LEFT JOIN o USING (law_id) ORDER BY inbound DESC, law_id LIMIT 100""")
def reform_impact(spark, folder):
    return reports.reform_impact(dependencies(spark, folder))


# No citation of the test tables leans on a definition, so each definition counts as a provision that leans on its law.
_DEFINITIONAL_SQL = f"""{DEPENDENCIES_SQL}, dx AS (SELECT *, regexp_replace(trim('Para efectos de ' || term || ': ' || definition_text, ' '), '[\\s\\p{{Z}}]+', ' ', 'g') AS t FROM definitions),
dd AS (SELECT citation_id, source_law, source_article, target_law_id, target_article, dependency_type FROM dep
  UNION ALL SELECT definition_id, coalesce(law_name, law_id), article, law_id, NULL, {_rules_sql()} FROM dx)"""


def _definitional(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("Para efectos de "), "term", F.lit(": "), "definition_text")
    none = F.lit(None).cast("string")
    rows = table(spark, folder, "definitions").select(
        F.col("definition_id").alias("citation_id"), F.coalesce("law_name", "law_id").alias("source_law"), F.col("article").alias("source_article"), F.col("law_id").alias("target_law_id"), none.alias("target_article"),
        none.alias("target_law_raw"), text.alias("citation_text"), none.alias("pattern_name"), none.alias("confidence"), none.alias("resolution_method"),
    )
    return dependencies(spark, folder).drop("ingested_at").unionByName(reports.classified(rows))


@query(f"""WITH {_DEFINITIONAL_SQL} SELECT target_law_id, CAST(count(*) AS BIGINT) AS n, count(DISTINCT source_law) AS n_laws, min(source_law) AS first_law FROM dd WHERE dependency_type = 'definitional' GROUP BY 1""")
def definition_trace(spark, folder):
    return reports.definition_trace(_definitional(spark, folder))


@query(f"""WITH {_DEFINITIONAL_SQL} SELECT target_law_id, citation_id, source_law, source_article, target_article,
  'term_definition_reference' AS dependency_subtype, 'high' AS confidence FROM dd WHERE dependency_type = 'definitional'""")
def definition_provisions(spark, folder):
    return reports.dependent_provisions(_definitional(spark, folder))


@query(f"""WITH {DEPENDENCIES_SQL}, b AS (SELECT least(source_law, target_law_id) AS a, greatest(source_law, target_law_id) AS b, dependency_type, count(*) AS n FROM dep WHERE source_law <> target_law_id GROUP BY 1, 2, 3),
r AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_types, string_agg(dependency_type || '=' || n, ',' ORDER BY dependency_type || '=' || n) AS by_type FROM b GROUP BY 1, 2 HAVING sum(n) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 100)
SELECT *, round(n + 1.5 * n_types, 2) AS priority FROM r""")
def harmonization(spark, folder):
    return reports.harmonization(dependencies(spark, folder))


@query(f"""WITH {DEPENDENCIES_SQL}, f AS (SELECT unnest([{{'field': 'source_law', 'v': source_law}}, {{'field': 'target_law_id', 'v': target_law_id}}, {{'field': 'dependency_type', 'v': dependency_type}},
  {{'field': 'source_article', 'v': source_article}}, {{'field': 'target_article', 'v': target_article}}]) AS r FROM dep)
SELECT r.field AS field, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(r.v, '') = '') AS BIGINT) AS n_lacking FROM f GROUP BY 1""")
def validate_dependencies(spark, folder):
    """Dependencies that lack a field, by field."""
    return reports.field_checks(dependencies(spark, folder), ["source_law", "target_law_id", "dependency_type", "source_article", "target_article"])


# --- text


@query(f"""WITH {LAWS_SQL} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12), chr(10) || chr(10)),
  '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g') AS text
FROM (SELECT id, {"".join("replace(" for _ in X.GARBLED_PAIRS)}full_text{"".join(f", '{a}', '{b}')" for a, b in X.GARBLED_PAIRS)} AS x FROM law)""")
def clean_text(spark, folder):
    return current_laws(spark, folder, "full_text").select("id", X.clean_text(F.col("full_text")).alias("text"))


@query(f"""WITH {LAWS_SQL} SELECT id, rtrim(substring(trim(regexp_replace(regexp_replace(translate(trim(lower(name), ' '), '{X.ACCENTED}', '{X.PLAIN}'), '[^a-z0-9\\s\\-]', '', 'g'), '[\\s\\-]+', '-', 'g'), '-'), 1, 60), '-') AS slug FROM law""")
def slugify(spark, folder):
    return current_laws(spark, folder, "name").select("id", X.slugify(F.col("name")).alias("slug"))


@query(f"""WITH {LAWS_SQL}, y AS (SELECT id, regexp_extract(substring(full_text, 1, 3000), '(?i)publicad[ao]\\s+en\\s+el\\s+D\\.?O\\.?F\\.?[^0-9]*([0-9]{{1,2}}\\s+de\\s+[\\p{{L}}\\p{{N}}_]+\\s+de\\s+[0-9]{{4}})', 1) AS d,
  regexp_extract_all(substring(full_text, 1, 2000), '(?:^|[^\\p{{L}}\\p{{N}}_])((?:19[4-9][0-9]|20[0-2][0-9])[\\p{{L}}\\p{{N}}_]?)', 1) AS found FROM law)
SELECT id, coalesce(TRY_CAST(right(d, 4) AS INTEGER), list_min(list_transform(list_filter(found, lambda y: length(y) = 4), lambda y: CAST(y AS INTEGER)))) AS year FROM y""")
def year_extract(spark, folder):
    return current_laws(spark, folder, "full_text").select("id", X.year_enacted(F.col("full_text")).alias("year"))


@query(f"WITH {LAWS_SQL} SELECT id, 'sha256:' || sha256(full_text) AS checksum FROM law WHERE full_text IS NOT NULL")
def checksum(spark, folder):
    return current_laws(spark, folder, "full_text").where("full_text is not null").select("id", X.checksum(F.col("full_text")).alias("checksum"))


#: White space by Unicode, for RE2.
_W = r"[\t-\r \x{85}\p{Z}]"


@query(f"""WITH {LAWS_SQL}, x AS (SELECT id, string_split(full_text, chr(10)) AS ls FROM law WHERE full_text IS NOT NULL),
l AS (SELECT id, generate_subscripts(ls, 1) AS i, regexp_replace(unnest(ls), '^{_W}+|{_W}+$', '', 'g') AS line FROM x),
z AS (SELECT id, min(i) AS z FROM l WHERE regexp_full_match(line, '(?i)(?:art[ií]culos?{_W}+)?transitorios?\\.?{_W}*') GROUP BY 1),
k AS (SELECT l.*, regexp_matches(line, '(?i)^(?:art[ií]culo|art\\.){_W}+[0-9]') AS head FROM l LEFT JOIN z USING (id) WHERE z IS NULL OR i < z),
g AS (SELECT *, CAST(sum(head::INT) OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS pos FROM k),
t AS (SELECT id, pos, arg_min(line, i) AS first, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^{_W}+|{_W}+$', '', 'g') AS segment_text FROM g WHERE pos > 0 GROUP BY 1, 2),
n AS (SELECT *, regexp_extract(first, '(?i)^(?:art[ií]culo|art\\.){_W}+([0-9]+[\\p{{L}}\\p{{M}}\\p{{N}}_\\-]*)', 1) AS number,
  regexp_replace(regexp_extract(first, '(?i)^(?:art[ií]culo|art\\.){_W}+[0-9]+[\\p{{L}}\\p{{M}}\\p{{N}}_\\-]*(?:[.\\-–]|{_W})*(.*)$', 1), '^{_W}+|{_W}+$', '', 'g') AS rest FROM t)
SELECT id, pos, number, 'Artículo ' || number || CASE WHEN rest <> '' THEN ' — ' || rest ELSE '' END AS title, segment_text FROM n""")
def segment_articles(spark, folder):
    return segment.segmented(current_laws(spark, folder, "full_text"), "id", "full_text")


@query(f"""WITH {CITATIONS_SQL}, n AS (SELECT DISTINCT target_law_raw AS raw FROM cit) SELECT raw, nullif(regexp_extract(raw, '(?i)art[ií]culos?\\s+([0-9]+[\\p{{L}}\\p{{N}}_\\-]*)', 1), '') AS article FROM n WHERE raw IS NOT NULL""")
def first_article(spark, folder):
    return raw_names(spark, folder).withColumn("article", X.first_article(F.col("raw")))


def re2(expression: str) -> str:
    return "(?i)" + expression.replace(r"\s", _W).replace(r"\w", r"[\p{L}\p{M}\p{N}_]")


def _clean_name_sql() -> str:
    name = "trim(raw, ' ')"
    for tail in P.NAME_TAILS:
        name = f"regexp_replace({name}, '{re2(tail)}', '', 'g')"
    name = f"rtrim({name}, '.,;: ' || chr(9) || chr(10))"
    trimmed = f"trim(regexp_replace(raw, '{re2(P.TRAILING_JUNK)}', '', 'g'), ' ')"
    return f"WITH n AS (SELECT DISTINCT target_law_raw AS raw FROM citations WHERE target_law_raw IS NOT NULL) SELECT raw, {name} AS name, {trimmed} AS trimmed FROM n"


@query(_clean_name_sql())
def clean_name(spark, folder):
    return raw_names(spark, folder).select("raw", X.clean_law_name(F.col("raw")).alias("name"), X.strip_trailing_junk(F.col("raw")).alias("trimmed"))


# --- extraction


def law_articles(spark: SparkSession, folder: str) -> DataFrame:
    return extract.articles_or_text(current_laws(spark, folder, "articles", "full_text"))


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts around citations as articles: the laws of the test tables cite only themselves."""
    return current_citations(spark, folder, "source_law", "source_article", "citation_text").select("source_law", "source_article", F.col("citation_text").alias("text"))


_MENTION_SQL = r"(?i)(?:^|[^\p{L}\p{N}_])(?:la|el)\s+((?:Ley|Código|Reglamento|Decreto)\s+(?:Federal|General|Nacional|Orgánica|Orgánico|de|del|para|sobre|en)\s+[A-ZÁÉÍÓÚÜÑ][^,;.()]{5,120}?)(?:[,;.()\n]|$)"


@query(f"""WITH {CITATIONS_SQL}, m AS (SELECT unnest(regexp_extract_all(citation_text, '{_MENTION_SQL}', 1)) AS name FROM cit) SELECT name, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1""")
def direct_mentions(spark, folder):
    expression = {name: expression for name, _, _, expression in P.CITATION_PATTERNS}["direct_mention"]
    found = contexts(spark, folder).select(F.explode(extract.find_all(F.col("text"), P.FLAGS + expression)).alias("m"))
    return found.groupBy(F.col("m.g1").alias("name")).agg(F.count("*").alias("n"))


@query(f"""WITH {CITATIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_law, source_article, substring(lower(target_law_raw), 1, 50) ORDER BY {RANK_SQL.format(c='confidence')} DESC, char_offset, citation_id) AS n FROM cit)
SELECT citation_id, source_law, source_article, target_law_raw, confidence FROM r WHERE n = 1""")
def citation_dedup(spark, folder):
    once = extract.deduplicate_citations(current_citations(spark, folder, "source_law", "source_article", "target_law_raw", "confidence", "char_offset"), ["char_offset", "citation_id"])
    return once.select("citation_id", "source_law", "source_article", "target_law_raw", "confidence")


@query(f"""WITH {CITATIONS_SQL}, {LAWS_SQL} SELECT citation_id FROM cit WHERE target_law_raw IS NULL OR NOT EXISTS (SELECT 1 FROM law WHERE law.id = cit.source_law AND lower(cit.target_law_raw) IN (lower(law.name), lower(law.short_name)))""")
def self_reference_filter(spark, folder):
    return extract.drop_self_references(current_citations(spark, folder, "source_law", "target_law_raw"), current_laws(spark, folder, "name", "short_name")).select("citation_id")


# --- resolution

ALIASES_SQL = """al AS (SELECT lower(trim(a, ' ')) AS alias, law_id, i FROM (SELECT law_id, unnest(list_concat([name, short], coalesce(aliases, []))) AS a, generate_subscripts(list_concat([name, short], coalesce(aliases, [])), 1) - 1 AS i FROM law_registry) WHERE a IS NOT NULL AND a <> ''),
am AS (SELECT alias, arg_max(law_id, (law_id, i)) AS law_id, min((law_id, i)) AS place FROM al GROUP BY 1)"""


def raw_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "citations").where("target_law_raw is not null").select(F.col("target_law_raw").alias("raw")).distinct()


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.alias_map(table(spark, folder, "law_registry"))


@query(f"WITH {ALIASES_SQL} SELECT alias, law_id FROM am")
def alias_map(spark, folder):
    return aliases(spark, folder).select("alias", "law_id")


@query(f"WITH {ALIASES_SQL}, n AS (SELECT DISTINCT target_law_raw AS raw FROM citations WHERE target_law_raw IS NOT NULL) SELECT raw, law_id, alias AS matched_alias FROM n JOIN am ON lower(trim(raw, ' ')) = alias")
def resolve_exact(spark, folder):
    return resolve.resolve_exact(raw_names(spark, folder), aliases(spark, folder))


@query(f"""WITH {ALIASES_SQL}, n AS (SELECT DISTINCT target_law_raw AS raw, lower(trim(target_law_raw, ' ')) AS c FROM citations WHERE target_law_raw IS NOT NULL),
j AS (SELECT raw, alias, law_id, place FROM n, am WHERE c <> '' AND length(alias) >= 10 AND (starts_with(c, substring(alias, 1, 15)) OR starts_with(alias, substring(c, 1, 15))))
SELECT raw, arg_min(law_id, place) AS law_id, arg_min(alias, place) AS matched_alias FROM j GROUP BY 1""")
def resolve_prefix(spark, folder):
    return resolve.resolve_prefix(raw_names(spark, folder), aliases(spark, folder))


@query()
def resolve_fuzzy(spark, folder):
    return resolve.resolve_fuzzy(raw_names(spark, folder), aliases(spark, folder))


@query()
def resolve_cascade(spark, folder):
    return resolve.resolve_names(raw_names(spark, folder), aliases(spark, folder), resolve.corpus_map(current_laws(spark, folder, "name", "short_name")))


@query()
def sector_lookup(spark, folder):
    registry = table(spark, folder, "law_registry")
    nodes = table(spark, folder, "citations").select(F.col("target_law_id").alias("id")).where("id <> 'unresolved'").distinct()
    return resolve.sector_lookup(nodes, registry, [("constitucional", ["constitucion"]), ("agua", ["agua", "riberas", "embalses"])])


# --- versions and increments


@query(f"WITH {CITATIONS_SQL} SELECT citation_id, epoch_us(ingested_at) AS ingested_us, target_law_id FROM cit")
def latest_version_dedup(spark, folder):
    return current_citations(spark, folder, "target_law_id").select("citation_id", F.unix_micros("ingested_at").alias("ingested_us"), "target_law_id")


@query(f"""WITH {LAWS_SQL}, seen AS (SELECT id, doc_checksum FROM law WHERE year_enacted < 2000) SELECT DISTINCT l.id FROM laws l
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.id = l.id AND (l.doc_checksum IS NULL OR l.doc_checksum = s.doc_checksum))""")
def incremental_skip(spark, folder):
    seen = current_laws(spark, folder, "year_enacted", "doc_checksum").where("year_enacted < 2000")
    return reports.new_rows(table(spark, folder, "laws"), seen, "id", "doc_checksum").select("id").distinct()


# --- graph algorithms, on the graph of suppliers


@query(f"""WITH RECURSIVE {LINES_SQL}, {VERTICES_SQL}, reach(id, reached) AS (SELECT src, dst FROM links UNION SELECT r.id, s.dst FROM reach r JOIN links s ON r.reached = s.src)
SELECT vs.id, CAST(count(r.id) AS BIGINT) AS cascade FROM vs LEFT JOIN (SELECT * FROM reach WHERE id <> reached) r ON r.reached = vs.id GROUP BY 1""")
def cascade_scores(spark, folder):
    return graph.cascade_scores(supplier_edges(spark, folder))


def pagerank_sql(steps: int, relations: str, result: str, weight: str = "1.0::DOUBLE", alpha: float = 0.85) -> str:
    """PageRank step by step over `links` and `vs` of the relations; `r<k>` holds the ranks after k steps."""
    out = f"WITH {relations}, d AS (SELECT src, dst, {weight}::DOUBLE / sum({weight}) OVER (PARTITION BY src) AS p FROM links), c AS (SELECT count(*)::DOUBLE AS n FROM vs), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM vs, c)"
    for i in range(1, steps + 1):
        out += f""", r{i} AS MATERIALIZED (SELECT vs.id, {1 - alpha}::DOUBLE / n + {alpha}::DOUBLE * (coalesce(m.m, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM d)) / n) AS r
          FROM vs CROSS JOIN c LEFT JOIN (SELECT dst AS id, sum(r * p) AS m FROM r{i - 1} JOIN d ON r{i - 1}.id = d.src GROUP BY 1) m ON m.id = vs.id)"""
    return f"{out} {result}"


@query(pagerank_sql(10, f"{LINES_SQL}, {VERTICES_SQL}", "SELECT id, round(r, 8) AS pagerank FROM r10"))
def pagerank_fixed_iters(spark, folder):
    return graph.pagerank(supplier_edges(spark, folder), iterations=10).select("id", F.round("pagerank", 8).alias("pagerank"))


def _hits_sql(steps: int) -> str:
    out = f"WITH {LINES_SQL}, {VERTICES_SQL}, h0 AS (SELECT id, 1.0::DOUBLE AS hub FROM vs)"
    for i in range(1, steps + 2):
        out += f", a{i} AS MATERIALIZED (SELECT id, a / sum(a) OVER () AS authority FROM (SELECT dst AS id, sum(hub) AS a FROM links JOIN h{i - 1} ON src = id GROUP BY 1))"
        if i <= steps:
            out += f", h{i} AS MATERIALIZED (SELECT id, h / sum(h) OVER () AS hub FROM (SELECT src AS id, sum(authority) AS h FROM links JOIN a{i} ON dst = id GROUP BY 1))"
    return out + f" SELECT vs.id, round(coalesce(hub, 0), 8) AS hub, round(coalesce(authority, 0), 8) AS authority FROM vs LEFT JOIN h{steps} h ON h.id = vs.id LEFT JOIN a{steps + 1} a ON a.id = vs.id"


@query(_hits_sql(6))
def hits_fixed_iters(spark, folder):
    return graph.hits(supplier_edges(spark, folder), 6).select("id", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


@query(f"""WITH RECURSIVE {LINES_SQL}, {VERTICES_SQL}, reach(id, reached) AS (SELECT id, id FROM vs UNION SELECT r.id, s.dst FROM reach r JOIN links s ON r.reached = s.src)
SELECT x.id, min(x.reached) AS component FROM reach x JOIN reach y ON x.id = y.reached AND x.reached = y.id GROUP BY 1""")
def scc(spark, folder):
    return graph.components(supplier_edges(spark, folder))


@query(f"""WITH {LINES_SQL}, f AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM links), d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM f UNION ALL SELECT b FROM f) GROUP BY 1),
t AS (SELECT x.a, x.b, y.b AS c FROM f x JOIN f y ON x.b = y.a JOIN f z ON z.a = x.a AND z.b = y.b), n AS (SELECT id, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY 1)
SELECT id, CAST(degree AS BIGINT) AS degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, CASE WHEN degree > 1 THEN round(2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)), 6) ELSE 0 END AS clustering FROM d LEFT JOIN n USING (id)""")
def clustering_coefficient(spark, folder):
    return graph.clustering(supplier_edges(spark, folder))


@query()
def communities(spark, folder):
    return graph.louvain(law_edges(spark, folder))


@query()
def communities_propagated(spark, folder):
    return graph.label_propagation(law_edges(spark, folder))


@query()
def community_analysis(spark, folder):
    edges = law_edges(spark, folder)
    sectors = table(spark, folder, "law_registry").select(F.col("law_id").alias("id"), "sector")
    return graph.community_analysis(graph.louvain(edges), edges, sectors)


# --- scores from several measures, on the graph of suppliers

_CONFLICT_SQL = """terms AS (SELECT term FROM {source} GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lower(trim(regexp_replace(substring(definition_text, 1, 100), '\\s+', ' ', 'g'), ' '))) > 1),
dc AS (SELECT law_id AS id, count(*) AS conflicts FROM {source} WHERE term IN (SELECT term FROM terms) GROUP BY 1)"""
_NODES_SQL = f"""{LINES_SQL}, {VERTICES_SQL}, {SUPPLIER_DEFINITIONS_SQL}, {_CONFLICT_SQL.format(source="sdef")}, reach(id, reached) AS (SELECT src, dst FROM links UNION SELECT r.id, s.dst FROM reach r JOIN links s ON r.reached = s.src),
ca AS (SELECT vs.id, CAST(count(r.id) AS BIGINT) AS cascade FROM vs LEFT JOIN (SELECT * FROM reach WHERE id <> reached) r ON r.reached = vs.id GROUP BY 1),
de AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links) GROUP BY 1),
mp AS (SELECT x.src AS a, x.dst AS b FROM links x JOIN links y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst), cy AS (SELECT id, count(*) AS cycles FROM (SELECT a AS id FROM mp UNION ALL SELECT b FROM mp) GROUP BY 1),
nodes AS (SELECT id, in_degree, out_degree, cascade, CAST(coalesce(cycles, 0) AS BIGINT) AS cycles, CAST(coalesce(conflicts, 0) AS BIGINT) AS conflicts, r_name AS sector
  FROM de JOIN ca USING (id) LEFT JOIN cy USING (id) LEFT JOIN dc USING (id) JOIN supplier ON s_suppkey = id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    edges = checkpointed(supplier_edges(spark, folder))
    region = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sector = table(spark, folder, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("sector"))
    return _measured(edges, supplier_definitions(spark, folder)).join(sector, "id").select(*NODE_COLUMNS)


NODE_COLUMNS = ("id", "in_degree", "out_degree", "cascade", "cycles", "conflicts", "sector")


def _measured(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Degrees, cascades, mutual pairs and definition conflicts of the nodes of `edges`."""
    parts = reports.participation(graph.mutual_pairs(edges), reports.conflicting_definitions(definitions).select(F.col("law_id").alias("id")))
    return graph.degree_metrics(edges).join(graph.cascade_scores(edges), "id").join(parts, "id", "left").fillna(0, ["cycles", "conflicts"])


@query(f"WITH RECURSIVE {_NODES_SQL} SELECT * FROM nodes")
def node_measures(spark, folder):
    return _nodes(spark, folder)


# The same on the law graph, where laws have definitions.

_CONFLICTS_SQL = _CONFLICT_SQL.format(source="definitions")
_LAW_NODES_SQL = f"""{_DEGREES_SQL}, {_CONFLICTS_SQL}, reach(id, reached) AS (SELECT src, dst FROM edges UNION SELECT r.id, e.dst FROM reach r JOIN edges e ON r.reached = e.src),
ca AS (SELECT reached AS id, count(*) AS cascade FROM reach WHERE id <> reached GROUP BY 1),
mp AS (SELECT x.src AS a, x.dst AS b FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst), cy AS (SELECT id, count(*) AS cycles FROM (SELECT a AS id FROM mp UNION ALL SELECT b FROM mp) GROUP BY 1),
nodes AS (SELECT d.id, in_degree, out_degree, CAST(coalesce(cascade, 0) AS BIGINT) AS cascade, CAST(coalesce(cycles, 0) AS BIGINT) AS cycles, CAST(coalesce(conflicts, 0) AS BIGINT) AS conflicts, coalesce(r.sector, 'unknown') AS sector
  FROM degrees d LEFT JOIN ca USING (id) LEFT JOIN cy USING (id) LEFT JOIN dc USING (id) LEFT JOIN law_registry r ON r.law_id = d.id)"""


def _law_nodes(spark: SparkSession, folder: str) -> DataFrame:
    edges = checkpointed(law_edges(spark, folder))
    sector = table(spark, folder, "law_registry").select(F.col("law_id").alias("id"), "sector")
    return _measured(edges, table(spark, folder, "definitions")).join(sector, "id", "left").fillna("unknown", ["sector"]).select(*NODE_COLUMNS)


@query(f"WITH RECURSIVE {_LAW_NODES_SQL} SELECT * FROM nodes")
def law_node_measures(spark, folder):
    return _law_nodes(spark, folder)


_REFORM_SQL = """s AS (SELECT *, CAST(15 * cycles + 20 * conflicts + least(30, (in_degree + cascade // 10) // 5) AS BIGINT) AS score FROM nodes)
SELECT id, score, concat_ws('; ', CASE WHEN cycles > 0 THEN cycles || ' cycles' END, CASE WHEN conflicts > 0 THEN conflicts || ' conflicts' END, CASE WHEN in_degree > 0 THEN 'cited by ' || in_degree END) AS rationale
FROM s WHERE score >= 10 ORDER BY score DESC, id LIMIT 40"""


@query(f"WITH RECURSIVE {_LAW_NODES_SQL}, {_REFORM_SQL}")
def law_reform_priority(spark, folder):
    return reports.reform_priority(_law_nodes(spark, folder))


_SAFETY_SQL = """sf AS (SELECT *, round_even((1 - in_degree / 316.0::DOUBLE) * 50 + (1 - cascade / 317.0::DOUBLE) * 35 + (1 - cycles / greatest((SELECT max(cycles) FROM nodes), 1)::DOUBLE) * 15, 1) AS safety FROM nodes)"""
_MERGER_SQL = """mg AS (SELECT a, b, round_even(CASE WHEN x.sector = y.sector THEN 30.0::DOUBLE ELSE 0 END + least(40.0::DOUBLE, 800.0::DOUBLE / greatest(x.out_degree + y.out_degree, 1)) + greatest(0, 20 - (x.in_degree + y.in_degree) // 4)
  + CASE WHEN x.cycles > 0 AND y.cycles > 0 THEN 10.0::DOUBLE ELSE 0 END, 1) AS score,
  concat_ws('; ', 'cite each other', CASE WHEN x.sector = y.sector THEN 'one sector' END, CASE WHEN x.in_degree + y.in_degree < 20 THEN 'seldom cited' END) AS rationale
  FROM mp JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b ORDER BY score DESC, a, b LIMIT 40)"""
_REFORM_ROWS_SQL = "rf AS (SELECT id FROM (SELECT *, CAST(15 * cycles + 20 * conflicts + least(30, (in_degree + cascade // 10) // 5) AS BIGINT) AS score FROM nodes) WHERE score >= 10 ORDER BY score DESC, id LIMIT 40)"


@query(f"""WITH RECURSIVE {_NODES_SQL}, {_SAFETY_SQL} SELECT id, safety, coalesce(nullif(concat_ws('; ', CASE WHEN in_degree = 0 THEN 'nobody cites it' WHEN in_degree <= 3 THEN 'cited by only ' || in_degree END,
  CASE WHEN cascade <= 5 THEN 'small cascade' END, CASE WHEN cycles = 0 THEN 'in no cycle' END, CASE WHEN out_degree <= 5 THEN 'cites only ' || out_degree END), ''), 'little activity') AS rationale FROM sf""")
def removal_safety(spark, folder):
    return reports.removal_safety(_nodes(spark, folder))


@query(f"WITH RECURSIVE {_NODES_SQL}, {_MERGER_SQL} SELECT * FROM mg")
def merger_candidates(spark, folder):
    nodes = checkpointed(_nodes(spark, folder))
    return reports.merger_candidates(graph.mutual_pairs(supplier_edges(spark, folder)), nodes)


@query(f"WITH RECURSIVE {_NODES_SQL}, {_REFORM_SQL}")
def reform_priority(spark, folder):
    return reports.reform_priority(_nodes(spark, folder))


@query(f"""WITH RECURSIVE {_NODES_SQL}, {_SAFETY_SQL}, {_MERGER_SQL}, {_REFORM_ROWS_SQL}
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (safety >= 80) AS BIGINT) AS removable, CAST(count(*) FILTER (in_degree = 0 AND out_degree <= 2) AS BIGINT) AS isolated,
  CAST((SELECT count(*) FROM mg) AS BIGINT) AS mergers, CAST((SELECT count(*) FROM rf) AS BIGINT) AS reforms, CAST(count(*) FILTER (cycles > 0) AS BIGINT) AS in_cycles,
  round_even(100.0::DOUBLE * count(*) FILTER (safety >= 80) / count(*), 0) AS removable_percent FROM sf""")
def simplification_summary(spark, folder):
    return reports.simplification_summary(checkpointed(_nodes(spark, folder)), graph.mutual_pairs(supplier_edges(spark, folder)))


@query()
def metric_suite(spark, folder):
    """All measures of the nodes in one table; PageRank and HITS until they hardly change."""
    out = graph.suite(supplier_edges(spark, folder))
    return out.withColumns({c: F.round(c, 8) for c in ("pagerank", "hub", "authority", "betweenness")})


def queries() -> dict[str, Query]:
    _others()
    return core_problems.queries() | QUERIES


def oracle_sql() -> dict[str, str]:
    _others()
    return core_problems.oracle_sql() | SQL


def _others() -> None:
    """Modules whose queries build on those above."""
    from lexmill.plans import ingest, views  # noqa: F401
