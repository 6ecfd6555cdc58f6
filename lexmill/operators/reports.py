"""Aggregate reports over citations, dependencies and definitions; orders of top lists are total, so every run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import classify, normalised_prefix

GENERIC = "generic_unresolved"


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by `order`; of rows equal in it any one."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def new_rows(df: DataFrame, seen: DataFrame, key: str, checksum: str) -> DataFrame:
    """Rows whose (key, checksum) isn't in `seen`; where a row has no checksum its key alone counts."""
    known = seen.select(F.col(key).alias("__k"), F.col(checksum).alias("__c"))
    same = (F.col(key) == F.col("__k")) & (F.col(checksum).isNull() | F.col(checksum).eqNullSafe(F.col("__c")))
    return df.join(known, same, "left_anti")


def map_text(key: Column, value: Column) -> Column:
    """Counts by name as one text, in order of the names, so that maps can be compared."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, value.cast("string")))), ",")


def citation_summary(citations: DataFrame, top: int = 20) -> DataFrame:
    """Counts by pattern, by confidence, and of the most cited raw names, in one pass over grouping sets."""
    sets = citations.select("pattern_name", "confidence", "target_law_raw").groupingSets([["pattern_name"], ["confidence"], ["target_law_raw"]], "pattern_name", "confidence", "target_law_raw")
    kind = F.grouping_id().alias("g")
    rows = sets.agg(kind, F.count("*").alias("n")).select(
        F.when(F.col("g") == 3, "pattern").when(F.col("g") == 5, "confidence").otherwise("raw_name").alias("kind"),
        F.when(F.col("g") == 3, F.col("pattern_name")).when(F.col("g") == 5, F.col("confidence")).otherwise(F.col("target_law_raw")).alias("name"), "n",
    )
    names = rows.where("kind = 'raw_name'").orderBy(F.desc("n"), F.col("name").asc_nulls_first()).limit(top)
    return rows.where("kind <> 'raw_name'").unionByName(names)


def resolution_report(citations: DataFrame) -> DataFrame:
    """One row per confidence of resolution (missing counts as unresolved): citations, resolved ones and their share of all."""
    confidence = F.coalesce("resolution_confidence", F.lit("unresolved"))
    rows = citations.groupBy(confidence.alias("resolution_confidence")).agg(F.count("*").alias("n"), F.count_if(F.col("target_law_id") != "unresolved").alias("resolved"))
    total = F.sum("n").over(Window.partitionBy())  # over a handful of confidences
    return rows.withColumn("share", F.round(F.col("n") / total, 4))


def top_targets(citations: DataFrame, top: int = 30) -> DataFrame:
    return citations.where("target_law_id <> 'unresolved'").groupBy("target_law_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_law_id").limit(top)


def definition_conflicts(definitions: DataFrame) -> DataFrame:
    """Terms with several definitions that differ in their first 100 characters; n_laws counts definitions, n_variants the different beginnings."""
    rows = definitions.groupBy("term").agg(F.count("*").alias("n_laws"), F.countDistinct(normalised_prefix(F.col("definition_text"))).alias("n_variants"))
    return rows.where("n_laws > 1 and n_variants > 1")


def conflicting_definitions(definitions: DataFrame) -> DataFrame:
    """The definitions (law_id, term) of the terms in definition_conflicts, each row of a law counting once more."""
    return definitions.select("law_id", "term").join(definition_conflicts(definitions).select("term"), "term", "left_semi")


def classified(citations: DataFrame) -> DataFrame:
    """Resolved citations with their dependency class; the confidence and method of the citation itself stay under other names."""
    kept = citations.where("target_law_id <> 'unresolved'").withColumn("cls", classify(F.col("citation_text"), F.col("target_law_raw"), F.col("pattern_name")))
    own = [c for c in citations.columns if c not in ("confidence", "resolution_method")]
    return kept.select(*own, F.col("resolution_method").alias("entity_resolution_method"), "cls.*")


def dependency_by_pair(dependencies: DataFrame) -> DataFrame:
    """The most frequent class of each (source, target), ties to the first by name."""
    n = dependencies.groupBy("source_law", "target_law_id", "dependency_type").agg(F.count("*").alias("n"))
    return n.groupBy("source_law", "target_law_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "dependency_type")).alias("m")).select("source_law", "target_law_id", F.col("m.dependency_type").alias("dependency_type"))


def reform_impact(dependencies: DataFrame, top: int = 100) -> DataFrame:
    """Laws by inbound dependencies: outbound, spillover (twice inbound plus outbound), distinct citing articles, and the mix of classes."""
    into = dependencies.groupBy(F.col("target_law_id").alias("law_id"))
    base = into.agg(F.count("*").alias("inbound"), F.countDistinct("source_article").alias("touchpoints"))
    mixed = dependencies.groupBy(F.col("target_law_id").alias("law_id"), "dependency_type").agg(F.count("*").alias("n")).groupBy("law_id").agg(map_text(F.col("dependency_type"), F.col("n")).alias("type_mix"))
    out = dependencies.groupBy(F.col("source_law").alias("law_id")).agg(F.count("*").alias("outbound"))
    rows = base.join(mixed, "law_id").join(out, "law_id", "left").fillna(0, ["outbound"])
    return rows.withColumn("spillover", 2 * F.col("inbound") + F.col("outbound")).orderBy(F.desc("inbound"), "law_id").limit(top)


def definition_trace(dependencies: DataFrame) -> DataFrame:
    """Targets of definitional dependencies: their number, the number of laws that depend on them, and the first of these; dependent_provisions has them all."""
    rows = dependencies.where("dependency_type = 'definitional'").groupBy("target_law_id", "source_law").agg(F.count("*").alias("n"))
    return rows.groupBy("target_law_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_laws"), F.min("source_law").alias("first_law"))


def dependent_provisions(dependencies: DataFrame) -> DataFrame:
    """Every definitional dependency as a row: the target, and the provision that depends on it."""
    columns = ("target_law_id", "citation_id", "source_law", "source_article", "target_article", "dependency_subtype", "confidence")
    return dependencies.where("dependency_type = 'definitional'").select(*columns)


def harmonization(dependencies: DataFrame, top: int = 100, considered: int = 250) -> DataFrame:
    """Unordered pairs of laws with at least two dependencies: count, number of classes, priority, and counts by class."""
    a, b = F.least("source_law", "target_law_id").alias("a"), F.greatest("source_law", "target_law_id").alias("b")
    by = dependencies.where("source_law <> target_law_id").groupBy(a, b, "dependency_type").agg(F.count("*").alias("n"))
    rows = by.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("n_types"), map_text(F.col("dependency_type"), F.col("n")).alias("by_type")).where("n >= 2")
    order = [F.desc("n"), F.col("a"), F.col("b")]
    first = rows.orderBy(*order).limit(considered).orderBy(*order).limit(top)
    return first.withColumn("priority", F.round(F.col("n") + 1.5 * F.col("n_types"), 2))


def weak_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependencies of low confidence or without a class."""
    return dependencies.where((F.col("confidence") == "low") | (F.col("dependency_type") == GENERIC))


def fragility(citations: DataFrame, dependencies: DataFrame, top: int = 150) -> DataFrame:
    """(kind, name, n): the raw names (trimmed) of unresolved citations, most frequent first, then the numbers of unresolved citations and of weak dependencies."""
    unresolved = citations.where("coalesce(target_law_id, 'unresolved') = 'unresolved'")
    names = unresolved.where("coalesce(target_law_raw, '') <> ''").groupBy(F.trim("target_law_raw").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), "n")
    return names.select(F.lit("raw_name").alias("kind"), "name", "n").unionByName(count(unresolved, "unresolved")).unionByName(count(weak_dependencies(dependencies), "low_confidence"))


def invalid_dependencies(dependencies: DataFrame) -> DataFrame:
    """Rows without one of the fields that every dependency must have, by field."""
    needed = ["source_law", "target_law_id", "dependency_type", "dependency_subtype", "dependency_strength", "confidence", "explanation"]
    lacking = F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in needed])
    return dependencies.select(F.explode(F.array_compact(lacking)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def field_checks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, n_lacking): of all rows, how many have nothing in each field."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("v")) for f in fields])
    return rows.select(F.explode(each).alias("r")).groupBy("r.field").agg(F.count("*").alias("n"), F.count_if(F.col("r.v") == "").alias("n_lacking"))


def article_stats_top(edges: DataFrame, top: int = 100, citing: int = 8) -> DataFrame:
    """Specific articles (not the unknown one) by citations, with the laws that cite each most."""
    into = edges.where(~F.col("dst").endswith("::?")).groupBy("dst", F.split("src", "::")[0].alias("law")).agg(F.sum("weight").alias("n"))
    total = into.groupBy("dst").agg(F.sum("n").alias("cited")).orderBy(F.desc("cited"), "dst").limit(top)
    ranked = into.join(F.broadcast(total), "dst").withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("n"), "law"))).where(F.col("r") <= citing)
    rows = ranked.groupBy("dst", "cited").agg(F.array_sort(F.collect_list(F.struct("r", "law", "n"))).alias("l"))
    return rows.select("dst", "cited", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["law"], x["n"].cast("string"))), ",").alias("citing"))


def article_drilldown(edges: DataFrame, laws: int = 60, articles: int = 80) -> DataFrame:
    """For the most cited laws their most cited articles: the unknown article last, then by number, then by name."""
    into = edges.select(F.split("dst", "::")[0].alias("law"), F.split("dst", "::")[1].alias("article"), "weight").groupBy("law", "article").agg(F.sum("weight").alias("cited"))
    first = into.groupBy("law").agg(F.sum("cited").alias("total")).orderBy(F.desc("total"), "law").limit(laws)
    ranked = into.join(F.broadcast(first), "law").withColumn("rank", F.row_number().over(Window.partitionBy("law").orderBy(F.desc("cited"), "article")))
    kept = ranked.where(F.col("rank") <= articles)
    order = [F.col("article") == "?", F.coalesce(F.expr("try_cast(article as int)"), F.lit(0)), F.col("article")]
    return kept.select("law", "article", "cited", F.row_number().over(Window.partitionBy("law").orderBy(*order)).alias("pos"))


def article_activity(edges: DataFrame, laws: int = 60, articles: int = 80, partners: int = 10) -> DataFrame:
    """For the laws with most citations in and out, their articles with most of both: in and out counts, and the laws each cites and is cited by most.

    Articles of equal counts: the unknown one last, then by number, then by name.
    """
    law, article = (lambda c: F.split(c, "::")[0]), (lambda c: F.split(c, "::")[1])
    side = lambda own, other, name: F.struct(law(own).alias("law"), article(own).alias("article"), F.lit(name).alias("side"), law(other).alias("partner"))
    rows = edges.select(F.explode(F.array(side("src", "dst", "out"), side("dst", "src", "in"))).alias("e"), "weight").groupBy("e").agg(F.sum("weight").alias("n")).select("e.*", "n")
    first = rows.groupBy("law").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "law").limit(laws).select("law")
    own = rows.join(F.broadcast(first), "law")
    count = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("n"))), F.lit(0))
    number = F.when(F.col("article").rlike("^[0-9]{1,9}$"), F.expr("try_cast(article as int)")).otherwise(0)
    order = [F.desc(F.col("in_degree") + F.col("out_degree")), F.col("article") == "?", number, F.col("article")]
    ranked = own.groupBy("law", "article").agg(count("in").alias("in_degree"), count("out").alias("out_degree")).withColumn("pos", F.row_number().over(Window.partitionBy("law").orderBy(*order)))
    r = F.row_number().over(Window.partitionBy("law", "article", "side").orderBy(F.desc("n"), "partner"))
    top = own.withColumn("r", r).where(F.col("r") <= partners)
    named = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("r", "partner", "n")))), lambda x: F.concat_ws("=", x["partner"], x["n"].cast("string"))), ",")
    lists = top.groupBy("law", "article").agg(named("out").alias("cites"), named("in").alias("cited_by"))
    return ranked.where(F.col("pos") <= articles).join(lists, ["law", "article"]).select("law", "article", "in_degree", "out_degree", "pos", "cites", "cited_by")


def complexity(article_rows: DataFrame, top: int = 15) -> DataFrame:
    """Laws by the degrees of all their articles."""
    law = F.split("node_id", "::")[0].alias("law_id")
    return article_rows.groupBy(law).agg(F.sum(F.col("in_degree") + F.col("out_degree")).alias("complexity")).orderBy(F.desc("complexity"), "law_id").limit(top)


def orphan_edges(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges to laws that were withdrawn, or that the registry doesn't name."""
    known = registry.select(F.col("law_id").alias("dst"), "name", "withdrawn_at")
    rows = edges.join(known, "dst", "left").where("withdrawn_at is not null or name is null")
    return rows.select("src", "dst", "citation_count", F.when(F.col("name").isNull(), "unknown").otherwise("withdrawn").alias("kind"))


def bipartite_edges(pairs: DataFrame) -> DataFrame:
    """Weighted edges of (src, dst) occurrences between two kinds of nodes."""
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def bipartite_summary(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group of targets: edges (not occurrences), distinct sources and targets."""
    return edges.join(groups, "dst").groupBy("group").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))


def law_vertices(laws: DataFrame, registry: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, name, short, sector, stub) of the laws (id, name, short_name, sector) of the corpus, of registry laws outside it, and of ids that are cited without being either.

    The latter two are stubs. Without a short name the first 20 characters of the id stand for it.
    """
    row = lambda df, key, name, short, sector, stub: df.select(
        F.col(key).alias("id"), name.alias("name"), F.coalesce(short, F.substring(F.col(key), 1, 20)).alias("short"), F.coalesce(F.nullif(sector, F.lit("")), F.lit("unknown")).alias("sector"), F.lit(stub).alias("stub")
    )
    none = F.lit(None).cast("string")
    own = row(laws, "id", F.col("name"), F.col("short_name"), F.col("sector"), False)
    listed = row(registry.join(laws.select(F.col("id").alias("law_id")), "law_id", "left_anti"), "law_id", F.col("name"), F.col("short"), F.col("sector"), True)
    known = own.unionByName(listed)
    return known.unionByName(row(cited.join(known.select("id"), "id", "left_anti"), "id", none, none, none, True))


def typed(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges with the dependency class that `kinds` (src, dst, dependency_type) has for them, else the generic one."""
    return edges.join(kinds, ["src", "dst"], "left").fillna(GENERIC, ["dependency_type"])


def article_types(dependencies: DataFrame) -> DataFrame:
    """(src, dst, dependency_type, type_mix) by articles: the class of the last citation by id, and the counts of all classes."""
    node = lambda law, article: F.concat_ws("::", law, F.coalesce(F.nullif(F.trim(article), F.lit("")), F.lit("?")))
    rows = dependencies.select(node("source_law", "source_article").alias("src"), node("target_law_id", "target_article").alias("dst"), "dependency_type", "citation_id")
    counts = rows.groupBy("src", "dst", "dependency_type").agg(F.count("*").alias("n"), F.max("citation_id").alias("last"))
    return counts.groupBy("src", "dst").agg(F.max_by("dependency_type", "last").alias("dependency_type"), map_text(F.col("dependency_type"), F.col("n")).alias("type_mix"))


def article_tab(edges: DataFrame, registry: DataFrame, top: int = 100) -> DataFrame:
    """The most cited specific articles with the names of their laws, and their citations as a percentage of the most cited one's."""
    into = edges.where(~F.col("dst").endswith("::?")).groupBy(F.col("dst").alias("node_id")).agg(F.sum("weight").alias("cited")).orderBy(F.desc("cited"), "node_id").limit(top)
    most = F.max("cited").over(Window.partitionBy(F.lit(0)))  # over `top` rows
    rows = into.select("node_id", F.split("node_id", "::")[0].alias("law_id"), "cited", F.bround(100.0 * F.col("cited") / most, 0).cast("long").alias("percent_of_most"))
    names = registry.select("law_id", F.col("name").alias("law_name"), F.col("short").alias("law_short"), "sector")
    joined = rows.join(names, "law_id", "left")
    return joined.select(
        "node_id", "law_id", F.coalesce("law_name", "law_id").alias("law_name"), F.coalesce("law_short", F.substring("law_id", 1, 12)).alias("law_short"), F.coalesce("sector", F.lit("unknown")).alias("sector"), "cited", "percent_of_most",
    )


def article_totals(edges: DataFrame) -> DataFrame:
    """One row: articles, citations, and the laws that are cited and that cite."""
    law = lambda c: F.split(c, "::")[0]
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("article_nodes"))
    sums = edges.agg(F.sum("weight").alias("citations"), F.countDistinct(law("dst")).alias("cited_laws"), F.countDistinct(law("src")).alias("citing_laws"))
    return nodes.crossJoin(sums)  # a row each


def workflow_summary(dependencies: DataFrame, citations: DataFrame) -> DataFrame:
    """(kind, name, n): the law whose reform spills over most, the law whose definitions most depend on, and the number of unresolved citations."""
    impact = reform_impact(dependencies, 1).select(F.lit("reform_impact").alias("kind"), F.col("law_id").alias("name"), F.col("spillover").alias("n"))
    defined = definition_trace(dependencies).orderBy(F.desc("n"), "target_law_id").limit(1).select(F.lit("definitions").alias("kind"), F.col("target_law_id").alias("name"), "n")
    open_ = citations.agg(F.count_if(F.col("target_law_id") == "unresolved").alias("n")).select(F.lit("unresolved").alias("kind"), F.lit(None).cast("string").alias("name"), "n")
    return impact.unionByName(defined).unionByName(open_)


def norm_summary(citations: DataFrame, norms: DataFrame, top: int = 20) -> DataFrame:
    """(kind, name, n): explicit, resolved and unresolved citations of norms, the norms cited by most laws, the laws that cite most norms, and edges by ministry."""
    explicit = citations.where("pattern_name = 'explicit_nom_code'")
    resolved = explicit.where("target_nom_id <> 'unresolved'")
    edges = resolved.select("source_law", "target_nom_id").distinct()
    row = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), "n")
    totals = explicit.agg(F.count("*").alias("explicit"), F.count_if(F.col("target_nom_id") != "unresolved").alias("resolved"), F.count_if(F.col("target_nom_id") == "unresolved").alias("unresolved"))
    totals = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("name"), F.col(k).alias("n")) for k in ("explicit", "resolved", "unresolved")])).alias("r")).select("r.*")
    first = lambda by: edges.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(top)
    ministry = edges.join(norms.select(F.col("id").alias("target_nom_id"), "ministry"), "target_nom_id", "left").groupBy(F.coalesce("ministry", F.lit("unknown")).alias("m")).agg(F.count("*").alias("n"))
    parts = (row(first("target_nom_id"), "norm", F.col("target_nom_id")), row(first("source_law"), "law", F.col("source_law")), row(ministry, "ministry", F.col("m")))
    return totals.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def search(nodes: DataFrame, query: str, fields: list[str], most: int = 8) -> DataFrame:
    """The first nodes by id that hold the query in one of the fields, without regard to case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.col(f)).contains(query.lower())
    return nodes.where(hit).orderBy("id").limit(most)


def participation(pairs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per law the mutual pairs and the definition conflicts it takes part in; conflicts count with multiplicity."""
    cycles = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("cycles"))
    return cycles.join(conflicts.groupBy("id").agg(F.count("*").alias("conflicts")), "id", "full").fillna(0)


def removal_safety(nodes: DataFrame, all_laws: int = 316) -> DataFrame:
    """Nodes (id, in_degree, out_degree, cascade, cycles) with their score of 0 to 100 and what speaks for it: few citations, a small cascade, few cycles. `all_laws` scales the first two."""
    most = F.broadcast(nodes.agg(F.greatest(F.max("cycles"), F.lit(1)).alias("most")))  # one row
    score = (1 - F.col("in_degree") / all_laws) * 50 + (1 - F.col("cascade") / (all_laws + 1)) * 35 + (1 - F.col("cycles") / F.col("most")) * 15
    reasons = _reasons(
        F.when(F.col("in_degree") == 0, "nobody cites it").when(F.col("in_degree") <= 3, F.concat(F.lit("cited by only "), F.col("in_degree").cast("string"))),
        F.when(F.col("cascade") <= 5, "small cascade"), F.when(F.col("cycles") == 0, "in no cycle"), F.when(F.col("out_degree") <= 5, F.concat(F.lit("cites only "), F.col("out_degree").cast("string"))),
    )
    return nodes.crossJoin(most).select("id", F.bround(score, 1).alias("safety"), F.coalesce(F.nullif(reasons, F.lit("")), F.lit("little activity")).alias("rationale"))


def _reasons(*parts: Column) -> Column:
    """The parts that hold, as one text."""
    return F.concat_ws("; ", *parts)


def merger_candidates(pairs: DataFrame, nodes: DataFrame, top: int = 40) -> DataFrame:
    """Mutual pairs by how well they would merge: same sector, small outputs, small inputs, both in cycles."""
    side = lambda p: nodes.select(F.col("id").alias(p), F.col("in_degree").alias(f"in_{p}"), F.col("out_degree").alias(f"out_{p}"), F.col("sector").alias(f"sector_{p}"), F.col("cycles").alias(f"cycles_{p}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.col("sector_a") == F.col("sector_b")
    score = (
        F.when(same, 30.0).otherwise(0.0)
        + F.least(F.lit(40.0), 800.0 / F.greatest(F.col("out_a") + F.col("out_b"), F.lit(1)))
        + F.greatest(F.lit(0), 20 - F.expr("(in_a + in_b) div 4"))
        + F.when((F.col("cycles_a") > 0) & (F.col("cycles_b") > 0), 10.0).otherwise(0.0)
    )
    reasons = _reasons(F.lit("cite each other"), F.when(same, "one sector"), F.when(F.col("in_a") + F.col("in_b") < 20, "seldom cited"))
    return rows.select("a", "b", F.bround(score, 1).alias("score"), reasons.alias("rationale")).orderBy(F.desc("score"), "a", "b").limit(top)


def reform_priority(nodes: DataFrame, top: int = 40, least: int = 10) -> DataFrame:
    """Nodes (id, in_degree, cascade, cycles, conflicts) by the problems they take part in and what hangs on them."""
    score = 15 * F.col("cycles") + 20 * F.col("conflicts") + F.least(F.lit(30), F.expr("(in_degree + cascade div 10) div 5"))
    reasons = _reasons(
        F.when(F.col("cycles") > 0, F.concat(F.col("cycles").cast("string"), F.lit(" cycles"))),
        F.when(F.col("conflicts") > 0, F.concat(F.col("conflicts").cast("string"), F.lit(" conflicts"))),
        F.when(F.col("in_degree") > 0, F.concat(F.lit("cited by "), F.col("in_degree").cast("string"))),
    )
    return nodes.select("id", score.cast("long").alias("score"), reasons.alias("rationale")).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(top)


def simplification_summary(nodes: DataFrame, pairs: DataFrame, safe: int = 80) -> DataFrame:
    """One row: nodes, those safe to remove and their percentage, isolated ones, candidates to merge and to reform, and nodes in cycles."""
    rows = nodes.join(removal_safety(nodes).select("id", "safety"), "id")
    removable = F.count_if(F.col("safety") >= safe)
    counts = rows.agg(
        F.count("*").alias("total"), removable.alias("removable"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") <= 2)).alias("isolated"), F.count_if(F.col("cycles") > 0).alias("in_cycles"),
        F.bround(100.0 * removable / F.count("*"), 0).alias("removable_percent"),
    )
    mergers = merger_candidates(pairs, nodes).agg(F.count("*").alias("mergers"))
    reforms = reform_priority(nodes).agg(F.count("*").alias("reforms"))
    return counts.crossJoin(mergers).crossJoin(reforms)  # a row each
