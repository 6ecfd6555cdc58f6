"""Extraction by patterns: one row per match with its offset, context and captured groups, without leaving the JVM.

Offsets come from the text between the matches: the pieces of a split and the
matches of the same expression alternate, so running sums of their lengths
give where each match starts. Each expression is run once over a text for its
matches, once for the pieces between and once for each group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions.text import clean_law_name, confidence_rank

UNRESOLVED = "unresolved"
#: Characters of context on either side of a citation, and of a norm's code.
CONTEXT, NORM_CONTEXT = 150, 200
LEAST_NAME = 5


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(text: Column, expression: str, groups: int = 1) -> Column:
    """Array of (offset, found, g1..gn) for all matches; offsets count code points from 0. Null text gives null."""
    pattern = F.lit(expression)
    captured = [F.regexp_extract_all(text, pattern, F.lit(i + 1)).alias(f"g{i + 1}") for i in range(groups)]
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, expression, -1).alias("gaps"), *captured)
    kind = ", ".join(["offset: int", "found: string", *(f"g{i + 1}: string" for i in range(groups))])

    def matches(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def step(so_far: Column, i: Column) -> Column:
            here = so_far["at"] + F.length(F.get(x["gaps"], i))
            return F.struct((here + F.length(F.get(x["found"], i))).alias("at"), F.concat(so_far["starts"], F.array(here)).alias("starts"))

        starts = F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), start, step, lambda s: s["starts"])
        one = lambda s: F.transform(x["found"], lambda m, i: F.struct(F.get(s, i).alias("offset"), m.alias("found"), *[F.get(x[f"g{k + 1}"], i).alias(f"g{k + 1}") for k in range(groups)]))
        return _bound(starts, one)

    # most texts have no match of most expressions: they are searched once, and that is all
    return F.when(text.rlike(expression), _bound(parts, matches)).when(text.isNotNull(), F.array().cast(f"array<struct<{kind}>>"))


def _context(text: Column, offset: Column, found: Column, width: int) -> Column:
    start = F.greatest(offset - width, F.lit(0))
    stop = F.least(offset + F.length(found) + width, F.length(text))
    return F.replace(F.substring(text, start + 1, stop - start), F.lit("\n"), F.lit(" "))


def articles_or_text(laws: DataFrame) -> DataFrame:
    """One row per article of each law: `source_law`, `source_article`, `text`; a law without articles gives its whole text as article 0."""
    held = F.size(F.coalesce("articles", F.array())) > 0
    listed = laws.where(held).select(F.col("id").alias("source_law"), F.explode("articles").alias("a"))
    whole = laws.where(~held & F.col("full_text").isNotNull()).select(F.col("id").alias("source_law"), F.lit("0").alias("source_article"), F.col("full_text").alias("text"))
    return listed.select("source_law", F.col("a.number").alias("source_article"), F.col("a.text").alias("text")).unionByName(whole)


def _matches(text: Column, order: int, name: str, group: str, confidence: str, expression: str) -> Column:
    """All matches of one citation pattern, with what is known of the pattern."""
    groups = 0 if name == "constitucion_bare" else 1
    known = {"pattern_order": order, "pattern_name": name, "pattern_group": group, "confidence": confidence}

    def one(m: Column) -> Column:
        own = [m["offset"].alias("char_offset"), m["found"].alias("found"), (m["g1"] if groups else F.lit("")).alias("g1")]
        return F.struct(*[F.lit(v).alias(k) for k, v in known.items()], *own)

    return F.transform(find_all(text, P.FLAGS + expression, groups), one)


def extract_citations(articles: DataFrame, constitution: tuple[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """All citations in `articles` (source_law, source_article, text), with pattern, confidence, context and offset; not deduplicated.

    `constitution` is (id, name) that constitutional citations point at; `names`
    restricts the patterns. Null texts and names under five characters give no row.
    """
    target_id, target_name = constitution or ("constitucion", "Constitución")
    rows = articles.where(F.col("text").rlike(P.FLAGS + P.CITATION_HINT))
    parts = [_matches(F.col("text"), order, *pattern) for order, pattern in enumerate(P.CITATION_PATTERNS) if not names or pattern[0] in names]
    each = rows.select("source_law", "source_article", "text", F.explode(F.concat(*parts)).alias("m")).select("source_law", "source_article", "text", "m.*")
    constitutional = F.col("pattern_group") == "constitutional"
    named = F.nullif(F.regexp_extract("found", P.FLAGS + P.ARTICLE_REFERENCE, 1), F.lit(""))
    out = each.select(
        "source_law",
        "source_article",
        F.when(constitutional, F.lit(target_name)).otherwise(clean_law_name(F.col("g1"))).alias("target_law_raw"),
        F.when(constitutional, F.lit(target_id)).alias("target_law_id"),
        F.when(constitutional, F.trim("g1")).otherwise(F.trim(named)).alias("target_article"),
        _context(F.col("text"), F.col("char_offset"), F.col("found"), CONTEXT).alias("citation_text"),
        "pattern_name",
        "pattern_group",
        "confidence",
        "char_offset",
        "pattern_order",
    )
    return out.where((F.length("target_law_raw") >= LEAST_NAME) & ~false_mention())


def false_mention() -> Column:
    """Whether a direct mention stands where laws are repealed, amended or listed, or names no law in particular."""
    context = reduce(lambda a, b: a | b, [F.col("citation_text").rlike(P.FLAGS + p) for p in (P.DEROGATION, P.AMENDMENT, P.ENUMERATION)])
    return (F.col("pattern_name") == "direct_mention") & (context | F.col("target_law_raw").rlike(P.FLAGS + P.GENERIC_NAME))


def deduplicate_citations(citations: DataFrame, order: list[str]) -> DataFrame:
    """The most confident citation of each (law, article, first 50 characters of the name); the first by `order` of equals."""
    key = ["source_law", "source_article", F.substring(F.lower("target_law_raw"), 1, 50)]
    best = Window.partitionBy(*key).orderBy(confidence_rank(F.col("confidence")).desc(), *order)
    return citations.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def drop_self_references(citations: DataFrame, laws: DataFrame) -> DataFrame:
    """Citations whose raw name isn't the name or short name of their own law (both without regard to case)."""
    own = laws.select(F.col("id").alias("source_law"), F.explode(F.array(F.lower("name"), F.lower("short_name"))).alias("__own")).where("__own is not null").distinct()
    raw = F.lower("target_law_raw")
    return citations.withColumn("__own", raw).join(own, ["source_law", "__own"], "left_anti").select(*citations.columns)


def extract_norm_citations(articles: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Citations of technical norms: explicit codes, looked up with and without their year in `registry` (code, nom_id), and generic mentions."""
    code = find_all(F.col("text"), P.FLAGS + P.NORM_CODE)
    generic = find_all(F.col("text"), P.FLAGS + P.NORM_GENERIC, 0)
    base = articles.where(F.col("text").rlike(P.FLAGS + "NOM-|Normas?\\s|NOM\\s"))
    keep = ["source_law", "source_article", "text"]
    explicit = base.select(*keep, F.explode(code).alias("m")).select(
        *keep, F.upper("m.g1").alias("target_nom_raw"), "m.offset", "m.found", F.lit("explicit_nom_code").alias("pattern_name")
    )
    if registry is None:
        registry = articles.sparkSession.createDataFrame([], "code string, nom_id string")
    names = norm_registry(registry)
    full, short = names.select(F.col("key").alias("target_nom_raw"), F.col("nom_id").alias("__full")), names.select(F.col("key").alias("__short"), F.col("nom_id").alias("__other"))
    explicit = explicit.withColumn("__short", F.regexp_replace("target_nom_raw", r"-[^-]*$", ""))
    explicit = explicit.join(full, "target_nom_raw", "left").join(short, "__short", "left").withColumn("target_nom_id", F.coalesce("__full", "__other"))
    explicit = explicit.select(
        *keep, "target_nom_raw", F.coalesce("target_nom_id", F.lit(UNRESOLVED)).alias("target_nom_id"), "offset", "found", "pattern_name",
        F.when(F.col("target_nom_id").isNotNull(), "high").otherwise("medium").alias("confidence"),
    )
    loose = base.select(*keep, F.explode(generic).alias("m")).select(
        *keep, F.col("m.found").alias("target_nom_raw"), F.lit("generic").alias("target_nom_id"), "m.offset", "m.found",
        F.lit("generic_nom_reference").alias("pattern_name"), F.lit("low").alias("confidence"),
    )
    both = explicit.unionByName(loose)
    return both.select(
        "source_law", "source_article", "target_nom_raw", "target_nom_id", _context(F.col("text"), F.col("offset"), F.col("found"), NORM_CONTEXT).alias("citation_text"),
        "pattern_name", "confidence", F.col("offset").alias("char_offset"),
    )


def norm_registry(norms: DataFrame) -> DataFrame:
    """(key, nom_id) of (code, nom_id): by full code the last id wins, by code without year the first; a full code goes before a short one."""
    full = norms.where("code <> ''").groupBy(F.upper("code").alias("key")).agg(F.max("nom_id").alias("nom_id"))
    parts = F.split(F.upper("code"), "-")
    short = norms.where(F.size(parts) >= 3).groupBy(F.regexp_replace(F.upper("code"), r"-[^-]*$", "").alias("key")).agg(F.min("nom_id").alias("nom_id"))
    return full.unionByName(short.join(full.select("key"), "key", "left_anti"))


def norm_to_norm(norms: DataFrame) -> DataFrame:
    """Distinct (src, dst) of norms (id, code, full_text) that name another norm's code."""
    cited = norms.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("full_text", F.lit(P.FLAGS + P.NORM_CODE), F.lit(1)), F.upper))).alias("key"))
    names = norm_registry(norms.select("code", F.col("id").alias("nom_id")))
    return cited.join(names, "key").select("src", F.col("nom_id").alias("dst")).where("src <> dst").distinct()


#: Characters behind a trigger that belong to its block.
BLOCK = 2000


def extract_definitions(articles: DataFrame, inline: bool = True, understood: bool = False) -> DataFrame:
    """Defined terms in `articles` (source_law, source_article, text): items of definition blocks, and with `inline` the "considered" sentences.

    Blocks of several triggers overlap and give their items each. Sentences of
    the "understood" kind always hold a trigger, so they are only used with
    `understood`, on all articles.
    """
    trigger = "|".join(f"(?:{t})" for t in P.DEFINITION_TRIGGERS)
    held = articles.where(F.col("text").rlike(P.FLAGS + trigger))
    keep = ["source_law", "source_article"]
    starts = [F.transform(find_all(F.col("text"), P.FLAGS + t, 0), lambda m: F.struct(m["offset"].alias("offset"), m["found"].alias("found"))) for t in P.DEFINITION_TRIGGERS]
    blocks = held.select(*keep, "text", F.explode(F.concat(*starts)).alias("b")).select(
        *keep, F.substring(F.col("text"), F.col("b.offset") + 1, F.length("b.found") + BLOCK).alias("block"), F.substring("b.found", 1, 100).alias("raw_snippet")
    )
    items = blocks.select(*keep, "raw_snippet", F.explode(find_all(F.col("block"), P.CASE_FLAGS + P.DEFINITION_ITEM, 2)).alias("m"))
    term, body = F.trim(F.col("m.g1")), F.trim(F.col("m.g2"))
    out = items.select(*keep, F.lower(term).alias("term"), F.substring(body, 1, 500).alias("definition_text"), "raw_snippet", F.lit("definition_block").alias("extraction_method"))
    out = out.where(F.length("term").between(3, 80) & (F.col("definition_text") != ""))
    for use, rows, expression, method in ((inline, held, P.IS_CONSIDERED, "se_considera"), (understood, articles, P.IS_UNDERSTOOD, "se_entiende")):
        if use:
            found = rows.select(*keep, F.explode(find_all(F.col("text"), P.CASE_FLAGS + expression, 2)).alias("m"))
            more = found.select(*keep, F.lower(term).alias("term"), body.alias("definition_text"), F.lit(None).cast("string").alias("raw_snippet"), F.lit(method).alias("extraction_method"))
            out = out.unionByName(more.where((F.length("term") < 80) & (F.col("term") != "") & (F.col("definition_text") != "")))
    return out
