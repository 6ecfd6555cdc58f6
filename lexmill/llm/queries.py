"""Queries of the training-data operators over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.containment import contained_items
from lexmill.llm.equivalents import collapse
from lexmill.llm.matching import UNMATCHED, Lexicon, match_names
from lexmill.llm.mixing import counted, mix, plan, shares
from lexmill.llm.mojibake import repaired
from lexmill.llm.splitting import split_oversized
from lexmill.llm.unify import is_mixed, unified
from lexmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Table, key and text field of problem 1, and of problem 6.
GARBLED_FIELDS = (("laws", "id", "full_text"), ("definitions", "definition_id", "definition_text"), ("citations", "citation_id", "citation_text"))
MIXED_FIELDS = (("laws", "id", "full_text"), ("citations", "citation_id", "target_law_raw"))


def _fields(spark: SparkSession, folder: str, fields: tuple[tuple[str, str, str], ...]) -> list[DataFrame]:
    return [
        table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
        for name, key, text in fields
    ]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with wrongly decoded characters."""
    parts = [df.where(repaired(F.col("text")).garbled_places > 0).select("table_name", "record_id") for df in _fields(spark, folder, GARBLED_FIELDS)]
    return reduce(DataFrame.unionByName, parts).distinct()


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled records with their restored text; a record that comes in several texts has a row for each."""
    parts = [
        df.select("table_name", "record_id", repaired(F.col("text")).alias("r"))
        .where(F.col("r.garbled_places") > 0)
        .select("table_name", "record_id", "r.restored", "r.garbled_places", "r.is_restored")
        for df in _fields(spark, folder, GARBLED_FIELDS)
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


# What is known of the names of laws. Words without weight, abbreviations, tails of a name, and words of rank and kind.
_STOP = "a al d de del e el en la las lo los y".split()
_SHORT_FORMS = {
    "l": "ley", "gral": "general", "fed": "federal", "org": "organica", "regl": "reglamento", "rgto": "reglamento", "cod": "codigo",
    "est": "estatuto", "dto": "decreto", "decr": "decreto", "const": "constitucion", "pol": "politica", "nac": "nacional",
}
_TAILS = (
    "segun su ultima reforma", "demas disposiciones aplicables", "adelante ley", "su reglamento", "vigor", "vigente",
    "antes citado", "antes citada", "recien citado", "recien citada", "citado", "citada", "mencionado", "mencionada", "ondaria",
)
_RANKS = "general federal organica marco politica nacional".split()
_KINDS = "ley codigo reglamento estatuto decreto constitucion acuerdo normativa regimen".split()
LAW_NAMES = Lexicon(
    frozenset(_STOP), tuple(_SHORT_FORMS.items()), tuple(tuple(t.split()) for t in _TAILS), (frozenset(_RANKS), frozenset(_RANKS + _KINDS)),
)


def _doubtful(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "citations").where(F.col("resolution_confidence").isin("low", "unresolved"))


def p2_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct raw names of doubtful citations with the law each names, or `unmatched`."""
    others = [F.array("short"), F.col("aliases")]
    return match_names(_doubtful(spark, folder), "target_law_raw", table(spark, folder, "law_registry"), "law_id", "name", others, lexicon=LAW_NAMES)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Doubtful citations with the law each names, or `unmatched`."""
    named = p2_names(spark, folder).where(F.col("matched") != UNMATCHED)
    cited = _doubtful(spark, folder).select("citation_id", "target_law_raw")
    return cited.join(named, "target_law_raw", "left").select("citation_id", F.coalesce("matched", F.lit(UNMATCHED)).alias("law_id")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with characters that should be others, or be absent."""
    fields = zip(MIXED_FIELDS, _fields(spark, folder, MIXED_FIELDS), strict=True)
    parts = [df.where(is_mixed(F.col("text"), prose=name == "laws")).select("table_name", "record_id") for (name, *_), df in fields]
    return reduce(DataFrame.unionByName, parts).distinct()


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of problem 6 as they were meant, in one form."""
    fields = zip(MIXED_FIELDS, _fields(spark, folder, MIXED_FIELDS), strict=True)
    meant = [df.select("table_name", "record_id", repaired(F.col("text"), prose=name == "laws").restored.alias("text")) for (name, *_), df in fields]
    parts = [df.select("table_name", "record_id", unified(F.col("text")).alias("text")) for df in meant]
    return reduce(DataFrame.unionByName, parts)


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return collapse(table(spark, folder, "definitions"), "definition_id", ["term", "definition_text"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are a copy of an earlier one."""
    found = _copies(spark, folder).where(F.col("key") != F.col("keep"))
    return found.select(F.col("keep").alias("keep_id"), F.col("key").alias("dup_id")).distinct()


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Each group of copies once, with its number of copies."""
    return _copies(spark, folder).where(F.col("key") == F.col("keep")).select(F.col("keep").alias("keep_id"), "copies").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items they contain."""
    pairs = contained_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")
    return pairs.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items with the number of documents that contain each."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


MIX_LEVELS = ["source", "lang"]


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The training mixture, one row per use of a document."""
    sizes = counted(table(spark, folder, "documents"), "doc_id", "text", MIX_LEVELS)
    budget = plan(sizes, table(spark, folder, "mix_targets"), MIX_LEVELS, "target_share", "max_repeats")
    return mix(sizes, budget, MIX_LEVELS).withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached by source."""
    return shares(p8_mixture(spark, folder), table(spark, folder, "mix_targets"), "source", "target_share")


#: Levels, exponent and size of the deep mixture: domains of the registry below languages, small branches raised, more than every share could be exact for.
DEEP_LEVELS, SMOOTHING, FILL = ["source", "lang", "domain"], 0.5, 0.8


def _deep(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    domains = table(spark, folder, "law_registry").select("law_id", F.col("sector").alias("domain"))
    sizes = counted(table(spark, folder, "documents").join(domains, "law_id", "left"), "doc_id", "text", DEEP_LEVELS)
    return sizes, plan(sizes, table(spark, folder, "mix_targets"), DEEP_LEVELS, "target_share", "max_repeats", fill=FILL, smoothing=SMOOTHING)


def p8_deep_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture down three levels that is larger than some branches can serve: what they lack goes to siblings, then to those of ancestors."""
    sizes, budget = _deep(spark, folder)
    return mix(sizes, budget, DEEP_LEVELS).withColumnRenamed("key", "doc_id")


def p8_deep_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Budgets of the deep mixture: source, language, domain, tokens held, cap and tokens to give."""
    return _deep(spark, folder)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    pieces = split_oversized(table(spark, folder, "documents"), "doc_id", "text", with_text=False)
    return pieces.where(F.col("n_pieces") > 1).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all documents."""
    return split_oversized(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    own = (p1_found, p1_restored, p2_found, p2_names, p5_found, p5_collapsed, p6_found, p6_unified, p7_found, p7_items, p8_mixture, p8_shares, p8_deep_mixture, p8_deep_budgets, p9_found, p9_pieces)
    return {f.__name__: f for f in own}


def _copies_sql() -> str:
    leaf = lambda c: rf"replace(lower(upper(regexp_replace(nfc_normalize(coalesce({c}, '')), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g'))), 'ς', 'σ')"
    return f"""WITH k AS (SELECT definition_id AS id, list_sort([{leaf("term")}, {leaf("definition_text")}]) AS k FROM definitions),
g AS (SELECT k, min(id) AS keep_id, CAST(count(*) AS BIGINT) AS copies FROM k GROUP BY 1 HAVING count(*) > 1)"""


def _leaks_sql() -> str:
    """Passages of both sides as text, by their number of words: 20, or all of a shorter item."""
    words = r"regexp_extract_all(regexp_replace(strip_accents(lower(nfc_normalize(text))), '[\p{M}\p{Cf}]', '', 'g'), '[\p{L}\p{N}]+')"
    return f"""WITH i AS (SELECT item_id, {words} AS ws FROM eval_items WHERE text IS NOT NULL), iw AS (SELECT *, least(len(ws), 20) AS k FROM i WHERE len(ws) > 0),
ip AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS passage FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM iw)),
firsts AS (SELECT DISTINCT k, split_part(passage, ' ', 1) || ' ' || split_part(passage, ' ', 2) AS w FROM ip),
d AS (SELECT doc_id, {words} AS ws FROM documents WHERE text IS NOT NULL), dp AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
c AS (SELECT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS passage FROM dp JOIN firsts ON w = ws[p] || ' ' || coalesce(ws[p + 1], '') WHERE p + k - 1 <= len(ws)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM c JOIN ip USING (k, passage))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"{_copies_sql()} SELECT DISTINCT keep_id, id AS dup_id FROM k JOIN g USING (k) WHERE id <> keep_id",
        "p5_collapsed": f"{_copies_sql()} SELECT keep_id, copies FROM g",
        "p7_found": f"{_leaks_sql()} SELECT * FROM leaks",
        "p7_items": f"{_leaks_sql()} SELECT item_id, CAST(count(*) AS BIGINT) AS n_documents FROM leaks GROUP BY 1",
        # sizes keep so far from the limit that words and signs are as good a measure as tokens
        "p9_found": r"SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]')) > 2048",
    }
