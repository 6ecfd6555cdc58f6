"""Several values packed in one field: one row per value, with its position and what was wrong in its writing.

The field is read by a parsing expression grammar with ordered alternatives
for bracketed, quoted and bare values. An opening quote or bracket without its
partner doesn't match its alternative; the parser then backtracks, takes the
mark alone and flags the values after it. The time is linear in the text.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.functions.peg import Expression, choice, mapped, nested, token

# Ordinals that name transitory articles, and the nouns for parts of an article.
ORDINALS = "Primero Segundo Tercero Cuarto Quinto Sexto Séptimo Octavo Noveno Décimo Undécimo Duodécimo Único".split()
PARTS = "fracción fracciones apartado apartados párrafo párrafos inciso incisos numeral numerales subinciso subincisos base bases punto puntos".split()
#: Opening quotes or brackets and their partners.
PAIRS = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’", "[": "]", "(": ")", "{": "}"}

_ANY_ORDINAL = "|".join(ORDINALS)
_PART = "|".join(sorted(PARTS, key=len, reverse=True))
_PLACE = rf"(?:{_ANY_ORDINAL}|últim[oa]|final|penúltimo|primer|tercer|segunda|primera|tercera)"
_ORDINAL_NAME = {o.lower(): o for o in ORDINALS}
#: A value of a part: a Roman numeral, a letter with its bracket, a word of order, or digits.
_LETTER = r"[A-Za-z]\)|\b[A-Z]\b"
_ROMAN = r"\b[IVXLC]+\b"
_LINK = r"\s*(?:,\s*(?:[yeo]\s+)?|\s[yeo]\s)\s*"


def _article(m) -> tuple[str, str]:
    number, letter, suffix = m["n"], m["letter"], m["suffix"]
    name = f"{number}-{letter.upper()}" if letter else number
    return f"{name} {suffix.capitalize()}" if suffix else name, ""


def article_grammar() -> Expression:
    """Grammar of a field that names articles: numbers with marks and suffixes, ordinals of transitory articles; parts of articles and prose name none."""
    number = token(
        r"(?<![\p{L}\p{N}])(?P<n>\d+)(?:\s?[º°ª]|(?:o|a)(?:\.|(?![\p{L}\p{N}.])))?(?:-(?P<letter>[A-Za-z])(?!\p{L}))?(?:\s*(?P<suffix>(?i:bis|ter|quáter|quater|quinquies))\b)?",
        _article,
    )
    ordinal = token(
        rf"(?<!\p{{L}})(?:(?P<o>{_ANY_ORDINAL})\b(?:\s+(?i:transitorio)s?\b)?|(?P<p>(?i:{_ANY_ORDINAL}))\s+(?i:transitorio)s?\b)",
        lambda m: (_ORDINAL_NAME[(m["o"] or m["p"]).lower()], ""),
    )
    part_name = rf"(?i:{_PART})\b\.?\s+"
    one = rf"(?:{_ROMAN}|{_LETTER}|(?i:{_PLACE})\b|\d+[º°]?)"
    listed = "|".join(rf"(?:{v})(?:{_LINK}(?:{v})(?![\p{{L}}]))*" for v in (_ROMAN, _LETTER, r"\d+[º°]?"))
    plural = token(rf"(?i:fracciones|apartados|párrafos|incisos|numerales|subincisos|bases|puntos)\b\s+(?:{listed})")
    single = token(rf"{part_name}{one}")
    placed = token(rf"(?i:{_PLACE})\s+(?i:{_PART})\b")
    part = choice(plural, placed, single)
    space = token(r"[\s,;|/+&\-–—:.]+|\b[yeoau]\b|\bal\b")
    word = token(r"[\p{L}\p{M}]+\.?|\p{N}+")
    value = choice(part, number, ordinal, space, word)
    return mapped(nested(value, PAIRS, ("", "unbalanced")), _flagged)


def _flagged(values: list) -> list:
    """Values after an unpartnered mark carry its flag; the marks themselves go."""
    out, flag = [], ""
    for value, sign in values:
        if value:
            out.append((value, flag))
        else:
            flag = sign
    return out


_GRAMMAR = article_grammar()


@lru_cache(maxsize=100_000)
def _cached(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(_GRAMMAR(text, 0)[1])


def articles_of(text: str | None) -> tuple[tuple[str, str], ...]:
    """(article, flag) in written order; none for null, empty or prose."""
    if not text:
        return ()
    return _cached(text) if len(text) < 200 else tuple(_GRAMMAR(text, 0)[1])


_ITEMS = T.ArrayType(T.StructType([T.StructField("article", T.StringType()), T.StructField("flag", T.StringType())]), False)


@arrow_udf(_ITEMS)
def _parse_all(values: pa.Array) -> pa.Array:
    distinct = values.dictionary_encode()
    parsed = [articles_of(t) for t in distinct.dictionary.to_pylist()]
    out = [parsed[i] if i is not None else () for i in distinct.indices.to_pylist()]
    offsets, articles, flags = [0], [], []
    for found in out:
        for article, flag in found:
            articles.append(article)
            flags.append(flag)
        offsets.append(len(articles))
    items = pa.StructArray.from_arrays([pa.array(articles, pa.string()), pa.array(flags, pa.string())], ["article", "flag"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


#: Not to be evaluated again where a filter on its result is moved below it.
_parse_all = _parse_all.asNondeterministic()


def parsed_articles(column: Column) -> Column:
    """Array of (article, flag) that a string column names; empty for null, empty and prose fields."""
    return _parse_all(column)


def split_articles(df: DataFrame, field: str, least: int = 1, position: str = "pos", value: str = "article") -> DataFrame:
    """One row per article that `field` names, for rows that name `least` or more.

    Adds `position` (from 1, in written order; repeats count, empty elements
    don't), `value`, and `<value>_flag` ("unbalanced" after a quote or bracket
    without its partner, else empty). Columns of `df` with these names are
    replaced. Rows with a null, empty or prose field give no row.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (position, value, f"{value}_flag")]
    source = F.col(f"`{field}`")
    # JVM first: only text with a digit or an ordinal can name an article
    rows = df.where(source.rlike(rf"[0-9]|(?iu)({_ANY_ORDINAL})")).select(*kept, parsed_articles(source).alias("__items"))
    rows = rows.where(F.size("__items") >= least)
    exploded = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__items"], F.posexplode("__items").alias("__at", "__item"))
    return exploded.select(
        *[F.col(f"`{c}`") for c in exploded.columns if c not in ("__at", "__item")],
        (F.col("__at") + 1).cast("int").alias(position),
        F.col("__item.article").alias(value),
        F.col("__item.flag").alias(f"{value}_flag"),
    )
