"""Scalar text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import patterns as P

# Garbled pairs that the clean-up replaces, in this order (later ones only see what earlier ones left).
GARBLED_PAIRS = [
    ("Ã¡", "á"), ("Ã©", "é"), ("Ã\xad", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("Ã¼", "ü"), ("Ã ", "Á"), ("Ã‰", "É"),
    ("Ã\x8d", "Í"), ("Ã“", "Ó"), ("Ãš", "Ú"), ("Ã‘", "Ñ"), ("Ãœ", "Ü"), ("Â¿", "¿"), ("Â¡", "¡"), ("Â°", "°"), ("Ã\x81", "Á"),
]
ACCENTED, PLAIN = "áàäéèëíìïóòöúùüñ", "aaaeeeiiiooouuun"


def clean_text(column: Column) -> Column:
    """Known garbled pairs replaced, line ends and blanks in one form, control characters gone, trimmed; null stays null."""
    text = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), GARBLED_PAIRS, column)
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.replace(text, F.lit("\f"), F.lit("\n\n"))
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def slugify(column: Column, most: int = 60) -> Column:
    """Lower-case letters, digits and hyphens of a name, accents folded, at most `most` characters, no hyphen at an end."""
    text = F.regexp_replace(F.translate(F.trim(F.lower(column)), ACCENTED, PLAIN), r"[^a-z0-9\s\-]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[\s\-]+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(text, 1, most), "-+$", "")


def code_slug(column: Column) -> Column:
    """A code in lower case with hyphens for blanks."""
    return F.replace(F.lower(column), F.lit(" "), F.lit("-"))


def absolute_url(column: Column, base: str) -> Column:
    """Links of a page made absolute against the folder `base`; null stays null."""
    base = base.rstrip("/")
    root = F.regexp_extract(F.lit(base), r"^(https?://[^/]+)", 1)
    return (
        F.when(column.rlike(r"^https?://"), column)
        .when(column.startswith("//"), F.concat(F.lit("https:"), column))
        .when(column.startswith("/"), F.concat(root, column))
        .otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(column, r"^(?:\./)+", "")))
    )


def clean_law_name(column: Column) -> Column:
    """A captured law name without what follows it; null gives an empty name."""
    name = F.trim(F.coalesce(column, F.lit("")))
    name = reduce(lambda c, p: F.regexp_replace(c, P.FLAGS + p, ""), P.NAME_TAILS, name)
    return F.regexp_replace(name, r"[.,;: \t\n]+$", "")


def strip_trailing_junk(column: Column) -> Column:
    """A raw name without the boilerplate that patterns capture behind it."""
    return F.trim(F.regexp_replace(column, P.FLAGS + P.TRAILING_JUNK, ""))


def first_article(column: Column) -> Column:
    """First article number after the word article, or null."""
    return F.nullif(F.regexp_extract(column, P.FLAGS + P.FIRST_ARTICLE, 1), F.lit(""))


def checksum(column: Column) -> Column:
    """SHA-256 of a string or binary column, with its name in front."""
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def normalised_prefix(column: Column, length: int = 100) -> Column:
    """The first `length` characters, blanks collapsed, trimmed, in lower case (cut first, then normalised)."""
    return F.lower(F.trim(F.regexp_replace(F.substring(column, 1, length), r"\s+", " ")))


def year_enacted(text: Column, published: Column | None = None) -> Column:
    """Year of publication named in the first 3,000 characters, else in the index's date, else the earliest year in the first 2,000."""
    named = _year(F.regexp_extract(F.substring(text, 1, 3000), P.FLAGS + P.PUBLISHED, 1))
    found = F.regexp_extract_all(F.substring(text, 1, 2000), F.lit(P.YEAR), F.lit(1))
    years = F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1917, 2030))
    return F.coalesce(named, *([_index_year(published)] if published is not None else []), F.array_min(years))


def year_reformed(text: Column, reformed: Column | None = None) -> Column:
    """Year of the last reform named in the first 3,000 characters, else in the index's date."""
    named = _year(F.regexp_extract(F.substring(text, 1, 3000), P.FLAGS + P.REFORMED, 1))
    return F.coalesce(named, *([_index_year(reformed)] if reformed is not None else []))


def _year(column: Column) -> Column:
    return F.nullif(F.regexp_extract(column, r"\b(\d{4})\b", 1), F.lit("")).cast("int")


def _index_year(column: Column) -> Column:
    year = _year(column)
    return F.when(year.between(1917, 2030), year)


def corpus_layer(name: Column, short: Column) -> Column:
    """Layer of a text by the words of its name."""
    full = F.concat_ws(" ", F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(short, F.lit(""))))
    has = lambda *tokens: reduce(lambda a, b: a | b, [full.contains(t) for t in tokens])
    return (
        F.when(has("constituci", "reglamento", "código", "ley"), "layer_1_normative_core")
        .when(has("decreto", "transitorio", "acuerdo"), "layer_2_change_layer")
        .otherwise("layer_3_interpretive_prepared")
    )


def classify(text: Column, target: Column, pattern: Column) -> Column:
    """Dependency type, subtype, strength, confidence, method and explanation of a citation: the first rule whose words it holds."""
    parts = [F.coalesce(c, F.lit("")) for c in (text, target, pattern)]
    full = F.regexp_replace(F.trim(F.concat_ws(" ", *parts)), r"(?U)\s+", " ")

    def row(kind: str, subtype: str, strength: str, method: str, explanation: str) -> Column:
        confidence = {"strong": "high", "medium": "medium", "weak": "low"}[strength]
        values = (
            ("dependency_type", kind), ("dependency_subtype", subtype), ("dependency_strength", strength), ("resolution_method", method),
            ("explanation", explanation), ("confidence", confidence),
        )
        return F.struct(*[F.lit(v).alias(k) for k, v in values])

    out = None
    for kind, subtype, strength, words, explanation in P.DEPENDENCY_RULES:
        holds = full.rlike(rf"{P.FLAGS}\b(?:{words})\b")
        value = row(kind, subtype, strength, "heuristic_rule", explanation)
        out = F.when(holds, value) if out is None else out.when(holds, value)
    kind, subtype, strength, explanation = P.FALLBACK_RULE
    return out.otherwise(row(kind, subtype, strength, "fallback", explanation))


def confidence_rank(column: Column) -> Column:
    """3, 2, 1 for high, medium, low; 0 for anything else."""
    return F.when(column == "high", 3).when(column == "medium", 2).when(column == "low", 1).otherwise(0)


def file_format(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    # Signatures in hexadecimal
    signatures = [
        ("D0CF11E0A1B11AE1", "ole2"), ("504B0304", "zip_ooxml"), ("25504446", "pdf"), ("7B5C727466", "rtf"), ("3C21444F43", "html"),
        ("3C68746D6C", "html"), ("3C48544D4C", "html"), ("EFBBBF", "utf8_bom"), ("FFFE", "utf16_le"),
    ]
    out = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
    for signature, name in signatures:
        out = out.when(head.startswith(signature), name)
    return out.otherwise("unknown")
