"""Documents into articles or numbered sections: line by line within each row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import patterns as P

_TRIM = r"(?U)^\s+|\s+$"
_LINE_ENDS = r"(?Udm)^[^\S\n]+|[^\S\n]+$"


def _segments(text: Column, begins: str, heading: str, title) -> Column:
    """Array of (number, title, text): a segment runs from its heading, which it holds, to the next one; lines before the first go.

    `begins` matches where a heading's line begins; splitting there takes one pass over the text.
    """
    pieces = F.filter(F.split(text, f"{P.LINE_FLAGS}(?={begins})", -1), lambda x: x.rlike(f"{P.FLAGS}{begins}"))

    def one(piece: Column) -> Column:
        line = F.regexp_extract(piece, "^[^\n]*", 0)
        number, rest = F.regexp_extract(line, heading, 1), F.regexp_replace(F.regexp_extract(line, heading, 2), _TRIM, "")
        return F.struct(number.alias("number"), title(number, rest).alias("title"), F.regexp_replace(piece, _TRIM, "").alias("text"))

    return F.transform(pieces, one)


def article_segments(text: Column) -> Column:
    """Articles of a text up to the heading of its transitory part; empty without a heading, null for null."""
    trimmed = F.regexp_replace(text, _LINE_ENDS, "")
    kept = F.get(F.split(trimmed, P.LINE_FLAGS + P.TRANSITORY.replace(r"\s*", r"[^\S\n]*").replace(r"\s+", r"[^\S\n]+"), 2), F.lit(0))
    title = lambda n, rest: F.concat(F.lit("Artículo "), n, F.when(rest != "", F.concat(F.lit(" — "), rest)).otherwise(F.lit("")))
    return _segments(kept, r"^(?:Art[ií]culo|Art\.)[^\S\n]+\d", P.FLAGS + P.ARTICLE_HEADING, title)


def section_segments(text: Column) -> Column:
    """Numbered sections of a text; a text without any is one section 0."""
    found = _segments(F.regexp_replace(text, _LINE_ENDS, ""), r"^\d+(?:\.\d+)*[^\S\n]*(?:[.\-]|[^\S\n])", "(?d)" + P.SECTION_HEADING, lambda n, rest: rest)
    whole = F.array(F.struct(F.lit("0").alias("number"), F.lit("").alias("title"), F.regexp_replace(text, _TRIM, "").alias("text")))
    return F.when(text.isNull(), F.lit(None)).when(F.size(found) > 0, found).otherwise(whole)


def segmented(df: DataFrame, key: str, text: str, kind: str = "articles") -> DataFrame:
    """One row per segment: key, `pos` (from 1), `number`, `title`, `segment_text`. Null texts give no row."""
    segments = {"articles": article_segments, "sections": section_segments}[kind](F.col(f"`{text}`"))
    return df.select(F.col(f"`{key}`"), F.posexplode(segments).alias("at", "s")).select(
        key, (F.col("at") + 1).alias("pos"), F.col("s.number").alias("number"), F.col("s.title").alias("title"), F.col("s.text").alias("segment_text")
    )
