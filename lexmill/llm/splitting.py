"""Oversized texts cut into pieces under a token limit, at the strongest natural boundary, with overlap.

Between any two pieces of the tokenizer's split there is a possible cut with a
strength: article, paragraph, line, sentence, word. A sparse table over the
strengths answers for each permissible window of lengths which cut is the
strongest, ties to the right; the next piece starts back by the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.llm.tokens import TOKENIZERS, VOCABULARY, TokenCounter, counter, token_counts

LIMIT, OVERLAP = 2048, 128
#: A piece is at least this share of the limit, so that a strong boundary right after the start doesn't make crumbs.
LEAST_SHARE = 0.5
BOUNDARIES = ("word", "sentence", "line", "paragraph", "article")
# Headings that begin an article, and ends of sentences.
_MARKS = (
    (1, regex.compile(r"[.!?…;:][»”\"')\]]*(?=\s)")),
    (2, regex.compile(r"\n(?!\n)")),
    (3, regex.compile(r"\n[ \t]*\n+")),
    (4, regex.compile(r"(?:^|\n)(?=[ \t]*(?i:art(?:[ií]culo|\.)\s*\d|transitorios?\b|cap[ií]tulo\s|t[ií]tulo\s))")),
)


class SparseTable:
    """Place of the largest value in any range of up to `widest` values, the rightmost of equals, in constant time."""

    def __init__(self, values: np.ndarray, widest: int | None = None):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32 if len(values) < 2**31 else np.int64)]
        width, most = 1, min(len(values), widest or len(values))
        while width * 2 <= most:
            left, right = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(values[left] > values[right], left, right))
            width *= 2

    def best(self, low: int, high: int) -> int:
        """Place of the largest value in [low, high]."""
        k = (high - low + 1).bit_length() - 1
        left, right = self.levels[k][low], self.levels[k][high - (1 << k) + 1]
        return int(left if self.values[left] > self.values[right] else right)


def _fine(text: str, starts: np.ndarray, counts: np.ndarray, count: TokenCounter, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with more than `most` tokens (a word without end) broken into single characters' runs small enough to place a cut."""
    if not (counts > most).any():
        return starts, counts
    new_starts, new_counts = [], []
    for i, n in enumerate(counts):
        start, end = int(starts[i]), int(starts[i + 1])
        step = end - start if n <= most else max(1, most // 4)  # a character has at most four bytes, and so at most four tokens
        for at in range(start, end, step):
            new_starts.append(at)
            new_counts.append(n if step == end - start else count.count(text[at : min(end, at + step)]))
    return np.array([*new_starts, int(starts[-1])], np.int64), np.array(new_counts, np.int64)


def _strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """Strength of the cut before each piece (and after the last)."""
    out = np.zeros(len(starts), np.int8)
    for strength, mark in _MARKS:
        ends = np.array([m.end() for m in mark.finditer(text)], np.int64)
        if len(ends):
            out[np.searchsorted(starts, ends)] = strength
    return out


def cut(text: str, count: TokenCounter, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, boundary at the end) of the pieces of `text`; one piece where it is within the limit.

    Offsets are in code points. Neighbours overlap by at least `overlap`
    tokens, and by no more than the word at the cut makes it (inside a word of
    more than a sixteenth of the limit, tokens are counted by its small parts); every piece but the last is cut at the strongest boundary between half the limit and the limit.
    """
    if not 0 <= overlap < limit * LEAST_SHARE / 2:
        raise ValueError("the overlap must be under a quarter of the limit")
    starts, counts = count.pieces(text)
    total = int(counts.sum())
    if total <= limit:
        return [(0, len(text), total, "end")]
    starts, counts = _fine(text, starts, counts, count, max(4, limit // 16))
    sums = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=sums[1:])
    table = SparseTable(_strengths(text, starts), limit + 1)  # a window holds no more pieces than tokens, and no level is kept beyond it
    pieces, first, last = [], 0, len(counts)
    while sums[last] - sums[first] > limit:
        room = limit
        while True:
            high = int(np.searchsorted(sums, sums[first] + room, "right")) - 1
            low = max(first + 1, int(np.searchsorted(sums, sums[first] + int(limit * LEAST_SHARE))))
            at = table.best(min(low, high), high)
            tokens = int(sums[at] - sums[first])
            # blanks at an edge may be split otherwise when the piece stands alone
            if tokens > limit - 16:
                tokens = count.count(text[starts[first] : starts[at]])
            if tokens <= limit:
                break
            room -= max(1, tokens - limit)
        pieces.append((int(starts[first]), int(starts[at]), tokens, BOUNDARIES[table.values[at]]))
        first = min(at, max(first + 1, int(np.searchsorted(sums, sums[at] - overlap, "right")) - 1))
    pieces.append((int(starts[first]), len(text), int(sums[last] - sums[first]), "end"))
    return pieces


_PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("boundary", T.StringType()), T.StructField("piece_text", T.StringType())])
_PIECES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("boundary", pa.string()), ("piece_text", pa.string())]))


def split_oversized(
    df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, with_text: bool = True
) -> DataFrame:
    """Pieces of each text: key, `piece` (from 1), `n_pieces`, `start` and `end` (code points), `n_tokens`, `boundary` at its end, and `with_text` `piece_text`.

    A text within the limit is one piece, an empty one too; a null text gives
    no row. A text of no more bytes than the limit can't have more tokens, so
    it isn't cut, and its tokens are only counted where somebody reads `n_tokens`. Rows with a repeated key
    are cut each on its own; other columns don't come back.
    """

    @arrow_udf(T.ArrayType(_PIECE))
    def pieces(values: pa.Array) -> pa.Array:
        count = counter(folder, vocabulary)
        rows = []
        for t in values.to_pylist():
            # each piece is taken out of the text here, in time that goes with its length
            rows.append(None if t is None else [{**dict(zip(_PIECE.names, p)), "piece_text": t[p[0] : p[1]] if with_text else None} for p in cut(t, count, limit, overlap)])
        return pa.array(rows, _PIECES_ARROW)

    body = F.col("text")
    long = F.octet_length(body) > limit
    rows = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    names = ["piece", "n_pieces", "start", "end", "n_tokens", "boundary", *(["piece_text"] if with_text else [])]
    # apart, so that short texts aren't sent to Python as nulls and the Python result isn't evaluated twice
    cuts = rows.where(long).select("key", pieces.asNondeterministic()("text").alias("cuts"))
    cuts = cuts.select("key", F.size("cuts").alias("n_pieces"), F.posexplode("cuts").alias("at", "p")).select("key", (F.col("at") + 1).alias("piece"), "n_pieces", "p.*")
    whole = rows.where(~long).select(
        "key", F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start"), F.length(body).cast("long").alias("end"),
        token_counts(body, folder, vocabulary).alias("n_tokens"), F.lit("end").alias("boundary"), body.alias("piece_text"),
    )
    return cuts.select("key", *names).unionByName(whole.select("key", *names)).select(F.col("key").alias(key), *names)
