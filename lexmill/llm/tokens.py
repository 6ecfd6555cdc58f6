"""Token counts of a public tokenizer, computed piece by piece.

A byte-level BPE splits text by a fixed pattern and merges within each piece
alone, so the count of a text is the sum over its pieces, and pieces repeat:
their counts are kept and only new ones are encoded.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces kept per process; numbers make the set of all pieces unbounded.
KEPT_PIECES = 300_000


class TokenCounter:
    """Counts tokens of texts and of their pieces."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        with open(os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._split = regex.compile(PATTERN).findall
        self._kept: dict[str, int] = {}

    def _counts(self, pieces: list[str]) -> list[int]:
        kept = self._kept
        try:
            return list(map(kept.__getitem__, pieces))
        except KeyError:
            pass
        if len(kept) > KEPT_PIECES:
            kept.clear()
        for piece in pieces:
            if piece not in kept:
                kept[piece] = len(self._encode(piece))
        return list(map(kept.__getitem__, pieces))

    def count(self, text: str) -> int:
        return sum(self._counts(self._split(text)))

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece starts (one more entry for the end of the text), and the tokens of each piece."""
        pieces = self._split(text)
        starts = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=starts[1:])
        return starts, np.array(self._counts(pieces), np.int64)


@cache
def counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> TokenCounter:
    """One counter per process and vocabulary."""
    return TokenCounter(folder, vocabulary)


def token_counts(column: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a string column; null for null."""

    @arrow_udf(T.LongType())
    def count(values: pa.Array) -> pa.Array:
        own = counter(folder, vocabulary)
        return pa.array([None if t is None else own.count(t) for t in values.to_pylist()], pa.int64())

    return count.asNondeterministic()(column)
