"""Evaluation texts inside training text: size-partitioned MinHash containment, verified by exact shingle containment.

A passage is `window` consecutive words of an item, or the whole item where it
is shorter; items are partitioned by the size of their passages. The smallest
hash of the word shingles of a passage is the same wherever the passage
stands, so a document that contains a passage has that minimum at the same
place: MinHash over sliding windows misses no passage. Documents yield one
fingerprint for each change of the sliding minimum; those that an item of the
same size class shares are candidates, and every candidate is verified word by
word on its shingles.

Words are runs of letters or digits; case, accents, spacing and punctuation
don't count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a passage, and of a shingle.
WINDOW, SHINGLE = 20, 5
#: Words of all items that may travel to every executor: 8 bytes each and as much for fingerprints.
MOST_BROADCAST_WORDS = 2_000_000
#: Blocks of that size that travel at once: some 60 MB each.
BLOCKS_PER_PASS = 4
#: Characters of documents that are worked on at once.
BLOCK_CHARACTERS = 1_500_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SKIP = 0xFFFFFFFF


def _fold_table(points: int = 0x30000) -> np.ndarray:
    """Per code point: the folded letter or digit, 0 for what separates words, and a skip sign for marks and invisible characters."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(points):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind[0] == "M" or kind == "Cf":
            table[point] = _SKIP
        elif c.isalnum():
            plain = [x for x in unicodedata.normalize("NFKD", c).casefold() if not unicodedata.combining(x)]
            table[point] = ord(plain[0]) if plain else 0
    return table


_table: list[np.ndarray] = []
#: Characters that fold to several letters are spelled out first; they are rare.
_LONG = {c: "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if not unicodedata.combining(x)) for c in "ßæœ\uFB00\uFB01\uFB02\uFB03\uFB04\uFB05\uFB06ĲĳǄǅǆǇǈǉǊǋǌŉẞÆŒ"}
_LONG = {c: {"æ": "ae", "œ": "oe"}.get(s, s) for c, s in _LONG.items()}
_SPELL = str.maketrans({c: s for c, s in _LONG.items() if len(s) > 1})


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text."""
    if not _table:
        _table.append(_fold_table())
    joined = "\n".join(texts)
    if any(c in joined for c in _LONG):
        texts = [t.translate(_SPELL) for t in texts]
        joined = "\n".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    folded = _table[0][np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    ends = np.cumsum(lengths + 1) - 1  # where the separator after each text stands
    kept = folded != _SKIP
    if not kept.all():
        ends = np.concatenate([np.cumsum(kept), [kept.sum()]])[np.minimum(ends, len(folded))] - np.where(ends < len(folded), 1, 0)
        folded = folded[kept]
    inside = folded != 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, stops = edges[0::2], edges[1::2]
    # polynomial hash of each word from one running sum over all characters
    powers = np.empty(len(folded) + 1, np.uint64)
    powers[0] = 1
    if len(folded):
        powers[1:] = np.cumprod(np.full(len(folded), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    inverse = np.ones(len(folded) + 1, np.uint64)
    if len(folded):
        inverse[1:] = np.cumprod(np.full(len(folded), _INVERSE, np.uint64))
    words = (sums[stops] - sums[starts]) * inverse[starts]
    words = (words ^ (words >> np.uint64(29))) * _MIX
    words ^= words >> np.uint64(32)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    return words, counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words, well mixed so that their order is as good as random."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        out = out * _BASE + words[i : len(words) - size + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(30))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Passages:
    """All passages of one size class: the distinct MinHashes; hash over all words, item and place of each passage, sorted by that hash."""

    words: int
    shingle: int
    minima: np.ndarray
    whole: np.ndarray
    items: np.ndarray
    places: np.ndarray


@dataclass
class ItemIndex:
    """The items' words, and their passages by size class."""

    ids: list[int]
    words: list[np.ndarray]
    classes: list[Passages] = field(default_factory=list)


def fingerprints(words: np.ndarray, size: int, shingle: int) -> np.ndarray:
    """MinHash of each `size`-word window over its shingles; empty where there are fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    return sliding_min(shingle_hashes(words, shingle), size - shingle + 1)


def passage_hashes(words: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hashes over the `size` words from each place on."""
    out = np.zeros(len(places), np.uint64)
    for i in range(size):
        out = (out ^ words[places + i]) * _BASE
        out ^= out >> np.uint64(32)
    return out


def build_index(ids: list[int], texts: list[str], window: int = WINDOW, shingle: int = SHINGLE) -> ItemIndex:
    """Index of items; an item without any word is in no class."""
    hashes, counts = word_hashes(texts)
    words = np.split(hashes, np.cumsum(counts)[:-1]) if len(texts) else []
    index = ItemIndex(list(ids), list(words))
    sizes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w):
            sizes.setdefault(min(len(w), window), []).append(i)
    for size, members in sorted(sizes.items()):
        k = min(shingle, size)
        prints = [fingerprints(words[i], size, k) for i in members]
        whole = np.concatenate([passage_hashes(words[i], np.arange(len(p)), size) for i, p in zip(members, prints, strict=True)])
        items = np.repeat(members, [len(p) for p in prints])
        places = np.concatenate([np.arange(len(p)) for p in prints])
        order = np.argsort(whole, kind="stable")
        index.classes.append(Passages(size, k, np.unique(np.concatenate(prints)), whole[order], items[order], places[order]))
    return index


def find_items(index: ItemIndex, words: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) by place for documents whose words lie between consecutive `bounds` of `words`."""
    found: set[tuple[int, int]] = set()
    shingles: dict[int, np.ndarray] = {}
    for part in index.classes:
        if part.shingle not in shingles:
            shingles[part.shingle] = shingle_hashes(words, part.shingle)
        width = part.words - part.shingle + 1
        if len(shingles[part.shingle]) < width:
            continue
        minima = sliding_min(shingles[part.shingle], width)
        # the minimum stays the same over several windows: only its changes are looked up
        changes = np.flatnonzero(np.concatenate([[True], minima[1:] != minima[:-1]]))
        at = np.searchsorted(part.minima, minima[changes])
        hit = part.minima[np.minimum(at, len(part.minima) - 1)] == minima[changes]
        lengths = np.diff(np.concatenate([changes, [len(minima)]]))[hit]
        if not len(lengths):
            continue
        # every window under a shared minimum is a candidate; windows that run over into the next document aren't
        places = np.repeat(changes[hit] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        docs = np.searchsorted(bounds, places, "right") - 1
        inside = places + part.words <= bounds[docs + 1]
        places, docs = places[inside], docs[inside]
        # verified on all shingles at once by the hash over the whole passage, then word by word
        whole = passage_hashes(words, places, part.words)
        first, last = np.searchsorted(part.whole, whole, "left"), np.searchsorted(part.whole, whole, "right")
        for k in np.flatnonzero(last > first):
            for j in range(first[k], last[k]):
                pair = int(docs[k]), int(part.items[j])
                p = part.places[j]
                if pair not in found and np.array_equal(words[places[k] : places[k] + part.words], index.words[pair[1]][p : p + part.words]):
                    found.add(pair)
    return found


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """(doc, item) for each document that contains `window` consecutive words of an item, or all of a shorter item.

    Null and empty texts contain nothing and are contained in nothing. Each
    pair comes once for each document row; other columns don't come back. The
    items must be within MOST_BROADCAST_WORDS words; that is checked before
    anything is sent, and beyond it the items are worked through in blocks of
    that size, BLOCKS_PER_PASS of them in each pass over the documents, whose words are hashed once for all of these.
    """
    held = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    size = F.length("t") / 2 + 1  # no text has more words than that
    total = held.agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0]
    blocks = int(total // MOST_BROADCAST_WORDS) + 1
    source = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    schema = T.StructType([T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("item", items.schema[item_id].dataType)])
    context, sent, parts = docs.sparkSession.sparkContext, [], []
    for block in range(blocks):
        own = held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block) if blocks > 1 else held
        rows = own.toArrow()  # within the bound just checked
        sent.append(context.broadcast(build_index(rows.column("i").to_pylist(), rows.column("t").to_pylist(), window, shingle)))
        if len(sent) == BLOCKS_PER_PASS or block == blocks - 1:
            parts.append(_probe(source, sent, schema))
            sent = []
    return reduce(DataFrame.unionByName, parts)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARACTERS together: the arrays over a block take some 50 bytes a character."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARACTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _probe(source: DataFrame, sent: list[Broadcast], schema: T.StructType) -> DataFrame:
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else None for f in schema.fields]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _blocks(texts):
                hashes, counts = word_hashes(texts[start:end])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for own in (x.value for x in sent):
                    pairs = sorted(find_items(own, hashes, bounds))
                    if pairs:
                        ids = batch.column(0).take(pa.array([start + d for d, _ in pairs], pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([own.ids[i] for _, i in pairs], kinds[1])], ["doc", "item"])

    return source.mapInArrow(probe, schema)
