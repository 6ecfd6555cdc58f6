"""Freely entered names mapped to a reference list by a prefix-filter set-similarity join.

Names become sets of letter trigrams, numbered by global rarity, rarest first.
Only the rare prefix of each set is joined; pairs must pass the length and the
positional filter, then Jaccard is computed in full and the best pairs are
kept. An exact check by words follows: each word of the name must be a word of
the entry but for a slip of the pen, with nothing left over on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.llm.containment import _fold_table
from lexmill.llm.mojibake import repair
from lexmill.llm.unify import unify
from lexmill.session import checkpointed, spread

#: Least Jaccard similarity of the trigram sets.
THRESHOLD = 0.4
#: Slips allowed in a whole name, and in a word of so many letters at least.
MOST_SLIPS = 3
SLIPS_BY_LENGTH = ((9, 2), (4, 1))
UNMATCHED = "unmatched"
#: Letters of all entries whose tokens may travel to every executor, 10 bytes each; beyond it the join shuffles.
MOST_BROADCAST_LETTERS = 4_000_000
#: Rows of one token on the names' side that one task joins at most.
ROWS_PER_TOKEN = 100_000


@dataclass(frozen=True)
class Lexicon:
    """What a caller knows of the names: none of it is needed.

    `stop` are words without weight, `short_forms` abbreviations and what they stand for, `tails` words that follow a name without being part of it.
    `droppable` are sets of words without which a name still names its entry where no other entry has the same rest.
    """

    stop: frozenset[str] = frozenset()
    short_forms: tuple[tuple[str, str], ...] = ()
    tails: tuple[tuple[str, ...], ...] = ()
    droppable: tuple[frozenset[str], ...] = ()


PLAIN = Lexicon()


@lru_cache(maxsize=50_000)
def slips(a: str, b: str, most: int) -> int:
    """Edits (one letter more, less or other, two letters swapped) from a to b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(word: str) -> int:
    return next((n for length, n in SLIPS_BY_LENGTH if len(word) >= length), 0)


_WORDS = regex.compile(r"[a-z0-9]+")
_FOLD: list[np.ndarray] = []


def _folded(text: str) -> str:
    if not _FOLD:
        _FOLD.append(_fold_table(0x3000))
    table = _FOLD[0]
    return "".join(chr(f) if (f := int(table[o])) and f < 0x3000 else "" if f else " " for c in text if (o := ord(c)) < 0x3000)


def _is_tail(words: list[str], tail: tuple[str, ...]) -> bool:
    return len(words) > len(tail) and all(slips(w, t, 2) <= min(2, max(allowed(t), 0)) for w, t in zip(words[-len(tail) :], tail, strict=True))


def canonical(name: str | None, lexicon: Lexicon = PLAIN) -> str:
    """Words that carry the name, folded, without tails and words without weight, abbreviations in full; an acronym as one word."""
    if not name:
        return ""
    text = _folded(unify(repair(name, prose=False)[0]))
    words = _WORDS.findall(text)
    if len(words) > 1 and all(len(w) == 1 for w in words):
        return "".join(words)
    short = dict(lexicon.short_forms)
    words = [short.get(w, w) for w in words]
    words = [w for w in words if w not in lexicon.stop] if len(words) > 1 else words
    while tail := next((t for t in lexicon.tails if _is_tail(words, t)), None):
        words = words[: -len(tail)]
    return " ".join(words)


def same_name(name: str, entry: str) -> int:
    """Slips between two canonical names, word by word in any order, or -1 if they differ by more."""
    rest, total, left = entry.split(), 0, []
    for word in name.split():
        if word in rest:
            rest.remove(word)
        else:
            left.append(word)
    if len(left) != len(rest):
        # a blank lost or put in: compare what is left run together
        a, b = "".join(left), "".join(rest)
        n = slips(a, b, 1) if min(len(a), len(b)) >= 6 and abs(len(left) - len(rest)) == 1 else 2
        return n + 1 if n <= 1 else -1
    for word in left:
        most = allowed(word)
        best = min(((slips(word, r, most), r) for r in rest), default=(most + 1, ""))
        if best[0] > min(most, allowed(best[1])):
            return -1
        rest.remove(best[1])
        total += best[0]
    return total if total <= MOST_SLIPS else -1


def _grams(name: str) -> set[str]:
    return {w[i : i + 3] for word in name.split() for w in (f" {word} ",) for i in range(max(1, len(w) - 2))}


def _code(gram: str) -> int:
    """A trigram of folded letters and digits as a number under 38 ** 3; the alphabet bounds the number of tokens."""
    n = 0
    for c in gram:
        n = n * 38 + (0 if c == " " else 1 + (ord(c) - 48 if c <= "9" else ord(c) - 87))
    return n


def canonical_names(column: Column, lexicon: Lexicon = PLAIN) -> Column:
    """`canonical` of a string column; null gives an empty name."""

    @arrow_udf(T.StringType())
    def names(values: pa.Array) -> pa.Array:
        return pa.array([canonical(t, lexicon) for t in values.to_pylist()], pa.string())

    return names.asNondeterministic()(column)


@arrow_udf(T.ArrayType(T.IntegerType()))
def _gram_codes(values: pa.Array) -> pa.Array:
    return pa.array([sorted(map(_code, _grams(t))) for t in values.to_pylist()], pa.list_(pa.int32()))


_gram_codes = _gram_codes.asNondeterministic()


@arrow_udf(T.IntegerType())
def _same(names: pa.Array, entries: pa.Array) -> pa.Array:
    return pa.array([same_name(a, b) for a, b in zip(names.to_pylist(), entries.to_pylist(), strict=True)], pa.int32())


_same = _same.asNondeterministic()


def _prefix_length(n: int | np.ndarray, threshold: float):
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


class Postings:
    """The entries' token sets, and for each token the entries that have it in their rare prefix, with its place."""

    def __init__(self, names: list[str], ranks: list[np.ndarray], tokens: int, threshold: float):
        self.names, self.threshold = names, threshold
        self.sizes = np.array([len(r) for r in ranks], np.int64)
        self.flat = np.concatenate([*ranks, np.empty(0, np.int64)]).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        lengths = _prefix_length(self.sizes, threshold) if len(names) else self.sizes
        entry = np.repeat(np.arange(len(names)), lengths)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        token = self.flat[self.starts[entry] + place]
        order = np.argsort(token, kind="stable")
        self.entry, self.place = entry[order].astype(np.int32), place[order].astype(np.int32)
        self.first = np.searchsorted(token[order], np.arange(tokens + 1))
        self.marks = np.zeros(tokens, bool)

    def similar(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries with a Jaccard of `threshold` or more, and that Jaccard, for a name with the tokens `ranks` (sorted, rarest first)."""
        n, t = len(ranks), self.threshold
        prefix = ranks[: int(_prefix_length(np.int64(n), t))]
        low, high = self.first[prefix], self.first[prefix + 1]
        counts = high - low
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        entry, place, own = self.entry[at], self.place[at], np.repeat(np.arange(len(prefix)), counts)
        sizes = self.sizes[entry]
        need = np.ceil((n + sizes) * (t / (1 + t)) - 1e-9)
        kept = (sizes >= n * t - 1e-9) & (n >= sizes * t - 1e-9) & (np.minimum(n - own, sizes - place) >= need)
        found = np.unique(entry[kept])
        if not len(found):
            return found, np.empty(0)
        self.marks[ranks] = True
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        tokens = self.flat[np.repeat(self.starts[found] - ends + sizes, sizes) + np.arange(ends[-1])]
        shared = np.add.reduceat(self.marks[tokens].astype(np.int64), ends - sizes)
        self.marks[ranks] = False
        jaccard = shared / (n + sizes - shared)
        return found[jaccard >= t - 1e-9], jaccard[jaccard >= t - 1e-9]


def _rank_table(sets: DataFrame, other: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens by rarity over both sides, and how often each token (by number) comes in the first."""
    both = sets.select(F.explode("codes").alias("c"), F.lit(1).alias("own")).unionByName(other.select(F.explode("codes").alias("c"), F.lit(0).alias("own")))
    # at most 38 ** 3 tokens whatever the input
    counts = both.groupBy("c").agg(F.count("*").alias("n"), F.sum("own").alias("own")).toPandas().sort_values(["n", "c"])
    rank = np.zeros(38**3, np.int32)
    rank[counts["c"].to_numpy(np.int64)] = np.arange(len(counts), dtype=np.int32)
    return rank, counts["own"].to_numpy(np.int64)


def _ranked(df: DataFrame, sent) -> DataFrame:
    @arrow_udf(T.ArrayType(T.IntegerType()))
    def ranks(codes: pa.Array) -> pa.Array:
        return pa.array([np.sort(sent.value[np.array(c, np.int64)]) for c in codes.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn("ranks", ranks.asNondeterministic()("codes")).drop("codes")


def _prefixed(df: DataFrame, side: str, threshold: float) -> DataFrame:
    """One row per token of the rare prefix: the name, its set, the token and its place."""
    n = F.size("ranks")
    length = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    return (
        df.withColumn(f"{side}_n", n)
        .select("*", F.posexplode(F.slice("ranks", 1, length)).alias(f"{side}_at", "token"))
        .withColumnRenamed("name", f"{side}_name")
        .withColumnRenamed("ranks", f"{side}_ranks")
    )


def similar_pairs(names: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, most_letters: int = MOST_BROADCAST_LETTERS, per_token: int = ROWS_PER_TOKEN) -> DataFrame:
    """(name, entry, jaccard) of all pairs of canonical names with a trigram Jaccard of `threshold` or more; both sides hold distinct `name`s.

    Entries of proven size travel as postings, and names are probed where they
    are; beyond `most_letters` both sides are joined on the tokens, and a token that comes
    in more than `per_token` names is split.
    """
    left, right = (checkpointed(df.select("name", _gram_codes("name").alias("codes"))) for df in (names, entries.select("name").distinct()))
    rank, counts = _rank_table(left, right)
    context = names.sparkSession.sparkContext
    # no set has more tokens than its name has letters
    if right.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0] <= most_letters:
        held = right.toArrow()
        codes = held.column("codes").to_pylist()
        postings = context.broadcast((rank, Postings(held.column("name").to_pylist(), [np.sort(rank[np.array(c, np.int64)]) for c in codes], len(counts), threshold)))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, own = postings.value
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for name, codes in zip(batch.column("name").to_pylist(), batch.column("codes").to_pylist()):
                    found, jaccard = own.similar(np.sort(table[np.array(codes, np.int64)]))
                    out[0].extend([name] * len(found))
                    out[1].extend(own.names[i] for i in found)
                    out[2].extend(jaccard.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["name", "entry", "jaccard"])

        return left.mapInArrow(probe, "name string, entry string, jaccard double")
    sent = context.broadcast(rank)
    left, right = _prefixed(_ranked(left, sent), "l", threshold), _prefixed(_ranked(right, sent), "r", threshold)
    hot = [(int(i), int(-(-counts[i] // per_token))) for i in np.flatnonzero(counts > per_token)]
    parts = F.broadcast(names.sparkSession.createDataFrame(hot, "token int, parts int"))  # of at most 38 ** 3 tokens
    split = lambda df: df.join(parts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = split(left).withColumn("part", F.pmod(F.xxhash64("l_name"), F.col("parts")).cast("int")).drop("parts")
    right = split(right).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = left.join(right, ["token", "part"])
    need = F.ceil((F.col("l_n") + F.col("r_n")) * (threshold / (1 + threshold)) - 1e-9)
    both = both.where((F.col("r_n") >= F.col("l_n") * threshold - 1e-9) & (F.col("l_n") >= F.col("r_n") * threshold - 1e-9))
    both = both.where(F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) >= need)
    # of all shared prefix tokens only the rarest one yields the pair, so no pair comes twice
    rarer = F.arrays_overlap(F.slice("l_ranks", F.lit(1), F.col("l_at")), F.slice("r_ranks", F.lit(1), F.col("r_at")))
    shared = both.where(~rarer).withColumn("shared", F.size(F.array_intersect("l_ranks", "r_ranks")))
    scored = shared.select(F.col("l_name").alias("name"), F.col("r_name").alias("entry"), (F.col("shared") / (F.col("l_n") + F.col("r_n") - F.col("shared"))).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold - 1e-9)


def entry_names(registry: DataFrame, key: str, name: str, others: list[Column], lexicon: Lexicon = PLAIN) -> DataFrame:
    """(name, id) of all canonical names of the reference list.

    These are names and other names, and each name without the words of each droppable
    set where what is left is no full name and belongs to one entry alone.
    """
    listed = [F.array(F.col(name)), *others]
    flat = registry.select(F.col(key).alias("id"), F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in listed])).alias("raw"))
    full = flat.where(F.col("raw").isNotNull()).select("id", canonical_names(F.col("raw"), lexicon).alias("name")).where(F.col("name") != "").distinct()
    if not lexicon.droppable:
        return full
    full = checkpointed(full)
    rests = [F.array_join(F.filter(F.split("name", " "), _is_none_of(dropped)), " ") for dropped in lexicon.droppable]
    rest = full.select("id", F.explode(F.array(*rests)).alias("name")).where(F.col("name").contains(" ")).distinct()
    alone = rest.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").select("id", "name")
    return full.unionByName(alone.join(full.select("name"), "name", "left_anti"))


def _is_none_of(words: frozenset[str]) -> Callable[[Column], Column]:
    return lambda w: ~w.isin(*sorted(words))


def match_names(raw: DataFrame, field: str, registry: DataFrame, key: str, name: str, others: list[Column], threshold: float = THRESHOLD, lexicon: Lexicon = PLAIN) -> DataFrame:
    """Distinct values of `field` with the `matched` entry of the reference list, or `unmatched`.

    Null and empty values are unmatched. Of several entries the one with the
    fewest slips is taken, then the most similar; two entries that are equal in
    both are ambiguous and so unmatched. An empty list matches nothing.
    """
    values = spread(raw.select(F.col(field).alias("raw")).distinct())
    canon = checkpointed(values.select("raw", canonical_names(F.col("raw"), lexicon).alias("name")))
    entries = checkpointed(entry_names(registry, key, name, others, lexicon))
    names = spread(canon.select("name").where(F.col("name") != "").distinct())
    pairs = similar_pairs(names, entries, threshold)
    checked = pairs.withColumn("slips", _same("name", "entry")).where(F.col("slips") >= 0)
    by_id = checked.join(entries.select(F.col("name").alias("entry"), "id"), "entry")
    ties = by_id.groupBy("name", "slips", (-F.col("jaccard")).alias("far")).agg(F.min("id").alias("id"), F.max("id").alias("last"))
    best = ties.groupBy("name").agg(F.min(F.struct("slips", "far", "id", "last")).alias("b"))
    found = best.select("name", F.when(F.col("b.id") == F.col("b.last"), F.col("b.id")).otherwise(F.lit(UNMATCHED)).alias("matched"))
    return canon.join(found, "name", "left").select(F.col("raw").alias(field), F.coalesce("matched", F.lit(UNMATCHED)).alias("matched"))
