"""Raw names resolved to ids: exact, fuzzy and by prefix against the aliases, then against the corpus.

Every step works on distinct names and is joined back, so that a name is
resolved once however often it is cited.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.functions.text import strip_trailing_junk
from lexmill.session import checkpointed, spread

UNRESOLVED = "unresolved"
FUZZY, FUZZY_HIGH, PREFIX_SCORE = 0.75, 0.90, 0.85
PREFIX_LENGTH, LEAST_ALIAS = 15, 10
#: Aliases that may travel to every executor at once for the fuzzy step.
MOST_BROADCAST_ALIASES = 200_000
#: Texts under which each is compared for itself rather than as an array.
FEW = 50


def alias_map(registry: DataFrame, name: str = "name", short: str = "short", aliases: str = "aliases", key: str = "law_id") -> DataFrame:
    """(alias, law_id, ord) of names, short names and aliases in lower case: the last law of an alias keeps it, at the place where it came first.

    Laws are ordered by key, within a law name, short name and aliases in order.
    """
    listed = F.concat(F.array(F.col(name), F.col(short)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    each = registry.select(F.col(key).alias("law_id"), F.posexplode(listed).alias("i", "a")).where("a is not null and a <> ''")
    each = each.select(F.lower(F.trim("a")).alias("alias"), "law_id", F.struct("law_id", "i").alias("place"))
    merged = each.groupBy("alias").agg(F.max_by("law_id", "place").alias("law_id"), F.min("place").alias("place"))
    return merged.select("alias", "law_id", F.concat_ws("/", "place.law_id", F.lpad(F.col("place.i").cast("string"), 6, "0")).alias("ord"))


def cleaned_name(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def resolve_exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, law_id, matched_alias) of names (raw) that are an alias, without regard to case; acronyms are aliases as well."""
    return names.withColumn("alias", cleaned_name(F.col("raw"))).join(aliases.select("alias", "law_id"), "alias").select("raw", "law_id", F.col("alias").alias("matched_alias"))


def _bag(texts: list[str]) -> np.ndarray:
    """Counts of the characters of each text, in 64 classes; characters that share one only raise the bound."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        codes, n = np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, return_counts=True)
        out[i, codes] = n
    return out


def _masks(text: str) -> dict[str, int]:
    """Bit i of a character's mask is set where the text has it at place i."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(name: str, masks: dict[str, int], length: int) -> int:
    """Length of the longest common subsequence with the text of `masks`, by bit-parallel addition."""
    full = (1 << length) - 1
    row = full
    for c in name:
        if m := masks.get(c):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


class Listed:
    """Texts by length, as arrays over which bounds of the matcher ratio are worked out for many of them at once.

    Their characters lie by place: all first ones, all second ones, and so on, so a long text takes only its own room.
    """

    def __init__(self, texts: list[str]):
        self.texts, length = texts, np.array([len(t) for t in texts], np.int64)
        self.order = np.argsort(length, kind="stable")
        self.length = length[self.order]
        kind = np.int16 if self.length.max(initial=0) < 32_768 else np.int32
        self.bags = np.ascontiguousarray(_bag(texts)[self.order].T.astype(kind))
        flat = np.frombuffer("".join(texts[i] for i in self.order).encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(flat, return_inverse=True)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.codes = codes[np.argsort(place, kind="stable")].astype(np.uint16 if len(self.letters) < 65_536 else np.uint32)
        #: How many texts are too short to have the place, and where the place begins in the codes.
        self.short = np.searchsorted(self.length, np.arange(self.length.max(initial=0)), side="right")
        self.begin = np.cumsum(len(texts) - self.short) - (len(texts) - self.short)

    def alike(self, name: str, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places by length of the texts whose characters in common allow a ratio of `least`, and that bound."""
        n = len(name)
        low, high = np.searchsorted(self.length, [least * n / (2 - least) - 1e-6, n * (2 - least) / least + 1e-6]) if least > 0 else (0, len(self.texts))
        common, own = np.zeros(high - low, self.bags.dtype), np.minimum(own, np.iinfo(self.bags.dtype).max).astype(self.bags.dtype)
        for c in np.flatnonzero(own):
            common += np.minimum(self.bags[c, low:high], own[c])
        bound = 2.0 * common / np.maximum(self.length[low:high] + n, 1)
        open_ = np.flatnonzero(bound >= least - 1e-12)
        return low + open_, bound[open_]

    def common_lengths(self, name: str, at: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of the name with the texts at ascending places by length, by bit-parallel addition over all of them."""
        if len(at) < FEW:
            masks = _masks(name)
            return np.array([common_length(self.texts[i], masks, len(name)) for i in self.order[at].tolist()], np.int64)
        words = -(-len(name) // 64)
        masks = np.zeros((words, len(self.letters)), np.uint64)
        codes = np.frombuffer(name.encode("utf-32-le"), np.uint32)
        found = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        for i in np.flatnonzero(self.letters[found] == codes).tolist():
            masks[i // 64, found[i]] |= np.uint64(1 << i % 64)
        rows = np.full((words, len(at)), np.uint64(2**64 - 1))
        for j, first in enumerate(np.searchsorted(at, self.short[: self.length[at[-1]]]).tolist()):
            letter = self.codes[self.begin[j] :].take(at[first:] - self.short[j])
            over = None
            for w in range(words):
                row = rows[w, first:]
                hit = masks[w].take(letter)
                hit &= row
                total = row + hit
                if w + 1 < words or over is not None:
                    carry, over = over, total < hit
                    if carry is not None:
                        total += carry
                        over |= carry & (total == 0)
                row ^= hit
                row |= total
        used = np.array([(1 << min(64, len(name) - 64 * w)) - 1 for w in range(words)], np.uint64)
        return len(name) - np.bitwise_count(rows & used[:, None]).sum(0, dtype=np.int64)

    def best_ratio(self, name: str, own: np.ndarray, least: float) -> tuple[int, float]:
        """Place in the list of the text with the largest matcher ratio of at least `least`, the first of equals; -1 if there is none.

        Two bounds come before the matcher, and neither can be under its ratio: the characters in common, and of the
        texts that these leave open the longest common subsequence. The text with most in common is matched first, so that its ratio closes others.
        """
        at, bound = self.alike(name, own, least)
        best, score = -1, 0.0

        def match(k: int) -> None:
            nonlocal best, score
            i = int(self.order[k])
            ratio = SequenceMatcher(None, name, self.texts[i]).ratio()
            if ratio >= least and (ratio > score or (ratio == score and i < best)):
                best, score = i, ratio

        if len(at):
            top = at[np.argmax(bound)]
            if 2.0 * self.common_lengths(name, at[at == top])[0] >= least * (len(name) + self.length[top]) - 1e-9:
                match(top)
            at = at[(bound >= score - 1e-12) & (at != top)]
        bound = 2.0 * self.common_lengths(name, at) / np.maximum(self.length[at] + len(name), 1)
        for k in np.lexsort((self.order[at], -bound)).tolist():
            if bound[k] < max(least, score) - 1e-12:
                break
            match(at[k])
        return best, score


def resolve_fuzzy(names: DataFrame, aliases: DataFrame, least: float = FUZZY, most_aliases: int = MOST_BROADCAST_ALIASES) -> DataFrame:
    """(raw, law_id, matched_alias, score) of the most similar alias by matcher ratio, for names that reach `least`.

    Aliases travel in blocks of at most `most_aliases`; of the best of each block the best is kept, the first of equals.
    """
    count = aliases.count()
    blocks = max(1, -(-count // most_aliases))
    if blocks > 1:
        part = F.pmod(F.xxhash64("alias"), F.lit(blocks))
        found = [resolve_fuzzy(names, aliases.where(part == i), least, count).join(aliases.select(F.col("alias").alias("matched_alias"), "ord"), "matched_alias") for i in range(blocks)]
        best = reduce(DataFrame.unionByName, found).groupBy("raw").agg(F.min(F.struct((-F.col("score")).alias("far"), "ord", "law_id", "matched_alias")).alias("m"))
        return best.select("raw", "m.law_id", "m.matched_alias", (-F.col("m.far")).alias("score"))
    rows = [(r["alias"], r["law_id"]) for r in aliases.orderBy("ord").collect()]
    sent = names.sparkSession.sparkContext.broadcast((rows, Listed([a for a, _ in rows])))
    kind = T.StructType([T.StructField("law_id", T.StringType()), T.StructField("matched_alias", T.StringType()), T.StructField("score", T.DoubleType())])

    @arrow_udf(kind)
    def match(values: pa.Array) -> pa.Array:
        entries, listed = sent.value
        texts = values.to_pylist()
        found = [listed.best_ratio(t, b, least) for t, b in zip(texts, _bag(texts), strict=True)]
        columns = [[entries[i][1] if i >= 0 else None for i, _ in found], [entries[i][0] if i >= 0 else None for i, _ in found], [s if i >= 0 else None for i, s in found]]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], kind.names)

    held = spread(names.where(cleaned_name(F.col("raw")) != ""))
    return held.select("raw", match.asNondeterministic()(cleaned_name(F.col("raw"))).alias("m")).where("m.law_id is not null").select("raw", "m.*")


def resolve_prefix(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, law_id, matched_alias): the first alias of ten characters or more that shares its first 15 with the name, or is shorter and begins it.

    The two sides of the rule are equi-joins: on the first 15 characters where both have them, else on each shorter length.
    """
    clean = names.select("raw", cleaned_name(F.col("raw")).alias("c")).where("c <> ''")
    listed = aliases.where(F.length("alias") >= LEAST_ALIAS).select("alias", F.struct("ord", "alias", "law_id").alias("f"))
    lengths = F.sequence(F.lit(1), F.lit(PREFIX_LENGTH))
    # only the first alias of a beginning can be the first of all, so each beginning has one row, and a common one multiplies nothing
    first_of = lambda df: df.groupBy("k").agg(F.min("f").alias("f"))
    # name begins with the alias's first 15 characters, which may be fewer
    own = clean.select("raw", F.explode(F.filter(lengths, lambda n: n >= LEAST_ALIAS)).alias("n"), "c").where(F.length("c") >= F.col("n")).select("raw", F.expr("substring(c, 1, n)").alias("k"))
    a = own.join(first_of(listed.select(F.substring("alias", 1, PREFIX_LENGTH).alias("k"), "f")), "k").select("raw", "f")
    # alias begins with the name's first 15 characters, which may be fewer
    begun = listed.select("alias", "f", F.explode(lengths).alias("n")).where(F.length("alias") >= F.col("n")).select(F.expr("substring(alias, 1, n)").alias("k"), "f")
    b = clean.withColumn("k", F.substring("c", 1, PREFIX_LENGTH)).join(first_of(begun), "k").select("raw", "f")
    first = a.unionByName(b).groupBy("raw").agg(F.min("f").alias("f"))
    return first.select("raw", F.col("f.law_id").alias("law_id"), F.col("f.alias").alias("matched_alias"))


def corpus_map(laws: DataFrame) -> DataFrame:
    """(alias, law_id, ord) of names and short names of the corpus itself; the last law of a name keeps it."""
    each = laws.select(F.col("id").alias("law_id"), F.explode(F.array("name", "short_name")).alias("a")).where("a is not null and a <> ''")
    return each.groupBy(F.lower(F.trim("a")).alias("alias")).agg(F.max("law_id").alias("law_id")).withColumn("ord", F.col("alias"))


def resolve_names(names: DataFrame, aliases: DataFrame, corpus: DataFrame | None = None, manual: dict[str, str] | None = None, prefix_first: bool = False) -> DataFrame:
    """(raw, law_id, confidence, score, matched_alias, method) of the distinct names: manual, exact, fuzzy, prefix, then the corpus.

    A corpus match replaces a fuzzy, prefix or missing one if its score is not lower. With `prefix_first` a
    prefix keeps its fixed score against the corpus; else it counts with the true ratio of the two names. Names that nothing resolves come back as unresolved.
    """
    names = checkpointed(names.select("raw").where("raw is not null").distinct())
    kind = "raw string, law_id string, confidence string, score double, matched_alias string, method string"
    by_hand = F.create_map(*[F.lit(x) for k, v in (manual or {"": ""}).items() for x in (k, v)])
    row = lambda df, confidence, score, method: df.select("raw", "law_id", confidence.alias("confidence"), score.alias("score"), "matched_alias", F.lit(method).alias("method"))
    hand = names.withColumn("law_id", F.try_element_at(by_hand, cleaned_name(F.col("raw")))).where("law_id is not null and law_id <> ''").withColumn("matched_alias", cleaned_name(F.col("raw")))
    done = row(hand, F.lit("high"), F.lit(1.0), "manual")
    exact = resolve_exact(names.join(done, "raw", "left_anti"), aliases)
    done = checkpointed(done.unionByName(row(exact, F.lit("high"), F.lit(1.0), "exact")))
    rest = checkpointed(names.join(done, "raw", "left_anti"))
    fuzzy = resolve_fuzzy(rest, aliases)
    fuzzy = checkpointed(row(fuzzy, F.when(F.col("score") >= FUZZY_HIGH, "high").otherwise("medium"), F.col("score"), "fuzzy"))
    prefix = resolve_prefix(rest.join(fuzzy, "raw", "left_anti"), aliases)
    prefix = row(prefix, F.lit("low"), F.lit(PREFIX_SCORE), "prefix")
    found = checkpointed(done.unionByName(fuzzy).unionByName(prefix))
    if corpus is not None:
        weak = names.join(found.where("confidence = 'high'"), "raw", "left_anti")
        own = row(resolve_exact(weak, corpus), F.lit("high"), F.lit(1.0), "corpus_exact")
        trimmed = weak.select("raw", strip_trailing_junk(F.col("raw")).alias("t"))
        left = trimmed.join(own, "raw", "left_anti")
        again = resolve_exact(left.select(F.col("t").alias("raw")).distinct(), corpus).withColumnRenamed("raw", "t")
        own = own.unionByName(row(left.join(again, "t"), F.lit("high"), F.lit(1.0), "corpus_exact"))
        near = resolve_fuzzy(left.select(F.col("t").alias("raw")).distinct().join(again.select(F.col("t").alias("raw")), "raw", "left_anti"), corpus).withColumnRenamed("raw", "t")
        near = checkpointed(near)
        own = own.unionByName(row(left.join(near, "t"), F.when(F.col("score") >= FUZZY_HIGH, "high").otherwise("medium"), F.col("score"), "corpus_fuzzy"))
        first = Window.partitionBy("raw").orderBy(F.col("score").desc(), F.col("stage").desc(), "law_id")
        both = found.withColumn("stage", F.lit(0)).unionByName(own.withColumn("stage", F.lit(1)))
        if not prefix_first:
            both = both.withColumn("score", F.when(F.col("method") == "prefix", F.least("score", F.lit(FUZZY))).otherwise(F.col("score")))
        found = both.withColumn("n", F.row_number().over(first)).where("n = 1").select(*found.columns)
    none = names.join(found, "raw", "left_anti").select("raw", F.lit(UNRESOLVED).alias("law_id"), F.lit(UNRESOLVED).alias("confidence"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("matched_alias"), F.lit("none").alias("method"))
    return found.unionByName(none).to(T._parse_datatype_string(kind))


def apply_resolution(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Citations with their resolution; rows that already have a target id keep it."""
    new = resolved.select(F.col("raw").alias("target_law_raw"), "law_id", "confidence", "score", "matched_alias", "method")
    joined = citations.join(new.withColumnRenamed("confidence", "__confidence"), "target_law_raw", "left")
    open_ = F.col("target_law_id").isNull()
    return joined.select(
        *[F.col(c) for c in citations.columns if c != "target_law_id"],
        F.coalesce("target_law_id", "law_id", F.lit(UNRESOLVED)).alias("target_law_id"),
        F.when(open_, F.coalesce("__confidence", F.lit(UNRESOLVED))).alias("new_confidence"),
        F.when(open_, F.col("score")).alias("new_score"),
        F.when(open_, F.col("method")).alias("new_method"),
    )


# Words without weight in ids, and words of an id that give its sector, in this order.
ID_STOP = ["-de-", "-del-", "-la-", "-el-", "-los-", "-las-", "-y-", "-e-", "-o-", "-u-"]


def strip_id(column: Column) -> Column:
    out = column
    for w in ID_STOP:
        out = F.replace(out, F.lit(w), F.lit("-"))
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def keyword_sector(column: Column, keywords: list[tuple[str, list[str]]]) -> Column:
    """The first sector one of whose words the id holds, or null; the table of words is the caller's."""
    word = F.lit(None).cast("string")
    for sector, words in reversed(keywords):
        hit = F.lit(False)
        for w in words:
            hit = hit | column.contains(w)
        word = F.when(hit, F.lit(sector)).otherwise(word)
    return word


def sector_lookup(nodes: DataFrame, registry: DataFrame, keywords: list[tuple[str, list[str]]], least: float = FUZZY) -> DataFrame:
    """(id, sector, how) of nodes (id): the registry's sector for the same id, the same id without small words, the most similar id, a keyword in the id, or unknown."""
    known = registry.where("sector is not null").select(F.col("law_id").alias("alias"), F.col("sector"))
    bare = known.groupBy(strip_id(F.col("alias")).alias("alias")).agg(F.max("sector").alias("sector"))
    own = nodes.select("id", strip_id(F.col("id")).alias("bare"))
    step = own.join(known.select(F.col("alias").alias("id"), F.col("sector").alias("s1")), "id", "left")
    step = step.join(bare.select(F.col("alias").alias("bare"), F.col("sector").alias("s2")), "bare", "left")
    open_ = step.where("s1 is null and s2 is null").select(F.col("bare").alias("raw")).distinct()
    near = resolve_fuzzy(open_, bare.select("alias", F.col("sector").alias("law_id"), F.col("alias").alias("ord")), least)
    step = step.join(near.select(F.col("raw").alias("bare"), F.col("law_id").alias("s3")), "bare", "left")
    word = keyword_sector(F.col("id"), keywords)
    how = F.when(F.col("s1").isNotNull(), "exact").when(F.col("s2").isNotNull(), "stripped").when(F.col("s3").isNotNull(), "fuzzy").when(word.isNotNull(), "keyword").otherwise("unknown")
    return step.select("id", F.coalesce("s1", "s2", "s3", word, F.lit("unknown")).alias("sector"), how.alias("how"))
