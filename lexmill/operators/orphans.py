"""References to records that don't exist: missing, gone again, or not there yet at the time of the reference.

Keys are hashed to 64 bits and cut into even ranges of the hash. Within a range
the parents are arrays sorted by (hash, key, start of validity); references are
probed in vectorised batches by binary search, and a hit counts only where the
keys themselves are equal. A parent table of proven small size travels to every
executor as one such array and the references aren't shuffled at all; a larger
one is range-partitioned together with them, parents first, so that a task
holds the parents of one range and passes over its references batch by batch.
A range that holds many references is split by a salt, its parents repeated
for each split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.session import spread

#: Parents that may travel to every executor, and bytes of all their keys.
MOST_BROADCAST_PARENTS, MOST_BROADCAST_BYTES = 1_000_000, 64_000_000
#: References that one task probes at most, as planned from the counts of each range.
REFERENCES_PER_TASK = 4_000_000
#: Parents of one range at most, on average: what a task holds.
PARENTS_PER_RANGE = 200_000
_FOREVER = np.iinfo(np.int64).max


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


class SortedParents:
    """Parents as arrays sorted by (hash, key, start); `last` is the latest end among the parents of that key up to each place."""

    def __init__(self, hashes: np.ndarray, keys: pa.Array, starts: np.ndarray, ends: np.ndarray):
        codes = keys.dictionary_encode()
        # numbers for the keys in place of the texts: only their equality counts
        numbers = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((starts, numbers, hashes))
        self.hashes, self.starts, ends, numbers = hashes[order], starts[order], ends[order], numbers[order]
        self.keys = keys.take(pa.array(order))
        self.last = ends.copy()
        same = np.zeros(len(ends), bool)
        same[1:] = numbers[1:] == numbers[:-1]
        # several validities of one key are few: repeat until no end moves on
        while same.any():
            moved = np.where(same[1:], np.maximum(self.last[1:], self.last[:-1]), self.last[1:])
            if (moved == self.last[1:]).all():
                break
            self.last[1:] = moved
        # two keys of one hash: such hashes are looked up key by key
        mixed = (self.hashes[1:] == self.hashes[:-1]) & ~same[1:]
        self.mixed = np.unique(self.hashes[1:][mixed])
        self.by_key: dict[str, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(np.isin(self.hashes, self.mixed)):
            self.by_key.setdefault(self.keys[int(i)].as_py(), []).append((int(self.starts[i]), int(ends[i])))

    def miss(self, hashes: np.ndarray, keys: pa.Array, times: np.ndarray) -> np.ndarray:
        """Whether no parent of the key is valid at the time (start <= time < end)."""
        if not len(self.hashes) or not len(hashes):
            return np.ones(len(hashes), bool)
        low = np.searchsorted(self.hashes, hashes, "left")
        high = np.searchsorted(self.hashes, hashes, "right")
        # within the run of one hash, the last start that isn't after the time: binary search over all runs at once
        lo, hi = low.copy(), high.copy()
        while (open_ := lo < hi).any():
            middle = (lo + hi) // 2
            before = open_ & (self.starts[np.minimum(middle, len(self.starts) - 1)] <= times)
            lo = np.where(before, middle + 1, lo)
            hi = np.where(open_ & ~before, middle, hi)
        at = np.maximum(lo - 1, 0)
        missed = (lo - 1 < low) | (self.last[at] <= times)
        hit = np.flatnonzero(~missed)
        equal = pc.equal(self.keys.take(pa.array(at[hit])), keys.take(pa.array(hit)))
        missed[hit] = ~equal.to_numpy(zero_copy_only=False).astype(bool)
        for i in np.flatnonzero(np.isin(hashes, self.mixed)) if len(self.mixed) else ():
            held = self.by_key.get(keys[int(i)].as_py(), ())
            missed[i] = not any(start <= times[i] < end for start, end in held)
        return missed


def _key_text(columns: list[Column]) -> Column:
    # the length keeps ("a", "bc") and ("ab", "c") apart
    texts = [c.cast("string") for c in columns]
    return F.concat_ws(":", *[x for t in texts for x in (F.length(t).cast("string"), t)])


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    ref_key: list[str],
    parent_key: list[str],
    time: str,
    start: str,
    end: str,
    most_broadcast: int = MOST_BROADCAST_PARENTS,
    per_task: int = REFERENCES_PER_TASK,
    per_range: int = PARENTS_PER_RANGE,
) -> DataFrame:
    """Rows of `refs` whose key has no parent valid at `time` (start <= time < end; a null end never comes).

    Keys are compared as they stand. A null key part or a
    null time refers to nothing and is no orphan; such rows don't come back. A parent with a null key part
    or a null start is never valid. With no parents every reference is an
    orphan. Repeated references stay repeated; all columns of `refs` come back.
    """
    held = (
        parents.where(F.col(start).isNotNull())
        .dropna(subset=parent_key)
        .select(
            _key_text([F.col(c) for c in parent_key]).alias("__orphan_key"),
            _micros(F.col(start)).alias("__orphan_start"),
            F.coalesce(_micros(F.col(end)), F.lit(int(_FOREVER))).alias("__orphan_end"),
        )
        .withColumn("__orphan_hash", F.xxhash64("__orphan_key"))
    )
    named = refs.where(F.col(time).isNotNull()).dropna(subset=ref_key)
    keyed = named.select("*", _key_text([F.col(c) for c in ref_key]).alias("__orphan_key"), _micros(F.col(time)).alias("__orphan_time"))
    keyed = keyed.withColumn("__orphan_hash", F.xxhash64("__orphan_key"))
    count, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__orphan_key")), F.lit(0))).first()
    if count <= most_broadcast and size <= MOST_BROADCAST_BYTES:
        index = _index(held.toArrow())  # within the bounds just counted
        sent = refs.sparkSession.sparkContext.broadcast(index)

        @arrow_udf(T.BooleanType())
        def missing(hashes: pa.Array, keys: pa.Array, times: pa.Array) -> pa.Array:
            return pa.array(sent.value.miss(hashes.to_numpy(zero_copy_only=False), keys, times.to_numpy(zero_copy_only=False)), pa.bool_())

        kept = keyed.where(missing("__orphan_hash", "__orphan_key", "__orphan_time"))
        return kept.drop("__orphan_hash", "__orphan_key", "__orphan_time")
    return _probe_ranges(keyed, held, count, per_task, per_range)


def _index(rows: pa.Table | pa.RecordBatch) -> SortedParents:
    keys = rows.column("__orphan_key")
    keys = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).cast(pa.string())
    return SortedParents(_numbers(rows, "__orphan_hash"), keys, _numbers(rows, "__orphan_start"), _numbers(rows, "__orphan_end"))


def _numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = rows.column(name)
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _probe_ranges(keyed: DataFrame, parents: DataFrame, count: int, per_task: int, per_range: int) -> DataFrame:
    """The way for parents of any size: even ranges of the hash, ranges with many references split by a salt."""
    bits = max(4, min(16, int(np.ceil(np.log2(max(2, count / per_range))))))
    range_of = F.shiftrightunsigned(F.col("__orphan_hash"), 64 - bits).cast("int")
    # one row per range: at most 2 ** 16, whatever the input
    splits = keyed.groupBy(range_of.alias("__orphan_range")).agg(F.ceil(F.count("*") / per_task).cast("int").alias("__orphan_splits"))
    splits = F.broadcast(splits)
    # a salt of the row's own values, so that a task that runs again puts it in the same place
    own = [F.col(f"`{c}`") for c, kind in keyed.dtypes if "map<" not in kind and kind != "variant"]
    salt = F.pmod(F.xxhash64(F.lit("salt"), *own), F.col("__orphan_splits")).cast("int")
    left = keyed.withColumn("__orphan_range", range_of).join(splits, "__orphan_range").withColumn("__orphan_salt", salt).drop("__orphan_splits")
    each = F.explode(F.sequence(F.lit(0), F.col("__orphan_splits") - 1)).alias("__orphan_salt")
    right = parents.withColumn("__orphan_range", range_of).join(splits, "__orphan_range").select(*parents.columns, "__orphan_range", each)
    place = ["__orphan_range", "__orphan_salt"]
    # a reference has no start; null sorts after the parents' starts
    both = spread(left.unionByName(right, allowMissingColumns=True), *place).sortWithinPartitions(*place, F.col("__orphan_start").asc_nulls_last())
    schema = T.StructType([f for f in keyed.schema if not f.name.startswith("__orphan_")])
    names, held = schema.names, parents.columns

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, index = None, [], None
        for batch in batches:
            where = np.stack([_numbers(batch, c) for c in place])
            edges = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if at != (own := tuple(where[:, low])):
                    at, gathered, index = own, [], None
                n = part.num_rows - part.column("__orphan_start").null_count  # parents come first
                if n:
                    gathered.append(part.slice(0, n).select(held))
                if n < part.num_rows:
                    rest = part.slice(n)
                    if index is None:
                        index, gathered = _index(pa.Table.from_batches(gathered)) if gathered else None, []
                    if index is None:
                        yield rest.select(names)
                        continue
                    keys = rest.column("__orphan_key").cast(pa.string())
                    gone = index.miss(_numbers(rest, "__orphan_hash"), keys, _numbers(rest, "__orphan_time"))
                    if gone.any():
                        yield rest.filter(pa.array(gone)).select(names)

    return both.mapInArrow(probe, schema)


def orphans_by_period(orphans: DataFrame, key: str, field: str, time: str, period: str = "month") -> DataFrame:
    """Distinct referring records per field and period; a record that comes again counts once."""
    return orphans.groupBy(F.col(field).alias("ref_field"), F.date_trunc(period, F.col(time)).alias("period")).agg(
        F.countDistinct(key).alias("n_orphans")
    )
