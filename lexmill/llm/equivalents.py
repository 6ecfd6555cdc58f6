"""Duplicates hidden by formatting: records equal but for case, spacing, punctuation or field order, collapsed and counted.

Bottom-up hashing: every leaf is normalised and digested, a record's digest is
made of its children's digests (sorted where the node has no order), and
records are grouped by the digest of their root. A group is confirmed by
comparing the normalised contents in full.
"""

from __future__ import annotations

import unicodedata
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from lexmill.session import checkpointed

#: Copies from which on the members of a group aren't brought together in one task.
HEAVY_GROUP = 200_000
#: Groups whose digests may travel to every executor.
MOST_BROADCAST_GROUPS = 500_000


@arrow_udf(T.StringType())
def _composed(values: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in values.to_pylist()], pa.string())


def leaf(column: Column) -> Column:
    """Letters and digits of a string column, in order, without regard to case; accents count. Null counts as empty.

    Only text with combining marks leaves the JVM, to be composed.
    """
    text = F.coalesce(column.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"\p{M}"), _composed(F.when(text.rlike(r"\p{M}"), text))).otherwise(text)
    # upper case first: letters that share a capital become one, as the two small sigmas
    return F.translate(F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", ""))), "ς", "σ")


def _content(value: object, kind: T.DataType, ordered: bool, bags: frozenset[str], path: str) -> str:
    """A nested value as text: leaves normalised, parts in brackets, sorted where their node has no order. Empty and null are alike."""
    if value is None:
        return ""
    if isinstance(kind, T.StructType):
        parts = [_content(value[f.name], f.dataType, ordered, bags, f"{path}.{f.name}") for f in kind]
        parts = parts if ordered else sorted(parts)
    elif isinstance(kind, T.ArrayType):
        parts = [_content(x, kind.elementType, ordered, bags, path) for x in value]
        parts = sorted(parts) if path in bags else parts
    elif isinstance(kind, T.MapType):
        sides = ((_content(k, kind.keyType, ordered, bags, path), _content(v, kind.valueType, ordered, bags, path)) for k, v in value)
        parts = sorted("=".join(x) for x in sides)
    else:
        text = unicodedata.normalize("NFC", value if isinstance(value, str) else str(value))
        return regex.sub(r"[^\p{L}\p{N}\p{M}]+", "", text).upper().lower().replace("ς", "σ")
    return f"[{'|'.join(parts)}]" if any(parts) else ""


def tree(column: Column, kind: T.DataType, ordered: bool, bags: frozenset[str], path: str) -> Column:
    """Content of a field: a leaf in the JVM, a struct, array or map by its schema."""
    if not isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return leaf(column)

    @arrow_udf(T.StringType())
    def content(values: pa.Array) -> pa.Array:
        return pa.array([_content(v, kind, ordered, bags, path) for v in values.to_pylist()], pa.string())

    return content(column)


def node(children: list[Column], ordered: bool = False) -> Column:
    """Digest of a node over its children's digests; without order they are sorted first. 128 bits as text."""
    digests = F.array(*children)
    return F.md5(F.array_join(digests if ordered else F.array_sort(digests), "|"))


def collapse(
    df: DataFrame, key: str, fields: list[str], ordered: bool = False, heavy: int = HEAVY_GROUP, bags: frozenset[str] = frozenset(), most_broadcast: int = MOST_BROADCAST_GROUPS
) -> DataFrame:
    """Members of each group of records that are equal in form: key, `keep` (smallest key of the group) and `copies` (rows of the group).

    Fields can be nested. Structs at any depth have the order that `ordered` says; lists keep theirs, but for those named
    by path in `bags` ("field" or "field.inner"); maps have none.

    Records with a repeated key are one record each in the count. Empty and
    null fields are alike; records with nothing but empty fields form a group
    as any other. Other columns don't matter and don't come back.
    """
    leaves = [tree(F.col(f"`{f}`"), df.schema[f].dataType, ordered, bags, f) for f in fields]
    hashed = df.select(F.col(f"`{key}`").alias("key"), F.array(*leaves).alias("leaves"))
    if not ordered:
        hashed = hashed.withColumn("leaves", F.array_sort("leaves"))
    hashed = hashed.withColumn("root", node([F.md5(F.get("leaves", F.lit(i))) for i in range(len(fields))], True))
    # counted on digests alone, before any shuffle of members: a group of any size leaves one row per task, without its contents
    groups = hashed.groupBy("root").agg(F.min("key").alias("keep"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    groups = checkpointed(groups)
    large = groups.where(F.col("copies") >= heavy)
    n, n_large = groups.agg(F.count("*"), F.count_if(F.col("copies") >= heavy)).first()
    if n <= most_broadcast:
        # contents of records without a copy stay where they are; 32 bytes a root and as many beside it
        return _confirmed(hashed.join(F.broadcast(groups), "root"), heavy)
    found = _confirmed(hashed.join(groups.where(F.col("copies") < heavy), "root"), heavy)
    if n_large:
        # at most rows / heavy groups, each a digest, a key and a number: their members aren't brought together by root
        found = found.unionByName(_confirmed(hashed.join(F.broadcast(large), "root"), heavy))
    return found


def _confirmed(members: DataFrame, heavy: int) -> DataFrame:
    """The `members` of groups whose contents are those of the record that is kept, compared in full.

    The kept record of a group goes to as many tasks as the group has times `heavy` members.
    """
    members = checkpointed(members)  # only records that have a copy, so that they are normalised once more and not twice
    parts = F.ceil(F.col("copies") / heavy).cast("int")
    kept = members.where(F.col("key") == F.col("keep")).groupBy("root", "copies").agg(F.first("leaves").alias("contents"))
    kept = kept.select("root", "contents", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    own = members.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    return own.join(kept, ["root", "part"]).where(F.col("leaves") == F.col("contents")).select("key", "keep", "copies")
