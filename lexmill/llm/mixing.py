"""Records of several sources mixed to target shares of all tokens, small sources repeated up to a cap.

Hierarchical budgeting: weights run down a tree of levels (domain, language,
source, in any order); a leaf can give its tokens times its cap. What a leaf
can't give goes to its siblings first, then to the siblings of its ancestors.
Each leaf gives whole epochs and then the token-prefix of one more epoch in a
seeded order, found from sums over buckets of that order, so that no leaf has
to pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from lexmill.session import checkpointed

#: The seeded order is cut into 2 ** BITS buckets, and the bucket at the edge of the prefix once more; of a leaf 1 / 2 ** (2 * BITS) is sorted in a task.
BITS = 12
#: Leaves whose budget is planned on the driver, and that may travel to every executor.
MOST_LEAVES = 100_000


@dataclass
class Node:
    """A node of the tree: its weight among its siblings, the tokens it can give at most, and what it is to give."""

    weight: float
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def smooth(self, power: float) -> None:
        for child in self.children.values():
            child.weight **= power
            child.smooth(power)

    def prepare(self) -> float:
        if self.children:
            self.capacity = sum(c.prepare() for c in self.children.values())
        return self.capacity

    def leaves(self, path: tuple = ()) -> Iterator[tuple[tuple, Node]]:
        for name, child in self.children.items():
            if child.children:
                yield from child.leaves((*path, name))
            else:
                yield (*path, name), child


def distribute(node: Node, amount: float) -> None:
    """Give `amount` (at most the capacity) to `node`: to its children by weight, and what one can't take to its siblings."""
    node.budget = min(amount, node.capacity)
    left, open_ = node.budget, [c for c in node.children.values() if c.weight > 0 and c.capacity > 0]
    while open_:
        weights = sum(c.weight for c in open_)
        full = [c for c in open_ if c.capacity <= left * c.weight / weights]
        if not full:
            for c in open_:
                distribute(c, left * c.weight / weights)
            return
        for c in full:
            distribute(c, c.capacity)
            left -= c.capacity
        open_ = [c for c in open_ if all(c is not f for f in full)]


def exact_total(node: Node) -> float:
    """Largest amount that every child with anything to give can serve at its weight."""
    able = [c for c in node.children.values() if c.weight > 0 and c.capacity > 0]
    weights = sum(c.weight for c in able)
    return min((c.capacity * weights / c.weight for c in able), default=0.0)


def counted(docs: DataFrame, key: str, text: str, levels: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Key, levels and `n_tokens` of each record, kept once in the checkpoint folder; null texts and texts without tokens are left out."""
    slim = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), *levels, token_counts(F.col(text), folder, vocabulary).alias("n_tokens"))
    return checkpointed(slim).where(F.col("n_tokens") > 0)


def plan(
    sizes: DataFrame, targets: DataFrame, levels: list[str], share: str, repeats: str, total: float | None = None, fill: float | None = None, smoothing: float = 1.0, most_leaves: int = MOST_LEAVES
) -> DataFrame:
    """Budget of each leaf: its level values, `tokens`, `budget` and `cap`.

    `targets` gives the share and the cap by the first level; levels below are
    weighted by the tokens they hold, to the power of `smoothing`: under 1, small branches get more than they hold of their
    parent, and what they can't give goes to their siblings, then to those of their ancestors. Sources without a target are left out, as
    are targets that are null or not positive; a cap under one or null counts as one. A repeated
    source counts with the sum of its shares and its largest cap. The mixture has `total` tokens, or `fill` times what all leaves can give;
    without either it is as large as it can be with every share exact among
    the sources that have records. Up to `most_leaves` leaves are planned on the driver, more of them level by level.
    """
    wanted = targets.where(F.col(share) > 0).dropna(subset=[levels[0]]).groupBy(levels[0]).agg(
        F.sum(share).alias("share"), F.greatest(F.max(F.coalesce(F.col(repeats), F.lit(1))), F.lit(1)).alias("cap")
    )
    leaves = checkpointed(sizes.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")).join(wanted, levels[0]))
    rows = leaves.limit(most_leaves + 1).collect()
    if len(rows) > most_leaves:
        return _plan_by_level(leaves, levels, total, fill, smoothing)
    root = Node(1.0)
    for r in rows:
        node = root
        for depth, level in enumerate(levels):
            child = node.children.setdefault(r[level], Node(float(r["share"]) if depth == 0 else 0.0))
            if depth:
                child.weight += float(r["tokens"])
            if depth == len(levels) - 1:
                child.capacity = float(r["tokens"]) * int(r["cap"])
            node = child
    for child in root.children.values():
        child.smooth(smoothing)
    most = root.prepare()
    distribute(root, total if total is not None else fill * most if fill is not None else exact_total(root))
    budget = {path: node.budget for path, node in root.leaves()}
    schema = T.StructType([*(leaves.schema[level] for level in levels), leaves.schema["tokens"], T.StructField("cap", T.IntegerType()), T.StructField("budget", T.DoubleType())])
    planned = [(*(r[x] for x in levels), r["tokens"], int(r["cap"]), float(budget[tuple(r[x] for x in levels)])) for r in rows]
    return sizes.sparkSession.createDataFrame(planned, schema)


def _plan_by_level(leaves: DataFrame, levels: list[str], total: float | None, fill: float | None, smoothing: float) -> DataFrame:
    """The same budgets by joins and sums, for any number of leaves: the amount per weight of each parent rises until no child of it runs short."""
    path = lambda depth: F.to_json(F.struct(*levels[:depth])) if depth else F.lit("")
    parents = None
    for depth in range(len(levels)):
        below = leaves.groupBy(path(depth).alias("parent"), path(depth + 1).alias("path")).agg(
            F.sum(F.col("tokens") * F.col("cap")).cast("double").alias("capacity"), F.sum("tokens").cast("double").alias("held"), F.max("share").alias("share")
        )
        weight = F.col("share") if depth == 0 else F.pow("held", F.lit(smoothing))
        children = checkpointed(below.select("parent", "path", "capacity", weight.alias("weight")))
        if parents is None:
            most = F.sum("capacity")
            exact = F.min(F.col("capacity") / F.col("weight")) * F.sum("weight")
            whole = F.lit(float(total)) if total is not None else most * fill if fill is not None else exact
            parents = children.groupBy("parent").agg(F.least(whole, most).alias("budget"))
        level = checkpointed(parents.select("parent", "budget", F.lit(0.0).alias("rate")))
        while True:
            short = F.col("capacity") <= F.col("rate") * F.col("weight")
            sums = children.join(level, "parent").groupBy("parent", "budget", "rate").agg(
                F.sum(F.when(short, F.col("capacity")).otherwise(0.0)).alias("full"), F.sum(F.when(short, 0.0).otherwise(F.col("weight"))).alias("open")
            )
            risen = sums.select("parent", "budget", F.when(F.col("open") > 0, (F.col("budget") - F.col("full")) / F.col("open")).otherwise(F.lit(float("inf"))).alias("new"), "rate")
            risen = checkpointed(risen)
            moved = risen.where(F.col("new") > F.col("rate") * (1 + 1e-12)).limit(1).count()
            level = risen.select("parent", "budget", F.greatest("new", "rate").alias("rate"))
            if not moved:
                break
        parents = children.join(level, "parent").select(F.col("path").alias("parent"), F.least("capacity", F.col("rate") * F.col("weight")).alias("budget"))
    return leaves.withColumn("parent", path(len(levels))).join(parents, "parent").select(*levels, "tokens", F.col("cap").cast("int").alias("cap"), "budget")


def _edge(rows: DataFrame, levels: list[str], bucket: str, name: str, before: Column, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` of leaves with something left to give, with the `bucket` in which the leaf's rest ends (as `name`) and what the buckets before it hold."""
    sums = rows.groupBy(*levels, "rest", before.alias("base"), bucket).agg(F.sum("n_tokens").alias("held"))
    running = sums.withColumn("upto", F.col("base") + F.sum("held").over(Window.partitionBy(*levels).orderBy(bucket)))  # BUCKETS rows of a leaf at most
    edges = running.where((F.col("upto") - F.col("held") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    edges = edges.select(*[F.col(level).alias(f"e_{level}") for level in levels], F.col(bucket).alias(name), (F.col("upto") - F.col("held")).alias(f"{name}_before"))
    joined = rows.join(send(edges), [F.col(level).eqNullSafe(F.col(f"e_{level}")) for level in levels])
    return joined.drop(*[f"e_{level}" for level in levels])


def mix(sizes: DataFrame, leaves: DataFrame, levels: list[str], seed: int = 42) -> DataFrame:
    """One row per use of a record: key, levels, `epoch` (from 0), `n_tokens`.

    Each leaf gives its budget to within half a record: whole epochs of all its
    records, then from one more epoch the prefix of the seeded order that comes
    nearest to what is left. Repeated keys are records of their own.
    """
    leaves = checkpointed(leaves)
    send = F.broadcast if leaves.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES else lambda df: df
    whole = F.least(F.floor(F.col("budget") / F.col("tokens")).cast("int"), F.col("cap"))
    rest = F.when(whole == F.col("cap"), 0.0).otherwise(F.col("budget") - whole * F.col("tokens"))
    planned = send(leaves.select(*[F.col(level).alias(f"b_{level}") for level in levels], whole.alias("epochs"), rest.alias("rest")))
    same = [F.col(level).eqNullSafe(F.col(f"b_{level}")) for level in levels]
    rows = sizes.join(planned, same).select("key", *levels, "n_tokens", "epochs", "rest")
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("key"))
    rows = rows.withColumn("order", order).withColumn("bucket", F.shiftrightunsigned("order", 64 - BITS).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.shiftrightunsigned("order", 64 - 2 * BITS), F.lit(1 << BITS)).cast("int"))
    marked = _edge(rows.where(F.col("rest") > 0), levels, "bucket", "edge", F.lit(0), send)
    finer = _edge(marked.where(F.col("bucket") == F.col("edge")), levels, "part", "part_edge", F.col("edge_before"), send)
    running = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1))
    last = finer.where(F.col("part") == F.col("part_edge")).withColumn("so_far", F.col("part_edge_before") + F.coalesce(running, F.lit(0)))
    last = last.where(F.col("so_far") + F.col("n_tokens") / 2 <= F.col("rest"))
    keep = ["key", *levels, "epoch", "n_tokens"]
    whole_epochs = rows.where(F.col("epochs") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).select(*keep)
    parts = (marked.where(F.col("bucket") < F.col("edge")), finer.where(F.col("part") < F.col("part_edge")), last)
    return reduce(DataFrame.unionByName, (p.withColumn("epoch", F.col("epochs")).select(*keep) for p in parts), whole_epochs)


def shares(mixture: DataFrame, targets: DataFrame, level: str, share: str) -> DataFrame:
    """Per source with a target: records used, tokens, the share wanted and the share reached (0 for a source without records)."""
    used = mixture.groupBy(level).agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    joined = targets.select(level, share).join(used, level, "left").fillna(0, ["n_uses", "n_tokens"])
    total = F.sum("n_tokens").over(Window.partitionBy())  # over the sources, as many rows as there are targets
    return joined.withColumn("reached_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(F.lit(0.0)))
