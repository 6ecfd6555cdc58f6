"""Graphs from citations, and measures on graphs given as edges (src, dst[, weight]).

An aggregated graph is often small whatever the texts it comes from: up to a
checked number of edges its iterative measures are worked out by tasks that
hold it whole (see whole_graph). Beyond that they are DataFrame steps with
reliable checkpoints. Either way the result is whole: a loop that doesn't come
to its end within its steps raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import confidence_rank
from lexmill.operators import whole_graph as whole
from lexmill.session import checkpointed

UNKNOWN = "?"
#: Edges of a graph that a task may hold whole: 16 bytes each, and the ids once.
MOST_LOCAL_EDGES = 5_000_000
#: Edges that a task may hold as they come, for ranks of all nodes.
MOST_FLAT_EDGES = 30_000_000
#: Edges that are worth a task of their own where a measure goes by source.
EDGES_PER_SHARE = 2_000
#: Edges of small components that a task works out one after the other, and nodes whose components may be broadcast.
BIN_EDGES, MOST_BROADCAST_NODES = 200_000, 1_000_000
#: Nodes whose components one task may find.
MOST_CONTRACTED_NODES = 5_000_000
#: Edges that every task may hold as rows of numbers: 4 bytes each either way, and 8 more while triangles are counted.
MOST_HELD_EDGES = 40_000_000
#: Edges times sources that are worth a task of their own within a component.
STEPS_PER_SHARE = 4e9
CHECKPOINT_EVERY = 5
#: Sources whose reach is followed at once beyond MOST_LOCAL_EDGES, 64 in each number.
WORDS = 8


def edge_aggregation(citations: DataFrame, least_rank: int = 2) -> DataFrame:
    """Law edges: citation count (the weight), best confidence and the first three source articles (by article, as text).

    Only resolved citations of at least `least_rank` confidence between different laws count. The pre-aggregated
    counts per article keep a much-cited law from bringing its citations together.
    """
    kept = citations.where((F.col("target_law_id") != "unresolved") & (F.col("source_law") != F.col("target_law_id")))
    kept = kept.withColumn("rank", confidence_rank(F.col("confidence"))).where(F.col("rank") >= least_rank)
    by_article = kept.groupBy(F.col("source_law").alias("src"), F.col("target_law_id").alias("dst"), "source_article").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    out = by_article.groupBy("src", "dst").agg(F.sum("n").alias("citation_count"), F.max("rank").alias("rank"), F.array_sort(F.collect_set("source_article")).alias("a"))
    return out.select("src", "dst", "citation_count", F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("confidence"), F.array_join(F.slice("a", 1, 3), ", ").alias("sample_article"), F.col("citation_count").cast("double").alias("weight"))


def article_id(law: Column, article: Column) -> Column:
    return F.concat_ws("::", law, F.coalesce(F.nullif(F.trim(article), F.lit("")), F.lit(UNKNOWN)))


def article_edges(citations: DataFrame) -> DataFrame:
    """Article edges with weight and confidence of the first citation (by offset, then id); self loops stay. A missing confidence counts as low."""
    kept = citations.where((F.col("target_law_id") != "unresolved") & (F.coalesce("resolution_confidence", F.lit("low")) != "unresolved"))
    ends = [article_id(F.col("source_law"), F.col("source_article")).alias("src"), article_id(F.col("target_law_id"), F.col("target_article")).alias("dst")]
    rows = kept.select(*ends, F.coalesce("resolution_confidence", F.lit("low")).alias("c"), F.struct("char_offset", "citation_id").alias("o"))
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min_by("c", "o").alias("confidence"))


def law_of(node: Column) -> Column:
    return F.split(node, "::")[0]


def article_metrics(edges: DataFrame) -> DataFrame:
    """Per article: degrees (distinct neighbours), weights, and the distinct laws it cites and is cited by."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"), F.sum("weight").alias("out_weight"), F.countDistinct(law_of(F.col("dst"))).alias("unique_laws_cited"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"), F.sum("weight").alias("in_weight"), F.countDistinct(law_of(F.col("src"))).alias("unique_laws_citing"))
    return out.join(into, "node_id", "full").fillna(0)


def article_graph_capped(citations: DataFrame, most_nodes: int = 5000, most_edges: int = 20000, edges_seen: int = 40000) -> DataFrame:
    """The article edges among the nodes with most citations: the caps are the feature, a graph small enough to draw.

    Degrees count citations; self loops are dropped; of the `edges_seen` heaviest
    edges those between kept nodes, at most `most_edges`.
    """
    edges = article_edges(citations).where("src <> dst")
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("degree"))
    kept = degree.orderBy(F.desc("degree"), "id").limit(most_nodes).select("id")
    heavy = edges.orderBy(F.desc("weight"), "src", "dst").limit(edges_seen)
    both = heavy.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select("src", "dst", "weight").orderBy(F.desc("weight"), "src", "dst").limit(most_edges)


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degree_metrics(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """In-degree, out-degree and total by distinct edges; vertices without edges have zeros."""
    ends = edges.select("src", "dst").distinct().select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    if vertices is not None:
        ends = ends.unionByName(vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))


def density(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One row: nodes, distinct edges, edges over ordered pairs (0 for fewer than two nodes)."""
    nodes = (vertices if vertices is not None else vertices_of(edges)).agg(F.countDistinct("id").alias("nodes"))
    n = F.col("nodes")
    return edges.agg(F.countDistinct("src", "dst").alias("edges")).crossJoin(nodes).select("nodes", "edges", F.when(n > 1, F.round(F.col("edges") / (n * (n - 1)), 6)).otherwise(F.lit(0.0)).alias("density"))  # one row by one row


def mutual_pairs(edges: DataFrame, without: list[str] | None = None) -> DataFrame:
    """Pairs a < b that cite each other, with the weight either way; nodes in `without` don't count."""
    kept = edges.where(~F.col("src").isin(without)).where(~F.col("dst").isin(without)) if without else edges
    there = kept.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("a_to_b"))
    back = kept.where("src > dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("b_to_a"))
    return there.join(back, ["a", "b"])


def mutual_evidence(pairs: DataFrame, citations: DataFrame, best: int = 3) -> DataFrame:
    """The best citations of each direction of each pair: by confidence, then offset and id; texts that begin alike count once."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    own = citations.select(F.col("source_law").alias("src"), F.col("target_law_id").alias("dst"), "confidence", "char_offset", "citation_id", F.substring("citation_text", 1, 300).alias("t"))
    order = [confidence_rank(F.col("confidence")).desc(), "char_offset", "citation_id"]
    once = own.join(ends, ["src", "dst"]).withColumn("n", F.row_number().over(Window.partitionBy("src", "dst", "t").orderBy(*order))).where("n = 1")
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*order))).where(F.col("rank") <= best)
    return top.select("src", "dst", "rank", "citation_id", "confidence")


def _slim(edges: DataFrame) -> DataFrame:
    """The edges once in the checkpoint folder, with nothing but ends and weight."""
    return checkpointed(edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else [])))


def _packed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges, and their number, out of the checkpoint folder, where they lie as compressed Arrow batches: rows of numbers take six times that room."""
    schema = edges.schema

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n", "rows"])

    def unpack(batches):
        for batch in batches:
            for held in batch.column("rows").to_pylist():
                yield from pa.ipc.open_stream(held)

    kept = checkpointed(edges.mapInArrow(pack, "n long, rows binary"))
    return kept.select("rows").mapInArrow(unpack, schema), kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class Parted:
    """Edges (src, dst, weight) of many components; `small` are in components that a task may hold whole, `large` (or None) are all others."""

    small: DataFrame | None
    large: DataFrame | None
    bins: int = 0
    nodes: int = 0
    #: Ids of `large`, if one task may hold them, how many edges leave them, and the ids of all.
    ids: DataFrame | None = None
    edges: int = 0
    every: DataFrame | None = None

    def work(self, run, schema: str, share: float | None = None) -> DataFrame:
        """What `run` yields of each small component; with `share`, one of more than that many edges times nodes is given to several tasks."""
        most = self.small.sparkSession.sparkContext.defaultParallelism
        parts = F.lit(1) if share is None else F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("edges") * F.col("nodes") / share))).cast("int")
        rows = self.small.withColumn("parts", parts).select("src", "dst", "weight", "component", "bin", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return whole.on_components(rows, run, schema, max(12, min(4 * self.bins, 2_000)))


def parted(edges: DataFrame, most_local: int) -> Parted:
    """The edges, which come out of the checkpoint folder, by component without regard to direction.

    Each task contracts its edges to a row for each node; these are joined in one task if there are no more nodes than it may hold.
    """
    kind = _kind(edges)
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    rows = checkpointed(edges.select("src", "dst").mapInArrow(whole.forest, f"id {kind}, root {kind}, m long"))
    if rows.count() > MOST_CONTRACTED_NODES and rows.select("id").distinct().count() > MOST_CONTRACTED_NODES:
        return Parted(None, edges)
    bin_edges = max(1, min(most_local, BIN_EDGES))
    parts = checkpointed(rows.repartition(1).mapInArrow(lambda b: whole.parted(b, bin_edges), f"id {kind}, component long, bin long, edges long, nodes long"))
    largest, least, bins, nodes = parts.agg(F.max("edges"), F.min("edges"), F.max("bin") + 1, F.count("*")).first()
    ids, above = parts.where(F.col("edges") > most_local).select("id"), 0
    if largest > most_local:
        above = parts.where(F.col("edges") > most_local).groupBy("component").agg(F.first("edges").alias("m")).agg(F.sum("m")).first()[0]
    if least > most_local:
        return Parted(None, edges, 0, nodes, ids, above, parts.select("id"))
    ends = parts.withColumnRenamed("id", "src")
    held = edges.join(F.broadcast(ends) if nodes <= MOST_BROADCAST_NODES else ends, "src")
    return Parted(held.where(F.col("edges") <= most_local), held.where(F.col("edges") > most_local).select("src", "dst", "weight") if largest > most_local else None, bins, nodes, ids, above, parts.select("id"))


@dataclass
class Held:
    """Edges between numbers, packed in the checkpoint folder, and the numbers' ids."""

    packed: DataFrame
    numbers: DataFrame
    n: int
    edges: dict[int, int]
    weights: str | None
    kind: str

    def work(self, run, columns: str, parts: int | None = None) -> DataFrame:
        """What `run` yields of all rows for each part, in columns of k and others."""
        return whole.on_rows(self.packed, self.n, self.edges, self.weights, run, f"k int, {columns}", parts or max(1, min(self.packed.sparkSession.sparkContext.defaultParallelism, 64)))

    def named(self, found: DataFrame) -> DataFrame:
        """With ids, and zeros for those that no edge is left of."""
        return self.numbers.join(found, "k", "left").drop("k").fillna(0)


def held(edges: DataFrame, ids: DataFrame, ways: tuple[int, ...], weighted: bool = False) -> Held:
    """The edges between the ids as rows of numbers, a few bytes each, of which every task may hold all; ids are numbered in order."""
    kind = _kind(edges)

    def numbered(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if tables:
            own = pa.concat_tables(tables)["id"]
            own = own.take(pa.compute.sort_indices(own))
            yield from pa.table({"id": own, "k": pa.array(np.arange(len(own), dtype=np.int32))}).to_batches()

    numbers = checkpointed(ids.repartition(1).mapInArrow(numbered, f"id {kind}, k int"))
    n = numbers.count()
    known = F.broadcast(numbers) if n <= MOST_BROADCAST_NODES else numbers
    side = lambda end, name: known.select(F.col("id").alias(end), F.col("k").alias(name))
    rows = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("a", "b", *(["weight"] if weighted else []))
    pieces = rows.mapInArrow(lambda b: whole.packed_pieces(b, n, ways, weighted), whole.PACKED)
    packed = checkpointed(pieces.repartition(max(12, edges.sparkSession.sparkContext.defaultParallelism), "way", "block").mapInArrow(whole.merged_pieces, whole.PACKED))
    sums = {w: (m, kinds) for w, m, kinds in packed.groupBy("way").agg(F.sum("n"), F.collect_set("kind")).collect()}  # a row for each way
    weights = np.result_type(*{k for _, kinds in sums.values() for k in kinds}).name if weighted else None
    return Held(packed, numbers, n, {w: sums[w][0] if w in sums else 0 for w in ways}, weights, kind)


def _kind(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def _shares(edges: DataFrame, count: int) -> int:
    return max(1, min(edges.sparkSession.sparkContext.defaultParallelism, 64, count // EDGES_PER_SHARE))


def pagerank(
    edges: DataFrame, vertices: DataFrame | None = None, weighted: bool = False, alpha: float = 0.85, iterations: int | None = None, tolerance: float = 1e-6, most: int = 5000,
    most_local: int = MOST_LOCAL_EDGES,
) -> DataFrame:
    """PageRank of all vertices; dangling mass is spread evenly. With `iterations` that many steps, else until the change is under n * tolerance."""
    e = _slim(edges)
    count = e.count()
    apart = vertices.select("id").distinct().join(vertices_of(e), "id", "left_anti") if vertices is not None else e.select(F.col("src").alias("id")).limit(0)
    if not count:
        return apart.select("id", (1.0 / F.count("*").over(Window.partitionBy(F.lit(0)))).alias("pagerank")) if vertices is not None else apart.withColumn("pagerank", F.lit(0.0))
    if count <= most_local:
        also = apart.count()

        def run(g: whole.Graph, shares: set[int], parts: int):
            ranks = whole.pagerank(g, weighted, alpha, iterations, tolerance, most, also)
            g.ids = [*g.ids, None]  # the last rank is that of a node apart
            yield g.rows(pagerank=ranks)

        ranks = whole.on_graph(e, run, f"id {_kind(e)}, pagerank double")
        own = ranks.where("id is not null")
        return own.unionByName(apart.crossJoin(F.broadcast(ranks.where("id is null").select("pagerank")))) if also else own  # one row
    return _pagerank_steps(e, apart, weighted, alpha, iterations, tolerance, most)


def _pagerank_steps(edges: DataFrame, apart: DataFrame, weighted: bool, alpha: float, iterations: int | None, tolerance: float, most: int) -> DataFrame:
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = edges.groupBy("src", "dst").agg(F.sum(weight).alias("w") if weighted else F.lit(1.0).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    e = checkpointed(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    nodes = checkpointed(vertices_of(edges).unionByName(apart).join(e.select(F.col("src").alias("id")).distinct().withColumn("gives", F.lit(True)), "id", "left"))
    n = nodes.count()
    ranks = nodes.select("id", "gives", F.lit(1.0 / n).alias("r"))
    for step in range(1, (iterations or most) + 1):
        lost = ranks.where("gives is null").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        moved = ranks.join(e, ranks["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("m"))
        new = nodes.join(moved, "id", "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("id", "gives", (F.lit((1 - alpha) / n) + F.lit(alpha) * (F.coalesce("m", F.lit(0.0)) + F.col("lost") / n)).alias("r"))
        if iterations is None:
            new = checkpointed(new)
            change = new.join(ranks.select("id", F.col("r").alias("old")), "id").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0]
            ranks = new
            if change < n * tolerance:
                break
        else:
            ranks = checkpointed(new) if step % CHECKPOINT_EVERY == 0 else new
    else:
        if iterations is None:
            raise ArithmeticError(f"ranks still change after {most} steps")
    return ranks.select("id", F.col("r").alias("pagerank"))


def hits(edges: DataFrame, iterations: int | None = 20, tolerance: float = 1e-8, most: int = 5000, most_local: int = MOST_LOCAL_EDGES) -> DataFrame:
    """Hubs and authorities, each summing to 1, from a uniform start.

    With `iterations` that many steps, else until the hubs change by less than `tolerance` in all.
    """
    e = checkpointed(edges.select("src", "dst").distinct())
    if e.count() <= most_local:

        def run(g: whole.Graph, shares: set[int], parts: int):
            hub, authority = whole.hits(g, iterations, tolerance, most)
            yield g.rows(hub=hub, authority=authority)

        return whole.on_graph(e, run, f"id {_kind(e)}, hub double, authority double")
    nodes = checkpointed(vertices_of(e))
    n = nodes.count()
    hub = nodes.select("id", F.lit(1.0 / n).alias("hub"))
    share = lambda df, c: df.crossJoin(F.broadcast(df.agg(F.sum(c).alias("t")))).select("id", (F.col(c) / F.col("t")).alias(c))
    for step in range(1, (iterations or most) + 1):
        old = hub
        authority = share(e.join(hub, e["src"] == hub["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority")), "authority")
        hub = share(e.join(authority, e["dst"] == authority["id"]).groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub")), "hub")
        if iterations is None:
            hub = checkpointed(hub)
            pair = hub.join(old.withColumnRenamed("hub", "old"), "id", "full").fillna(0.0)
            if (pair.agg(F.sum(F.abs(F.col("hub") - F.col("old")))).first()[0] or 0.0) < tolerance:
                break
        elif step % 2 == 0:
            hub = checkpointed(hub)
    else:
        if iterations is None:
            raise ArithmeticError(f"hubs still change after {most} steps")
    authority = share(e.join(hub, e["src"] == hub["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority")), "authority")
    return nodes.join(hub, "id", "left").join(authority, "id", "left").fillna(0.0)


def _coefficient() -> Column:
    return F.when(F.col("degree") > 1, F.round(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)), 6)).otherwise(F.lit(0.0))


def clustering(edges: DataFrame, most_local: int = MOST_LOCAL_EDGES, most_held: int = MOST_HELD_EDGES) -> DataFrame:
    """Degree, triangles and local clustering coefficient on the undirected graph; a node with no edge but to itself has zeros.

    Edges point from the node of lower degree to that of higher degree, so that
    a hub's neighbours are never paired with one another.
    """
    c = _coefficient()
    e, count = _packed(edges.select("src", "dst").distinct())

    def run(g: whole.Graph, shares: set[int], parts: int):
        degree, triangles = whole.triangles(g)
        yield g.rows(degree=degree, triangles=triangles)

    schema = f"id {_kind(e)}, degree long, triangles long"
    if count <= most_local:
        return whole.on_graph(e, run, schema).withColumn("clustering", c)
    by = parted(e, most_local)
    small = by.work(run, schema).withColumn("clustering", c) if by.small is not None else None
    if by.large is None:
        return small
    rest = by.large.select("src", "dst")
    large = (_clustering_of_rows(held(rest, by.ids, (2,))) if by.ids is not None and by.edges <= most_held else _clustering_by_joins(rest)).withColumn("clustering", c)
    return large if small is None else small.unionByName(large)


def _clustering_of_rows(h: Held) -> DataFrame:
    """Every task holds all edges and takes a part of the nodes."""
    n = h.n

    def run(ways: dict[int, whole.Rows], part: int, parts: int):
        degree, triangles = whole.triangles_of_rows(ways[2], part, parts)
        yield whole.rows_of(k=np.arange(n, dtype=np.int32), degree=degree, triangles=triangles)

    return h.named(h.work(run, "degree long, triangles long").groupBy("k").agg(F.sum("degree").alias("degree"), F.sum("triangles").alias("triangles")))


def _clustering_by_joins(e: DataFrame) -> DataFrame:
    alone = vertices_of(e)
    flat = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = flat.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    d = degree.select(F.col("id"), F.struct("degree", "id").alias("o"))
    rows = flat.join(d.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(d.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    up = checkpointed(rows.select(F.when(F.col("oa") < F.col("ob"), F.struct("oa", "ob")).otherwise(F.struct(F.col("ob").alias("oa"), F.col("oa").alias("ob"))).alias("e")).select("e.oa", "e.ob"))
    x, y = up.select(F.col("oa").alias("u"), F.col("ob").alias("v")), up.select(F.col("oa").alias("u"), F.col("ob").alias("w"))
    closed = up.select(F.col("oa").alias("v"), F.col("ob").alias("w"))
    triples = x.join(y, "u").where("v < w").join(closed, ["v", "w"])
    triangles = triples.select(F.explode(F.array("u.id", "v.id", "w.id")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return alone.join(degree, "id", "left").join(triangles, "id", "left").fillna(0, ["degree", "triangles"])


def reachability(edges: DataFrame, most: int = 100) -> DataFrame:
    """Pairs (id, reached) of nodes and the nodes they reach by one edge or more; a node on a cycle reaches itself.

    Path lengths double with each step, so a path of k edges takes log2(k) joins. The
    result has as many pairs as it names, up to nodes squared: cascade_scores counts without it.
    """
    found = checkpointed(edges.select(F.col("src").alias("id"), F.col("dst").alias("reached")).distinct())
    count = found.count()
    for _ in range(most):
        left, right = found, found.select(F.col("id").alias("reached"), F.col("reached").alias("next"))
        new = checkpointed(found.unionByName(left.join(right, "reached").select("id", F.col("next").alias("reached"))).distinct())
        if (n := new.count()) == count:
            return new
        found, count = new, n
    raise ArithmeticError(f"paths still grow after {most} doublings")


def cascade_scores(edges: DataFrame, vertices: DataFrame | None = None, most_local: int = MOST_LOCAL_EDGES, words: int = WORDS) -> DataFrame:
    """Number of other nodes from which each node can be reached, itself not counted; nodes that nothing reaches have 0.

    No pair is ever written: which sources of a block reach a node are bits of a few numbers, and only their count is kept.
    """
    e = _slim(edges)
    count = e.count()
    if count <= most_local:

        def run(g: whole.Graph, shares: set[int], parts: int):
            yield g.rows(reached=whole.cascades(g, shares, parts))

        parts = whole.on_graph(e, run, f"id {_kind(e)}, reached long", _shares(e, count // 50))
        found = parts.groupBy("id").agg((F.sum("reached") - 1).alias("cascade"))
    else:
        found = _cascades_by_blocks(e, words)
    return found if vertices is None else vertices.select("id").distinct().join(found, "id", "left").fillna(0, ["cascade"])


def _cascades_by_blocks(edges: DataFrame, words: int) -> DataFrame:
    """The same for graphs of any size: for a block of sources at a time, bits are joined along the edges between components until nothing changes."""
    parts = checkpointed(components(edges))
    side = lambda end, name: parts.select(F.col("id").alias(end), F.col("component").alias(name))
    between = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()
    between = checkpointed(between)
    blocks = max(1, -(-parts.count() // (64 * words)))
    # even blocks by the hash of the id, and within a block each source a bit of its own by rank
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    placed = parts.withColumn("block", block).withColumn("bit", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1)
    placed = checkpointed(placed.withColumn("slice", F.floor(F.col("bit") / (64 * words)).cast("int")).withColumn("bit", F.col("bit") % (64 * words)))
    total = None
    names = [f"w{i}" for i in range(words)]
    for b, s in [tuple(r) for r in placed.select("block", "slice").distinct().orderBy("block", "slice").collect()]:  # a row for 64 * words sources
        own = placed.where((F.col("block") == b) & (F.col("slice") == s))
        mine = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(n) for i, n in enumerate(names)]
        state = checkpointed(own.groupBy("component").agg(*mine))
        front = state
        while front.limit(1).count():
            pushed = between.join(front, between["a"] == front["component"]).groupBy("b").agg(*[F.bit_or(n).alias(f"p_{n}") for n in names])
            merged = state.join(pushed.withColumnRenamed("b", "component"), "component", "full")
            joined = [F.coalesce(F.col(n), F.lit(0).cast("long")).bitwiseOR(F.coalesce(F.col(f"p_{n}"), F.lit(0).cast("long"))).alias(n) for n in names]
            changed = F.lit(False)
            for n in names:
                changed = changed | (F.coalesce(F.col(f"p_{n}"), F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(F.coalesce(F.col(n), F.lit(0).cast("long")))) != 0)
            new = checkpointed(merged.select("component", *joined, changed.alias("changed")))
            state, front = new.select("component", *names), new.where("changed").select("component", *names)
        reached = sum((F.bit_count(n).cast("long") for n in names), F.lit(0).cast("long"))
        counts = state.select("component", reached.alias("reached"))
        total = counts if total is None else total.unionByName(counts)
        total = checkpointed(total.groupBy("component").agg(F.sum("reached").alias("reached")))
    return parts.join(total, "component").select("id", (F.col("reached") - 1).alias("cascade"))


def cascade_top(edges: DataFrame, top: int = 30, samples: int = 5) -> DataFrame:
    """The nodes with the largest cascades, their direct dependents and the first of these by id."""
    scores = checkpointed(cascade_scores(edges).orderBy(F.desc("cascade"), "id").limit(top))
    direct = edges.where("src <> dst").select("src", F.col("dst").alias("id")).distinct().join(F.broadcast(scores.select("id")), "id")  # `top` rows
    counts = direct.groupBy("id").agg(F.count("*").alias("direct"))
    # a limit per group is kept in each task before the shuffle
    first = direct.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("src"))).where(F.col("n") <= samples)
    named = first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("src")), ", ").alias("samples"))
    return scores.join(counts, "id", "left").join(named, "id", "left").select("id", "cascade", "direct", "samples")


def components(edges: DataFrame, most: int = 10_000, most_local: int = MOST_LOCAL_EDGES) -> DataFrame:
    """Strongly connected component of each node, named by its smallest node.

    Up to `most_local` edges in one pass. Beyond, nodes that nothing enters or leaves are taken off while that takes a good part
    of them; then by colouring: the smallest id that reaches a node is its colour, the nodes of that colour
    that reach the smallest node back are its component. They are taken out, edges between colours are dropped, and as soon as the rest is small it is done in one pass.
    """
    nodes = checkpointed(vertices_of(edges))
    e = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    done = nodes.select("id", F.col("id").alias("component")).limit(0)
    steps = 0

    def step() -> None:
        nonlocal steps
        steps += 1
        if steps > most:
            raise ArithmeticError(f"components aren't complete after {most} steps")

    def within(e: DataFrame, nodes: DataFrame) -> DataFrame:
        return checkpointed(e.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"))

    while True:
        if e.count() <= most_local:
            kind = _kind(e)

            def run(g: whole.Graph, shares: set[int], parts: int):
                names = whole.components(g)
                g_names = [g.ids[i] for i in names.tolist()]
                yield whole.pa.RecordBatch.from_arrays([whole.pa.array(g.ids, g.kind), whole.pa.array(g_names, g.kind)], ["id", "component"])

            found = checkpointed(whole.on_graph(e, run, f"id {kind}, component {kind}"))
            alone = nodes.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
            return done.unionByName(found).unionByName(alone)
        count, left = None, nodes.count()
        while count is None or left < 0.9 * count:
            step()
            count = left
            inner = checkpointed(e.select(F.col("src").alias("id")).distinct().intersect(e.select(F.col("dst").alias("id")).distinct()))
            done = checkpointed(done.unionByName(nodes.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))))
            nodes, e = inner, within(e, inner)
            left = nodes.count()
        if not left:
            return done
        if e.count() <= most_local and most_local:
            continue
        colour = nodes.withColumn("c", F.col("id"))
        while True:
            step()
            pushed = e.join(colour, e["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("p"))
            new = checkpointed(colour.join(pushed, "id", "left").select("id", F.least("c", F.coalesce("p", "c")).alias("c"), (F.col("p") < F.col("c")).alias("moved")))
            colour = new.select("id", "c")
            if not new.where("moved").limit(1).count():
                break
        side = lambda end, name, colour=colour: colour.select(F.col("id").alias(end), F.col("c").alias(name))
        e = checkpointed(e.join(side("src", "cs"), "src").join(side("dst", "cd"), "dst").where("cs = cd").select("src", "dst"))
        back = front = checkpointed(colour.where("id = c").select("id", "c"))
        while True:
            step()
            front = checkpointed(e.join(front, e["dst"] == front["id"]).select(F.col("src").alias("id"), "c").distinct().join(back, "id", "left_anti"))
            if not front.limit(1).count():
                break
            back = checkpointed(back.unionByName(front))
        done = checkpointed(done.unionByName(back.select("id", F.col("c").alias("component"))))
        nodes = checkpointed(nodes.join(back, "id", "left_anti"))
        if not nodes.limit(1).count():
            return done
        e = within(e, nodes)


def betweenness(edges: DataFrame, sources: int | None = None, weighted: bool = False, normalised: bool = True, most_local: int = MOST_LOCAL_EDGES, most_held: int = MOST_HELD_EDGES) -> DataFrame:
    """Shares of shortest paths through each node, from all sources or the first `sources` in a fixed random order; with `weighted`, weights are lengths.

    Tasks hold the graph whole, up to `most_local` edges, and sources are spread over them. Beyond that, with all sources, they hold components of
    up to as many edges, and of larger ones, up to `most_held` edges in all, numbers alone. What is larger, and a larger graph with some sources only, is followed by joins, level by level for a block of sources at a time;
    lengths other than one aren't supported beyond `most_local`.
    """
    e, count = _packed(edges.select("src", "dst", *(["weight"] if weighted else [])))
    if count > most_local:
        return _betweenness_by_components(e, sources, weighted, normalised, most_local, most_held)

    def run(g: whole.Graph, shares: set[int], parts: int):
        used = g.n if sources is None else min(sources, g.n)
        scale = (g.n / used) / (max((g.n - 1) * (g.n - 2), 1) if normalised else 1)
        yield g.rows(b=whole.betweenness(g, shares, parts, sources, weighted) * scale)

    parts = whole.on_graph(e, run, f"id {_kind(e)}, b double", _shares(e, count))
    return parts.groupBy("id").agg(F.sum("b").alias("betweenness"))


def _betweenness_by_components(e: DataFrame, sources: int | None, weighted: bool, normalised: bool, most_local: int, most_held: int) -> DataFrame:
    """No path leaves a component: those that a task may hold are worked out there with their own sources, the others as numbers or by joins."""
    if weighted and sources is not None:
        raise ValueError(f"more than {most_local} edges; with weights as lengths and chosen sources this measure takes no more")
    by = parted(e, most_local) if sources is None else Parted(None, e)
    if by.large is not None and weighted:
        raise ValueError(f"a component of more than {most_local} edges; with weights as lengths this measure takes no larger one")
    if by.large is not None and (by.ids is None or by.edges > most_held):
        large = _betweenness_by_levels(by.large, sources, normalised and by.small is None)
        if by.small is None:
            return large
    elif by.large is not None:
        large = _betweenness_of_rows(held(by.large.select("src", "dst"), by.ids, (0, 1)))

    def run(g: whole.Graph, shares: set[int], parts: int):
        yield g.rows(b=whole.betweenness(g, shares, parts, None, weighted))

    found = by.work(run, f"id {_kind(e)}, b double", STEPS_PER_SHARE).groupBy("id").agg(F.sum("b").alias("betweenness")) if by.small is not None else None
    if by.large is not None:
        found = large if found is None else found.unionByName(large)
    return found.withColumn("betweenness", F.col("betweenness") / max((by.nodes - 1) * (by.nodes - 2), 1)) if normalised else found


def _betweenness_of_rows(h: Held) -> DataFrame:
    """Every task holds all edges both ways and takes a part of the sources."""
    n = h.n

    def run(ways: dict[int, whole.Rows], part: int, parts: int):
        yield whole.rows_of(k=np.arange(n, dtype=np.int32), betweenness=whole.betweenness_of_rows(ways[0], ways[1], np.arange(part, n, parts)))

    return h.named(h.work(run, "betweenness double").groupBy("k").agg(F.sum("betweenness").alias("betweenness")))


#: Sources whose paths are followed at once by joins.
SOURCES_AT_ONCE = 256


def _betweenness_by_levels(edges: DataFrame, sources: int | None, normalised: bool) -> DataFrame:
    """Counts of shortest paths go forward level by level, dependencies come back the same way; a row for each source and node it reaches."""
    e = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = checkpointed(vertices_of(edges))
    n = nodes.count()
    used = n if sources is None else min(sources, n)
    ranked = nodes.select("id", F.md5(F.col("id").cast("string")).alias("h"))
    chosen = checkpointed(ranked.orderBy("h", "id").limit(used) if sources is not None else ranked)
    blocks = -(-used // SOURCES_AT_ONCE)
    total = None
    for block in range(blocks):
        front = checkpointed(chosen.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
        seen, levels = front.select("s", "v"), [front]
        while True:
            ahead = front.join(e, front["v"] == e["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
            front = checkpointed(ahead.join(seen, ["s", "v"], "left_anti"))
            if not front.limit(1).count():
                break
            levels.append(front)
            seen = checkpointed(seen.unionByName(front.select("s", "v")))
        below = None
        for level in reversed(levels):
            if below is None:
                below = level.withColumn("share", F.lit(0.0))
                continue
            after = below.select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            steps = level.join(e, level["v"] == e["src"]).select("s", "v", "paths", F.col("dst").alias("w")).join(after, ["s", "w"])
            given = steps.groupBy("s", "v").agg(F.sum(F.col("paths") * F.col("part")).alias("share"))
            mine = below.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("b"))
            total = checkpointed((mine if total is None else total.unionByName(mine)).groupBy("id").agg(F.sum("b").alias("b")))
            below = checkpointed(level.join(given, ["s", "v"], "left").fillna(0.0, ["share"]))
    scale = (n / max(used, 1)) / (max((n - 1) * (n - 2), 1) if normalised else 1)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    return nodes.join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def louvain(edges: DataFrame, most_local: int = MOST_LOCAL_EDGES) -> DataFrame:
    """Communities by modularity on the undirected graph, the same on every run (ties to the smaller community), numbered by size.

    A graph of more than `most_local` edges is first made smaller by rounds of moves over all nodes at once, community by community.
    """
    e = _slim(edges)
    members = None
    while e.count() > most_local:
        moved = _grouped_moves(e)
        side = lambda end, name, moved=moved: moved.select(F.col("id").alias(end), F.col("community").alias(name))
        weight = F.sum(F.col("weight").cast("double") if "weight" in e.columns else F.lit(1.0)).alias("weight")
        smaller = checkpointed(e.join(side("src", "a"), "src").join(side("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(weight))
        members = moved if members is None else checkpointed(members.join(side("community", "next"), "community").select("id", F.col("next").alias("community")))
        if smaller.count() > 0.9 * e.count():
            break
        e = smaller

    def run(g: whole.Graph, shares: set[int], parts: int):
        yield g.rows(community=whole.louvain(g).astype("int32"))

    if e.count() <= most_local:
        found = whole.on_graph(e, run, f"id {_kind(e)}, community int")
        return found if members is None else members.withColumnRenamed("community", "c").join(found.withColumnRenamed("id", "c"), "c").select("id", "community")
    # as small as moves can make it: communities numbered by size and smallest node
    sizes = members.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    numbered = sizes.withColumn("k", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "m")) - 1).cast("int"))
    return members.join(numbered.select("community", "k"), "community").select("id", F.col("k").alias("community"))


SUITE_COLUMNS = ("id", "in_degree", "out_degree", "total_degree", "pagerank", "hub", "authority", "triangles", "clustering", "cascade", "component", "betweenness", "community")


def suite(edges: DataFrame, most_local: int = MOST_LOCAL_EDGES, most_flat: int = MOST_FLAT_EDGES, most_held: int = MOST_HELD_EDGES) -> DataFrame:
    """All measures of the nodes (SUITE_COLUMNS) of edges with weight, each pair once; PageRank and HITS until they hardly change.

    Beyond `most_local` edges the measures that don't leave a component come from one pass over the components, and the two ranks, which
    bind all nodes, from one task that holds up to `most_flat` edges as they come. Up to `most_held` edges with a larger component, every task
    holds all edges as numbers. A graph that is larger goes measure by measure.
    """
    e, count = _packed(edges.select("src", "dst", "weight"))
    by = parted(e, most_local) if most_local < count <= max(most_flat, most_held) else Parted(None, None)
    if by.every is not None and by.large is not None and count <= most_held:
        return _suite_of_rows(held(e, by.every, (0, 1, 2), True), most_local)
    if by.small is None or by.large is not None or count > most_flat:
        e = checkpointed(e)
        parts = [
            degree_metrics(e), pagerank(e, weighted=True, tolerance=1e-9, most_local=most_local), hits(e, None, most_local=most_local), clustering(e, most_local).drop("degree"), cascade_scores(e, most_local=most_local),
            components(e, most_local=most_local), betweenness(e, most_local=most_local), louvain(e, most_local),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, "id", "left")
        return out.select(*SUITE_COLUMNS)
    kind, total = _kind(e), 2 * (e.where("src <> dst").agg(F.sum(F.col("weight").cast("double"))).first()[0] or 0.0)
    counts = ("in_degree", "out_degree", "degree", "triangles", "cascade")

    def within(g: whole.Graph, shares: set[int], parts: int):
        columns = [pa.array(whole.betweenness(g, shares, parts, None, False))]
        if 0 in shares:  # the others share sources of betweenness alone
            degree, triangles = whole.triangles(g)
            numbers = np.bincount(g.dst, minlength=g.n), np.bincount(g.src, minlength=g.n), degree, triangles, whole.cascades(g, {0}, 1) - 1
            own = whole.louvain(g, total)
            first = np.unique(own, return_index=True)[1]
            named = ([g.ids[i] for i in at.tolist()] for at in (whole.components(g), first[own]))
            columns += [*(pa.array(x.astype(np.int64)) for x in numbers), *(pa.array(x, g.kind) for x in named)]
        else:
            columns += [*(pa.nulls(g.n, pa.int64()) for _ in counts), pa.nulls(g.n, g.kind), pa.nulls(g.n, g.kind)]
        yield pa.RecordBatch.from_arrays([pa.array(g.ids, g.kind), *columns], ["id", "betweenness", *counts, "component", "label"])

    def ranks(g: whole.Flat):
        hub, authority = whole.hits(g, None, 1e-8, 5000)
        yield g.rows(pagerank=whole.pagerank(g, True, 0.85, None, 1e-9, 5000)[:-1], hub=hub, authority=authority)

    found = by.work(within, f"id {kind}, betweenness double, {', '.join(f'{c} long' for c in counts)}, component {kind}, label {kind}", STEPS_PER_SHARE)
    found = checkpointed(found.groupBy("id").agg(F.sum("betweenness").alias("betweenness"), *[F.max(c).alias(c) for c in (*counts, "component", "label")]))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label")
    names = found.groupBy("label").agg(F.count("*").alias("n")).select("label", (F.row_number().over(order) - 1).cast("int").alias("community"))
    both = whole.on_flat(e, count, ranks, f"id {kind}, pagerank double, hub double, authority double")
    out = found.join(names, "label").join(both, "id").withColumn("total_degree", F.col("in_degree") + F.col("out_degree")).withColumn("clustering", _coefficient())
    return out.withColumn("betweenness", F.col("betweenness") / max((by.nodes - 1) * (by.nodes - 2), 1)).select(*SUITE_COLUMNS)


def _suite_of_rows(h: Held, most_local: int) -> DataFrame:
    """Every task holds all edges as numbers: one works out what binds all nodes or takes one pass, and each of them a part of the sources of betweenness, and of the triangles."""
    n = h.n
    ways = Held(h.packed.where("way < 2"), h.numbers, n, {w: m for w, m in h.edges.items() if w < 2}, h.weights, h.kind)
    pairs = Held(h.packed.where("way = 2"), h.numbers, n, {2: h.edges[2]}, None, h.kind)
    longs, doubles, ints = ("in_degree", "out_degree", "cascade"), ("pagerank", "hub", "authority"), ("component_k", "community")

    def run(rows: dict[int, whole.Rows], part: int, parts: int):
        out, into = rows[0], rows[1]
        # the first part has the other measures and half as many sources as each other part
        share = (np.arange(n) % (2 * parts - 1) + 1) // 2
        columns = {"betweenness": whole.betweenness_of_rows(out, into, np.flatnonzero(share == part))}
        if part:
            own = [*columns.values(), *(pa.nulls(n, pa.int64()) for _ in longs), *(pa.nulls(n, pa.float64()) for _ in doubles), *(pa.nulls(n, pa.int32()) for _ in ints)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(n, dtype=np.int32), *own)], ["k", "betweenness", *longs, *doubles, *ints])
            return
        component = whole.components_of_rows(out, into, most_local)
        columns |= dict(zip(longs, (into.counts(), out.counts(), whole.cascades_of_rows(out, component) - 1)))
        community = whole.louvain_of_rows(out, into, most_local)
        order = np.argsort(out.begin + (out.counts() == 0) * len(out.heads), kind="stable")
        flat = whole.Flat(range(n), pa.int32(), np.repeat(order, out.counts()[order]).astype(out.heads.dtype), out.heads, out.weight)
        hub, authority = whole.hits(flat, None, 1e-8, 5000)
        columns |= dict(zip(doubles, (whole.pagerank(flat, True, 0.85, None, 1e-9, 5000)[:-1], hub, authority)))
        columns |= dict(zip(ints, (component.astype(np.int32), community.astype(np.int32))))
        yield whole.rows_of(k=np.arange(n, dtype=np.int32), **columns)

    schema = ", ".join(["betweenness double", *(f"{c} long" for c in longs), *(f"{c} double" for c in doubles), *(f"{c} int" for c in ints)])
    found = ways.work(run, schema).groupBy("k").agg(F.sum("betweenness").alias("betweenness"), *[F.max(c).alias(c) for c in (*longs, *doubles, *ints)])
    out = _clustering_of_rows(pairs).withColumn("clustering", _coefficient()).drop("degree").join(ways.named(found), "id")
    out = out.join(h.numbers.select(F.col("id").alias("component"), F.col("k").alias("component_k")), "component_k").withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    return out.withColumn("betweenness", F.col("betweenness") / max((n - 1) * (n - 2), 1)).select(*SUITE_COLUMNS)


def _grouped_moves(edges: DataFrame, rounds: int = 16, groups: int = 4) -> DataFrame:
    """(id, community) after rounds in which each node of one of `groups` by hash takes the neighbouring community with most gain, until modularity stops rising for all groups."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), weight.alias("w"))
    both = checkpointed(edges.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e")).select("e.*").groupBy("a", "b").agg(F.sum("w").alias("w")))
    degree = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d")))
    total = degree.agg(F.sum("d")).first()[0]
    labels, best, last = degree.select("id", "d", F.col("id").alias("community")), None, 0
    for k in range(rounds):
        sums = labels.groupBy("community").agg(F.sum("d").alias("held"))
        inner = both.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
        score = (inner.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] - sums.agg(F.sum(F.col("held") * F.col("held"))).first()[0] / total) / total
        if best is None or score > best[0] + 1e-9:
            best, last = (score, labels), k
        if k - last >= groups:
            break
        near = both.where("a <> b").join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("to"))
        own = labels.select("id", "d", F.col("community").alias("now"))
        choice = near.join(own, "id").join(sums, "community")
        held = F.col("held") - F.when(F.col("community") == F.col("now"), F.col("d")).otherwise(F.lit(0.0))
        gain = F.col("to") - held * F.col("d") / total
        picked = choice.groupBy("id").agg(F.max(F.struct(gain.alias("g"), (F.col("community") == F.col("now")).alias("stay"), "community")).alias("m"))
        turn = F.pmod(F.xxhash64("id") + k, F.lit(groups)) == 0
        labels = labels.join(picked, "id", "left").select("id", "d", F.when(turn & (F.col("m.g") > 0), F.col("m.community")).otherwise(F.col("community")).alias("community"))
        labels = checkpointed(labels)
    return best[1].select("id", "community")


def label_propagation(edges: DataFrame, most: int = 1000, most_local: int = MOST_LOCAL_EDGES) -> DataFrame:
    """Communities in which no node has more weight to another label than to its own; labels are ids they began with.

    A node changes only where another label has more weight, to the smallest of equals. Up to `most_local` edges nodes do so one
    after the other, so that the weight within labels only rises; beyond, half of them at once, another half by hash in each round.
    """
    e = _slim(edges)
    if e.count() <= most_local:
        kind = _kind(e)

        def run(g: whole.Graph, shares: set[int], parts: int):
            names = whole.label_propagation(g).tolist()
            yield whole.pa.RecordBatch.from_arrays([whole.pa.array(g.ids, g.kind), whole.pa.array([g.ids[i] for i in names], g.kind)], ["id", "community"])

        return whole.on_graph(e, run, f"id {kind}, community {kind}")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    both = e.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), weight.alias("w")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), weight.alias("w")))).alias("e")).select("e.*")
    both = checkpointed(both.groupBy("a", "b").agg(F.sum("w").alias("w")))
    labels, quiet = checkpointed(vertices_of(e).withColumn("community", F.col("id"))), 0
    for k in range(most):
        votes = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
        own = labels.select("id", F.col("community").alias("now"))
        ranked = votes.join(own, "id").groupBy("id", "now").agg(
            F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("m"), F.coalesce(F.sum(F.when(F.col("community") == F.col("now"), F.col("w"))), F.lit(0.0)).alias("held")
        )
        wants = checkpointed(ranked.where(-F.col("m.w") > F.col("held") + 1e-9).select("id", F.col("m.community").alias("to")))
        if not wants.limit(1).count():
            return labels
        moves = wants.where(F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(2)) == 0)
        labels = checkpointed(labels.join(moves, "id", "left").select("id", F.coalesce("to", "community").alias("community")))
    raise ArithmeticError(f"labels still change after {most} rounds")


def pagerank_within(
    members: DataFrame, edges: DataFrame, weighted: bool = True, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 5000, most_local: int = MOST_LOCAL_EDGES
) -> DataFrame:
    """PageRank (id, community, pagerank) in the subgraph that each community induces, all at once until none changes by its size * tolerance.

    Ranks sum to 1 in each community, and dangling mass stays in its own.
    """
    members = checkpointed(members.select("id", "community"))
    side = lambda end, name: members.select(F.col("id").alias(end), F.col("community").alias(name))
    weight = F.sum(F.col("weight").cast("double")) if weighted else F.lit(1.0)
    inner = edges.join(side("src", "cs"), "src").join(side("dst", "cd"), "dst").where("cs = cd").groupBy("src", "dst").agg(weight.alias("w"))
    inner = checkpointed(inner)
    if members.count() + inner.count() <= most_local:
        # a member is an edge to itself without weight, so that the task sees all of them with their communities
        kind, label = members.dtypes[0][1], members.dtypes[1][1]
        rows = members.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), "community").unionByName(inner, allowMissingColumns=True)

        def run(batches):
            yield from whole.ranks_within(batches, alpha, tolerance, most)

        return rows.repartition(1).mapInArrow(run, f"id {kind}, community {label}, pagerank double")
    e = checkpointed(inner.join(inner.groupBy("src").agg(F.sum("w").alias("out")), "src").select("src", "dst", (F.col("w") / F.col("out")).alias("p")))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    givers = e.select(F.col("src").alias("id")).distinct().withColumn("gives", F.lit(True))
    nodes = checkpointed(members.join(sizes, "community").join(givers, "id", "left"))
    ranks = nodes.withColumn("r", 1.0 / F.col("size"))
    for _ in range(most):
        lost = ranks.where("gives is null").groupBy("community").agg(F.sum("r").alias("lost"))
        moved = ranks.join(e, ranks["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("m"))
        given = F.coalesce("m", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("size")
        new = nodes.join(moved, "id", "left").join(lost, "community", "left").select("id", "community", "size", "gives", ((1 - alpha) / F.col("size") + alpha * given).alias("r"))
        new = checkpointed(new)
        change = new.join(ranks.select("id", F.col("r").alias("old")), "id").groupBy("community").agg((F.sum(F.abs(F.col("r") - F.col("old"))) / F.max("size")).alias("c")).agg(F.max("c")).first()[0]
        ranks = new
        if change is None or change < tolerance:
            return ranks.select("id", "community", F.col("r").alias("pagerank"))
    raise ArithmeticError(f"ranks still change after {most} steps")


def community_analysis(members: DataFrame, edges: DataFrame, sectors: DataFrame, listed: int = 10) -> DataFrame:
    """Per community: size, most frequent sector, the five most frequent with their counts, central node, and its first members.

    The central node has the largest PageRank in the subgraph of the community; ranks that are equal to ten places go to the smaller id.
    """
    members = checkpointed(members)
    rank = pagerank_within(members, edges.where("src <> dst")).select("id", F.round("pagerank", 10).alias("g"))
    rows = members.join(sectors, "id", "left").join(rank, "id").fillna("unknown", ["sector"])
    by = rows.groupBy("community", "sector").agg(F.count("*").alias("n")).groupBy("community").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "sector"))), 1, 5).alias("s"))
    listing = F.array_join(F.transform("s", lambda x: F.concat_ws("=", x["sector"], (-x["n"]).cast("string"))), ",")
    sector = by.select("community", F.col("s")[0]["sector"].alias("dominant_sector"), listing.alias("sectors"))
    # a limit per group is kept in each task before the shuffle
    first = rows.select("community", "id").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("id"))).where(F.col("r") <= listed)
    named = first.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ", ").alias("members"))
    out = rows.groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("g")).alias("g"), "id")).alias("m"))
    return out.join(sector, "community").join(named, "community").select("community", "size", "dominant_sector", "sectors", F.col("m.id").alias("central"), "members")


def articles_of_laws(citations: DataFrame, laws: DataFrame, confidences: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    """Article edges into `laws` (id) from citations of the given confidences, with weight and whether the citing law is one of them; no self loops."""
    laws = F.broadcast(checkpointed(laws))  # a top list
    held = citations.where(F.col("confidence").isin(*confidences)).join(laws.withColumnRenamed("id", "target_law_id"), "target_law_id", "left_semi")
    marked = held.join(laws.select(F.col("id").alias("source_law"), F.lit(True).alias("own")), "source_law", "left")
    ends = [article_id(F.col("source_law"), F.col("source_article")).alias("src"), article_id(F.col("target_law_id"), F.col("target_article")).alias("dst")]
    rows = marked.select(*ends, "own").where("src <> dst").groupBy("src", "dst")
    return rows.agg(F.count("*").alias("weight"), F.coalesce(F.max("own"), F.lit(False)).alias("source_in_top"))


def neighbourhood(edges: DataFrame, node) -> DataFrame:
    """The node and its neighbours either way."""
    near = edges.where((F.col("src") == F.lit(node)) | (F.col("dst") == F.lit(node)))
    return near.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def view_graph(edges: DataFrame, focus: str | None = None, most_nodes: int = 50, least_weight: float = 1) -> DataFrame:
    """Links to draw: of the nodes with most weight (those of `focus` where given), links with both ends kept and enough weight."""
    own = edges.where((law_of(F.col("src")) == focus) | (law_of(F.col("dst")) == focus)) if focus else edges
    weight = own.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("w"))
    kept = F.broadcast(weight.orderBy(F.desc("w"), "id").limit(most_nodes).select("id"))
    links = own.where(F.col("weight") >= least_weight).where("src <> dst")
    return links.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
