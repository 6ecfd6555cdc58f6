"""Measures of graphs of proven size, each worked out on the whole graph by tasks on the executors.

Edges are read batch by batch, ends are numbered as they come, and the graph is
kept as arrays: 16 bytes an edge. A measure that goes by source (betweenness,
cascades) is spread: each task gets the graph and a share of the sources.
Nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of bit rows that a task holds for the sources of one block.
BLOCK_BYTES = 64_000_000


@dataclass
class Graph:
    """Ids in order, and for each edge the numbers of its ends and its weight, sorted by (src, dst), each pair once."""

    ids: list
    kind: pa.DataType
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        self.n = len(self.ids)
        self.first = np.searchsorted(self.src, np.arange(self.n + 1))

    def rows(self, **columns: np.ndarray) -> pa.RecordBatch:
        """All ids with the columns, one value each."""
        return pa.RecordBatch.from_arrays([pa.array(self.ids, self.kind), *(pa.array(c) for c in columns.values())], ["id", *columns])


def build(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], numbers: dict, kind: pa.DataType) -> Graph:
    """The graph of edge arrays by provisional numbers; weights of a pair that comes again are added."""
    empty = np.empty(0, np.int32)
    src, dst = (np.concatenate([empty, *(p[i] for p in parts)]) for i in (0, 1))
    weight = np.concatenate([np.empty(0), *(p[2] for p in parts)])
    ids = sorted(numbers)
    place = np.empty(len(ids), np.int32)
    place[[numbers[v] for v in ids]] = np.arange(len(ids), dtype=np.int32)
    src, dst = place[src], place[dst]
    order = np.lexsort((dst, src))
    src, dst, weight = src[order], dst[order], weight[order]
    if len(src):
        head = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]))
        src, dst, weight = src[head], dst[head], np.add.reduceat(weight, head)
    return Graph(ids, kind, src, dst, weight)


def on_graph(edges: DataFrame, run: Callable[[Graph, set[int], int], Iterator[pa.RecordBatch]], schema: str, parts: int = 1) -> DataFrame:
    """What `run` yields of the graph and a set of shares, of `parts` in all; each share is in the set of one task."""
    held = edges.select("src", "dst", F.col("weight").cast("double").alias("weight") if "weight" in edges.columns else F.lit(1.0).alias("weight"))
    if parts > 1:
        held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "part")
    else:
        held = held.withColumn("part", F.lit(0)).repartition(1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict = {}
        pieces, shares, own, kind = [], set(), None, pa.string()
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy(zero_copy_only=False)
            shares.update(np.unique(part).tolist())
            own = int(part[0]) if own is None else own
            batch = batch.filter(pa.array(part == own))  # a task that has two shares has the graph twice
            ends, kind = [], batch.schema.field("src").type
            for name in ("src", "dst"):
                codes = batch.column(name).dictionary_encode()
                known = np.array([numbers.setdefault(v, len(numbers)) for v in codes.dictionary.to_pylist()], np.int32)
                ends.append(known[codes.indices.to_numpy(zero_copy_only=False)])
            pieces.append((*ends, batch.column("weight").to_numpy(zero_copy_only=False)))
        if shares:
            yield from run(build(pieces, numbers, kind), shares, parts)

    return held.mapInArrow(task, schema)


@dataclass
class Flat:
    """The same without an order: numbers of the ends and weights as the edges came, each pair once. 16 bytes an edge, and no copy of any."""

    ids: list
    kind: pa.DataType
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        self.n = len(self.ids)

    rows = Graph.rows


def on_flat(edges: DataFrame, count: int, run: Callable[[Flat], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `run` yields of a graph of `count` edges (src, dst, weight), each pair once, in one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict = {}
        ends, weight, at, kind = (np.empty(count, np.int32), np.empty(count, np.int32)), np.empty(count), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("src").type
            for name, held in zip(("src", "dst"), ends):
                codes = batch.column(name).dictionary_encode()
                known = np.array([numbers.setdefault(v, len(numbers)) for v in codes.dictionary.to_pylist()], np.int32)
                held[at : at + batch.num_rows] = known[codes.indices.to_numpy(zero_copy_only=False)]
            weight[at : at + batch.num_rows] = batch.column("weight").to_numpy(zero_copy_only=False)
            at += batch.num_rows
        if at != count:
            raise ArithmeticError(f"{at} edges came, not {count}")
        if count:
            yield from run(Flat(list(numbers), kind, *ends, weight))

    return edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).repartition(1).mapInArrow(task, schema)


#: Edges along which values move at once, so that no array of all of them is made.
MOVED_AT_ONCE = 1_000_000


def moved(to: np.ndarray, values: np.ndarray, along: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The sum at each node `to` of the values at the nodes `along`, times the weights."""
    total = np.zeros(n)
    for i in range(0, max(len(to), 1), MOVED_AT_ONCE):
        own = slice(i, i + MOVED_AT_ONCE)
        total += np.bincount(to[own], values[along[own]] if weight is None else values[along[own]] * weight[own], n)
    return total


# --- larger graphs as rows of numbers, of which every task gets all


#: Blocks of rows that are packed for themselves, and edges that a task packs at once.
BLOCKS, PACKED_AT_ONCE = 64, 2_000_000
PACKED = "way int, block int, n int, first long, size int, keys binary, kind string, weights binary"


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _stretched(held: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(held, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same values in the smallest type that holds them exactly."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if len(values) == 0 or (0 <= values.min() and values.max() <= np.iinfo(kind).max and (values == np.floor(values)).all()):
            return values.astype(kind)
    return values


def _piece(way: int, block: int, keys: np.ndarray, weights: np.ndarray | None) -> dict:
    """A row of PACKED: sorted keys as gaps."""
    gaps = _narrow(np.diff(keys))
    weights = np.empty(0, np.uint8) if weights is None else _narrow(weights)
    return {
        "way": way, "block": block, "n": len(keys), "first": int(keys[0]), "size": gaps.dtype.itemsize, "keys": _squeezed(gaps), "kind": weights.dtype.name, "weights": _squeezed(weights) if len(weights) else None,
    }


def _keys(row: dict) -> np.ndarray:
    gaps = _stretched(row["keys"], f"<u{row['size']}" if row["size"] < 8 else "<i8", row["n"] - 1) if row["n"] > 1 else np.empty(0, np.int64)
    return np.cumsum(np.concatenate([[row["first"]], gaps]), dtype=np.int64)


def _once(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted, each key once; weights of a key that comes again are added."""
    if not len(keys):
        return keys, weights
    if weights is None:
        keys = np.sort(keys)
        return keys[np.concatenate([[True], keys[1:] != keys[:-1]])], None
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(weights, head)


def block_width(n: int) -> int:
    return max(1, -(-n // BLOCKS))


def packed_pieces(batches: Iterator[pa.RecordBatch], n: int, ways: tuple[int, ...], weighted: bool) -> Iterator[pa.RecordBatch]:
    """Of edges (a, b[, weight]) between the numbers below n: pieces of PACKED by way (0: from a to b, 1: from b to a, 2: from the smaller to the larger, without loops)."""

    def ended(held: list) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([h[i] for h in held]).astype(np.int64) for i in (0, 1))
        weights = np.concatenate([h[2] for h in held]) if weighted else None
        for way in ways:
            if way == 2:
                keep = a != b
                keys = np.minimum(a, b)[keep] * n + np.maximum(a, b)[keep]
            else:
                keep, keys = slice(None), b * n + a if way else a * n + b
            if not len(keys):
                continue
            keys, own = _once(keys, weights[keep] if weighted else None)
            block = keys // (n * block_width(n))
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            rows = [_piece(way, int(block[i]), keys[i:j], own[i:j] if weighted else None) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield from pa.Table.from_pylist(rows, _PIECES).to_batches()

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", *(["weight"] if weighted else []))))
        rows += batch.num_rows
        if rows > PACKED_AT_ONCE:
            yield from ended(held)
            held, rows = [], 0
    if held:
        yield from ended(held)


_PIECES = pa.schema([("way", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("kind", pa.string()), ("weights", pa.binary())])


def merged_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of PACKED for each way and block of a task's rows."""
    held: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            held[row["way"], row["block"]].append(row)
    for way, block in sorted(held):
        rows = held.pop((way, block))
        weighted = rows[0]["weights"] is not None
        weights = np.concatenate([_stretched(r["weights"], r["kind"], r["n"]) for r in rows]).astype(float) if weighted else None
        yield from pa.Table.from_pylist([_piece(way, block, *_once(np.concatenate([_keys(r) for r in rows]), weights))], _PIECES).to_batches()


@dataclass
class Rows:
    """For each number below n the numbers it leads to, in order: those of v lie from begin[v] to end[v]. 4 bytes an edge (2 where n is small), and its weight in the type that holds all of them."""

    n: int
    begin: np.ndarray
    end: np.ndarray
    heads: np.ndarray
    weight: np.ndarray | None

    def counts(self) -> np.ndarray:
        return self.end - self.begin

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """All numbers that the nodes lead to, row after row."""
        heads = self.heads
        found = [heads[i:j] for i, j in zip(self.begin[nodes].tolist(), self.end[nodes].tolist())]
        return np.concatenate(found, dtype=np.intp) if found else np.empty(0, np.intp)

    def tails(self) -> np.ndarray:
        """The number that each edge leaves, in the order of `heads`."""
        order = np.argsort(self.begin, kind="stable")
        order = order[self.counts()[order] > 0]
        return np.repeat(order.astype(np.int32), self.counts()[order])


def on_rows(packed: DataFrame, n: int, edges: dict[int, int], weights: str | None, run: Callable[[dict[int, Rows], int, int], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """What `run` yields of all rows by way, a part, and the number of parts. edges: how many each way has; weights: the type that holds every weight."""
    columns = packed.columns
    every = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartitionById(parts, F.col("part")).select("part", *columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {way: Rows(n, np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(m, np.uint16 if n <= 1 << 16 else np.int32), np.empty(m, weights) if weights else None) for way, m in edges.items()}
        at, part = dict.fromkeys(edges, 0), None
        for batch in batches:
            for row in batch.to_pylist():
                part, way, keys = row["part"], row["way"], _keys(row)
                g, i, first = held[way], at[way], row["block"] * block_width(n)
                last = min(first + block_width(n), n)
                bounds = np.searchsorted(keys, np.arange(first, last + 1) * n)
                g.begin[first:last], g.end[first:last] = i + bounds[:-1], i + bounds[1:]
                g.heads[i : i + row["n"]] = keys % n
                if weights:
                    g.weight[i : i + row["n"]] = _stretched(row["weights"], row["kind"], row["n"])
                at[way] += row["n"]
        if part is None:
            return
        if at != edges:
            raise ArithmeticError(f"{at} edges came, not {edges}")
        yield from run(held, part, parts)

    return every.mapInArrow(task, schema)


def rows_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


#: Keys that are turned at once.
TURNED_AT_ONCE = 1_000_000


def triangles_of_rows(up: Rows, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a part of all nodes: degrees (the whole of them in part 0), and the triangles whose node of lowest degree is in this part, at each of their three nodes.

    `up` leads from the smaller to the larger number of each pair, and isn't of use afterwards.
    """
    n, m = up.n, len(up.heads)
    degree = up.counts().copy()
    for i in range(0, m, TURNED_AT_ONCE):
        degree += np.bincount(up.heads[i : i + TURNED_AT_ONCE], minlength=n)
    by_rank = np.lexsort((np.arange(n), degree))
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    keys, at = np.empty(m, np.int64), 0
    wide = np.append(np.flatnonzero(np.diff(np.cumsum(up.counts()) // TURNED_AT_ONCE)) + 1, n)
    start = 0
    for stop in wide.tolist():
        nodes = np.arange(start, stop)
        heads, tails = rank[up.of(nodes)], np.repeat(rank[nodes], up.counts()[nodes])
        keys[at : at + len(heads)] = np.minimum(heads, tails) * n + np.maximum(heads, tails)
        at, start = at + len(heads), stop
    keys.sort()
    first = np.searchsorted(keys, np.arange(n + 1) * n)
    heads = up.heads
    for i in range(0, m, TURNED_AT_ONCE):
        heads[i : i + TURNED_AT_ONCE] = keys[i : i + TURNED_AT_ONCE] % n
    del keys
    higher = Rows(n, first[:-1], first[1:], heads, None)
    sizes, found, near = np.diff(first), np.zeros(n, np.int64), np.zeros(n, bool)
    for u in range(part, n, parts):
        if sizes[u] < 2:
            continue
        own = heads[first[u] : first[u + 1]]
        near[own] = True
        for i in range(0, len(own), 1_000):
            middle = own[i : i + 1_000]
            reached = higher.of(middle)
            closed = np.flatnonzero(near[reached])
            if len(closed):
                found[u] += len(closed)
                ends = np.cumsum(sizes[middle])
                found[middle] += np.diff(np.searchsorted(closed, ends), prepend=0)
                np.add.at(found, reached[closed], 1)
        near[own] = False
    triangles = np.empty(n, np.int64)
    triangles[by_rank] = found
    return degree if part == 0 else np.zeros(n, np.int64), triangles


# --- components that are worked out for themselves


def weak(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each node, without regard to direction."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((after := label[label]) != label).any():
            label = after


def _contracted(table: pa.Table) -> pa.Table:
    """(id, root, m) with a row for each id of (id, root, m): the smallest id it is joined to, and the sum of m."""
    ends = pa.chunked_array([*table["id"].chunks, *table["root"].chunks], table["id"].type).combine_chunks()
    if isinstance(ends, pa.ChunkedArray):
        ends = ends.chunk(0)
    codes = ends.dictionary_encode()
    order = pa.compute.sort_indices(codes.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    ids, at = codes.dictionary.take(order), place[codes.indices.to_numpy(zero_copy_only=False)]
    a, b = at[: table.num_rows], at[table.num_rows :]
    m = np.bincount(a, table["m"].to_numpy(), len(ids)).astype(np.int64)
    return pa.table({"id": ids, "root": ids.take(pa.array(weak(len(ids), a, b))), "m": m})


#: Edges that are taken at once when they are contracted.
CONTRACTED_AT_ONCE = 500_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (src, dst): (id, root, m) that join the same nodes, with the edges that leave each id."""
    pieces, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pieces.append(pa.table({"id": batch.column("src"), "root": batch.column("dst"), "m": np.ones(batch.num_rows, np.int64)}))
        rows += batch.num_rows
        if rows > CONTRACTED_AT_ONCE:
            pieces, rows = [_contracted(pa.concat_tables(pieces))], 0
    if pieces:
        yield from _contracted(pa.concat_tables(pieces)).to_batches()


def parted(batches: Iterator[pa.RecordBatch], bin_edges: int) -> Iterator[pa.RecordBatch]:
    """Of all rows of `forest`: (id, component, bin, edges, nodes), the last two of the component; components follow one another in bins of `bin_edges` or one component."""
    pieces, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pieces.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows > CONTRACTED_AT_ONCE:
            pieces, rows = [_contracted(pa.concat_tables(pieces))], 0
    if not pieces:
        return
    found = _contracted(pa.concat_tables(pieces))
    codes = found["root"].combine_chunks().dictionary_encode()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    own = codes.indices.to_numpy(zero_copy_only=False)
    edges, nodes = np.bincount(own, found["m"].to_numpy()).astype(np.int64), np.bincount(own)
    bins = (np.cumsum(edges) - edges) // bin_edges
    columns = {"id": found["id"], "component": own.astype(np.int64), "bin": bins[own], "edges": edges[own], "nodes": nodes[own]}
    yield from pa.table(columns).to_batches()


def on_components(edges: DataFrame, run: Callable[[Graph, set[int], int], Iterator[pa.RecordBatch]], schema: str, tasks: int) -> DataFrame:
    """What `run` yields of each component of edges (src, dst, weight, component, bin, part, parts), one after the other as they come sorted."""
    rows = edges.repartition(tasks, "bin", "part").sortWithinPartitions("component", "part")

    def ended(pieces: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(pieces)
        ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], table["src"].type).combine_chunks()
        ends = ends.chunk(0) if isinstance(ends, pa.ChunkedArray) else ends
        codes = ends.dictionary_encode()
        at, n = codes.indices.to_numpy(zero_copy_only=False).astype(np.int32), table.num_rows
        numbers = {v: i for i, v in enumerate(codes.dictionary.to_pylist())}
        graph = build([(at[:n], at[n:], table["weight"].to_numpy())], numbers, ends.type)
        yield from run(graph, {table["part"][0].as_py()}, table["parts"][0].as_py())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            component, part = (batch.column(c).to_numpy() for c in ("component", "part"))
            cuts = np.flatnonzero((component[1:] != component[:-1]) | (part[1:] != part[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = int(component[start]), int(part[start])
                if pieces and key != last:
                    yield from ended(pieces)
                    pieces = []
                pieces.append(pa.Table.from_batches([batch.slice(start, end - start)]))
                last = key
        if pieces:
            yield from ended(pieces)

    return rows.mapInArrow(task, schema)


# --- ranks


def pagerank(g: Graph | Flat, weighted: bool, alpha: float, iterations: int | None, tolerance: float, most: int, also: int = 0) -> np.ndarray:
    """Ranks of all nodes, and of `also` more that no edge touches (they share the dangling mass; the last value is theirs)."""
    w = g.weight if weighted else None
    out = moved(g.src, np.ones(g.n), g.src, g.n, w)
    share = np.divide(1.0, out, out=np.zeros(g.n), where=out != 0)
    n = g.n + also
    ranks, apart = np.full(g.n, 1.0 / n), 1.0 / n
    for _ in range(iterations or most):
        lost = ranks[out == 0].sum() + also * apart
        new = (1 - alpha) / n + alpha * (moved(g.dst, ranks * share, g.src, g.n, w) + lost / n)
        new_apart = (1 - alpha) / n + alpha * lost / n
        change = np.abs(new - ranks).sum() + also * abs(new_apart - apart)
        ranks, apart = new, new_apart
        if iterations is None and change < n * tolerance:
            break
    else:
        if iterations is None:
            raise ArithmeticError(f"ranks still change after {most} steps")
    return np.append(ranks, apart)


def hits(g: Graph | Flat, iterations: int | None, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    hub = np.full(g.n, 1.0 / max(g.n, 1))
    for _ in range(iterations or most):
        authority = moved(g.dst, hub, g.src, g.n)
        new = moved(g.src, authority / authority.sum(), g.dst, g.n)
        new /= new.sum()
        change, hub = np.abs(new - hub).sum(), new
        if iterations is None and change < tolerance:
            break
    else:
        if iterations is None:
            raise ArithmeticError(f"hubs still change after {most} steps")
    authority = moved(g.dst, hub, g.src, g.n)
    return hub, authority / authority.sum()


# --- components and cascades


def components(g: Graph) -> np.ndarray:
    """Strongly connected component of each node, as the smallest number in it; one pass over the edges, without recursion."""
    first, dst = g.first.tolist(), g.dst.tolist()
    number, low, component = [-1] * g.n, [0] * g.n, [-1] * g.n
    at, stack, count = first[:-1].copy(), [], 0
    for root in range(g.n):
        if number[root] >= 0:
            continue
        path = [root]
        number[root] = low[root] = count
        count += 1
        stack.append(root)
        while path:
            v = path[-1]
            if at[v] < first[v + 1]:
                w = dst[at[v]]
                at[v] += 1
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    path.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                members = []
                while True:
                    w = stack.pop()
                    members.append(w)
                    if w == v:
                        break
                name = min(members)
                for w in members:
                    component[w] = name
    return np.array(component, np.int64)


def places(nodes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from bounds[v] to bounds[v + 1] of the nodes v in order, and how many each has."""
    counts = bounds[nodes + 1] - bounds[nodes]
    return np.repeat(bounds[nodes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()), counts


def _levels(n: int, src: np.ndarray, dst: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of an acyclic graph, by length of the longest path to a node: the nodes, their incoming edges' sources, and where each node's begin."""
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    left = np.bincount(dst, minlength=n)
    into = np.searchsorted(dst, np.arange(n + 1))
    by_src = np.argsort(src, kind="stable")
    out, heads = np.searchsorted(src[by_src], np.arange(n + 1)), dst[by_src]
    ready, levels = np.flatnonzero(left == 0), []
    while len(ready):
        reached, counts = np.unique(heads[places(ready, out)[0]], return_counts=True)
        left[reached] -= counts
        ready = reached[left[reached] == 0]
        if len(ready):
            sizes = into[ready + 1] - into[ready]
            levels.append((ready, src[places(ready, into)[0]], np.cumsum(sizes) - sizes))
    return levels


def cascades(g: Graph, shares: set[int], parts: int, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Number of nodes of this task's sources from which each node can be reached, itself included where it is one of them.

    A bit row for each component holds which sources of a block reach it; rows are joined along the edges between components, level by level.
    """
    names, component = np.unique(components(g), return_inverse=True)
    src, dst = component[g.src], component[g.dst]
    pairs = np.unique(np.stack([src, dst])[:, src != dst], axis=1)
    return _reaching(component, len(names), pairs[0], pairs[1], np.flatnonzero(np.isin(np.arange(g.n) % parts, list(shares))), block_bytes)


def _reaching(component: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, own: np.ndarray, block_bytes: int) -> np.ndarray:
    """For each node the number of the nodes `own` that reach its component, by the edges between the n components."""
    levels = _levels(n, src, dst)
    words = max(1, block_bytes // 8 // max(n, len(src), 1))
    total = np.zeros(n, np.int64)
    for start in range(0, len(own), 64 * words):
        block = own[start : start + 64 * words]
        bits = np.zeros((n, -(-len(block) // 64)), np.uint64)
        at = np.arange(len(block))
        np.bitwise_or.at(bits, (component[block], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        for nodes, before, begins in levels:
            bits[nodes] |= np.bitwise_or.reduceat(bits[before], begins, axis=0)
        total += np.bitwise_count(bits).sum(1, dtype=np.int64)
    return total[component]


# --- triangles


#: Nodes of a graph that may be kept as a matrix, and cells of it for each edge at most.
MOST_DENSE, CELLS_AN_EDGE = 3_000, 32


def is_dense(g: Graph) -> bool:
    """Whether products of the matrix of the graph take less than steps along its edges."""
    return g.n <= MOST_DENSE and g.n * g.n <= CELLS_AN_EDGE * len(g.src)


def triangles(g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """Degree and number of triangles of each node on the undirected graph; edges point to the node of higher degree."""
    keep = g.src != g.dst
    a, b = np.minimum(g.src[keep], g.dst[keep]), np.maximum(g.src[keep], g.dst[keep])
    a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
    degree = np.bincount(a, minlength=g.n) + np.bincount(b, minlength=g.n)
    if is_dense(g):
        near = np.zeros((g.n, g.n), np.float32)
        near[a, b] = near[b, a] = 1
        common = near @ near  # exact: counts of at most MOST_DENSE
        return degree, ((common * near).sum(1, dtype=np.float64) / 2).astype(np.int64)
    rank = np.empty(g.n, np.int64)
    rank[np.lexsort((np.arange(g.n), degree))] = np.arange(g.n)
    up = rank[a] < rank[b]
    tails, heads = np.where(up, a, b), np.where(up, b, a)
    order = np.argsort(tails, kind="stable")
    heads, first = heads[order], np.searchsorted(tails[order], np.arange(g.n + 1))
    found, near = np.zeros(g.n, np.int64), np.zeros(g.n, bool)
    for u in np.flatnonzero(np.diff(first) > 1).tolist():
        own = heads[first[u] : first[u + 1]]
        near[own] = True
        at, counts = places(own, first)
        closed = near[heads[at]]
        near[own] = False
        if closed.any():
            found[u] += closed.sum()
            np.add.at(found, np.repeat(own, counts)[closed], 1)
            np.add.at(found, heads[at][closed], 1)
    return degree, found


# --- betweenness


def _unweighted(g: Graph, start: int) -> np.ndarray:
    """Dependencies of the source on each node, level by level over all edges of a level at once."""
    distance, paths = np.full(g.n, -1), np.zeros(g.n)
    distance[start], paths[start] = 0, 1.0
    frontier, levels = np.array([start]), []
    while len(frontier):
        at, counts = places(frontier, g.first)
        tails, heads = np.repeat(frontier, counts), g.dst[at]
        new = distance[heads] < 0
        tails, heads = tails[new], heads[new]  # to nodes that no shorter path reaches
        frontier = np.unique(heads)
        distance[frontier] = len(levels) + 1
        paths += np.bincount(heads, paths[tails], g.n)
        levels.append((tails, heads))
    share = np.zeros(g.n)
    for tails, heads in reversed(levels):
        share += np.bincount(tails, paths[tails] / paths[heads] * (1 + share[heads]), g.n)
    share[start] = 0.0
    return share


def _dense(g: Graph, sources: np.ndarray, at_once: int = 256) -> np.ndarray:
    """The sum of `_unweighted` over the sources, by products of matrices for `at_once` of them."""
    edge, total = np.zeros((g.n, g.n)), np.zeros(g.n)
    edge[g.src, g.dst] = 1
    for i in range(0, len(sources), at_once):
        own = sources[i : i + at_once]
        rows = np.arange(len(own))
        distance, paths, level = np.full((len(own), g.n), -1), np.zeros((len(own), g.n)), 0
        distance[rows, own], paths[rows, own] = 0, 1.0
        while True:
            ahead = np.where(distance == level, paths, 0.0) @ edge
            new = (distance < 0) & (ahead > 0)
            if not new.any():
                break
            level += 1
            distance[new], paths[new] = level, ahead[new]
        share = np.zeros((len(own), g.n))
        for k in range(level, 0, -1):
            part = np.divide(1 + share, paths, out=np.zeros_like(share), where=distance == k)
            share += np.where(distance == k - 1, paths * (part @ edge.T), 0.0)
        share[rows, own] = 0.0
        total += share.sum(0)
    return total


def _weighted(g: Graph, start: int, first: list[int], heads: list[int], lengths: list[float]) -> np.ndarray:
    """The same with weights as lengths."""
    paths, before, order = [0.0] * g.n, [[] for _ in range(g.n)], []
    distance, settled = [float("inf")] * g.n, [False] * g.n
    distance[start], paths[start] = 0.0, 1.0
    heap = [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if settled[v]:
            continue
        settled[v] = True
        order.append(v)
        for i in range(first[v], first[v + 1]):
            w, new = heads[i], d + lengths[i]
            if new < distance[w] - 1e-12:
                distance[w], paths[w], before[w] = new, paths[v], [v]
                heapq.heappush(heap, (new, w))
            elif not settled[w] and abs(new - distance[w]) <= 1e-12:
                paths[w] += paths[v]
                before[w].append(v)
    share = [0.0] * g.n
    for w in reversed(order):
        part = (1 + share[w]) / paths[w]
        for v in before[w]:
            share[v] += paths[v] * part
    share[start] = 0.0
    return np.array(share)


def first_sources(ids: list, most: int | None) -> np.ndarray:
    """Numbers of the first `most` ids in an order that is as good as random, the same on every run: by MD5 of the id as text."""
    if most is None or most >= len(ids):
        return np.arange(len(ids))
    return np.array(sorted(range(len(ids)), key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))[:most])


def betweenness(g: Graph, shares: set[int], parts: int, sources: int | None, weighted: bool) -> np.ndarray:
    if not weighted and is_dense(g):
        chosen = first_sources(g.ids, sources)
        return _dense(g, chosen[np.isin(np.arange(len(chosen)) % parts, list(shares))])
    total, lists = np.zeros(g.n), (g.first.tolist(), g.dst.tolist(), g.weight.tolist()) if weighted else ()
    for k, s in enumerate(first_sources(g.ids, sources).tolist()):
        if k % parts in shares:
            total += _weighted(g, s, *lists) if weighted else _unweighted(g, s)
    return total


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, so many for each count; 0 for a count of 0."""
    total, some = np.zeros(len(counts)), counts > 0
    if some.any():
        total[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return total


#: Edges of less than this share of all nodes are followed without arrays of all nodes; edges that are followed at once, so that their values stay in a cache.
FEW, FOLLOWED_AT_ONCE = 1 / 8, 100_000


def _cut(nodes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Consecutive nodes of so many edges, their counts, and their places."""
    ends = np.cumsum(counts)
    cuts = np.searchsorted(ends, np.arange(FOLLOWED_AT_ONCE, ends[-1] if len(ends) else 0, FOLLOWED_AT_ONCE)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(nodes)]):
        if i < j:
            yield nodes[i:j], counts[i:j], slice(i, j)


def _gathered(rows: Rows, nodes: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of the nodes the sum of the values that its row leads to."""
    total = np.zeros(len(nodes))
    for own, n, at in _cut(nodes, counts):
        total[at] = _sums(values[rows.of(own)], n)
    return total


def _scattered(rows: Rows, nodes: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For all numbers the sum of the values of those of the nodes whose rows lead to it."""
    total = np.zeros(rows.n)
    for own, n, at in _cut(nodes, counts):
        np.add.at(total, rows.of(own), np.repeat(values[at], n))
    return total


def betweenness_of_rows(out: Rows, into: Rows, sources: np.ndarray) -> np.ndarray:
    """The sum of `_unweighted` over the sources, on rows of both ways.

    A level is found along the edges that leave the one before, or along those that enter nodes not reached yet, and dependencies
    come back along those that leave the one before or those that enter the level: whichever are fewer. So a level of nearly all nodes
    is followed along all its edges neither way. Where the nodes not reached yet were the last level for the source before, their
    dependencies are summed up with their paths, and hold if they are again.
    """
    n, outs, ins = out.n, out.counts(), into.counts()
    total, ahead, every, entered = np.zeros(n), np.zeros(n), int(ins.sum()), ins > 0
    at_once = False
    for s in sources.tolist():
        level, paths, share = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        level[s], paths[s] = 0, 1.0
        fronts, open_, last = [np.array([s])], every - int(ins[s]), None
        while open_:
            front = fronts[-1]
            steps = int(outs[front].sum())
            if steps < FEW * n and steps <= open_:
                new, at = np.unique(out.of(front), return_inverse=True)
                own = level[new] < 0
                new, sums = new[own], np.bincount(at, np.repeat(paths[front], outs[front]), len(new))[own]
            elif steps <= open_:
                sums = _scattered(out, front, outs[front], paths[front])
                new = np.flatnonzero((level < 0) & (sums > 0))
                sums = sums[new]
            else:
                new = np.flatnonzero((level < 0) & entered)
                ahead[front] = paths[front]
                if at_once:
                    last, sums = np.zeros(n), np.zeros(len(new))
                    for own, counts, at in _cut(new, ins[new]):
                        tails = into.of(own)
                        sums[at] = _sums(ahead[tails], counts)
                        np.add.at(last, tails, np.repeat(np.divide(1.0, sums[at], out=np.zeros(len(own)), where=sums[at] > 0), counts))
                else:
                    sums = _gathered(into, new, ins[new], ahead)
                ahead[front] = 0.0
                own = sums > 0
                at_once = bool(own.all())
                if not at_once:
                    new, sums, last = new[own], sums[own], None
            if not len(new):
                break
            level[new], paths[new] = len(fronts), sums
            open_ -= int(ins[new].sum())
            fronts.append(new)
        for k in range(len(fronts) - 1, 1, -1):
            own, before = fronts[k], fronts[k - 1]
            part = (1 + share[own]) / paths[own]
            if k == len(fronts) - 1 and last is not None:
                share[before] = paths[before] * last[before]
            elif outs[before].sum() <= ins[own].sum():
                ahead[own] = part
                share[before] = paths[before] * _gathered(out, before, outs[before], ahead)
                ahead[own] = 0.0
            else:
                share[before] = paths[before] * _scattered(into, own, ins[own], part)[before]
        total += share
    return total


# --- other measures on rows of both ways


def _reach(rows: Rows, start: int, allowed: np.ndarray) -> np.ndarray:
    """Which of the allowed nodes the start leads to, itself among them."""
    seen, counts, front = np.zeros(rows.n, bool), rows.counts(), np.array([start])
    seen[start] = True
    while len(front):
        new = np.zeros(rows.n, bool)
        for own, _, _ in _cut(front, counts[front]):
            new[rows.of(own)] = True
        new &= allowed & ~seen
        seen |= new
        front = np.flatnonzero(new)
    return seen


def _peeled(rows: Rows, degree: np.ndarray, left: np.ndarray) -> None:
    """Takes off `left` what none of it leads to, again and again."""
    counts = rows.counts()
    degree = degree.copy()
    front = np.flatnonzero(left & (degree == 0))
    while len(front):
        left[front] = False
        touched = np.zeros(rows.n, np.int64)
        for own, _, _ in _cut(front, counts[front]):
            touched += np.bincount(rows.of(own), minlength=rows.n)
        degree -= touched
        front = np.flatnonzero(left & (degree == 0) & (touched > 0))


def _inner(rows: Rows, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ends of the edges between nodes that are left."""
    nodes, counts = np.flatnonzero(left), rows.counts()
    for own, n, _ in _cut(nodes, counts[nodes]):
        heads, tails = rows.of(own), np.repeat(own, n)
        keep = left[heads]
        yield tails[keep], heads[keep]


def components_of_rows(out: Rows, into: Rows, most_local: int) -> np.ndarray:
    """Strongly connected component of each node, as the smallest number in it.

    What nothing enters or leaves is alone; of the rest the component of the node with most edges is what it leads to and what leads to it, until `most_local` edges are left.
    """
    n, component, left = out.n, np.arange(out.n), np.ones(out.n, bool)
    while left.any():
        for rows in (out, into):
            degree = np.zeros(n, np.int64)
            for a, b in _inner(rows, left):
                degree += np.bincount(b, minlength=n)
            _peeled(rows, degree, left)
        ends = [(a, b) for a, b in _inner(out, left)] if sum(len(a) for a, _ in _inner(out, left)) <= most_local else None
        if ends is not None:
            if ends:
                a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
                names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                g = Graph(names.tolist(), pa.int64(), at[: len(a)], at[len(a) :], np.ones(len(a)))
                component[names] = names[components(g)]
            return component
        start = int(np.argmax(np.where(left, np.minimum(out.counts(), into.counts()), -1)))
        own = _reach(out, start, left) & _reach(into, start, left)
        component[own] = np.flatnonzero(own)[0]
        left &= ~own
    return component


def cascades_of_rows(out: Rows, component: np.ndarray, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """What `cascades` gives of all sources, by the components."""
    names, at = np.unique(component, return_inverse=True)
    keys = np.empty(0, np.int64)
    for a, b in _inner(out, np.ones(out.n, bool)):
        new = (at[a] * len(names) + at[b])[at[a] != at[b]]
        if len(new):
            keys = np.unique(np.concatenate([keys, new]))
    return _reaching(at, len(names), keys // len(names), keys % len(names), np.arange(out.n), block_bytes)


def _level_of_rows(out: Rows, into: Rows, degree: np.ndarray, total: float) -> np.ndarray:
    """What `_one_level` gives, with degrees that hold inner weights."""
    own, inside, to, gains_now = np.arange(out.n), degree.copy(), np.zeros(out.n), True
    bounds = [x.tolist() for x in (out.begin, out.end, into.begin, into.end)]
    while gains_now:
        gains_now = False
        if len(names := np.unique(own)) * out.n <= MOST_TABLE_CELLS:
            return _level_by_table(out, into, degree, total, own, names, bounds)
        for v, (i, j, k, m) in enumerate(zip(*bounds)):
            near, weight = np.concatenate((out.heads[i:j], into.heads[k:m]), dtype=np.intp), np.concatenate((out.weight[i:j], into.weight[k:m]), dtype=float)
            others = own[near]
            if not len(near):
                continue
            np.add.at(to, others, weight)
            now = own[v]
            if len(at := np.flatnonzero(near == v)):
                to[now] -= weight[at].sum()
            inside[now] -= degree[v]
            gain = to[others] - inside[others] * degree[v] / total
            if len(at):
                gain[at] = -np.inf
            best = gain.max()
            if best > to[now] - inside[now] * degree[v] / total + 1e-9:
                now = own[v] = others[gain == best].min()
                gains_now = True
            inside[now] += degree[v]
            to[others] = 0.0
    return own


#: Nodes times communities from which on the weight from each node to each community is kept.
MOST_TABLE_CELLS = 16_000_000


def _level_by_table(out: Rows, into: Rows, degree: np.ndarray, total: float, own: np.ndarray, names: np.ndarray, bounds: list[list[int]]) -> np.ndarray:
    """The rest of the same moves, in the same order, from a table of the weights between nodes and communities: the next node that gains is looked for among many at once."""
    n, size = out.n, len(names)
    at, table = np.searchsorted(names, own), np.zeros((n, size))
    flat = table.reshape(-1)
    for rows in (out, into):
        counts = rows.counts()
        for nodes, c, _ in _cut(np.arange(n), counts):
            heads, tails = rows.of(nodes), np.repeat(nodes, c)
            weight = np.concatenate([rows.weight[i:j] for i, j in zip(rows.begin[nodes].tolist(), rows.end[nodes].tolist())], dtype=float)
            keep = heads != tails
            np.add.at(flat, (tails * size + at[heads])[keep], weight[keep])
    inside, (out_begin, out_end, in_begin, in_end) = np.bincount(at, degree, size), bounds
    gains_now = True
    while gains_now:
        gains_now, v, many = False, 0, 32
        while v < n:
            rows = slice(v, v + many)
            to, own_degree, places = table[rows], degree[rows], at[rows]
            gain = to - inside * own_degree[:, None] / total
            gain[to <= 0] = -np.inf  # no neighbour there
            each = np.arange(len(places))
            now = to[each, places] - (inside[places] - own_degree) * own_degree / total
            gain[each, places] = now
            best = gain.argmax(1)
            moves = gain[each, best] > now + 1e-9
            first = int(moves.argmax())
            if not moves[first]:
                v, many = v + many, min(2 * many, 2_048)
                continue
            v, gains_now, many = v + first, True, 32
            old, new = int(at[v]), int(best[first])
            i, j, k, m = out_begin[v], out_end[v], in_begin[v], in_end[v]
            near, weight = np.concatenate((out.heads[i:j], into.heads[k:m]), dtype=np.intp), np.concatenate((out.weight[i:j], into.weight[k:m]), dtype=float)
            keep = near != v
            near, weight = near[keep] * size, weight[keep]
            np.subtract.at(flat, near + old, weight)
            np.add.at(flat, near + new, weight)
            inside[old] -= degree[v]
            inside[new] += degree[v]
            at[v] = new
            v += 1
    return names[at]


def louvain_of_rows(out: Rows, into: Rows, most_local: int) -> np.ndarray:
    """What `louvain` gives, on rows with weights; once there are at most `most_local` edges between communities it goes on with these."""
    member, loops = np.arange(out.n), False
    while True:
        degree = np.zeros(out.n)
        for rows in (out, into):
            counts = rows.counts()
            for nodes, c, at in _cut(np.arange(out.n), counts):
                weight = np.concatenate([rows.weight[i:j] for i, j in zip(rows.begin[nodes].tolist(), rows.end[nodes].tolist())], dtype=float)
                degree[at] += _sums(weight if loops else np.where(rows.of(nodes) == np.repeat(nodes, c), 0.0, weight), c)
        total = degree.sum() or 1.0
        names, own = np.unique(_level_of_rows(out, into, degree, total), return_inverse=True)
        member, size = own[member], len(names)
        keys, sums, held, waiting = np.empty(0, np.int64), np.empty(0), [], 0
        for nodes, c, _ in _cut(np.arange(out.n), out.counts()):
            heads, tails = out.of(nodes), np.repeat(nodes, c)
            weight = np.concatenate([out.weight[i:j] for i, j in zip(out.begin[nodes].tolist(), out.end[nodes].tolist())], dtype=float)
            keep = slice(None) if loops else heads != tails
            held.append((own[tails[keep]] * size + own[heads[keep]], weight[keep]))
            waiting += len(heads)
            if waiting > PACKED_AT_ONCE:
                held, waiting = [_once(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))], 0
        if held:
            keys, sums = _once(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        if size == out.n or len(keys) <= most_local:
            near: list[dict[int, float]] = [defaultdict(float) for _ in range(size)]
            if size < out.n:
                for a, b, w in zip((keys // size).tolist(), (keys % size).tolist(), sums.tolist(), strict=True):
                    near[a][b] += w
                    near[b][a] += w
                return _levels_of_louvain(near, member, total)
            return _levels_of_louvain([], member, total)
        turned = keys % size * size + keys // size
        order = np.argsort(turned)
        ways = []
        for k, w in ((keys, sums), (turned[order], sums[order])):
            first = np.searchsorted(k, np.arange(size + 1) * size)
            ways.append(Rows(size, first[:-1], first[1:], (k % size).astype(np.int32), w))
        (out, into), loops = ways, True


# --- communities


def louvain(g: Graph, total: float | None = None) -> np.ndarray:
    """Communities by modularity on the undirected graph: nodes in order, ties to the smaller community; numbered by size, then by smallest node.

    A component is given the `total` of the degrees of all, and its nodes move as they do in the whole graph.
    """
    keep = g.src != g.dst
    near: list[dict[int, float]] = [defaultdict(float) for _ in range(g.n)]
    for a, b, w in zip(g.src[keep].tolist(), g.dst[keep].tolist(), g.weight[keep].tolist(), strict=True):
        near[a][b] += w
        near[b][a] += w
    return _levels_of_louvain(near, np.arange(g.n), total)


def _levels_of_louvain(near: list[dict[int, float]], member: np.ndarray, total: float | None) -> np.ndarray:
    """Communities of all nodes, each of them a `member` of one of the nodes of `near`, when nothing gains any more."""
    while len(near):
        names, own = np.unique(_one_level(near, total), return_inverse=True)
        member = own[member]
        if len(names) == len(near):
            break
        merged: list[dict[int, float]] = [defaultdict(float) for _ in names]
        for v, row in enumerate(near):
            for w, x in row.items():
                merged[own[v]][int(own[w])] += x
        near = merged
    names, smallest, counts = np.unique(member, return_index=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((smallest, -counts))] = np.arange(len(names))
    return rank[member] if len(member) else member


def _one_level(near: list[dict[int, float]], total: float | None = None) -> list[int]:
    """Local moves until none gains; `near` is symmetric and holds inner weights on its diagonal."""
    own = list(range(len(near)))
    degree = [sum(row.values()) for row in near]
    inside, total = list(degree), total or sum(degree) or 1.0
    moved = True
    while moved:
        moved = False
        for v, row in enumerate(near):
            to: dict[int, float] = defaultdict(float)
            for w, x in row.items():
                if w != v:
                    to[own[w]] += x
            inside[own[v]] -= degree[v]
            gain = lambda c, to=to, v=v: to.get(c, 0.0) - inside[c] * degree[v] / total
            best = max(sorted({own[v], *to}), key=lambda c: (gain(c), -c))
            if gain(best) <= gain(own[v]) + 1e-9:
                best = own[v]
            inside[best] += degree[v]
            if best != own[v]:
                own[v], moved = best, True
    return own


def label_propagation(g: Graph) -> np.ndarray:
    """Labels that no node has more weight against than for; nodes in order, again and again, each to the heaviest label, the smallest of equals."""
    keep = g.src != g.dst
    a, b = np.concatenate([g.src[keep], g.dst[keep]]), np.concatenate([g.dst[keep], g.src[keep]])
    order = np.argsort(a, kind="stable")
    b, w = b[order], np.concatenate([g.weight[keep], g.weight[keep]])[order]
    first = np.searchsorted(a[order], np.arange(g.n + 1))
    label, moved = np.arange(g.n), True
    while moved:
        moved = False
        for v in range(g.n):
            near = label[b[first[v] : first[v + 1]]]
            if not len(near):
                continue
            names, inverse = np.unique(near, return_inverse=True)
            held = np.bincount(inverse, w[first[v] : first[v + 1]])
            best = int(np.argmax(held))
            own = held[names == label[v]]
            if held[best] > (own[0] if len(own) else 0.0) + 1e-9:
                label[v], moved = names[best], True
    return label


def ranks_within(batches: Iterator[pa.RecordBatch], alpha: float, tolerance: float, most: int) -> Iterator[pa.RecordBatch]:
    """PageRank in each community of rows (src, dst, w, community); only the rows of members, from a node to itself, name the community."""
    table = pa.Table.from_batches(list(batches))
    own = table.filter(pa.compute.is_valid(table["community"]))
    inner = table.filter(pa.compute.is_null(table["community"]))
    ids = own["src"].combine_chunks()
    place = {v: i for i, v in enumerate(ids.to_pylist())}
    codes = own["community"].combine_chunks().dictionary_encode()
    group, n_groups = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary)
    src, dst = (np.array([place[v] for v in inner[c].to_pylist()], np.int64) for c in ("src", "dst"))
    w, n = inner["w"].to_numpy().astype(float), len(ids)
    out, size = np.bincount(src, w, n), np.bincount(group, minlength=n_groups).astype(float)
    p, ranks = w / out[src], 1.0 / size[group]
    for _ in range(most):
        lost = np.bincount(group, np.where(out == 0, ranks, 0.0), n_groups) / size
        new = (1 - alpha) / size[group] + alpha * (np.bincount(dst, ranks[src] * p, n) + lost[group])
        change = (np.bincount(group, np.abs(new - ranks), n_groups) / size).max(initial=0.0)
        ranks = new
        if change < tolerance:
            yield pa.RecordBatch.from_arrays([ids, own["community"].combine_chunks(), pa.array(ranks)], ["id", "community", "pagerank"])
            return
    raise ArithmeticError(f"ranks still change after {most} steps")
