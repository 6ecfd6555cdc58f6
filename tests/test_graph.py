import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import graph

EDGES = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("d", "e", 1), ("e", "d", 1), ("f", "f", 1), ("f", "a", 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight long")


def reach(node, out):
    seen, todo = set(), [node]
    while todo:
        for w in out.get(todo.pop(), ()):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def test_degrees_and_density(edges, spark):
    got = {r.id: (r.in_degree, r.out_degree) for r in graph.degree_metrics(edges, spark.createDataFrame([("z",)], "id string")).collect()}
    assert got["a"] == (2, 1) and got["z"] == (0, 0) and got["f"] == (1, 2)
    assert tuple(graph.density(edges).first()) == (6, 8, round(8 / 30, 6))
    assert tuple(graph.density(edges.limit(0)).first()) == (0, 0, 0.0)


def test_reach_components_cascade(edges):
    out = {}
    for s, d, _ in EDGES:
        out.setdefault(s, []).append(d)
    wanted = {(n, m) for n in "abcdef" for m in reach(n, out)}
    assert {tuple(r) for r in graph.reachability(edges).collect()} == wanted
    assert {r.id: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {r.id: r.cascade for r in graph.cascade_scores(edges).collect()} == {n: sum(1 for m in "abcdef" if m != n and n in reach(m, out)) for n in "abcdef"}
    top = graph.cascade_top(edges, 2).orderBy("id").collect()
    assert [(r.id, r.cascade, r.direct, r.samples) for r in top] == [("d", 5, 2, "c, e"), ("e", 5, 1, "d")]


def random_edges(seed, n=40, m=70):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(n):02d}"
    return sorted({(name(), name()) for _ in range(m)})


def test_beyond_the_local_bound(spark, seed=1):
    """Each measure by joins gives what it gives on the whole graph in one task, and components and cascades what plain search gives."""
    pairs = random_edges(seed)
    e = spark.createDataFrame([(a, b, 1 + i % 3) for i, (a, b) in enumerate(pairs)], "src string, dst string, weight long")
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    ids = sorted({i for p in pairs for i in p})
    ahead = {v: reach(v, out) for v in ids}
    wanted = {v: min([v, *(w for w in ids if w in ahead[v] and v in ahead[w])]) for v in ids}
    cascade = {v: sum(v in ahead[w] for w in ids if w != v) for v in ids}
    for most in (0, 10**6):
        assert {r.id: r.component for r in graph.components(e, most_local=most).collect()} == wanted
        assert {r.id: r.cascade for r in graph.cascade_scores(e, most_local=most, words=1).collect()} == cascade
    column = lambda df, c: {r["id"]: r[c] for r in df.collect()}
    for run, c in (
        (lambda most: graph.pagerank(e, iterations=7, weighted=True, most_local=most), "pagerank"),
        (lambda most: graph.hits(e, 5, most_local=most), "authority"),
        (lambda most: graph.betweenness(e, most_local=most), "betweenness"),
        (lambda most: graph.betweenness(e, sources=9, normalised=False, most_local=most), "betweenness"),
    ):
        assert column(run(0), c) == pytest.approx(column(run(10**6), c), abs=1e-12)


def test_a_long_chain_ends(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.components(chain).agg(F.countDistinct("component")).first()[0] == n + 1
    assert graph.cascade_scores(chain).where("cascade = id").count() == n + 1


def test_nothing_is_left_out_silently(edges):
    with pytest.raises(ArithmeticError):
        graph.components(edges, most=1, most_local=0)
    for most in (0, 10**6):
        with pytest.raises(Exception, match="still change"):
            graph.pagerank(edges, tolerance=0, most=3, most_local=most).collect()
    with pytest.raises(ArithmeticError):
        graph.reachability(edges, most=1)


def modularity(pairs, label):
    total, degree, inner = 0, {}, 0
    for a, b, w in pairs:
        for v in (a, b):
            degree[v] = degree.get(v, 0) + w
        inner += 2 * w * (label[a] == label[b])
        total += 2 * w
    held = {}
    for v, d in degree.items():
        held[label[v]] = held.get(label[v], 0) + d
    return inner / total - sum((x / total) ** 2 for x in held.values())


def test_large_graphs_are_made_smaller_first(spark):
    rng = random.Random(3)
    pairs = [(f"{g}{i}", f"{g}{j}", 1) for g in "abcd" for i in range(8) for j in range(i) if rng.random() < 0.8] + [("a0", "b0", 1), ("b1", "c1", 1), ("c2", "d2", 1)]
    e = spark.createDataFrame(pairs, "src string, dst string, weight long")
    one, many = ({r.id: r.community for r in graph.louvain(e, most).collect()} for most in (10**6, 60))
    assert len(many) == len(one)
    assert modularity(pairs, many) > 0.6 * modularity(pairs, one)


def test_labels_are_at_rest(spark):
    pairs = [(a, b, 1 + i % 4) for i, (a, b) in enumerate(random_edges(4, 30, 60)) if a != b]
    df = spark.createDataFrame(pairs, "src string, dst string, weight long")
    for most in (0, 10**6):
        got = {r.id: r.community for r in graph.label_propagation(df, most_local=most).collect()}
        for v in got:
            held = {}
            for a, b, w in pairs:
                if v in (a, b):
                    other = got[b if v == a else a]
                    held[other] = held.get(other, 0) + w
            assert held.get(got[v], 0) >= max(held.values())


def test_mutual(edges):
    assert [tuple(r) for r in graph.mutual_pairs(edges).collect()] == [("d", "e", 1, 1)]
    assert graph.mutual_pairs(edges, ["e"]).count() == 0


def test_pagerank_and_hits_sum_to_one(edges):
    for kind in ({"iterations": 12}, {"weighted": True}):
        ranks = {r.id: r.pagerank for r in graph.pagerank(edges, **kind).collect()}
        assert abs(sum(ranks.values()) - 1) < 1e-9 and len(ranks) == 6
    h = graph.hits(edges, 10).collect()
    assert abs(sum(r.hub for r in h) - 1) < 1e-9 and abs(sum(r.authority for r in h) - 1) < 1e-9
    assert graph.pagerank(edges.limit(0)).count() == 0


def test_betweenness_chain_and_star(spark):
    chain = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, weight long")
    assert {r.id: r.betweenness for r in graph.betweenness(chain, normalised=False).collect()} == {"a": 0, "b": 2, "c": 2, "d": 0}
    diamond = spark.createDataFrame([("a", "b", 1), ("a", "c", 5), ("b", "d", 1), ("c", "d", 1)], "src string, dst string, weight long")
    assert {r.id: r.betweenness for r in graph.betweenness(diamond, normalised=False).collect()} == {"a": 0, "b": 0.5, "c": 0.5, "d": 0}
    assert {r.id: r.betweenness for r in graph.betweenness(diamond, weighted=True, normalised=False).collect()} == {"a": 0, "b": 1, "c": 0, "d": 0}
    sampled = graph.betweenness(diamond, sources=100, normalised=False).collect()
    assert {r.id: r.betweenness for r in sampled} == {"a": 0, "b": 0.5, "c": 0.5, "d": 0}


def test_clustering(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string")
    for most in (0, 10**6):
        assert {r.id: (r.degree, r.triangles, r.clustering) for r in graph.clustering(e, most).collect()} == {"a": (2, 1, 1.0), "b": (2, 1, 1.0), "c": (3, 1, 0.333333), "d": (1, 0, 0.0)}
    dense = spark.createDataFrame([(i, j) for i in range(40) for j in range(40) if (i * j + i) % 3 == 1], "src int, dst int")
    one, many = (sorted(map(tuple, graph.clustering(dense, most).select("id", "degree", "triangles", "clustering").collect())) for most in (10**6, 0))
    assert one == many


def test_communities(spark):
    two = [(x, y, 5) for g in ("abcd", "efgh") for x in g for y in g if x < y] + [("a", "e", 1)]
    e = spark.createDataFrame(two, "src string, dst string, weight long")
    got = {r.id: r.community for r in graph.louvain(e).collect()}
    assert len(set(got.values())) == 2 and got["a"] == got["d"] != got["e"] == got["h"]
    spread = {r.id: r.community for r in graph.label_propagation(e).collect()}
    assert spread["b"] == spread["d"] and spread["f"] == spread["h"]
    sectors = spark.createDataFrame([("a", "x"), ("b", "x"), ("e", "y")], "id string, sector string")
    rows = {r.community: r for r in graph.community_analysis(graph.louvain(e), e, sectors).collect()}
    assert rows[0]["size"] == 4 and rows[0].members == "a, b, c, d"


def test_edge_aggregation(spark):
    rows = [("a", "9", "b", "high"), ("a", "10", "b", "medium"), ("a", "1", "b", "medium"), ("a", "2", "b", "medium"), ("a", "1", "a", "high"), ("a", "1", "unresolved", "high"), ("a", "1", "c", "low")]
    df = spark.createDataFrame(rows, "source_law string, source_article string, target_law_id string, confidence string")
    assert [tuple(r) for r in graph.edge_aggregation(df).collect()] == [("a", "b", 4, "high", "1, 10, 2", 4.0)]


def copies(spark, n=6, loops=True):
    """Several components, dense and thin ones, more edges in all than in any of them."""
    rng = random.Random(11)
    dense = [(f"{k}d{i}", f"{k}d{j}", 1 + (i + j) % 3) for k in range(n) for i in range(12) for j in range(12) if i != j and rng.random() < 0.5]
    thin = [(f"{k}t{i}", f"{k}t{rng.randrange(60)}", 1 + i % 4) for k in range(n) for i in range(60)]
    return spark.createDataFrame(sorted({(a, b): w for a, b, w in dense + thin if loops or a != b}.items()), "e struct<src: string, dst: string>, weight long").select("e.*", "weight").repartition(5)


def no_joins(*_, **__):
    raise AssertionError("components that a task may hold went through joins")


def test_clustering_by_components(spark, monkeypatch):
    """A graph of more edges than a task may hold is worked out by component; only components over that go through joins."""
    e = copies(spark)
    rows = lambda most: sorted(map(tuple, graph.clustering(e, most).select("id", "degree", "triangles", "clustering").collect()))
    wanted = rows(10**6)
    assert e.count() > 200 and rows(62) == wanted  # some components are larger, some aren't
    monkeypatch.setattr(graph, "_clustering_by_joins", no_joins)
    assert rows(200) == wanted


def one_large(spark, loops=True):
    """A component of a few hundred edges with hubs, ends and edges both ways, and a small one beside it."""
    rng = random.Random(5)
    pairs = {(f"n{min(rng.randrange(70), rng.randrange(70))}", f"n{rng.randrange(70)}") for _ in range(500)} | {(f"n{i}", f"m{i}") for i in range(9)} | {("x", "y"), ("y", "z"), ("z", "x")}
    rows = [(a, b, 1 + (len(a) * 7 + i) % 300) for i, (a, b) in enumerate(sorted(p for p in pairs if loops or p[0] != p[1]))]
    return spark.createDataFrame(rows, "src string, dst string, weight long").repartition(5)


def test_clustering_of_a_large_component(spark, monkeypatch):
    """A component of more edges than a task may hold as arrays is counted by tasks that hold it as numbers; joins give the same."""
    e = one_large(spark)
    rows = lambda most, **k: sorted(map(tuple, graph.clustering(e, most, **k).select("id", "degree", "triangles", "clustering").collect()))
    wanted = rows(10**6)
    assert rows(20, most_held=0) == wanted
    monkeypatch.setattr(graph, "_clustering_by_joins", no_joins)
    assert rows(20) == rows(0) == wanted and any(r[2] for r in wanted)
    alone = spark.createDataFrame([("a", "a"), ("b", "b")], "src string, dst string")
    assert sorted(map(tuple, graph.clustering(alone, 0).select("id", "degree", "triangles").collect())) == [("a", 0, 0), ("b", 0, 0)]


def test_betweenness_by_components(spark, monkeypatch):
    """The same with all sources, also where one component is given to several tasks; weights as lengths are left to components."""
    e = copies(spark)
    rows = lambda most, weighted=False: {r.id: r.betweenness for r in graph.betweenness(e, weighted=weighted, most_local=most).collect()}
    wanted = rows(10**6)
    assert rows(62) == pytest.approx(wanted, abs=1e-12)
    monkeypatch.setattr(graph, "_betweenness_by_levels", no_joins)
    monkeypatch.setattr(graph, "STEPS_PER_SHARE", 500)
    assert rows(200) == pytest.approx(wanted, abs=1e-12)
    assert rows(200, True) == pytest.approx(rows(10**6, True), abs=1e-12)


def test_betweenness_of_a_large_component(spark, monkeypatch):
    """A component of more edges than a task may hold as arrays is followed by tasks that hold it as numbers, from all sources; joins give the same."""
    e = one_large(spark)
    rows = lambda most, **k: {r.id: r.betweenness for r in graph.betweenness(e, most_local=most, **k).collect()}
    wanted = rows(10**6)
    assert rows(20, most_held=0, normalised=False) == pytest.approx(rows(10**6, normalised=False), abs=1e-9)
    monkeypatch.setattr(graph, "_betweenness_by_levels", no_joins)
    assert rows(20) == pytest.approx(wanted, abs=1e-12) and rows(0) == pytest.approx(wanted, abs=1e-12)


def test_betweenness_of_rows_either_way():
    """Levels and dependencies give the same whichever edges they are followed along, few or many at once."""
    from lexmill.operators import whole_graph as whole

    rng = np.random.default_rng(4)
    few, many = whole.FEW, whole.FOLLOWED_AT_ONCE
    try:
        for n, p in ((5, 0.5), (30, 0.05), (30, 0.2), (40, 0.5)):
            pairs = np.argwhere(rng.random((n, n)) < p)
            g = whole.build([(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), np.ones(len(pairs)))], {i: i for i in range(n)}, whole.pa.int64())
            ways = []
            for a, b in ((pairs[:, 0], pairs[:, 1]), (pairs[:, 1], pairs[:, 0])):
                keys = np.sort(a * n + b)
                first = np.searchsorted(keys, np.arange(n + 1) * n)
                ways.append(whole.Rows(n, first[:-1], first[1:], (keys % n).astype(np.uint16), None))
            for whole.FEW, whole.FOLLOWED_AT_ONCE in ((0, 3), (1 / 8, 100), (9, 10**6)):
                assert whole.betweenness_of_rows(*ways, np.arange(n)) == pytest.approx(sum(whole._unweighted(g, s) for s in range(n)), abs=1e-9)
    finally:
        whole.FEW, whole.FOLLOWED_AT_ONCE = few, many


def test_dense_products_as_steps_along_edges():
    """Triangles and betweenness of a dense graph by matrices are those by its edges, loops and sources without a way out among them."""
    from lexmill.operators import whole_graph as whole

    rng = np.random.default_rng(2)
    pairs = np.argwhere(rng.random((40, 40)) < 0.12)
    pairs = pairs[pairs[:, 0] != 3]
    g = whole.build([(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), np.ones(len(pairs)))], {i: i for i in range(40)}, whole.pa.int64())
    assert whole.is_dense(g)
    assert whole._dense(g, np.arange(40), 7) == pytest.approx(sum(whole._unweighted(g, s) for s in range(40)), abs=1e-9)
    dense, whole.CELLS_AN_EDGE = whole.triangles(g), 0
    try:
        thin = whole.triangles(g)
    finally:
        whole.CELLS_AN_EDGE = 32
    assert all((a == b).all() for a, b in zip(dense, thin)) and thin[1].any()


def test_suite_by_components(spark, monkeypatch):
    """A graph beyond a task's size with components within it gets all measures of the whole, without a step by joins, and the same communities."""
    e = copies(spark)
    rows = lambda most: {r.id: r for r in graph.suite(e, most).collect()}
    wanted = rows(10**6)
    for name in ("_pagerank_steps", "_clustering_by_joins", "_cascades_by_blocks", "_betweenness_by_levels", "_grouped_moves"):
        monkeypatch.setattr(graph, name, no_joins)
    monkeypatch.setattr(graph, "STEPS_PER_SHARE", 500)
    got = rows(200)
    assert got.keys() == wanted.keys()
    for c in graph.SUITE_COLUMNS:
        one, other = ({i: r[c] for i, r in x.items()} for x in (got, wanted))
        assert one == (pytest.approx(other, abs=1e-9) if isinstance(one["0d0"], float) else other), c


def test_suite_of_a_large_component(spark, monkeypatch):
    """All measures of the whole, the same communities among them, of a graph with a component of more edges than a task may hold as arrays."""
    e = one_large(spark)
    rows = lambda most: {r.id: r for r in graph.suite(e, most).collect()}
    wanted = rows(10**6)
    for name in ("_pagerank_steps", "_clustering_by_joins", "_cascades_by_blocks", "_betweenness_by_levels", "_grouped_moves"):
        monkeypatch.setattr(graph, name, no_joins)
    got = rows(100)
    assert got.keys() == wanted.keys()
    for c in graph.SUITE_COLUMNS:
        one, other = ({i: r[c] for i, r in x.items()} for x in (got, wanted))
        assert one == (pytest.approx(other, abs=1e-9) if isinstance(one["x"], float) else other), c


def test_measures_of_rows():
    """Components, cascades and communities on rows are those on arrays, whether communities are looked up or kept in a table, and of several levels."""
    from lexmill.operators import whole_graph as whole

    rng = np.random.default_rng(6)
    at_once, cells = whole.FOLLOWED_AT_ONCE, whole.MOST_TABLE_CELLS
    whole.FOLLOWED_AT_ONCE = 7
    try:
        for t in range(40):
            n = int(rng.integers(3, 60))
            pairs = np.argwhere(rng.random((n, n)) < rng.random() * (0.03, 0.1, 0.4)[t % 3])
            weight = rng.integers(1, 5, len(pairs)).astype(np.uint8)
            g = whole.Graph(list(range(n)), whole.pa.int64(), pairs[:, 0], pairs[:, 1], weight.astype(float))
            ways = []
            for a, b in ((pairs[:, 0], pairs[:, 1]), (pairs[:, 1], pairs[:, 0])):
                keys = a * n + b
                order = np.argsort(keys)
                first = np.searchsorted(keys[order], np.arange(n + 1) * n)
                ways.append(whole.Rows(n, first[:-1], first[1:], (keys[order] % n).astype(np.uint16), weight[order]))
            for most in (0, 5, 1000):
                component = whole.components_of_rows(*ways, most)
                assert (component == whole.components(g)).all() and (whole.cascades_of_rows(ways[0], component) == whole.cascades(g, {0}, 1)).all()
                for whole.MOST_TABLE_CELLS in (0, 10 * n, 10**6):
                    assert (whole.louvain_of_rows(*ways, most) == whole.louvain(g)).all()
    finally:
        whole.FOLLOWED_AT_ONCE, whole.MOST_TABLE_CELLS = at_once, cells
