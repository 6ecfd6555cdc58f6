import os

import numpy as np
import pytest

from lexmill.operators import graph
from lexmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_hits_converges(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "d")]
    ids = "abcd"
    m = np.zeros((4, 4))
    for s, d in pairs:
        m[ids.index(s), ids.index(d)] = 1
    h = np.full(4, 0.25)
    for _ in range(2000):
        h = m @ m.T @ h
        h /= h.sum()
    a = m.T @ h
    got = {r.id: (r.hub, r.authority) for r in graph.hits(spark.createDataFrame(pairs, "src string, dst string"), None).collect()}
    for i, name in enumerate(ids):
        assert got[name] == pytest.approx((h[i], a[i] / a.sum()), abs=1e-5)


@tables
def test_suite_is_whole(spark):
    edges = catalogue.supplier_edges(spark, FOLDER)
    rows = {r.id: r for r in catalogue.queries()["metric_suite"](spark, FOLDER).collect()}
    for column, df in {
        "betweenness": graph.betweenness(edges), "community": graph.louvain(edges), "pagerank": graph.pagerank(edges, weighted=True, tolerance=1e-9),
    }.items():
        assert {i: r[column] for i, r in rows.items()} == pytest.approx({r["id"]: r[column] for r in df.collect()}, abs=1e-7)


@tables
def test_articles(spark):
    """PageRank of the article graph held against brute force, betweenness beside it, hubs in order."""
    edges = [tuple(r) for r in catalogue.article_edges(spark, FOLDER).select("src", "dst", "weight").collect()]
    ids = sorted({i for s, d, _ in edges for i in (s, d)})
    place = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for s, d, w in edges:
        m[place[d], place[s]] += w
    out = m.sum(axis=0)
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        r = 0.15 / len(ids) + 0.85 * (m @ np.divide(r, out, out=np.zeros_like(r), where=out > 0) + r[out == 0].sum() / len(ids))
    got = {x.node_id: x.pagerank for x in catalogue.queries()["article_pagerank"](spark, FOLDER).collect()}
    assert got == pytest.approx(dict(zip(ids, r)), abs=1e-5) and sum(got.values()) == pytest.approx(1, abs=1e-4)
    between = catalogue.queries()["article_betweenness"](spark, FOLDER).collect()
    assert sorted(x.node_id for x in between) == ids
    hubs = [x.pagerank for x in catalogue.queries()["hub_top"](spark, FOLDER).collect()]
    assert len(hubs) == 20 and hubs == sorted(hubs, reverse=True)
