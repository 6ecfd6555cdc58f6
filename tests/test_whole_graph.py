"""The supplier queries without SQL read every edge: held against brute force over the lines of the smallest test tables."""

import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lexmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def pairs():
    lines = pq.read_table(f"{FOLDER}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"]).to_pylist()
    lines.sort(key=lambda r: (r["l_orderkey"], r["l_linenumber"], r["l_suppkey"], r["l_partkey"], r["l_returnflag"]))
    return Counter((x["l_suppkey"], y["l_suppkey"]) for x, y in zip(lines, lines[1:]) if x["l_orderkey"] == y["l_orderkey"] and x["l_suppkey"] != y["l_suppkey"])


def brute_betweenness(pairs):
    """By counting paths: distances and numbers of shortest paths of all pairs."""
    ids = sorted({i for p in pairs for i in p})
    inf = float("inf")
    d = {(a, b): 0 if a == b else 1 if (a, b) in pairs else inf for a in ids for b in ids}
    for k in ids:
        for a in ids:
            for b in ids:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    paths = {(a, a): 1 for a in ids}
    for a in ids:
        for b in sorted((b for b in ids if 0 < d[a, b] < inf), key=lambda b: d[a, b]):
            paths[a, b] = sum(paths[a, v] for v in ids if (v, b) in pairs and d[a, v] + 1 == d[a, b])
    n = len(ids)
    return {v: sum(paths[a, v] * paths[v, b] / paths[a, b] for a in ids for b in ids if len({a, b, v}) == 3 and d[a, v] + d[v, b] == d[a, b] < inf) / ((n - 1) * (n - 2)) for v in ids}


def test_betweenness(spark, pairs):
    wanted = brute_betweenness(pairs)
    for name in ("betweenness", "betweenness_sampled"):  # fewer nodes than sources
        got = {r.id: r.betweenness for r in catalogue.queries()[name](spark, FOLDER).collect()}
        assert got == pytest.approx(wanted, abs=1e-7)


def test_cascade_top(spark, pairs):
    into = Counter(b for _, b in pairs)
    got = {r.id: r.direct for r in catalogue.queries()["cascade_top"](spark, FOLDER).collect()}
    assert got == dict(into)


def test_metric_suite_degrees(spark, pairs):
    rows = catalogue.queries()["metric_suite"](spark, FOLDER).collect()
    assert {(r.id, r.in_degree, r.out_degree) for r in rows} == {(i, sum(b == i for _, b in pairs), sum(a == i for a, _ in pairs)) for i in {i for p in pairs for i in p}}
