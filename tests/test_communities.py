import pytest

from lexmill.operators import graph

#: "hub" is cited by many and cites "far" alone, with a light citation; "often" is cited most, by one node that nobody cites. "out" is in another community.
EDGES = [*((f"n{i}", "hub", 1) for i in range(6)), ("hub", "far", 1), ("n0", "often", 9), ("out", "often", 50), ("out", "in", 1)]
COMMUNITY = {n: 0 for n in ("hub", "far", "often", *(f"n{i}" for i in range(6)))} | {"out": 1, "in": 1}


def brute(nodes, edges, alpha=0.85):
    r = {n: 1 / len(nodes) for n in nodes}
    given = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
    for _ in range(500):
        lost = sum(r[n] for n in nodes if not given[n]) / len(nodes)
        r = {n: (1 - alpha) / len(nodes) + alpha * (lost + sum(r[a] * w / given[a] for a, b, w in edges if b == n)) for n in nodes}
    return r


def test_central_and_sectors(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, weight long")
    members = spark.createDataFrame(list(COMMUNITY.items()), "id string, community int")
    wanted = {}
    for c in (0, 1):
        nodes = [n for n in COMMUNITY if COMMUNITY[n] == c]
        wanted |= brute(nodes, [e for e in EDGES if e[0] in nodes and e[1] in nodes])
    for most, near in ((10**6, 1e-10), (0, 1e-4)):
        got = {r.id: r.pagerank for r in graph.pagerank_within(members, edges, tolerance=near, most_local=most).collect()}
        assert got == pytest.approx(wanted, abs=10 * near)
    sectors = spark.createDataFrame([("hub", "b"), ("far", "b"), ("n0", "a"), ("n1", "a"), ("n2", "a"), ("n3", "c"), ("n4", "d"), ("n5", "e")], "id string, sector string")
    rows = {r.community: r for r in graph.community_analysis(members, edges, sectors).collect()}
    best = max((n for n in COMMUNITY if COMMUNITY[n] == 0), key=wanted.get)
    assert best == "far"  # "often" receives most inner weight
    assert (rows[0].central, rows[0].dominant_sector, rows[0].sectors, rows[0]["size"]) == ("far", "a", "a=3,b=2,c=1,d=1,e=1", 9)
    assert (rows[1].central, rows[1].sectors) == ("in", "unknown=2")
