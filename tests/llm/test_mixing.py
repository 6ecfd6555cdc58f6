import random

import pytest

from lexmill.llm.mixing import Node, counted, distribute, mix, plan, shares
from lexmill.llm.tokens import counter


def tree():
    return Node(1.0, children={
        "a": Node(0.5, children={"es": Node(1.0, 10.0), "en": Node(1.0, 100.0)}),
        "b": Node(0.5, children={"es": Node(1.0, 1000.0)}),
    })


def test_shortage_goes_to_siblings_first():
    root = tree()
    root.prepare()
    distribute(root, 200.0)
    assert {p: n.budget for p, n in root.leaves()} == {("a", "es"): 10.0, ("a", "en"): 90.0, ("b", "es"): 100.0}
    distribute(root, 400.0)
    assert {p: n.budget for p, n in root.leaves()} == {("a", "es"): 10.0, ("a", "en"): 100.0, ("b", "es"): 290.0}


def loops(node, amount):
    """Budgets by small portions: at each step the child that is furthest behind its weight, and still has something, gets one."""
    if not node["children"]:
        return {(): amount}
    given = {name: 0.0 for name in node["children"]}
    low, high = 0.0, 1e12
    for _ in range(300):  # the amount per weight at which the children take `amount` together
        rate = (low + high) / 2
        taken = sum(min(c["capacity"], rate * c["weight"]) for c in node["children"].values())
        low, high = (rate, high) if taken < amount else (low, rate)
    given = {name: min(c["capacity"], high * c["weight"]) for name, c in node["children"].items()}
    return {(name, *rest): b for name, c in node["children"].items() for rest, b in loops(c, given[name]).items()}


def nested(rows, share, cap, power):
    """The tree of plain dictionaries for rows of (levels, tokens)."""
    root = {"children": {}, "tokens": 0.0, "capacity": 0.0}
    for *path, tokens in rows:
        if path[0] not in share:
            continue
        node, n = root, tokens * cap[path[0]]
        root["capacity"] += n
        for name in path:
            node = node["children"].setdefault(name, {"children": {}, "tokens": 0.0, "capacity": 0.0})
            node["tokens"] += tokens
            node["capacity"] += n

    def weigh(node, depth):
        for name, c in node["children"].items():
            c["weight"] = share[name] if depth == 0 else c["tokens"] ** power
            weigh(c, depth + 1)

    weigh(root, 0)
    return root


def test_budgets_as_plain_loops(spark):
    """Three levels, a total above what every share could be exact for, small branches raised: shortages arise at each level."""
    rng = random.Random(5)
    rows = [(s, la, d, rng.randrange(1, 4000)) for s in "abcdx" for la in ("es", "en", None) for d in ("civil", "agua", None) if rng.random() < 0.8]
    sizes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, source string, lang string, domain string, n_tokens long")
    share, cap = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1, "none": 0.5}, {"a": 1, "b": 2, "c": 4, "d": 1}
    wanted = targets(spark, [(k, v, cap.get(k, 1)) for k, v in share.items()])
    levels = ["source", "lang", "domain"]
    for fill in (0.3, 0.8, 1.0):
        root = nested(rows, share, cap, 0.5)
        expected = loops(root, fill * root["capacity"])
        for most in (1000, 0):
            got = plan(sizes, wanted, levels, "target_share", "max_repeats", fill=fill, smoothing=0.5, most_leaves=most).collect()
            assert {tuple(r[x] for x in levels): r.budget for r in got} == pytest.approx(expected, rel=1e-6)
        full = {p for p, b in expected.items() if b >= 0.999 * sum(t * cap[s] for s, la, d, t in rows if (s, la, d) == p)}
        assert fill == 1.0 or 0 < len(full) < len(expected)


def docs(spark):
    rows = [(i, " ".join(["palabra"] * (5 + i % 7)), "big", "es" if i % 3 else None) for i in range(600)]
    rows += [(1000 + i, "texto breve de prueba", "small", "es") for i in range(20)] + [(2000, None, "big", "es"), (2001, "", "big", "es"), (2002, "x", None, "es"), (2003, "x " * 50_000, "other", "en")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, epoch string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def run(spark, wanted, total=None):
    sizes = counted(docs(spark), "doc_id", "text", ["source", "lang"])
    budget = plan(sizes, targets(spark, wanted), ["source", "lang"], "target_share", "max_repeats", total)
    return mix(sizes, budget, ["source", "lang"])


def test_shares_and_caps(spark):
    wanted = [("big", 0.8, 1), ("small", 0.2, 3), ("missing", 0.1, 1)]
    mixture = run(spark, wanted).persist()
    got = {r.source: r for r in shares(mixture, targets(spark, wanted), "source", "target_share").collect()}
    assert abs(got["big"].reached_share - 0.8) < 0.02 and abs(got["small"].reached_share - 0.2) < 0.02 and got["missing"].n_uses == 0
    uses = mixture.groupBy("key").count().collect()
    assert max(r["count"] for r in uses if r.key >= 1000) <= 3 and max(r["count"] for r in uses if r.key < 1000) == 1
    assert mixture.select("key", "epoch").distinct().count() == mixture.count()
    assert mixture.where("source is null or source = 'other'").count() == 0
    again = run(spark, wanted)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.collect()))


def test_given_total_redistributes(spark):
    wanted = [("big", 0.5, 1), ("small", 0.5, 2)]
    mixture = run(spark, wanted, total=2000.0)
    by = {r.source: r.t for r in mixture.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    small = counter().count("texto breve de prueba") * 20 * 2
    assert by["small"] == small and abs(by["big"] - (2000 - small)) < 30


def test_empty(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [("none", 1.0, None), ("big", None, 1)]).count() == 0


def test_counts_by_piece_equal_the_tokenizer():
    own = counter()
    for text in ["", "  \n\n Artículo 1.- Ñandú's 12345 «x»\t\t fin  ", "граница ≥ 40", "x" * 5000, "\u3000 a\u00A0b"]:
        assert own.count(text) == len(own._encode(text))
        starts, counts = own.pieces(text)
        assert starts[-1] == len(text) and counts.sum() == own.count(text)
