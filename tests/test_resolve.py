import random
from difflib import SequenceMatcher

import numpy as np

from lexmill.operators import resolve

REGISTRY = [
    ("ley-de-aguas", "Ley de Aguas Nacionales", "LAN", ["Ley del Agua"], "agua"),
    ("ley-de-salud", "Ley General de Salud", "LGS", None, "salud"),
    ("codigo-fiscal", "Código Fiscal de la Federación", "CFF", [], "fiscal"),
]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "law_id string, name string, short string, aliases array<string>, sector string")


def names(spark, *raw):
    return spark.createDataFrame([(r,) for r in raw], "raw string")


def test_aliases_last_law_wins(spark):
    both = spark.createDataFrame([("a", "X", "S", ["Y"], ""), ("b", "Y", "S", [], "")], "law_id string, name string, short string, aliases array<string>, sector string")
    assert {(r.alias, r.law_id) for r in resolve.alias_map(both).collect()} == {("x", "a"), ("s", "b"), ("y", "b")}


def test_fuzzy_as_brute_force(spark):
    rng = random.Random(3)
    aliases = resolve.alias_map(registry(spark)).orderBy("ord").collect()
    pool = [a.alias for a in aliases]
    raw = [None, "", "x"]
    for _ in range(120):
        t = list(rng.choice(pool))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("aeiou lsn")
        raw.append("".join(t))
    got = {r.raw: (r.matched_alias, round(r.score, 9)) for r in resolve.resolve_fuzzy(names(spark, *raw), resolve.alias_map(registry(spark))).collect()}
    wanted = {}
    for t in raw:
        best, score = None, 0.0
        for a in pool:
            ratio = SequenceMatcher(None, (t or "").lower().strip(" "), a).ratio()
            if ratio > score:
                best, score = a, ratio
        if t and score >= 0.75:
            wanted[t] = (best, round(score, 9))
    assert got == wanted


def test_cascade(spark):
    corpus = spark.createDataFrame([("local", "Bando de Tranvías del Puerto", None)], "id string, name string, short_name string")
    raw = ["LAN", "ley general de salud", "Ley General de la Salud", "Bando de Tranvías del Puerto", "Ley de Aguas Nacionales y de sus riberas, lagos y demás cuerpos", "nada que ver", "nada que ver", None, "el congreso"]
    got = {r.raw: (r.law_id, r.method) for r in resolve.resolve_names(names(spark, *raw), resolve.alias_map(registry(spark)), resolve.corpus_map(corpus), {"el congreso": "ley-congreso"}).collect()}
    assert got == {
        "LAN": ("ley-de-aguas", "exact"), "ley general de salud": ("ley-de-salud", "exact"), "Ley General de la Salud": ("ley-de-salud", "fuzzy"), "Bando de Tranvías del Puerto": ("local", "corpus_exact"),
        "Ley de Aguas Nacionales y de sus riberas, lagos y demás cuerpos": ("ley-de-aguas", "prefix"), "nada que ver": ("unresolved", "none"), "el congreso": ("ley-congreso", "manual"),
    }
    assert resolve.resolve_names(names(spark), resolve.alias_map(registry(spark))).count() == 0


def test_apply_keeps_earlier_targets(spark):
    cited = spark.createDataFrame([("LAN", None), ("LAN", "old"), ("zzz", None)], "target_law_raw string, target_law_id string")
    done = resolve.resolve_names(names(spark, "LAN", "zzz"), resolve.alias_map(registry(spark)))
    assert sorted(r.target_law_id for r in resolve.apply_resolution(cited, done).collect()) == ["ley-de-aguas", "old", "unresolved"]


def test_sectors(spark):
    nodes = spark.createDataFrame([("ley-de-aguas",), ("ley-aguas",), ("ley-del-agua-de-riego",), ("codigo-fiscal-x",), ("zzz",)], "id string")
    got = {r.id: (r.sector, r.how) for r in resolve.sector_lookup(nodes, registry(spark), [("agua", ["agua"])]).collect()}
    assert got["ley-de-aguas"] == ("agua", "exact") and got["ley-aguas"] == ("agua", "stripped") and got["codigo-fiscal-x"] == ("fiscal", "fuzzy")
    assert got["ley-del-agua-de-riego"][1] in ("keyword", "fuzzy") and got["zzz"] == ("unknown", "unknown")


def test_fuzzy_in_blocks(spark):
    """Aliases that travel in several blocks give what one block gives, ties to the first included."""
    aliases = spark.createDataFrame([(f"ley de faros {c}", f"l{i}", f"{i:03d}") for i, c in enumerate("abcdefgh")], "alias string, law_id string, ord string")
    names = spark.createDataFrame([("ley de faros",), ("ley de faros h",), ("ley de faro e",), ("zzz",)], "raw string")
    one, many = (sorted(map(tuple, resolve.resolve_fuzzy(names, aliases, most_aliases=n).select("raw", "law_id", "matched_alias", "score").collect())) for n in (100, 3))
    assert one == many and len(one) == 3


def test_best_ratio_among_many_texts():
    """Arrays of bounds give what the matcher gives over all texts, first of equals, whatever the lengths."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdeñ ") for _ in range(n))
    texts = [word(rng.randrange(60, 75)) for _ in range(400)] + [word(rng.randrange(1, 230)) for _ in range(100)] + ["", "a"]
    texts += texts[:5]
    listed = resolve.Listed(texts)
    names = ["x", word(63), word(64), word(65), word(130)] + ["".join(c if rng.random() > 0.2 else rng.choice(["", "xy", "e"]) for c in rng.choice(texts)) for _ in range(25)]
    for name, own in zip(names, resolve._bag(names)):
        ratios = [SequenceMatcher(None, name, t).ratio() for t in texts]
        most = max(ratios)
        assert listed.best_ratio(name, own, 0.6) == ((ratios.index(most), most) if most >= 0.6 else (-1, 0.0))
    for at in (range(0, len(texts), 9), range(len(texts))):  # for themselves and as arrays
        got = listed.common_lengths(names[4], np.array(at))
        masks = resolve._masks(names[4])
        assert got.tolist() == [resolve.common_length(texts[listed.order[k]], masks, len(names[4])) for k in at]
    assert resolve.Listed([]).best_ratio("a", resolve._bag(["a"])[0], 0.75) == (-1, 0.0)
