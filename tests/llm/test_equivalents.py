import random
import unicodedata

from lexmill.llm.equivalents import collapse


def brute(rows):
    leaf = lambda t: "".join(c for c in unicodedata.normalize("NFC", t or "").upper().lower() if c.isalnum()).replace("ς", "σ")
    groups = {}
    for i, a, b in rows:
        groups.setdefault(tuple(sorted((leaf(a), leaf(b)))), []).append(i)
    return sorted((i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g)


def make(seed, n=300):
    rng = random.Random(seed)
    base = [("Agua potable", "la que se bebe, año 5"), ("agua", "potable la que"), ("ñ", "n"), ("όρος", "ΌΡΟΣ"), (None, ""), ("a" * 3000, "b"), ("accio\u0301n", "x-1"), ("acción", "x1"), ("accion", "x1"), ("1", "2")]
    rows = []
    for i in range(n):
        a, b = base[0] if rng.random() < 0.35 else rng.choice(base)
        change = rng.choice([str.upper, str.lower, lambda t: t.replace(" ", "  "), lambda t: f"«{t}».", lambda t: t])
        a, b = (change(x) if x is not None else None for x in (a, b))
        rows.append((i, *((a, b) if rng.random() < 0.5 else (b, a))))
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = make(seed)
        df = spark.createDataFrame([(*r, "k", "r") for r in rows], "id long, term string, body string, key string, root string")
        for heavy, most in ((10**6, 10**6), (20, 10**6), (20, 0), (10**6, 0)):
            got = sorted((r.key, r.keep, r.copies) for r in collapse(df, "id", ["term", "body"], heavy=heavy, most_broadcast=most).collect())
            assert got == brute(rows)


def test_ordered_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "A", "b!")], "id long, term string, body string")
    assert sorted((r.key, r.keep) for r in collapse(df, "id", ["term", "body"], ordered=True).collect()) == [(1, 1), (3, 1)]
    assert sorted((r.key, r.keep) for r in collapse(df, "id", ["term", "body"]).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert collapse(df.limit(0), "id", ["term", "body"]).count() == 0
