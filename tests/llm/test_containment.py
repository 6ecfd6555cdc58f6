import random
import re
import unicodedata

from lexmill.llm import containment as C


def words(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def brute(docs, items, window=20):
    out = set()
    for d, t in docs:
        held = words(t or "")
        for i, x in items:
            w = words(x or "")
            k = min(window, len(w))
            passages = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
            if any(tuple(held[a : a + k]) in passages for a in range(len(held) - k + 1)):
                out.add((d, i))
    return out


def make(seed):
    rng = random.Random(seed)
    pool = ["ley", "Órgano", "año", "el", "de", "la", "42", "río", "agua", "según", "STRASSE", "x"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 12, 19, 20, 21, 60]))) for i in range(1, 20)] + [(20, None), (21, ""), (22, "...")]
    docs = [(100, None), (101, ""), (102, "¡!")]
    for d in range(60):
        body = text(rng.randrange(0, 80))
        if rng.random() < 0.6:
            part = (rng.choice(items[:19])[1]).split()
            at = rng.randrange(max(1, len(part) - 19))
            part = part[at : at + rng.choice([15, 19, 20, 25, 60])]
            body += "\n" + rng.choice([" ", ", ", "\n"]).join(part).upper() + ". " + text(rng.randrange(5))
        docs.append((d, body))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        docs, items = make(seed)
        d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, doc int, i int")
        i = spark.createDataFrame(items, "item_id long, text string")
        for most in (2_000_000, 100):
            monkeypatch.setattr(C, "MOST_BROADCAST_WORDS", most)
            got = C.contained_items(d, i, "doc_id", "text", "item_id", "text").collect()
            assert {tuple(r) for r in got} == brute(docs, items)


def test_repeats_long_texts_and_empty_tables(spark):
    item = " ".join(f"w{n}" for n in range(30))
    docs = spark.createDataFrame([(1, item), (1, item), (2, "relleno " * 200_000 + item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in C.contained_items(docs, items, "doc_id", "text", "item_id", "text").collect())
    assert got == [(1, 7), (1, 7), (1, 8), (1, 8), (2, 7), (2, 8)]
    assert C.contained_items(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert C.contained_items(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_words_fold_alike():
    for a, b in [("Straße", "STRASSE"), ("\uFB01n", "fin"), ("e\u0301l", "él"), ("Niño", "nino"), ("x\u00ADy", "xy")]:
        assert C.word_hashes([a])[0].tolist() == C.word_hashes([b])[0].tolist(), (a, b)
    hashes, counts = C.word_hashes(["a b", "", "c\u0301", "d"])
    assert counts.tolist() == [2, 0, 1, 1] and len(hashes) == 4
