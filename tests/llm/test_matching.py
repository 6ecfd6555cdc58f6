import random

from lexmill.llm.matching import _grams, canonical, match_names, same_name, similar_pairs, slips
from lexmill.llm.queries import LAW_NAMES
from pyspark.sql import functions as F

REGISTRY = [
    ("l1", "Ley General de Veredas Territoriales", "LGVT", ["Ley Zamcuzul"]), ("l2", "Ley Orgánica de Veredas Territoriales", "LOVT", None),
    ("l3", "Código de Faros y Balizas Fluviales", "CFBF", ["Normativa de Faros y Balizas Fluviales"]), ("l4", "Ley Federal de Muelles Comunales", "LFMC", []), ("l5", "Constitución Política de Ondaria", "CPO", ["Carta Fundamental"]),
]
CASES = {
    "Ley General de Veredas Territoriales": "l1", "LEY ORGANICA DE VEREDAS TERRITORIALES": "l2", "L. Gral. de Veredas Territoriales": "l1", "Ley General Veredas Territoriales": "l1",
    "Veredas Territoriales, Ley Orgánica de": "l2", "Ley General de Veerdas Territorales": "l1", "L.G.V.T.": "l1", "l g v t": "l1", "lovt": "l2", "Ley Zamcuzl": "l1", "Veredas Territoriales": "unmatched",
    "Faros & Balizas Fluviales": "l3", "Cód. de Faros y Balizas Fluviales, según su útima reforma": "l3", "Ley de Muelles Comunales": "l4", "Ley Federal de Muelles Comunales (en adelante, la Ley)": "l4",
    "Ley General de Muelles Comunales": "unmatched", "Ley Federal de Muelles Comunales del Estado de Talximón": "unmatched", "la ley del ramo": "unmatched", "s/n": "unmatched", "": "unmatched", None: "unmatched",
    "\uFF2C\uFF45\uFF59 Fedеral de Muelles\u00A0Comunales": "l4", "la  ley federal d muelles comunales ": "l4", "CFBX": "unmatched", "la ley federal d\u00A0muelles\u2007comunales ": "l4", "Ley Federal de Muelles Comunales; y su reglamento": "l4", "x" * 5000: "unmatched",
}


def registry(spark, rows=REGISTRY):
    return spark.createDataFrame(rows, "law_id string, name string, short string, aliases array<string>")


def run(spark, names, rows=REGISTRY):
    df = spark.createDataFrame([(n, "x", "y") for n in names], "raw_name string, name string, matched string")
    return {r.raw_name: r.matched for r in match_names(df, "raw_name", registry(spark, rows), "law_id", "name", [F.array("short"), F.col("aliases")], lexicon=LAW_NAMES).collect()}


def test_names(spark):
    got = run(spark, [*CASES, *CASES])
    assert got == CASES


def test_empty_sides(spark):
    assert run(spark, ["LGVT"], []) == {"LGVT": "unmatched"} and run(spark, []) == {}


def test_join_as_brute_force(spark):
    rng = random.Random(5)
    words = ["faros", "balizas", "muelles", "ribera", "fluvial", "comunal", "ley", "codigo"]
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(60)})
    entries = sorted({" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(40)})
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    for threshold in (0.4, 0.8):
        wanted = {(a, b): len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b)) for a in names for b in entries}
        wanted = {k: round(v, 9) for k, v in wanted.items() if v >= threshold - 1e-9}
        for most, per_token in ((0, 10**6), (0, 5), (10**6, 10**6)):
            rows = similar_pairs(frame(names), frame(entries), threshold, most, per_token).collect()
            assert len(rows) == len(wanted) and {(r.name, r.entry): round(r.jaccard, 9) for r in rows} == wanted


def test_slips():
    assert (slips("faros", "farso", 2), slips("faros", "faro", 2), slips("a", "abcd", 2), slips("federal", "general", 2)) == (1, 1, 3, 2)
    assert same_name("ley faros fluviales", "ley fluviales farso") == 1 and same_name("ley federal faros", "ley general faros") == -1
    assert same_name("ley faros", "ley faros fluviales") == -1 and canonical("L.F.M.C.") == "lfmc" and canonical(None) == ""


def test_without_a_lexicon(spark):
    df = spark.createDataFrame([("ley general de veredas territoriales",), ("L. Gral. de Veredas Territoriales",)], "raw_name string")
    got = {r.raw_name: r.matched for r in match_names(df, "raw_name", registry(spark), "law_id", "name", []).collect()}
    assert got == {"ley general de veredas territoriales": "l1", "L. Gral. de Veredas Territoriales": "unmatched"}
