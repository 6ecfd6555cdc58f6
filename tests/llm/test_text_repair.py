import random

import pytest

from lexmill.llm.mojibake import repair, repaired
from lexmill.llm.unify import LOOKALIKES, TABLE, check_mapping, composition_rules, is_mixed, unified, unify
from pyspark.sql import functions as F

PLAIN = "La comisión pública revisará según el artículo 12 — «ñandú» de 40°, año ÁÉÍÓÚ."
LEGIT = [
    "La marca «AÇÃO LITORÂNEA» y el rótulo «SÃO VELMO»", "La voz «Âmbar» se inscribirá", "«pâté à l’ancienne» — salvo aviso", "el vocablo «граница» y la palabra «όρος»",
    "coeficiente α, √(área) y ≥ 40 unidades, 12º y 5ª", "¿Cuántos? ¡Muchos! 50 £ o 20 ¢", "la MAÇÃ»", "", "texto llano",
]


@pytest.mark.parametrize("text", LEGIT)
def test_correct_text_is_no_case(text):
    assert repair(text) == (text, 0, True)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_utf8_read_in_a_legacy_page_comes_back(page):
    text = PLAIN.replace("Á", "").replace("Í", "") if page == "cp1252" else PLAIN
    garbled = text.encode("utf-8").decode(page)
    assert repair(garbled) == (text, repair(garbled)[1], True)
    twice = "revisará el padrón".encode().decode("latin-1").encode().decode("latin-1")
    assert repair(twice)[0] == "revisará el padrón"
    stretch = "Sin daño: «Âmbar». " + "La comisión revisará".encode().decode(page) + " más."
    assert repair(stretch)[0] == "Sin daño: «Âmbar». La comisión revisará más."


def test_single_byte_pages():
    text = "la comisión de cartografía revisará según el año técnico"
    assert repair(text.encode("cp1252").decode("mac_roman"))[0] == text
    assert repair(text.encode("cp850").decode("cp1252", "replace"))[0] == text or repair(text.encode("cp850").decode("latin-1"))[0] == text
    assert repair("El registro sancionar\u00A0 la omisi¢n")[0] == "El registro sancionará la omisión"
    assert repair("La\u00A0ventanilla única\u00A0de obras")[1] == 0


BETWEEN = "La presentación de la “Ley” —art. 5 · nota… y la aplicación"


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_correct_text_between_misread_words_stays(page):
    """Only the words that were misread change: quotes, dashes and ellipses between them are as they were."""
    words = {w: w.encode().decode(page) for w in ("presentación", "aplicación")}
    garbled = BETWEEN
    for plain, wrong in words.items():
        garbled = garbled.replace(plain, wrong)
    assert repair(garbled)[0] == BETWEEN and repair(garbled)[1] > 0


def test_single_byte_misreads_between_correct_text():
    assert repair("La presentaciÛn de la “Ley” —art. 5 · nota… y la aplicaciÛn")[0] == BETWEEN
    assert repair("La presentaci¢n de la “Ley” —art. 5 · nota… y la aplicaci¢n")[0] == BETWEEN
    text = "El artículo «quinto» señala: ¿cuál órgano? SECCIÓN ÚNICA, según la 3ª resolución de 2º grado. La marca «AÇÃO», también así"
    assert repair(text.encode("cp1252").decode("mac_roman"))[0] == text
    whole = "El artículo «quinto» señala: ¿cuál órgano? SECCIÓN ÚNICA, también así"
    assert repair(whole.encode("cp850").decode("cp1252"))[0] == whole


def test_what_may_be_garbled_still_isnt_called_restored():
    assert repair("La Ã\x8dndole dÃ³nde — “x” Ã")[2] is False
    assert repair("La resoluciÛn de …l dice que la sanciÛn")[2] is False


def test_text_garbled_many_times():
    text = garbled = "revisará el padrón"
    for _ in range(7):
        garbled = garbled.encode().decode("latin-1")
    assert repair(garbled)[0] == text


def test_lost_characters_are_found_but_not_restored():
    text, places, whole = repair("la omisi\uFFFDn")
    assert places == 1 and not whole and text == "la omisi\uFFFDn"


def test_repair_columns(spark):
    rows = [(1, None), (2, ""), (3, "acciÃ³n"), (3, "acciÃ³n"), (4, "x" * 100_000 + "Ã³"), (5, "omisi\uFFFDn")]
    got = {r.id: (r.restored, r.garbled_places, r.is_restored) for r in spark.createDataFrame(rows, "id int, t string").select("id", repaired(F.col("t")).alias("r")).select("id", "r.*").collect()}
    assert got[1] == (None, 0, True) and got[2] == ("", 0, True) and got[3] == ("acción", 1, True)
    assert got[4][0].endswith("xó") and got[5][2] is False


CASES = [
    ("\uFF2C\uFF45\uFF59 \uFF26\uFF45\uFF44\uFF45\uFF52\uFF41\uFF4C", "Ley Federal"), ("Ley Genеral", "Ley General"), ("la\u3000ley\u00A0general", "la ley general"), ("Consti\u00ADtu\u200Bción", "Constitución"),
    ("accio\u0301n", "acción"), ("n\u0303andu\u0301", "ñandú"), ("\uFB01rme", "firme"), ("\u200B\u2060", ""), ("\uFF24\uFF45\uFF43\uFF52еto", "Decreto"),
    ("«граница» y «όρος», α", "«граница» y «όρος», α"), ("“x” — 12º, 5° √ ≥ «y»", "“x” — 12º, 5° √ ≥ «y»"), ("", ""),
]


@pytest.mark.parametrize("text, wanted", CASES)
def test_unify(text, wanted):
    assert unify(text) == wanted and unify(unify(text)) == unify(text)


def test_blanks_between_the_words_of_names(spark):
    name = "la ley d\u00A0veredas"
    assert repair(name, prose=False)[1] == 0
    assert spark.createDataFrame([(name,)], "t string").select(is_mixed(F.col("t"), prose=False).alias("m")).first().m


def test_mapping_has_no_conflict():
    check_mapping(TABLE | LOOKALIKES)
    with pytest.raises(ValueError):
        check_mapping({"a": "b", "b": "c"})


COMBINED = [
    ("\uFF41\u0301", "á"), ("a\u200B\u0301", "á"), ("\uFF2E\u0303and\u00ADu\u0301", "Ñandú"), ("o\u0302\u0301", "ố"), ("e\u0301\u0327", "ȩ́"), ("е\u0301l", "él"), ("и\u0306", "й"), ("q\u0301", "q\u0301"),
    ("\u0301abc", "\u0301abc"), ("x" * 100_000 + "\u0301", "x" * 100_000 + "\u0301"), ("граница\u200B", "граница"),
]


@pytest.mark.parametrize("text, wanted", COMBINED)
def test_compositions(text, wanted):
    assert unify(text) == wanted and unify(wanted) == wanted


def test_one_pass_is_enough():
    """Random clusters of inputs, marks and look-alikes: a second pass never changes anything, and plain text stays."""
    rng = random.Random(8)
    parts = [*TABLE, *LOOKALIKES, *"\u0301\u0302\u0303\u0308\u0327", *"aeiouncAEN á ñ.,-", "я", "λ"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        once = unify(text)
        assert unify(once) == once
        assert not set(once) & set(TABLE)


def test_compositions_are_checked():
    assert composition_rules()["a\u0301"] == "á"
    with pytest.raises(ValueError):
        check_mapping({"á": "a"}, {"a\u0301": "á"})
    with pytest.raises(ValueError):
        check_mapping({}, {"a\u0301": "á", "á": "b"})


def test_unify_columns(spark):
    rows = [(1, None), (2, ""), (3, "\uFF2C\uFF45\uFF59"), (3, "\uFF2C\uFF45\uFF59"), (4, "a\u00A0" * 50_000), (5, "artÃ\u00ADculo"), (6, "Ley")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.u, r.m) for r in df.select("id", unified(F.col("text")).alias("u"), is_mixed(F.col("text")).alias("m")).collect()}
    assert got[1] == (None, False) and got[2] == ("", False) and got[3] == ("Ley", True) and got[4] == ("a " * 50_000, True)
    assert got[5][1] is False and got[6] == ("Ley", False)
    assert df.limit(0).select(unified(F.col("text"))).count() == 0
