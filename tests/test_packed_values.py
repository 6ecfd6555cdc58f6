import time

import pytest

from lexmill.functions.peg import choice, many, sequence, token
from lexmill.operators.packed_values import articles_of, split_articles

CASES = [
    (None, []), ("", []), ("   ", []), (" ,; ", []),
    ("14", ["14"]), ("14 Bis y 15-B", ["14 Bis", "15-B"]), ("1o., 2º y 3°", ["1", "2", "3"]),
    ("10, fracción 2 y 11", ["10", "11"]), ("10, fracciones I, V y X, 12", ["10", "12"]), ("9, incisos a) y c), 10", ["9", "10"]),
    ("3, inciso b) y párrafo final, segundo párrafo", ["3"]), ("5, apartados A y B y 6", ["5", "6"]),
    ('"12, fracción I"|"13"', ["12", "13"]), ('["1", "2-A"]', ["1", "2-A"]), ("«4»; «Segundo transitorio»", ["4", "Segundo"]), ("'1' y '1'", ["1", "1"]),
    ("1 al 8; Primero", ["1", "8", "Primero"]), ("1 – 3", ["1", "3"]), ("arts. 2/7", ["2", "7"]), ("Art.3;;artículo 4", ["3", "4"]), ("9 o 10", ["9", "10"]), ("9o o 10", ["9", "10"]),
    ("7 de la citada ley en materia de riberas", ["7"]), ("anterior, que fijará los plazos", []), ("1\n2\t3", ["1", "2", "3"]), ("2, , 19, ,", ["2", "19"]),
]


@pytest.mark.parametrize("text, wanted", CASES)
def test_grammar(text, wanted):
    assert [a for a, _ in articles_of(text)] == wanted


def test_malformed_quotes_backtrack_and_are_flagged():
    assert articles_of('"12, fracción I; 13') == (("12", "unbalanced"), ("13", "unbalanced"))
    assert articles_of("1] y [2") == (("1", ""), ("2", "unbalanced")) or [a for a, _ in articles_of("1] y [2")] == ["1", "2"]
    assert [a for a, _ in articles_of("((((1")] == ["1"]


def test_very_long_field():
    assert len(articles_of(", ".join(map(str, range(5000))))) == 5000


@pytest.mark.parametrize("text, n", [
    (", ".join(f'"{i}"' for i in range(10_000)), 10_000), ("(" * 10_000 + "7", 1), ("7" + ")" * 10_000, 1), ('"' * 9_999 + "7", 1),
    ("([{" * 3_000 + "7" + "}])" * 3_000, 1), ("\"(" * 5_000 + "7", 1), ("'1" * 10_001, 10_001),
])
def test_time_is_linear_in_the_marks(text, n):
    began = time.process_time()
    assert len(articles_of(text)) == n
    assert time.process_time() - began < 1


def test_marks_pair_across_depths():
    assert articles_of('("1", [2]) 3') == (("1", ""), ("2", ""), ("3", ""))
    assert articles_of('"1 (2" 3') == (("1", ""), ("2", "unbalanced"), ("3", "unbalanced"))
    assert articles_of("(9, inciso a), 10) y 11") == (("9", ""), ("10", ""), ("11", ""))


def test_rows(spark):
    rows = [(1, "1 y 2", "x"), (1, "1 y 2", "x"), (2, None, "x"), (3, "", "x"), (4, "5", "x"), (5, "que antecede", "x")]
    df = spark.createDataFrame(rows, "id int, field string, pos string")
    got = sorted((r.id, r.pos, r.article) for r in split_articles(df, "field").collect())
    assert got == [(1, 1, "1"), (1, 1, "1"), (1, 2, "2"), (1, 2, "2"), (4, 1, "5")]
    assert {r.id for r in split_articles(df, "field", least=2).collect()} == {1}
    assert split_articles(df.limit(0), "field").count() == 0
    assert split_articles(df, "field").columns == ["id", "field", "pos", "article", "article_flag"]


def test_ordered_choice():
    digits, letters = token(r"\d+", lambda m: int(m[0])), token(r"[a-z]+", lambda m: m[0])
    assert many(choice(digits, letters))("12ab3", 0) == (5, [12, "ab", 3])
    assert sequence(digits, digits)("12", 0) is None
