import re

from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import extract, segment

TEXTS = [
    "conforme a lo dispuesto en la Ley Federal del Trabajo, y de acuerdo con la Ley General de Salud.",
    "en términos de lo establecido por el Código Fiscal de la Federación; lo previsto en el Reglamento de Tránsito de Ríos",
    "con fundamento en el artículo 12, 13 y 14 de la Ley de Aguas Nacionales. De conformidad con los Estatutos del Órgano",
    "en los términos de la Ley de Órganos Ágiles\na que se refiere la ley orgánica de los ríos (vigente)",
    "la Ley de Puertos y sus reglamentos, sin perjuicio de lo dispuesto en el Decreto Marco de Faros.",
    "para los efectos de la Ley de Minas, en materia de agua conforme a la Ley de Riberas; señaladas en la Ley de Caza",
    "artículo 27 de la Constitución Política de los Estados Unidos Mexicanos y artículos 3 y 4 constitucionales; la Constitución",
    "la Ley General de Salud, de la Ley de Pesca, se derogan los del Código Civil Federal, artículo 5 bis de la Ley de Aguas",
    "", "sin citas", "establecidas en la Ley de Ñandúes Ibéricos y demás disposiciones",
]


def test_all_patterns_as_in_python(spark):
    """Matches, groups and offsets of every citation pattern equal those of Python's engine."""
    df = spark.createDataFrame(list(enumerate(TEXTS + [" ".join(TEXTS)])), "i int, t string")
    for name, _, _, expression in P.CITATION_PATTERNS:
        groups = 0 if name == "constitucion_bare" else 1
        rows = df.select("i", F.explode(extract.find_all(F.col("t"), P.FLAGS + expression, groups)).alias("m")).select("i", "m.*").collect()
        got = sorted((r.i, r.offset, r.found) + ((r.g1,) if groups else ()) for r in rows)
        wanted = [(i, m.start(), m[0]) + ((m[1],) if groups else ()) for i, t in enumerate(TEXTS + [" ".join(TEXTS)]) for m in re.finditer(expression, t, re.I)]
        assert got == sorted(wanted), name


def test_citations(spark):
    articles = spark.createDataFrame([("l1", str(i), t) for i, t in enumerate(TEXTS)] + [("l2", "1", None)], "source_law string, source_article string, text string")
    found = extract.extract_citations(articles, ("cpo", "Constitución Política"))
    rows = found.collect()
    assert {r.pattern_name for r in rows} >= {"conforme_dispuesto", "fundamento_articulo", "constitucion_full", "constitucion_bare", "ley_y_reglamentos"}
    assert all(r.target_law_id == "cpo" and r.target_law_raw == "Constitución Política" for r in rows if r.pattern_group == "constitutional")
    assert all(r.target_article == "" for r in rows if r.pattern_name == "constitucion_bare")
    assert not [r for r in rows if r.pattern_name == "direct_mention" and "derogan" in r.citation_text]
    once = extract.deduplicate_citations(found, ["pattern_order", "char_offset"]).collect()
    keys = [(r.source_law, r.source_article, r.target_law_raw.lower()[:50]) for r in once]
    assert len(keys) == len(set(keys))
    laws = spark.createDataFrame([("l1", "Ley General de Salud", None)], "id string, name string, short_name string")
    left = extract.drop_self_references(found, laws).collect()
    assert len(left) < len(rows) and not [r for r in left if r.target_law_raw == "Ley General de Salud"]
    assert extract.extract_citations(articles.limit(0)).count() == 0


def test_norms(spark):
    articles = spark.createDataFrame([("l", "1", "según la NOM-043-SSA2-2012 y NOM-001-STPS-2008; las Normas Oficiales Mexicanas"), ("l", "2", None)], "source_law string, source_article string, text string")
    registry = spark.createDataFrame([("NOM-043-SSA2-2015", "a"), ("NOM-043-SSA2-2013", "b")], "code string, nom_id string")
    got = sorted((r.target_nom_raw, r.target_nom_id, r.confidence, r.char_offset) for r in extract.extract_norm_citations(articles, registry).collect())
    assert got == [("NOM-001-STPS-2008", "unresolved", "medium", 29), ("NOM-043-SSA2-2012", "a", "high", 9), ("Normas Oficiales Mexicanas", "generic", "low", 52)]
    norms = spark.createDataFrame([("a", "NOM-001-X-2020", "ver NOM-002-Y-2021 y NOM-001-X-2020"), ("b", "NOM-002-Y-2021", None)], "id string, code string, full_text string")
    assert [tuple(r) for r in extract.norm_to_norm(norms).collect()] == [("a", "b")]


def test_definitions(spark):
    text = "Para los efectos de esta Ley, se entiende por:\nI. Agua potable: la que se puede beber sin daño;\nII. Ribera: la faja de tierra que toca el cauce."
    rows = extract.extract_definitions(spark.createDataFrame([("l", "1", text)], "source_law string, source_article string, text string")).collect()
    blocks = [r for r in rows if r.extraction_method == "definition_block"]
    assert {r.term for r in blocks} == {"agua potable", "ribera"}
    assert all(len(r.definition_text) <= 500 and len(r.raw_snippet) <= 100 for r in blocks)


def test_segments(spark):
    text = "Preámbulo\nArtículo 1.- Objeto\nPrimera línea\n\nOtra\nART. 2-A. Fin\nTRANSITORIOS\nArtículo 9. No cuenta"
    rows = segment.segmented(spark.createDataFrame([(1, text), (2, None), (3, "nada"), (4, "")], "id int, t string"), "id", "t").collect()
    got = [(r.id, r.pos, r.number, r.title, r.segment_text) for r in rows]
    assert got == [(1, 1, "1", "Artículo 1 — Objeto", "Artículo 1.- Objeto\nPrimera línea\n\nOtra"), (1, 2, "2-A", "Artículo 2-A — Fin", "ART. 2-A. Fin")]
    sections = segment.segmented(spark.createDataFrame([(1, "x\n1. Uno\na\n1.1 Dos\nb"), (2, "sin nada"), (3, None)], "id int, t string"), "id", "t", "sections").collect()
    assert [(r.id, r.number, r.title) for r in sections] == [(1, "1", "Uno"), (1, "1.1", "Dos"), (2, "0", "")]


def test_scalar_functions(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c.alias("x")).first().x
    c0, c1 = F.col("c0"), F.col("c1")
    assert one(X.slugify(c0), " Ley de Ñandúes -- y Ríos (2020)! ") == "ley-de-nandues-y-rios-2020"
    assert len(one(X.slugify(c0), "palabra " * 20)) <= 60
    assert one(X.clean_text(c0), "\r\n AcciÃ³n\x07  y\t\tmÃ¡s\n\n\n\n\nfin ") == "Acción y más\n\n\nfin"
    assert one(X.clean_law_name(c0), "Ley de Aguas vigente en todo, ") == "Ley de Aguas" and one(X.clean_law_name(c0), None) == ""
    assert one(X.strip_trailing_junk(c0), "Ley de Aguas y demás leyes aplicables") == "Ley de Aguas"
    assert one(X.first_article(c0), "véase el artículo 14-B y el artículo 3") == "14-B" and one(X.first_article(c0), "nada") is None
    assert one(X.checksum(c0), "a").startswith("sha256:ca978112")
    assert one(X.normalised_prefix(c0, 5), "A  b cd") == "a b"
    assert one(X.year_enacted(c0), "publicada en el DOF el 5 de mayo de 1999, y 1950") == 1999 and one(X.year_enacted(c0), "de 1980 a 1975") == 1975
    assert one(X.year_reformed(c0, c1), "x", "DOF 01/02/2011") == 2011 and one(X.year_reformed(c0), "Última reforma publicada DOF 3 de abril de 2020") == 2020
    assert one(X.corpus_layer(c0, c1), "Decreto de Faros", "x") == "layer_2_change_layer" and one(X.corpus_layer(c0, c1), None, None) == "layer_3_interpretive_prepared"
    assert one(X.absolute_url(c0, "https://a.example/x"), "doc/y.doc") == "https://a.example/x/doc/y.doc" and one(X.absolute_url(c0, "https://a.example/x"), "/z") == "https://a.example/z"
    for text, kind in [("se entenderá por", "definitional"), ("el plazo", "procedural"), ("los plazos", "generic_unresolved"), ("de manera supletoria", "supletory"), ("derechos humanos", "constitutional_grounding")]:
        assert one(X.classify(c0, c1, c1).dependency_type, text, "") == kind


def test_offsets_of_thousands_of_matches(spark):
    """The time goes with the number of matches, not with its square."""
    import time

    from lexmill.operators.extract import find_all

    expression = P.FLAGS + {name: e for name, _, _, e in P.CITATION_PATTERNS}["direct_mention"]
    text = "según la Ley Federal de Aguas Claras, y más. " * 4000
    began = time.time()
    found = spark.createDataFrame([(text,)], "text string").select(find_all(F.col("text"), expression).alias("m")).first().m
    assert [m.offset for m in found] == [m.start() for m in re.finditer("la Ley", text)] and time.time() - began < 10
