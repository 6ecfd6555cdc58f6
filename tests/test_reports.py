from lexmill.operators import reports


def test_article_activity(spark):
    edges = [("a::1", "b::2", 3), ("a::1", "b::?", 1), ("a::1", "c::9", 4), ("c::9", "b::2", 1), ("b::2", "b::10", 1)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    got = {tuple(r) for r in reports.article_activity(df).collect()}
    assert got == {
        ("a", "1", 0, 8, 1, "b=4,c=4", ""), ("b", "2", 4, 1, 1, "b=1", "a=3,c=1"), ("b", "10", 1, 0, 2, "", "b=1"), ("b", "?", 1, 0, 3, "", "a=1"), ("c", "9", 4, 1, 1, "b=1", "a=4"),
    }
    assert {r.law for r in reports.article_activity(df, laws=1).collect()} == {"a"}  # 8 out and none in, before 7 of b
    assert {(r.law, r.article) for r in reports.article_activity(df, articles=1).collect()} == {("a", "1"), ("b", "2"), ("c", "9")}
    assert {r.cites for r in reports.article_activity(df, partners=1).where("law = 'a'").collect()} == {"b=4"}


def test_dependent_provisions(spark):
    """Every definitional citation is a row, with the values that the SQL of definition_provisions has as constants."""
    columns = "citation_id long, source_law string, source_article string, target_law_id string, target_article string, target_law_raw string, citation_text string, pattern_name string, confidence string, resolution_method string"
    rows = [(i, law, str(i), "t", "5", "Ley T", text, "p", "medium", "exact") for i, law, text in ((1, "b", "para efectos de la Ley"), (2, "a", "se entenderá por agua"), (3, "b", "definiciones de la Ley"), (4, "c", "una multa"))]
    got = reports.dependent_provisions(reports.classified(spark.createDataFrame(rows, columns))).collect()
    assert {tuple(r) for r in got} == {("t", i, law, str(i), "5", "term_definition_reference", "high") for i, law in ((1, "b"), (2, "a"), (3, "b"))}
