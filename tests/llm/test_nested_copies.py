from lexmill.llm.equivalents import collapse

ROWS = [
    (1, ("Agua", ("Uno", "dos")), ["x", "y"]), (2, ("agua.", ("DOS", "uno")), ["X", "y"]),  # inner fields in another order
    (3, ("agua", ("uno", "dos")), ["y", "x"]), (4, ("agua", ("uno", "tres")), ["x", "y"]), (5, ("agua", None), []), (6, ("Agua!", (None, "")), None),
]


def groups(df, **options):
    return {(r.key, r.keep, r.copies) for r in collapse(df, "id", ["r", "l"], **options).collect()}


def test_inner_nodes(spark):
    df = spark.createDataFrame(ROWS, "id long, r struct<t: string, p: struct<a: string, b: string>>, l array<string>")
    assert groups(df) == {(1, 1, 2), (2, 1, 2), (5, 5, 2), (6, 5, 2)}
    assert groups(df, ordered=True) == {(5, 5, 2), (6, 5, 2)}
    assert groups(df, bags=frozenset({"l"})) == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (5, 5, 2), (6, 5, 2)}
