import glob
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexmill.operators import reports
from lexmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_conflicting_definitions(spark):
    rows = [("x", "Agua", "uno"), ("x", "Agua", "dos"), ("y", "Agua", "uno"), ("z", "Rio", "igual"), ("z", "Rio", " IGUAL "), ("z", "Mar", "solo")]
    df = spark.createDataFrame(rows, "law_id string, term string, definition_text string")
    pairs = spark.createDataFrame([("x", "w")], "a string, b string")
    got = reports.participation(pairs, reports.conflicting_definitions(df).withColumnRenamed("law_id", "id"))
    assert {tuple(r) for r in got.select("id", "cycles", "conflicts").collect()} == {("x", 1, 2), ("y", 0, 1), ("w", 1, 0)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_conflicts_reach_the_score(spark, tmp_path):
    """Two laws that cite each other and define one term in different ways."""
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        shutil.copy(path, tmp_path)
    for name, given in (
        ("citations", [{"source_law": a, "source_article": "1", "target_law_id": b, "confidence": "high"} for a, b in (("x", "y"), ("y", "x"))]),
        ("definitions", [{"law_id": a, "term": "agua", "definition_text": t} for a, t in (("x", "uno"), ("y", "dos"))]),
    ):
        old = pq.read_table(f"{FOLDER}/{name}.parquet")
        first = old.slice(0, 2).to_pylist()
        os.remove(tmp_path / f"{name}.parquet")
        pq.write_table(pa.Table.from_pylist([f | g | {"citation_id": i} if name == "citations" else f | g for i, (f, g) in enumerate(zip(first, given))], old.schema), tmp_path / f"{name}.parquet")
    nodes = {r.id: (r.cycles, r.conflicts) for r in catalogue.queries()["law_node_measures"](spark, str(tmp_path)).collect()}
    assert nodes == {"x": (1, 1), "y": (1, 1)}
    got = [tuple(r) for r in catalogue.queries()["law_reform_priority"](spark, str(tmp_path)).collect()]
    assert got == [("x", 35, "1 cycles; 1 conflicts; cited by 1"), ("y", 35, "1 cycles; 1 conflicts; cited by 1")]
