import json

from lexmill.sources import binary, html, readers, writers
from lexmill.streaming import incremental

PAGE = """<html><body><table><tr><td>x</td></tr></table><table>
<tr><td>002</td><td><a href="ref/lan.htm"><b>Ley de Aguas</b></a> DOF 01/12/1992 Abrogada por otra</td><td>DOF 11/08/2014</td><td><a href="pdf/LAN.pdf">p</a><a href="doc/LAN.doc">d</a><a href="pdf_mov/LAN.pdf">m</a></td></tr>
<tr><td>001<td><a href="ref/cff.htm">Código Fiscal</a><td>x</tr>
<tr><td>003</td><td><a href="ref/LAN.htm">otra vez</a></td></tr><tr><td>004</td><td><a href="/else.htm">no</a></td></tr></table></body></html>"""


def test_index(spark):
    rows = readers.parse_index(spark.createDataFrame([(PAGE,), (None,), ("",)], "page string"), "page", "https://a.example/b").collect()
    assert [r.file_id for r in rows] == ["CFF", "LAN"]
    lan = rows[1]
    assert (lan.id, lan.is_abrogated, lan.dof_published, lan.doc_url) == ("ley-de-aguas", True, "DOF 01/12/1992", "https://a.example/b/doc/LAN.doc")
    assert rows[0].pdf_url == "https://a.example/b/pdf/CFF.pdf" and rows[0].abrogation_note is None


def test_norm_pages(spark):
    page = "<html><head><style>x</style></head><body><nav>menu</nav><h1>NOM-043-SSA2-{y} Servicios</h1><div id='contenidoNorma'>" + "Texto de la norma. " * 10 + "12 de mayo de 2014{z}</div></body></html>"
    pages = [(4001, page.format(y=2014, z="")), (4005, page.format(y=2014, z=" bis")), (4002, page.format(y=2001, z="")), (4003, page.format(y=2016, z=" cancelada ")), (4004, "<p>nada</p>"), (4006, None)]
    rows = readers.parse_norms(spark.createDataFrame(pages, "codp long, page string"), "page", "codp").collect()
    assert [(r.codp, r.nom_code, r.ministry, r.year, r.publication_date) for r in rows] == [(4005, "NOM-043-SSA2-2014", "SSA2", 2014, "12 de mayo de 2014")]
    assert "menu" not in html.norm_text(page.format(y=2014, z="")) and html.norm_text("<body>corto</body>") is None
    done = spark.createDataFrame([(4000,), (4002,)], "codp int")
    assert [r.codp for r in readers.open_keys(spark, done, "codp", 4000, 4003).orderBy("codp").collect()] == [4001, 4003]


def test_json_folders(spark, tmp_path):
    (tmp_path / "a_citations.json").write_text(json.dumps({"law_id": "a", "citations": [{"source_law": "a", "char_offset": 3, "target_article": ""}, {"source_law": "a", "resolution_score": 0.5}]}, indent=1))
    rows = readers.read_citations(spark, f"{tmp_path}/*_citations.json").collect()
    assert [(r.source_law, r.target_article, r.resolution_score) for r in rows] == [("a", "", None), ("a", None, 0.5)]
    (tmp_path / "d.json").write_text(json.dumps({"law_id": "a", "definitions": [{"term": "x"}]}))
    assert readers.read_definitions(spark, f"{tmp_path}/d.json").first().term == "x"


def test_binary(spark, tmp_path):
    words = "Artículo primero del texto que se guarda en el archivo. " * 12
    (tmp_path / "a.doc").write_bytes(binary.OLE + b"\x00" * 504 + b"\x01\x02" * 8 + words.encode("utf-16-le") + b"\x00\x00\x07\xff")
    (tmp_path / "b.doc").write_bytes(words.encode("cp1252"))
    (tmp_path / "c.doc").write_bytes(b"x")
    rows = {r.path[-5:]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.doc"].format == "ole2" and rows["a.doc"].method == "ole" and "Artículo primero" in rows["a.doc"].text
    assert rows["b.doc"].method == "plain" and rows["b.doc"].text == words and rows["c.doc"].method == "none"
    assert rows["c.doc"].checksum.startswith("sha256:2d711642")


def test_writers(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'A & "B"', 0.12345678), ("b", None, 1.0)], "id string, name string, pagerank double")
    edges = spark.createDataFrame([("a", "b", 3, "high")], "src string, dst string, weight long, confidence string")
    document = writers.graph_document(nodes, edges)
    assert document["links"] == [{"source": "a", "target": "b", "weight": 3, "confidence": "high"}] and document["nodes"][0]["pagerank"] == 0.123457
    writers.write_graph_json(nodes, edges, str(tmp_path / "g.json"))
    back_nodes, back_edges = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert back_nodes.count() == 2 and back_edges.first().src == "a"
    text = writers.graphml(nodes, edges)
    assert "A &amp; " in text and text.count("<node ") == 2
    writers.write_markdown(str(tmp_path / "r.md"), "Report", [("Edges", edges, ["src"])])
    assert "| a | b | 3 | high |" in (tmp_path / "r.md").read_text()
    writers.write_by_law(edges.withColumnRenamed("src", "law_id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_incremental(spark, tmp_path):
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    first = spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "id int, at int, v string")
    first.write.parquet(source)
    change = lambda df: df.where("v <> 'b'")
    incremental.process_new(spark, source, first.schema, change, target, mark)
    spark.createDataFrame([(1, 20, "c")], first.schema).write.mode("append").parquet(source)
    incremental.process_new(spark, source, first.schema, change, target, mark)
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == ["a", "c"]
    incremental.upsert_latest(spark, source, first.schema, "id", "at", str(tmp_path / "v"), str(tmp_path / "mark2"))
    spark.createDataFrame([(2, 30, "d")], first.schema).write.mode("append").parquet(source)
    incremental.upsert_latest(spark, source, first.schema, "id", "at", str(tmp_path / "v"), str(tmp_path / "mark2"))
    kept = lambda: sorted((r.id, r.v) for r in incremental.read_latest(spark, str(tmp_path / "v"), first.schema).collect())
    assert kept() == [(1, "c"), (2, "d")]
    # a batch without rows writes no version, and the next one still finds the last
    first.limit(0).coalesce(1).write.mode("append").parquet(source)
    incremental.upsert_latest(spark, source, first.schema, "id", "at", str(tmp_path / "v"), str(tmp_path / "mark2"))
    assert kept() == [(1, "c"), (2, "d")]
    spark.createDataFrame([(2, 40, "e"), (3, 40, "f")], first.schema).write.mode("append").parquet(source)
    incremental.upsert_latest(spark, source, first.schema, "id", "at", str(tmp_path / "v"), str(tmp_path / "mark2"))
    assert kept() == [(1, "c"), (2, "e"), (3, "f")]
