"""Writers: tables by law, and the small files that a graph or report ends in."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a graph or report that may come to the driver to be written as one file.
MOST_ROWS = 2_000_000


def write_by_law(df: DataFrame, path: str, key: str = "law_id", form: str = "parquet", per_file: int = 1_000_000) -> None:
    """A folder per law, overwritten as a whole and never in place: read from one path, write to another.

    A law of more than `per_file` rows is written by several tasks.
    """
    parts = df.groupBy(F.col(key).alias("__k")).agg(F.ceil(F.count("*") / per_file).cast("int").alias("__parts"))
    own = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    salted = df.join(parts, df[key].eqNullSafe(F.col("__k"))).withColumn("__part", F.pmod(F.xxhash64(*own), F.col("__parts")))
    salted.repartition(F.col(key), F.col("__part")).select(*df.columns).write.mode("overwrite").partitionBy(key).format(form).save(path)


def _rows(df: DataFrame, order: list[str]) -> list[dict]:
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write the table itself")
    return [r.asDict() for r in rows]


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph of any size as two folders of JSON lines, `nodes` and `links` (source, target and all other attributes)."""
    vertices.write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{path}/links")


def write_csv(df: DataFrame, path: str) -> None:
    """A table with a header; line ends, quotes and empty texts come back as they were."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def graph_document(vertices: DataFrame, edges: DataFrame) -> dict:
    """Nodes and links for drawing; floats are rounded to six places, and all attributes of the edges are kept."""
    short = lambda r: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()}
    links = [{"source": r.pop("src"), "target": r.pop("dst"), **short(r)} for r in _rows(edges, ["src", "dst"])]
    return {"nodes": [short(r) for r in _rows(vertices, ["id"])], "links": links}


def write_graph_json(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(graph_document(vertices, edges), out, ensure_ascii=False, indent=1)


def graphml(vertices: DataFrame, edges: DataFrame) -> str:
    """The graph as GraphML, directed, with typed attributes; nulls are left out."""
    kinds = {"string": "string", "int": "int", "bigint": "long", "double": "double", "boolean": "boolean"}
    parts, keys = [], {}
    for scope, df, own in (("node", vertices, ("id",)), ("edge", edges, ("src", "dst"))):
        for name, kind in df.dtypes:
            if name not in own:
                keys[scope, name] = f"d{len(keys)}"
                parts.append(f'<key id="{keys[scope, name]}" for="{scope}" attr.name={quoteattr(name)} attr.type="{kinds.get(kind, "string")}"/>')
    parts.append('<graph edgedefault="directed">')
    text = lambda v: escape(str(v).lower() if isinstance(v, bool) else str(v))
    data = lambda scope, r: "".join(f'<data key="{keys[scope, k]}">{text(v)}</data>' for k, v in r.items() if (scope, k) in keys and v is not None)
    parts += [f"<node id={quoteattr(str(r['id']))}>{data('node', r)}</node>" for r in _rows(vertices, ["id"])]
    parts += [f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}>{data('edge', r)}</edge>" for r in _rows(edges, ["src", "dst"])]
    return '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(parts) + "\n</graph>\n</graphml>\n"


def review_sample(df: DataFrame, order: list[str], rows: int = 500) -> DataFrame:
    """The first rows by a stated order, for people to look at: the limit is the feature."""
    return df.orderBy(*order).limit(rows)


def flattened_citations(df: DataFrame, by: list[str]) -> DataFrame:
    """Citations of each group as one text, best rank first, for a table of pairs."""
    one = F.concat(F.lit("[Art."), F.coalesce("source_article", F.lit("?")), F.lit(" · "), F.col("confidence"), F.lit(" · "), F.col("pattern_name"), F.lit("] "), F.col("citation_text"))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))).alias("l"))
    return rows.select(*by, F.array_join(F.transform("l", lambda x: x["t"]), " ||| ").alias("citations"))


def markdown_table(df: DataFrame, order: list[str], rows: int = 50) -> str:
    """The first rows of a report as a Markdown table."""
    names = df.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in df.orderBy(*order).limit(rows).collect():
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |")
    return "\n".join(lines) + "\n"


def write_markdown(path: str, title: str, sections: list[tuple[str, DataFrame, list[str]]], rows: int = 50) -> None:
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"# {title}\n")
        for name, df, order in sections:
            out.write(f"\n## {name}\n\n{markdown_table(df, order, rows)}")
