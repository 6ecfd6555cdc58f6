"""lexmill: citation and dependency analytics for document corpora, on PySpark."""
