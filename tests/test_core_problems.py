"""p3_found and p4_found on the smallest tables, against plain loops over the same rows."""

import os

import duckdb
import pytest

from lexmill.operators.packed_values import articles_of
from lexmill.plans import core_problems

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(sql):
    return duckdb.connect().execute(sql.replace("@", FOLDER)).fetchall()


def test_p3_found(spark):
    laws = {i: (a, b) for i, a, b in rows("select law_id, epoch_us(registered_at), epoch_us(withdrawn_at) from '@/law_registry.parquet'")}
    articles = {(i, n): (a, b) for i, n, a, b in rows("select law_id, article, epoch_us(in_force_from), epoch_us(repealed_at) from '@/registry_articles.parquet'")}
    there = lambda held, at: held is not None and held[0] <= at and (held[1] is None or held[1] > at)
    wanted = set()
    for id_, law, field, at in rows("select citation_id, target_law_id, target_article, epoch_us(extracted_at) from '@/citations.parquet'"):
        if law == "unresolved":
            continue
        if not there(laws.get(law), at):
            wanted.add((id_, "target_law_id"))
        elif any(not there(articles.get((law, a)), at) for a, _ in articles_of(field)):
            wanted.add((id_, "target_article"))
    assert {tuple(r) for r in core_problems.p3_found(spark, FOLDER).collect()} == wanted
    by_month = core_problems.p3_by_month(spark, FOLDER).collect()
    assert sum(r.n_orphans for r in by_month) == len(wanted)


def test_p4_found(spark):
    wanted = set()
    for id_, field in rows("select citation_id, target_article from '@/citations.parquet'"):
        named = [a for a, _ in articles_of(field)]
        wanted |= {(id_, i, a) for i, a in enumerate(named, 1)} if len(named) > 1 else set()
    assert {tuple(r) for r in core_problems.p4_found(spark, FOLDER).collect()} == wanted
