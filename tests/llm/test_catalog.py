"""Queries on text that have SQL give the same rows as that SQL; the others keep what must hold of them."""

from collections import Counter
from pathlib import Path

import pytest

from orelode.llm import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_languages_of_documents_and_segments(spark):
    q = catalog.queries()
    documents = {r.doc_id: r for r in q["p9_documents"](spark, DIR).collect()}
    segments = Counter(r.doc_id for r in q["p9_segments"](spark, DIR).select("doc_id", "seg_no").distinct().collect())
    assert {d: r.n_segments for d, r in documents.items() if r.n_segments} == segments
    assert all((r.lang is None) == (r.n_segments == 0) and 0 <= r.confidence <= 1 for r in documents.values())
    assert {r.doc_id for r in q["p9_found"](spark, DIR).collect()} <= set(segments)
