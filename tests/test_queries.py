"""Every query of the core that has SQL gives the same rows as that SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from orelode.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_catalog():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6)} <= set(catalog.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["exposure_state", "confidence_tier", "pattern_name", "n_findings", "n_blobs", "max_score"]


def test_rest_of_the_queries(spark):
    """Those without SQL hold the rows of those that have it."""
    q = catalog.queries()
    rest = set(q) - set(catalog.oracle_sql())
    assert rest == {"p1_occurrence_lists", "p2_commit_descendant_index", "p6_flat_tables", "p6_variants"}
    index = q["p2_commit_descendant_index"](spark, DIR).collect()
    rings = {r.root for r in index if r.circle}
    assert {r.node: r.leave - r.enter for r in index if r.root not in rings} == {r.node: r.n_descendants for r in q["p2_commit_descendants"](spark, DIR).collect()}
    lists = q["p1_occurrence_lists"](spark, DIR).collect()
    assert sum(r.n_rows for r in lists) == q["p1_list_rows"](spark, DIR).count() and all(r.n_rows == len(r.occurrences) <= 20_000 for r in lists)
    flat = Counter((r.child_table, r.variant) for r in q["p6_flat_tables"](spark, DIR).select("child_table", "variant").collect())
    assert {(r.child_table, r.variant): r.n_rows for r in q["p6_variants"](spark, DIR).collect()} == flat
    for t in ("finding", "occurrence", "signal", "timeline"):
        assert sum(n for (table, _), n in flat.items() if table == t) == q[f"p6_{t}s"](spark, DIR).count()
