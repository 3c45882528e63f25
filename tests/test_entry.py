"""The driver's contract: every query has a callable; SQL belongs to queries only; and SQL agrees on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from repolens import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


@pytest.mark.parametrize("name", ["chunk_documents", "search_ranked", "call_sites", "uses_sites", "neighbors_d2", "usage_totals", "expand_window"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    show = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert show([r[c] for c in cols] for r in df.collect()) == show([r[i] for i in at] for r in rel.fetchall())


@pytest.mark.parametrize("pages", [0, 3000])
def test_graph_path_on_a_hub_and_without_links(spark, tmp_path, pages):
    """Every page links to one hub, so all pages are two steps from each other."""
    con = duckdb.connect()
    path = tmp_path / "pages.parquet"
    page = """i AS page_id, 'http://p.example.org/' || i AS url, '<a href="/hub">' AS html"""
    con.sql(f"COPY (SELECT {page} FROM range({pages}) r(i)) TO '{path}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    df, rel = catalog.queries()["graph_path"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["graph_path"])
    assert df.columns == rel.columns and [tuple(r) for r in df.collect()] == rel.fetchall()


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "start_line", "end_line", "score", "reason"]
