"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def _rows(records, columns):
    return sorted(tuple(_plain(r[c]) for c in columns) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    records = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert _rows([r.asDict() for r in got.collect()], columns) == _rows(records, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_without_subpackage(monkeypatch, spark):
    import sys

    for name in [m for m in sys.modules if m.startswith("gallerist.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "review_list" in entry.queries() and not [k for k in entry.queries() if k.startswith("op")]
