"""Every registered query against its SQL on the smallest tables."""

import importlib
import importlib.util
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from __spark_entry__ import entry, oracle_sql, queries
from kinweave.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(str(tuple(r[i] for i in at)) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["biaoshi_hashcode", "guid"]
    assert df.count() > 0


@pytest.fixture
def reloaded(monkeypatch):
    """The entry module under a condition, and as it was afterwards."""
    yield lambda: importlib.reload(contract)
    monkeypatch.undo()
    importlib.reload(contract)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "kinweave.llm"])
def test_the_optional_subpackage_may_be_missing(reloaded, monkeypatch, gone):
    for name in [n for n in sys.modules if n == gone or n.startswith((gone + ".", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    assert set(reloaded().queries()) == set(QUERIES)
    assert set(contract.oracle_sql()) == set(ORACLES)


@pytest.mark.skipif(importlib.util.find_spec("kinweave.llm") is None, reason="the subpackage is not there")
def test_what_it_imports_may_not(reloaded, monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("kinweave.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.raises(ModuleNotFoundError, match="zstandard"):
        reloaded()
