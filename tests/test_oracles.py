"""Every named query against its SQL twin, on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from webloom.plans.oracles import ORACLES
from webloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as from '{SF}/{name}'")
    return con


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    want = sql.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert ordered(got.select(*columns).collect()) == ordered(want.project(", ".join(columns)).fetchall())


@pytest.mark.parametrize("missing", ["tiktoken", "xxhash", "webloom.llm"])
def test_entry_without_an_optional_package(monkeypatch, missing):
    """The other queries stay when a package of the optional part cannot be imported."""
    for name in [n for n in sys.modules if n.startswith(("webloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(contract.queries()) - {"pipeline"} == set(QUERIES)  # the pipeline may do without the package
    assert set(contract.oracle_sql()) == set(ORACLES)
