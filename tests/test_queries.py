from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, duck

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], sf_dir) in (None, "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"exp1_strategies"}))
def test_query_without_sql_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["year", "feature", "n", "missing_rate", "psi"]


def test_no_machine_local_or_unreliable_cuts():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "steadfold")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                assert "localCheckpoint(" not in open(os.path.join(folder, f)).read()
