"""Registered queries against their checking SQL on the smallest given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from geoledger.workload.oracle import ORACLE

SF = "/root/testdata/sf0.001"
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    checked = sql.execute(entry.oracle_sql()[name])
    assert got == _rows([c[0] for c in checked.description], checked.fetchall())
