"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x).__name__) if isinstance(x, str) else "", x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = entry_point.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(map(plain, r)) for r in df.select(columns).collect()]
    cursor = oracle.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert ordered(found) == ordered(expected)


def test_entry(spark):
    report = entry_point.entry(spark)
    assert report.count() > 0 and "style" in report.columns
