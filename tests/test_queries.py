"""Each query of the catalogue runs over the smallest data, and agrees with its SQL where it has one."""

from __future__ import annotations

import decimal
import glob
import math
import os

import pytest

from leafstream.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, int) and not isinstance(value, bool):
        return round(float(value), 6)
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert found
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        names = [c[0] for c in cursor.description]
        rows = [dict(zip(names, r)) for r in cursor.fetchall()]
        assert sorted(names) == columns
        expected = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
        assert found == expected
