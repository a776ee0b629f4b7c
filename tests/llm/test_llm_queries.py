"""Each registered query of the subpackage runs over the smallest data, and agrees with its SQL where it has one."""

from __future__ import annotations

import glob
import os

import pytest

from leafstream.llm.oracles import ORACLES
from leafstream.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert found
    if name in ORACLES:
        duckdb = pytest.importorskip("duckdb")
        connection = duckdb.connect()
        for path in glob.glob(f"{DATA}/*.parquet"):
            connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        cursor = connection.execute(ORACLES[name])
        names = [c[0] for c in cursor.description]
        rows = [dict(zip(names, r)) for r in cursor.fetchall()]
        assert found == sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
