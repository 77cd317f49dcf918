"""The queries that SQL can express against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import os

import pytest

from epochal.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    duck = pytest.importorskip("duckdb").connect()
    for table in ("documents", "pages"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    mine, theirs = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(str(r[i]) for i in order) for r in theirs.fetchall())
    assert sorted(mine.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in sorted(mine.columns)) for r in mine.collect()) == want
