"""Every registered core query against its SQL in DuckDB, on the driver's smallest tables."""

from __future__ import annotations

import os

import pytest

from epochal.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert canonical(mine.columns, [tuple(r) for r in mine.collect()]) == canonical(names, theirs.fetchall())


def test_checkpoints_of_repeated_and_undated_lines(spark, duck, tmp_path):
    """Of 20 equal lines, and of lines without a date or a price, row numbers are SQL's."""
    odd = """SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM lineitem
        UNION ALL SELECT l.* FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 50) l, range(20)"""
    duck.execute(f"COPY ({odd}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    mine = QUERIES["per_key_checkpoints"](spark, str(tmp_path))
    theirs = own.execute(ORACLES["per_key_checkpoints"]).fetchall()
    assert len(theirs) > 300 and canonical(mine.columns, [tuple(r) for r in mine.collect()]) == canonical(mine.columns, theirs)
