"""Every query of the catalogue against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from tarn.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(rows):
    return sorted((tuple(map(str, r)) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = _rows([[r[c] for c in columns] for r in found.collect()])
    assert got
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert got == _rows([[r[names.index(c)] for c in columns] for r in want.fetchall()])
