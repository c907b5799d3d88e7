"""Each query of the catalogue against its SQL on the small tables."""

import os

import duckdb
import pytest

from loomgraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(x, 4) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, db):
    df = QUERIES[name](spark, SF)
    sql = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())
