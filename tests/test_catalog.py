"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cytoplane.plans import catalog, matrix_queries, verb_queries  # noqa: F401  the others add their queries to the first

D = "/root/testdata/sf0.001"
TABLES = ["customer", "embeddings", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, D)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    q = db.execute(catalog.ORACLE_SQL[name])
    assert mine == rows([c[0] for c in q.description], q.fetchall())
