"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from docfacts.plans import release_queries, text_queries  # noqa: F401
from docfacts.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    cursor = db.execute(ORACLE_SQL[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    want = sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
