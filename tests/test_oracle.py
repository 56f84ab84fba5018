"""Every base query with SQL against DuckDB on the smallest tables; the others must give rows."""

import glob
import os

import duckdb
import pytest

from scriptorium.plans import corpus_queries, file_queries, queries, record_queries, structure_queries, verse_queries, work_queries  # noqa: F401
from scriptorium.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def norm(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, list):
        return str([norm(v) for v in value])
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not glob.glob(f"{DATA}/*"), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in queries.ORACLE_SQL:
        out = duck.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, out.fetchall())
    else:
        assert got
