"""Every registered query of the knowledge-base operators against its DuckDB counterpart."""

import datetime
import decimal

import duckdb
import pytest

from quire.plans import documents, faults, migration
from quire.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = df.collect()
    assert rows_of(df.columns, rows) == rows_of(names, got.fetchall())
    seen = {r[c] for r in rows for c in ("code", "result", "decision") if c in df.columns}
    assert (faults.EXPECTED | documents.EXPECTED | migration.EXPECTED).get(name, set()) <= seen
