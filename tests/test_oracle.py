"""Every named query against its SQL restatement on another engine."""

import duckdb
import pytest
from conftest import SMALL

from fleetsight.plans.oracle import oracle_sql
from fleetsight.plans.workload import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want
