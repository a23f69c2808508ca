"""Every registered query against its SQL, on the smallest tables."""

import re

import duckdb
import pytest

from granary import plans
from granary.sources.tables import TABLES

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


def rows(columns, found):
    held = ({c: round(v, 6) if isinstance(v, float) else v for c, v in zip(columns, row)} for row in found)
    return sorted(repr(sorted(row.items())) for row in held)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    got = df.collect()
    if name not in plans.ORACLE_SQL:
        return
    want = duck.sql(plans.ORACLE_SQL[name])
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == {c: str(k) for c, k in zip(want.columns, want.types)}
    found = want.fetchall()
    assert rows(df.columns, got) == rows(want.columns, found)
    if re.search(r"ORDER BY [^()]*$", plans.ORACLE_SQL[name]):  # what is asked for in an order comes in it
        assert [repr(sorted(zip(df.columns, map(rounded, r)))) for r in got] == [repr(sorted(zip(want.columns, map(rounded, r)))) for r in found]


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
