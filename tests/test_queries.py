"""Registered queries against their reference SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"
#: The library's own queries; those of optional parts are tested beside them.
NAMES = sorted(n for n in entry.oracle_sql() if re.match(r"[a-z]+[0-9]+_", n) and not re.match(r"op[0-9]+_", n))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(canon(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted("|".join(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want and got


def test_every_reference_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 5
