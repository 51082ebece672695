"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from webquarry.plans import registry

SF = "/root/testdata/sf0.001"
OWN = registry.ORACLES


def normal(rows):
    return sorted(
        [tuple("" if v is None else str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool)
               else str(v) for v in r) for r in rows])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation supplier documents pages benchmark conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})")
    assert normal([tuple(r) for r in got.select(*columns).collect()]) == normal(want.fetchall())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
