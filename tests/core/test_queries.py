"""Each query against its SQL on the smallest tables, and the shape of some plans."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from tessera import queries as core
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.sql(core.SQL[name])
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in found.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


@pytest.mark.parametrize("name", ["bridge_pairs", "compound_tuples", "fk_uniform", "rule_bound", "validate_unique", "gen_fallback"])
def test_plan(spark, name):
    plan = core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"):
        assert bad not in plan
