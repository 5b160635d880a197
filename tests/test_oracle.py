"""Registered Spark queries against their DuckDB oracle SQL on the smallest driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from scripts.check_oracle import duck_for, frame_digest
from tests.conftest import SMALL

ORACLE_KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return duck_for(SMALL)


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_matches_oracle(spark, duck, name):
    sp = entry.queries()[name](spark, SMALL).toPandas()
    dk = duck.sql(entry.oracle_sql()[name]).df()
    assert frame_digest(sp) == frame_digest(dk)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"league", "season", "team", "total_points", "position"} <= set(df.columns)
