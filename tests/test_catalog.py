"""Every query of the catalogue against its SQL in an independent engine."""

import math

import duckdb
import pytest

from marlstone.plans.catalog import ORACLE, QUERIES
from marlstone.sources.tables import NAMES

TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def engine(sf):
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 9))
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_and_types(spark, sf, engine, name):
    got = QUERIES[name](spark, sf)
    want = engine.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(kinds[c], kinds[c].lower().replace(" ", "")) for c in got.columns} == dict(got.dtypes)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
