"""Every registered query outside the training-data folder against DuckDB on the same small tables."""

import math

import duckdb
import pytest

from folioscope.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, duck, sf):
    ours = QUERIES[name](spark, sf)
    got = rows(ours.columns, [tuple(r) for r in ours.collect()])
    theirs = duck.execute(ORACLES[name])
    want = rows([c[0] for c in theirs.description], theirs.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
