"""Every registered query with oracle SQL, compared on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import canonical

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert got == canonical(names, found.fetchall())


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= entry.queries().keys()


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
