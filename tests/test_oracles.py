"""Every query of the library against its SQL in DuckDB, on the smallest test tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from momentrank import queries


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, con, sf, name):
    got = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    have = Counter(tuple(r[c] for c in sorted(names)) for r in got.collect())
    assert have == want and have


def test_all_registered_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_bootstrap_interval_holds_the_mean(spark, sf):
    row = queries.QUERIES["bootstrap_interval"](spark, sf).first()
    mean = spark.read.parquet(f"{sf}/lineitem.parquet").agg({"l_quantity": "avg"}).first()[0]
    assert row.low < mean < row.high and row.high - row.low < 1
