"""Compares a query with its SQL in DuckDB, as multisets of rows."""

from collections import Counter
from pathlib import Path

import duckdb


def same(spark, query, sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    got = query(spark, str(folder))
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    have = Counter(tuple(r[c] for c in sorted(names)) for r in got.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    assert have
