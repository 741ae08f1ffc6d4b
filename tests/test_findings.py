"""Inputs on which a query once differed from its SQL, or grew faster than its tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from momentrank import queries
from momentrank.functions.medians import quantiles
from momentrank.operators import evaluate


def same_rows(spark, name, folder, **tables):
    """The query over tables made of rows equals its SQL; gives the rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    have = [tuple(r[c] for c in names) for r in got.collect()]
    assert Counter(have) == Counter(cursor.fetchall())
    return have


@pytest.mark.parametrize("name", ["config_diff", "stale_stages"])
def test_settings_of_a_zero_balance_and_of_a_repeated_key(spark, tmp_path, name):
    rows = [(1, -0.0, "A"), (2, 0.0, "A"), (4, -999.5, "B"), (5, -0.0, "A"), (7, 9000.0, "A"), (8, 9000.0, "A"), (8, 10000.0, "B"), (9, None, None), (10, 9500.0, "A"), (10, 10500.0, "B")]
    have = same_rows(spark, name, tmp_path, customer=spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string"))
    assert {r[0] for r in have} == {"5", "7", "9", "10"}


def sort_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_violations_join_in_steps(spark, sf):
    """The places of a gap's events are joined and written step by step, not in each part and all in one stage."""
    assert sort_joins(queries.QUERIES["constraint_violations"](spark, sf)) <= 1


def test_items_of_two_sort_keys_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "query_id long, video long, a double, b double"
    items = spark.createDataFrame([(1, 1, 0.9, 0.1), (1, 2, 0.8, 0.2), (2, 1, 0.5, 0.5)], kind).mapInArrow(each, kind)
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "query_id long, video long")
    rows = evaluate.sort_key_effect(items, truth, "a", "b").orderBy("query_id").collect()
    assert [(r.rank_a, r.rank_b, r.moved) for r in rows] == [(1, 2, True), (1, 1, False), (None, None, False)]
    assert seen.value == 3


@pytest.mark.parametrize("n", [0, 1, 2, 101, 5000])
def test_quantiles_without_all_values_in_one_task(spark, n):
    rows = spark.range(n).select(F.when(F.col("id") % 10 != 3, (F.col("id") * 7919 % 997) / 8).alias("x"))
    found = quantiles(rows, "x", {"a": 0.0, "b": 0.5, "c": 0.95})
    want = rows.agg(*[F.percentile("x", share).alias(name) for name, share in (("a", 0.0), ("b", 0.5), ("c", 0.95))])
    assert found.columns == want.columns and found.first() == pytest.approx(want.first())
