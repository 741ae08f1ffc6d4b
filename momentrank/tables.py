"""Joins with small tables, and the binding of the library's tables to the test data."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side table (rules, statistics of groups, configurations) is broadcast; larger ones are merged.
SMALL = 10_000
#: Microseconds of 2024-01-01, the start of the test data's time axis.
ORIGIN = 1704067200000000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` for the small side of a join: broadcast once its rows are counted, and hinted to merge beyond the limit.

    The rows that the count has read are used again, so nothing is computed twice.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df.hint("merge")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-tables-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names, for what is read more than once.

    Its lineage is cut, so lost executors cost no more than a read. Only a local session can do without the setting.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(base or _own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts"):
    """Seconds on the test data's axis; whole microseconds are subtracted first, or doubles lose digits."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) - ORIGIN) / 1e6


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hits from ``events``: a user is a video, an event type an event, the value the relevance."""
    return table(spark, sf_dir, "events").select(
        F.lit("s").alias("session_id"), F.col("event_type").alias("event_id"), F.col("user_id").alias("video_id"),
        F.col("event_id").alias("frame_id"), seconds().alias("timestamp_seconds"), F.col("value").alias("raw_relevance_score"),
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"),
    )


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second binding, from ``orders``: a customer is a video, a priority an event."""
    return table(spark, sf_dir, "orders").select(
        F.lit("o").alias("session_id"), F.col("o_orderpriority").alias("event_id"), F.col("o_custkey").alias("video_id"),
        F.col("o_orderkey").alias("frame_id"), seconds("o_orderdate").alias("timestamp_seconds"),
        F.col("o_totalprice").alias("raw_relevance_score"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"),
    )


#: The same two bindings in SQL.
CANDIDATES_SQL = f"""c AS (
  SELECT 's' AS session_id, event_type AS event_id, user_id AS video_id, event_id AS frame_id,
         (epoch_us(ts) - {ORIGIN}) / 1e6 AS t, value AS raw, event_id::VARCHAR AS id, event_id AS seq FROM events)"""
ORDER_CANDIDATES_SQL = f"""c AS (
  SELECT 'o' AS session_id, o_orderpriority AS event_id, o_custkey AS video_id, o_orderkey AS frame_id,
         (epoch_us(o_orderdate) - {ORIGIN}) / 1e6 AS t, o_totalprice AS raw, o_orderkey::VARCHAR AS id, o_orderkey AS seq FROM orders)"""
