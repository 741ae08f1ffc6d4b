"""Shared helpers of the training-data operators: shared storage, word splitting, components.

Operators write intermediate tables to the folder that ``spark.checkpoint.dir`` names. The frame an operator returns reads
them, so they stay until the result is used; a program that has written its result can put the calls in a ``run_folder``,
which removes them at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python pattern of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_run: ContextVar[str | None] = ContextVar("run", default=None)


@lru_cache(maxsize=1)
def own_folder() -> str:
    """One temporary folder, for driver and executors in one process."""
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one, only a local session can do, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or own_folder()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, inside the folder of the run if there is one."""
    return f"{_run.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside the block share a folder, which is removed at the block's end; results must be written by then."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, gives Spark true sizes, outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def row_marks(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row, 128 bits together; rows that share both are taken as equal."""
    columns = [F.to_json(F.struct(f"`{c}`")) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    return F.xxhash64(*columns), F.xxhash64(F.lit("again"), *columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches that are sorted by ``key``; the last run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if keys[0] == keys[-1]:
            if held and held[-1].column(key)[-1] != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int((values != values[-1]).nonzero()[0][-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


#: Edges of one node that one task joins; the edges of nodes with more are salted, and so are their partners.
HUB, SALTS = 256, 64


def salted_join(edges: DataFrame, side: DataFrame, key: str, other: str, size: int) -> DataFrame:
    """``edges`` joined with the row of ``side`` for each ``key``; a hub's edges are spread over SALTS tasks by ``other``.

    A hub has over HUB edges, and over 1/100,000 of all ``size`` edges, so there are 100,000 hubs at most to broadcast.
    """
    most = max(HUB, size // 100_000)
    hubs = edges.groupBy(F.col(key).alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("hub")
    hubs = edges.sparkSession.createDataFrame(hubs.collect(), hubs.schema)
    hot = F.broadcast(hubs.select("hub"))
    salt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int")
    edges = edges.join(hot, F.col(key) == F.col("hub"), "left").withColumn("salt", salt).drop("hub")
    salts = F.sequence(F.lit(0), F.when(F.col("hub").isNotNull(), SALTS - 1).otherwise(0))
    side = side.join(hot, F.col(key) == F.col("hub"), "left").withColumn("salt", F.explode(salts)).drop("hub")
    return edges.hint("merge").join(side.hint("merge"), [key, "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges`` as ``(node, root)``, root the smallest node; nodes without an edge have no row.

    Alternating large-star and small-star steps. Each keeps one edge for each node and neighbour group, so a
    component never grows into its pairs, and a hub's edges are salted in the joins; minima are combined before they
    are shuffled. A step is written to the shared folder, so a lost executor costs one step.
    """
    edge = stored(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges"
    )
    sign = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")), F.sum(F.xxhash64("lo", "hi").bitwiseAND(0xFFFFFF)))
    seen = edge.agg(sign).first()[0]
    while seen[0]:
        low = edge.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edge.select("hi", "lo"))
        low = low.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = salted_join(edge, low, "lo", "hi", seen[0]).select(F.col("m").alias("lo"), "hi").distinct()
        large = stored(large, "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = salted_join(large, least, "hi", "lo", seen[0]).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edge = stored(moved.where("lo < hi").union(least.select("m", "hi")).distinct(), "small")
        now = edge.agg(sign).first()[0]
        if now == seen:
            break
        seen = now
    return edge.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edge.select("lo", "lo").distinct())
