"""Exact medians and quantiles of populations of any size, without a population's values in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import small, written

#: Values of a population that one task orders; more are narrowed down first.
HELD = 1_000_000
#: Parts into which a pass cuts what is left of a population.
CUTS = 32


def medians(df: DataFrame, by: Sequence[str], value: str, held: int = HELD) -> DataFrame:
    """``by..., median``: the mean of the two middle values of each population; null without values. Nulls in ``value`` and in keys are left out.

    A population is known by its two middle places and by the bracket of values that they lie in. A pass takes approximate
    percentiles of the bracket as cuts, counts exactly what equals a cut and what lies between two, and keeps the part that holds the middle.
    Cuts decide the speed only: the bracket's ends are always among them, so each pass leaves less. Middle places in two parts
    are the end of one and the start of the other. What fits into ``held`` is ordered at last.
    """
    keys, v = list(by), F.col("__v")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).dropna(subset=keys)
    state = rows.groupBy(*keys).agg(F.count(v).alias("__inside"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    n = F.col("__inside")
    state = state.withColumns({"__k1": F.floor((n - 1) / 2), "__k2": F.floor(n / 2), "__median": F.when(F.col("__lo") == F.col("__hi"), F.col("__lo"))})
    state = written(state, "medians")
    done: list[DataFrame] = []
    while True:
        done.append(state.where("__median is not null or __inside = 0").select(*keys, F.col("__median").alias("median")))
        state = state.where("__median is null and __inside > 0")
        wide = state.where(n > held)
        if wide.isEmpty():
            break
        narrow = state.where(n <= held).select(*keys, "__inside", "__lo", "__hi", "__k1", "__k2", "__median")
        state = written(narrow.unionByName(narrowed(rows, keys, wide)), "medians")
    inside = rows.join(small(state), keys).where(v.between(F.col("__lo"), F.col("__hi")))
    upto = F.sum("__n").over(W.partitionBy(*keys).orderBy("__v"))
    counts = inside.groupBy(*keys, "__k1", "__k2", "__v").agg(F.count("*").alias("__n")).withColumn("__upto", upto)
    middle = lambda k: F.min(F.when(F.col("__upto") > F.col(k), v))
    last = counts.groupBy(*keys).agg(middle("__k1").alias("__a"), middle("__k2").alias("__b"))
    out = last.select(*keys, halfway("__a", "__b").alias("median"))
    for d in done:
        out = out.unionByName(d)
    return out


def halfway(a: str, b: str):
    return F.when(F.col(a) == F.col(b), F.col(a)).otherwise(0.5 * F.col(a) + 0.5 * F.col(b))


def narrowed(rows: DataFrame, keys: list[str], wide: DataFrame) -> DataFrame:
    """The part of each bracket in ``wide`` that holds the middle, or the median where the two middle values lie in two parts."""
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    inside = rows.join(small(wide), keys).where(v.between(lo, hi))
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = inside.groupBy(*keys, "__lo", "__hi", "__k1", "__k2").agg(F.percentile_approx(v, shares, 100 * CUTS).alias("__cuts"))
    cuts = cuts.withColumn("__cuts", F.array_sort(F.array_distinct(F.concat(F.array(lo, hi), "__cuts"))))
    part = 2 * F.size(F.filter("__cuts", lambda c: c < v)) + F.when(F.array_contains("__cuts", v), 1).otherwise(0)
    parts = rows.join(small(cuts), keys).where(v.between(lo, hi)).groupBy(*keys, "__k1", "__k2", part.alias("__part"))
    parts = parts.agg(F.count("*").alias("__n"), F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("__before", F.coalesce(before, F.lit(0)))
    held = parts.where("__before <= __k2 and __before + __n > __k1").groupBy(*keys, "__k1", "__k2")
    held = held.agg(
        F.sum("__n").alias("__inside"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.min("__before").alias("__before"),
        F.count("*").alias("__parts"), F.min("__hi").alias("__a"), F.max("__lo").alias("__b"),
    )
    known = F.when(F.col("__parts") > 1, halfway("__a", "__b")).when(lo == hi, lo)
    return held.select(*keys, "__inside", "__lo", "__hi", (F.col("__k1") - F.col("__before")).alias("__k1"), (F.col("__k2") - F.col("__before")).alias("__k2"), known.alias("__median"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: under each name the exact quantile of ``value``, between two neighbours as ``percentile`` has it; null without values.

    Counts of values are written in ranges, of which the driver gets the sums, a row a range; a task orders one range that holds a
    wanted place, and no task meets all values.
    """
    v, n = F.col("__v"), F.col("__n")
    counts = df.select(F.col(value).cast("double").alias("__v")).where("__v is not null").groupBy("__v").agg(F.count("*").alias("__n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = written(counts.repartitionByRange(parts, "__v").withColumn("__range", F.spark_partition_id()), "quantiles")
    sums = sorted((r["__range"], r["n"]) for r in line.groupBy("__range").agg(F.sum(n).alias("n")).collect())
    total = sum(x for _, x in sums)
    wanted = {}
    for share in shares.values():
        at = share * (total - 1)
        wanted |= {int(k): None for k in (math.floor(at), math.ceil(at)) if total}
    before = 0
    for own, size in sums:
        wanted |= {k: (own, k - before) for k in wanted if before <= k < before + size}
        before += size
    some = line.where(F.col("__range").isin(sorted({own for own, _ in wanted.values()})))
    some = some.withColumn("__upto", F.sum(n).over(W.partitionBy("__range").orderBy("__v")))
    value_at = lambda k: F.min(F.when((F.col("__range") == wanted[k][0]) & (F.col("__upto") > wanted[k][1]), v))
    out = []
    for name, share in shares.items():
        at = share * (total - 1)
        low, high = math.floor(at), math.ceil(at)
        one = F.lit(None).cast("double") if not total else value_at(low) if low == high else (high - at) * value_at(low) + (at - low) * value_at(high)
        out.append(one.alias(name))
    return some.agg(F.count("*").alias("__rows"), *out).drop("__rows")
