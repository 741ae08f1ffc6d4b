"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Sources share ``share`` times all words by weight. A source's target stops at ``most`` times its size and the
excess goes to the others by weight, which ends where one water level times the weight, cut at the cap, uses up
the budget. A source's rate over training time t in [0, 1] is its target times ``1 + slope * (2t - 1)``; the
integral ``t + slope * (t*t - t)`` is its share of demand met by t. A document's place in its source's shuffled
order (by md5 of the id) gives the demand met before it, and the integral's inverse its training position.

Running sums need no task that sees a whole source: a source's order is cut into ``buckets`` by the hash, bucket
sums are added up first, and a document adds only within its bucket.

Defined results: null text has size 0; a null source is a source of its own, last; a document of size 0, or of a
source with target 0, is never taken and has no position; rows that repeat an id, or have none, are documents of their
own, told apart by hashes of the whole row; equal rows are taken as often as there are. ``mix`` reads only the id, text and
source columns; ``mixed`` takes names for its own columns that the documents don't have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, row_marks, stored

WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (-0.5, 0.0, 0.5)


def targets(sources: DataFrame, weights: Sequence[float], slopes: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds weight, slope and target to ``(source, source_size)``, one row a source; the only sort of all sources."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod(rank, F.lit(len(values))) + 1)
    cap = most * F.col("source_size")
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    level = (share * F.sum("source_size").over(W.partitionBy()) - before) / after
    ranked = sources.withColumns({"weight": of(weights), "slope": of(slopes), "cap": cap}).withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("level", F.max(fits).over(W.partitionBy()))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "slope", target.alias("target"))


def reached(demand: Column, slope: Column) -> Column:
    """The time at which a source has met the share ``demand`` of its target: the inverse of t + slope * (t*t - t)."""
    return 2 * demand / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * demand))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    share: float = 1.5,
    most: float = 2.0,
    buckets: int = 4096,
    marks: Sequence[Column] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, slope, target, start, taken, position`` for each row of ``docs``.

    ``marks`` are passed on as ``mark0``, ``mark1`` and so on, and put rows that share id and size in order.

    ``taken``: words that the mix takes, repeats counted: all of the document in each whole pass over the source, and
    in the last pass as far as the source's target reaches. ``position``: training time of its first word.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    turn = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bucket = F.pmod(F.conv(F.substring(turn, 1, 8), 16, 10).cast("long"), F.lit(buckets))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), turn.alias("turn"),
        *[m.alias(f"mark{i}") for i, m in enumerate(marks)],
    ).withColumn("bucket", bucket)
    sized = stored(sized, "sizes")
    sums = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, share, most)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("first", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sums = sums.join(sources.withColumnRenamed("source", "s").hint("merge"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    sums = stored(sums, "offsets").withColumnsRenamed({"source": "s", "bucket": "b"})
    both = sized.hint("merge").join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    names = [f"mark{i}" for i in range(len(marks))]
    before = W.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", *names).rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("start", F.col("first") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    some = (F.col("size") > 0) & (F.col("target") > 0)
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor(F.col("target") - whole * F.col("source_size")) - F.col("start")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    taken = F.when(some, taken).otherwise(0).cast("long")
    return both.withColumn("taken", taken).select(
        "doc_id", "source", "size", "source_size", "slope", "target", "start", "taken",
        F.when(F.col("taken") > 0, reached(F.col("start") / F.col("target"), F.col("slope"))).alias("position"), *names,
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The training stream: the columns of ``docs``, a row for each pass that takes a document, sorted by position.

    The row of a pass that takes a part has the text's first words, white space kept.
    """
    found = mix(docs, id_col, text_col, source_col, marks=row_marks(docs), **options).where("taken > 0")
    passes = F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))
    found = found.withColumn("pass", F.explode(passes))
    demand = F.least((F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    left = F.col("taken") - F.col("pass") * F.col("size")
    names = ["mark0", "mark1", "pass", "position", "words", "cut"]
    own = dict(zip(names, (fresh(docs, f"mixed_{n}") for n in names)))
    place = reached(demand, F.col("slope"))
    found = found.select("mark0", "mark1", "pass", place.alias("position"), F.least("size", left).cast("int").alias("words"), (left < F.col("size")).alias("cut"))
    found = stored(found, "positions")
    marked = docs.withColumns(dict(zip((own["mark0"], own["mark1"]), row_marks(docs))))
    if found.groupBy("mark0", "mark1", "pass").count().where("count > 1").take(1):
        marked = marked.dropDuplicates([own["mark0"], own["mark1"]])  # equal rows meet all their places once
    found = found.withColumnsRenamed(own)
    ends = F.split(text_col, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col(own["cut"]), F.array_join(F.slice(ends, 1, F.col(own["words"])), "")).otherwise(F.col(text_col))
    rows = marked.hint("merge").join(found.hint("merge"), [own["mark0"], own["mark1"]])
    rows = rows.withColumn(text_col, text)
    return rows.orderBy(own["position"], id_col).select([f"`{c}`" for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][k + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][k + 1]::DOUBLE AS slope,
             2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope,
             least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.slope, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || turn[1:8])::BIGINT % 4096, turn, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 AND target > 0 THEN floor(target / source_size) * size
             + greatest(0, least(floor(target - floor(target / source_size) * source_size) - start, size)) ELSE 0 END::BIGINT AS taken FROM o)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       round(CASE WHEN taken > 0 THEN 2 * (start / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) END, 6) AS position
FROM k"""
