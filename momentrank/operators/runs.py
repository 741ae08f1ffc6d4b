"""Run logs, configurations and what must be rebuilt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import small

STAGES = ("retrieval", "region", "refinement", "tuple")
#: First stage that a change of a path affects; the longest prefix counts. Fixed values.
STAGE_OF = {"tuple_ranking": "tuple", "event.anchor_query": "retrieval", "event.boundary_type": "tuple", "event.temporal_relation": "tuple",
            "command.mark_videos": "refinement", "command.clear_allowed_videos": "refinement", "command.fix_frame": "tuple", "command.clear_constraint": "tuple"}


def latest(log: DataFrame, key: Sequence[str], attempt: str) -> DataFrame:
    """The last attempt of each key, as one aggregation."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), attempt).alias("x")).select(*key, "x.*")


def pending(queries: DataFrame, log: DataFrame, final: Sequence[str] = ("ok", "error")) -> DataFrame:
    """Queries without a final row in the log."""
    done = latest(log, ["query_id"], "attempt").where(F.col("status").isin(*final)).select("query_id")
    return queries.join(done, "query_id", "left_anti")


def replace_events(old: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """Stored rows of the named (session, event) give way to new ones; other events keep theirs."""
    kept = old.join(small(events.select("session_id", "event_id").distinct()), ["session_id", "event_id"], "left_anti")
    return kept.unionByName(new)


def replace_violations(old: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """``rule, id`` of new rows of an event that isn't replaced, and of ids that stand twice afterwards."""
    foreign = new.join(events, ["session_id", "event_id"], "left_anti").select(F.lit("foreign_event").alias("rule"), "id")
    twice = replace_events(old, new, events).groupBy("session_id", "id").count().where("count > 1")
    return foreign.union(twice.select(F.lit("duplicate_id"), "id"))


def config_diff(before: DataFrame, after: DataFrame, *key: str) -> DataFrame:
    """``key, path, before, after`` of leaf paths whose values differ; both sides are ``(key, path, value)``, a row a key and path.

    The key is ``session_id``, or the named columns."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    return a.hint("merge").join(b.hint("merge"), [*(key or ["session_id"]), "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def flattened(df: DataFrame, key: str) -> DataFrame:
    """``key, path, value`` of every leaf of a row's nested structs; arrays are leaves, written as JSON."""

    def leaves(schema, prefix: str) -> list[str]:
        out = []
        for f in schema:
            name = f"{prefix}{f.name}"
            out += leaves(f.dataType, f"{name}.") if f.dataType.typeName() == "struct" else [name]
        return out

    paths = [p for p in leaves(df.schema, "") if p != key]
    one = lambda p: F.struct(F.lit(p).alias("path"), F.to_json(F.struct(F.col(p).alias("v"))).alias("value"))
    return df.select(key, F.inline(F.array(*map(one, paths))))


def stale(diff: DataFrame, key: str = "session_id", rules: dict[str, str] = STAGE_OF) -> DataFrame:
    """``key, stage_no, stage`` to rebuild: the earliest stage that a changed path affects, and all after it.

    A path without a rule gives ``unknown``.
    """
    spark = diff.sparkSession
    table = spark.createDataFrame([(p, STAGES.index(s)) for p, s in rules.items()], "prefix string, first int")
    some = diff.select(key, "path").distinct()
    hit = (F.col("path") == F.col("prefix")) | F.col("path").startswith(F.concat("prefix", F.lit(".")))
    rules_ = some.join(F.broadcast(table), hit, "left")  # a fixed handful of rules
    first = rules_.groupBy(key, "path").agg(F.max_by("first", F.length("prefix")).alias("first"))
    unknown = first.where("first is null").select(key, F.lit(-1).alias("stage_no"), F.lit("unknown").alias("stage")).distinct()
    known = first.groupBy(key).agg(F.min("first").alias("first")).where("first is not null")
    steps = known.select(key, F.explode(F.sequence("first", F.lit(len(STAGES) - 1))).alias("stage_no"))
    return steps.withColumn("stage", F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage_no") + 1)).union(unknown)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``rows, digest``: a commutative digest of all rows, so order and partitioning don't matter; repeats count."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.conv(F.substring(row, i, 8), 16, 10).cast("long")
    parts = [F.coalesce(F.pmod(F.sum(part(i)), F.lit(1 << 32)), F.lit(0)).cast("long") for i in (1, 9, 17, 25)]
    return df.agg(F.count("*").alias("rows"), F.concat(*[F.lpad(F.lower(F.hex(p)), 8, "0") for p in parts]).alias("digest"))


def row_fingerprint(columns: Sequence[str], version: str) -> Column:
    """Digest of a row's values and a version."""
    return F.sha2(F.concat_ws("|", F.to_json(F.struct(*columns)), F.lit(version)), 256)


def run_counts(candidates: DataFrame, regions: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates, regions and runs of each session."""
    parts = [df.groupBy("session_id").agg(F.count("*").alias(n)) for df, n in ((candidates, "candidates"), (regions, "regions"), (runs, "runs"))]
    out = parts[0].join(parts[1], "session_id", "full_outer").join(parts[2], "session_id", "full_outer")
    return out.na.fill(0)


def wide_metrics(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """A column for each named metric of a map."""
    return runs.select("run_id", *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names])


def frontier(regions: DataFrame, videos: int = 5, per_event: int = 3, total: int = 60, explore: float = 0.15) -> DataFrame:
    """Regions to work on within a budget [from documentation].

    The best ``videos`` of each session by ``priority``, at most ``per_event`` regions of an event in a video, ``total`` in all.
    Classes: pinned first, then each event's best region, then the rest by score; the last ``explore`` share of the budget
    goes to a stable order of what is left. Choice of ours: exploration goes by region id's hash.
    """
    vids = regions.groupBy("session_id", "video_id").agg(F.max("priority").alias("p"))
    top = W.partitionBy("session_id").orderBy(F.desc("p"), "video_id")
    vids = vids.withColumn("vr", F.row_number().over(top)).where(F.col("vr") <= videos).select("session_id", "video_id", "vr")
    some = regions.join(small(vids), ["session_id", "video_id"])
    own = W.partitionBy("session_id", "video_id", "event_id").orderBy(F.desc("pinned"), F.desc("score"), "id")
    some = some.withColumn("er", F.row_number().over(own)).where(F.col("er") <= per_event)
    first = W.partitionBy("session_id", "event_id").orderBy(F.desc("score"), "id")
    some = some.withColumn("fr", F.row_number().over(first))
    kind = F.when(F.col("pinned"), 0).when(F.col("fr") == 1, 1).otherwise(2)
    by = W.partitionBy("session_id").orderBy(kind, F.desc("score"), "id")
    ranked = some.withColumn("kind", kind).withColumn("rank", F.row_number().over(by))
    steady = total - int(total * explore)
    by = W.partitionBy("session_id", (F.col("rank") > steady)).orderBy(F.md5("id"), "id")
    ranked = ranked.withColumn("er2", F.row_number().over(by))
    kept = (F.col("rank") <= steady) | (F.col("er2") <= total - steady)
    return ranked.where(kept).withColumn("explored", F.col("rank") > steady).drop("er", "fr", "er2", "rank", "vr")
