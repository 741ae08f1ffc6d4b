"""Regions: calibrated candidates, pools, clusters and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import robust_sigmoid
from .along import along

GROUP = ["session_id", "video_id", "event_id"]


def calibrated(candidates: DataFrame) -> DataFrame:
    """Adds ``normalized_relevance_score`` per (session, event), over all videos; a supplied one is kept but still counts."""
    given = F.col("normalized_relevance_score") if "normalized_relevance_score" in candidates.columns else F.lit(None).cast("double")
    scored = robust_sigmoid(candidates.withColumn("__given", given), ["session_id", "event_id"], "raw_relevance_score", "__own")
    return scored.withColumn("normalized_relevance_score", F.coalesce("__given", "__own")).drop("__given", "__own")


def atomic_regions(candidates: DataFrame, margin: float = 0.0) -> DataFrame:
    """One region a candidate, padded by ``margin``, its start not below 0. Calibrates first, before any constraint."""
    t = F.col("timestamp_seconds")
    return calibrated(candidates).select(
        F.concat(F.lit("atomic_"), "id").alias("id"), "session_id", "event_id", "video_id",
        F.greatest(F.lit(0.0), t - margin).alias("start_seconds"), (t + margin).alias("end_seconds"), F.array("id").alias("candidate_ids"),
        F.col("raw_relevance_score").alias("raw_coarse_score"), F.col("normalized_relevance_score").alias("normalized_coarse_score"),
        F.lit("pending").alias("refinement_status"), F.lit("active").alias("user_status"), "seq",
        t.alias("best_seconds"),
    )


def representative(regions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``best_seconds``: the time of a region's best raw candidate, the first on ties; its middle if none resolves."""
    own = regions.select("session_id", F.col("id").alias("region"), F.posexplode("candidate_ids").alias("pos", "candidate"))
    some = candidates.select("session_id", F.col("id").alias("candidate"), "timestamp_seconds", "raw_relevance_score")
    best = own.hint("merge").join(some.hint("merge"), ["session_id", "candidate"]).groupBy("session_id", "region")
    best = best.agg(F.max_by("timestamp_seconds", F.struct("raw_relevance_score", -F.col("pos"))).alias("best_seconds"))
    middle = (F.col("start_seconds") + F.col("end_seconds")) / 2
    out = regions.drop("best_seconds").hint("merge").join(best.withColumnRenamed("region", "id").hint("merge"), ["session_id", "id"], "left")
    return out.withColumn("best_seconds", F.coalesce("best_seconds", middle))


def pooled(regions: DataFrame, absolute: float = 0.0, delta: float = 0.15, most: int = 100_000) -> DataFrame:
    """The regions of each (session, video, event) that reach both thresholds, best first: adds ``rn`` and ``margin``.

    A member's margin is its lead over the pool's best other member: the runner-up for the first, the first for the rest.
    Rows are dealt by (session, video), so what is built on a video's pools needs no further exchange; to a fixed number of
    partitions, as adaptive execution would join those of few bytes, however much work is in them.
    """
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    regions = regions.repartition(parts, "session_id", "video_id").withColumn("score", F.coalesce("normalized_coarse_score", F.lit(0.0)))
    ranked = W.partitionBy(*GROUP).orderBy(F.desc("score"), "seq")
    best = F.max("score").over(W.partitionBy(*GROUP))
    pool = regions.withColumn("best", best).where((F.col("score") >= absolute) & (F.col("score") >= F.col("best") - delta))
    pool = pool.withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") <= most)
    top = F.col("score") - F.lead("score").over(ranked)
    margin = F.when(F.col("rn") == 1, F.coalesce(top, F.col("score"))).otherwise(F.col("score") - F.first("score").over(ranked))
    return pool.withColumn("margin", margin).drop("best")


def over(a: float | None, b: float | None, most: float) -> bool:
    """Whether ``a - b`` is above ``most``; what isn't known is not."""
    return a is not None and b is not None and a - b > most


def clusters(candidates: DataFrame, gap: float = 3.0, margin: float = 3.0, longest: float = 30.0) -> DataFrame:
    """Runs of a group's hits in time: cut where the gap, or the span from the run's start, is too long (both strictly).

    The span rule depends on where the run began, so sorted hits stream past with the run's start, its last hit and its number as
    state; runs are then grouped. Gives ``start_seconds, end_seconds`` with margins, candidate ids in time order, and the best
    scores. Clusters can touch once they have margins: ``merged`` unites them, and ``clustered`` does both.
    """
    if longest < 2 * margin:
        raise ValueError("a region must hold both margins")
    core = longest - 2 * margin
    group = ["session_id", "event_id", "video_id"]

    def step(state: tuple | None, t: float | None) -> tuple[tuple, int]:
        if state is None:
            return (t, t, 0), 0
        start, last, run = state
        if over(t, last, gap) or over(t, start, core):
            return (t, t, run + 1), run + 1
        return (start, t, run), run

    hits = calibrated(candidates).withColumn("timestamp_seconds", F.col("timestamp_seconds").cast("double"))
    runs = along(hits, group, ["timestamp_seconds", "frame_id", "id"], ["timestamp_seconds"], step, "__run")
    hit = F.struct(F.col("timestamp_seconds").alias("t"), "frame_id", "id")
    runs = runs.groupBy(*group, "__run").agg(
        F.min("timestamp_seconds").alias("a"), F.max("timestamp_seconds").alias("z"), F.transform(F.array_sort(F.collect_list(hit)), lambda h: h.id).alias("ids"),
        F.max("raw_relevance_score").alias("raw"), F.max("normalized_relevance_score").alias("norm"),
    )
    return runs.select(
        F.concat_ws(":", F.lit("region"), "session_id", "event_id", "video_id", F.element_at("ids", 1)).alias("id"),
        "session_id", "event_id", "video_id", F.greatest(F.lit(0.0), F.col("a") - margin).alias("start_seconds"),
        (F.col("z") + margin).alias("end_seconds"), F.col("ids").alias("candidate_ids"), F.col("raw").alias("raw_coarse_score"),
        F.col("norm").alias("normalized_coarse_score"), F.lit("pending").alias("refinement_status"), F.lit("active").alias("user_status"),
    )


def clustered(candidates: DataFrame, gap: float = 3.0, margin: float = 3.0, longest: float = 30.0) -> DataFrame:
    """Clusters, and those that touch by their margins united, up to ``longest``."""
    return merged(clusters(candidates, gap, margin, longest), longest)


def merged(regions: DataFrame, longest: float | None = None) -> DataFrame:
    """Unites overlapping or touching regions of a scope, unless the union would be longer than ``longest``.

    Regions are taken in the order of start, end and id, each against the last one kept, whose ends are the state.
    """
    scope = ["session_id", "event_id", "video_id", "refinement_status", "user_status"]

    def step(state: tuple | None, a: float | None, z: float | None) -> tuple[tuple, int]:
        if state is None:
            return (a, z, 0), 0
        start, end, part = state
        low, high = least(a, start), most(z, end)
        if over(a, end, 0.0) or (longest is not None and over(high, low, longest)):
            return (a, z, part + 1), part + 1
        return (low, high, part), part

    least = lambda x, y: y if x is None else x if y is None else min(x, y)
    most = lambda x, y: y if x is None else x if y is None else max(x, y)
    kinds = {c: F.col(c).cast("double") for c in ("start_seconds", "end_seconds")}
    parts = along(regions.withColumns(kinds), scope, ["start_seconds", "end_seconds", "id"], ["start_seconds", "end_seconds"], step, "__part")
    one = F.struct(F.col("start_seconds").alias("a"), F.col("end_seconds").alias("z"), "id", F.col("candidate_ids").alias("ids"))
    out = parts.groupBy(*scope, "__part").agg(
        F.array_sort(F.collect_list(one)).alias("rows"), F.min("start_seconds").alias("a"), F.max("end_seconds").alias("z"),
        F.max("raw_coarse_score").alias("raw"), F.max("normalized_coarse_score").alias("norm"),
    )
    ids = F.array_distinct(F.flatten(F.transform("rows", lambda r: r.ids)))
    return out.select(
        F.col("rows")[0].id.alias("id"), "session_id", "event_id", "video_id", F.col("a").alias("start_seconds"), F.col("z").alias("end_seconds"),
        F.when(F.size("rows") == 1, F.col("rows")[0].ids).otherwise(ids).alias("candidate_ids"),
        F.col("raw").alias("raw_coarse_score"), F.col("norm").alias("normalized_coarse_score"),
        "refinement_status", "user_status",
    )


def _islands(regions: DataFrame, scope: list[str]) -> DataFrame:
    """Adds ``__island``, which goes up where a region starts after all earlier ones' ends."""
    w = W.partitionBy(*scope).orderBy("start_seconds", "end_seconds", "id")
    reach = F.max("end_seconds").over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.when(F.col("start_seconds") > reach, 1).otherwise(0)
    return regions.withColumn("__new", first).withColumn("__island", F.sum("__new").over(w)).drop("__new")


def islands(regions: DataFrame) -> DataFrame:
    """Merging without a length limit, as windows: a new island where a region starts after all earlier ones' ends."""
    scope = ["session_id", "event_id", "video_id", "refinement_status", "user_status"]
    return _islands(regions, scope).groupBy(*scope, "__island").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.count("*").alias("regions"),
        F.max("raw_coarse_score").alias("raw_coarse_score"), F.max("normalized_coarse_score").alias("normalized_coarse_score"),
    ).drop("__island")


def listed(regions: DataFrame, event: str | None = None, video=None) -> DataFrame:
    """The regions of one event, one video, or both; plain comparisons, which reach a Parquet scan."""
    if event is not None:
        regions = regions.where(F.col("event_id") == event)
    return regions if video is None else regions.where(F.col("video_id") == video)


def duration(start: str = "start_seconds", end: str = "end_seconds") -> Column:
    """Length of a region, to three digits."""
    return F.round(F.col(end) - F.col(start), 3)


def seeds(regions: DataFrame, candidates: DataFrame, ratio: float = 0.1, regions_kept: int = 2, most: int = 6) -> DataFrame:
    """Anchor times of each (event, video): candidates, best raw first, of the best regions within a relative threshold."""
    best = F.max("raw_coarse_score").over(W.partitionBy(*GROUP))
    order = W.partitionBy(*GROUP).orderBy(F.desc("raw_coarse_score"), "start_seconds", "id")
    kept = regions.withColumn("best", best).where(F.col("raw_coarse_score") >= F.col("best") * (1 - ratio))
    kept = kept.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= regions_kept)
    own = kept.select(*GROUP, "rn", F.posexplode("candidate_ids").alias("pos", "id"))
    hits = candidates.select("session_id", "id", "timestamp_seconds", "raw_relevance_score")
    some = own.hint("merge").join(hits.hint("merge"), ["session_id", "id"])
    by = W.partitionBy(*GROUP).orderBy(F.desc("raw_relevance_score"), "rn", "pos")
    return some.withColumn("seed", F.row_number().over(by)).where(F.col("seed") <= most).select(*GROUP, "seed", "id", "timestamp_seconds", "raw_relevance_score")
