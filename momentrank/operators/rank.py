"""Video rankings: independent best-per-event, priorities of tuple winners, and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import robust_sigmoid
from ..tables import small, written


def distinctness(times: Column, norm: float = 3.0) -> Column:
    """Smallest gap between sorted neighbours over ``norm``, at most 1; 1 with fewer than two times. Nulls are left out."""
    t = F.array_sort(F.filter(times, lambda x: x.isNotNull()))
    gaps = F.zip_with(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(t) < 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.array_min(gaps) / norm))


def independent(regions: DataFrame, events: Sequence[str], weights: tuple[float, float, float, float] = (0, 1, 0, 0), norm: float = 3.0) -> DataFrame:
    """Best region of each (video, event), the last on ties; coverage, mean, minimum and distinctness, and their blend.

    Regions without a normalised score are calibrated over all active regions of the session together.
    """
    active = robust_sigmoid(regions, ["session_id"], "raw_coarse_score", "__own")
    active = active.withColumn("score", F.coalesce("normalized_coarse_score", "__own")).where(F.col("event_id").isin(list(events)))
    middle = (F.col("start_seconds") + F.col("end_seconds")) / 2
    best = active.groupBy("session_id", "video_id", "event_id").agg(F.max(F.struct("score", "seq", middle.alias("t"))).alias("b"))
    n, s = len(events), F.col("b.score")
    rows = best.groupBy("session_id", "video_id").agg(
        F.count("*").alias("event_coverage"), (F.sum(s) / n).alias("mean_score"), F.min(s).alias("low"), F.collect_list("b.t").alias("times")
    )
    low = F.when(F.col("event_coverage") < n, F.lit(0.0)).otherwise(F.col("low"))
    rows = rows.withColumns({"normalized_coverage": F.col("event_coverage") / n, "min_score": low, "distinctness": distinctness(F.col("times"), norm)})
    parts = ["normalized_coverage", "mean_score", "min_score", "distinctness"]
    blend = sum((w * F.col(c) for w, c in zip(weights, parts)), F.lit(0.0)) / float(sum(weights))
    return rows.withColumn("priority_score", blend).drop("low", "times")


def priorities(videos: DataFrame, events: Sequence[str], candidates: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Final rows of tuple winners: coverage, mean, minimum, distinctness, matched frames and times, and a watch url.

    A frame pin of the video wins over the winner's own frame; what doesn't resolve is ``?`` and null.
    """
    n = len(events)
    ids = F.transform("region_ids", lambda x: F.regexp_replace(x, "^atomic_", ""))
    zipped = F.arrays_zip(F.array(*map(F.lit, events)).alias("event_id"), ids.alias("id"))
    places = videos.select("session_id", "video_id", F.posexplode(zipped).alias("pos", "x")).select("session_id", "video_id", "pos", "x.event_id", "x.id")
    frames = candidates.select("session_id", "id", "frame_id", "timestamp_seconds")
    found = places.hint("merge").join(frames.hint("merge"), ["session_id", "id"], "left")
    frame, time = F.col("frame_id").cast("string"), F.col("timestamp_seconds")
    if pins is not None:
        fixed = pins.where("fixed_frame_id is not null").select(
            "session_id", "event_id", F.col("fixed_video_id").alias("video_id"), "fixed_frame_id", "fixed_timestamp_seconds"
        )
        found = found.join(small(fixed), ["session_id", "event_id", "video_id"], "left")
        pinned = F.col("fixed_frame_id").isNotNull()
        frame, time = F.when(pinned, F.col("fixed_frame_id").cast("string")).otherwise(frame), F.when(pinned, F.col("fixed_timestamp_seconds")).otherwise(time)
    one = F.struct("pos", F.coalesce(frame, F.lit("?")).alias("frame"), time.alias("time"))
    matched = found.groupBy("session_id", "video_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    out = videos.hint("merge").join(matched.hint("merge"), ["session_id", "video_id"])
    covered = F.size(F.filter("region_ids", lambda x: x.isNotNull()))
    return out.select(
        "session_id", "video_id", covered.alias("event_coverage"), (covered / n).alias("normalized_coverage"),
        F.concat_ws("/", covered.cast("string"), F.lit(str(n))).alias("coverage_label"), F.col("region_mean_score").alias("mean_best_event_score"),
        F.array_min("region_scores").alias("min_best_event_score"), F.array_max("region_scores").alias("max_best_event_score"), distinctness(F.col("timestamps")).alias("distinctness"), "order_score",
        "raw_score", "priority_score", F.transform("m", lambda x: x.frame).alias("matched_frame_ids"), F.transform("m", lambda x: x.time).alias("matched_timestamps"),
    )


def watch_urls(candidates: DataFrame) -> DataFrame:
    """First non-null url of each video, by ingest order."""
    some = candidates.where("watch_url is not null")
    return some.groupBy("session_id", "video_id").agg(F.min_by("watch_url", "seq").alias("watch_url"))


def final_order(rows: DataFrame, rules: DataFrame | None = None) -> list[Column]:
    """Sort keys of a session's videos: priority, raw score, coverage, id; see ``listed_first`` for rules."""
    front = [F.asc_nulls_last("pos")] if rules is not None else []
    return [*front, F.round("priority_score", 9).desc(), F.round("raw_score", 9).desc(), F.desc("event_coverage"), F.asc("video_id")]


def listed_first(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``pos``, the place in the list of prioritised videos; scores stay as they are."""
    front = rules.where("rule = 'prioritize'").select("session_id", "video_id", "pos")
    return rows.join(small(front), ["session_id", "video_id"], "left")


def page(rows: DataFrame, order: Sequence[Column | str], offset: int, limit: int, ranges: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order, with the total of all rows.

    Rows are written in ranges of the order (as many as Spark's shuffle has, or ``ranges``) and counted by range; only the ranges
    that the page lies in are read again and sorted, so a late page costs what the first one does. Without rows it is empty.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit can't be negative")
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("__range", F.spark_partition_id())
    held = written(dealt, "page")
    counts = sorted(held.groupBy("__range").count().collect())  # a row a shuffle partition
    total, before, start, picked = sum(c["count"] for c in counts), 0, None, []
    for c in counts:
        if before < offset + limit and before + c["count"] > offset:
            start = before if start is None else start
            picked.append(c["__range"])
        before += c["count"]
    low, high = (picked[0], picked[-1]) if picked else (0, -1)
    some = held.where(F.col("__range").between(low, high)).drop("__range").orderBy(*order)
    return some.offset(offset - (start or 0) if picked else 0).limit(limit).withColumn("total", F.lit(total).cast("long"))


def overfetch(rows: DataFrame, rejected: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    """The best ``limit`` rows whose video isn't rejected."""
    return rows.join(small(rejected.select("video_id").distinct()), "video_id", "left_anti").orderBy(*order).limit(limit)
