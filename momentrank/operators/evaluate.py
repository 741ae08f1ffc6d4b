"""Offline evaluation: hits to videos, ranks of the truth, recall and reciprocal rank, interval hits, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.medians import quantiles
from ..functions.text import timestamp_seconds
from ..tables import small, written

KS = (1, 5, 20, 50, 100)


def video_scores(hits: DataFrame, method: str = "max", top_m: int = 3, temperature: float = 1.0, k: float = 60.0) -> DataFrame:
    """``query_id, video, score, hit_count, best`` by max, top_m_mean, logsumexp or rrf; a missing score counts 0.

    ``top_m_mean`` divides by min(m, n); logsumexp takes the maximum off before it scales. Rows without a video are left out.
    """
    hits = hits.where(F.col("video").isNotNull()).withColumn("score", F.coalesce("score", F.lit(0.0)))
    key = ["query_id", "video"]
    extra = [F.count("*").alias("hit_count"), F.max("score").alias("best")]
    if method == "max":
        return hits.groupBy(*key).agg(F.max("score").alias("score"), *extra)
    if method in ("top_m_mean", "rrf"):
        by = W.partitionBy(*key).orderBy(F.desc("score"))
        ranked = hits.withColumn("rn", F.row_number().over(by))
        score = F.avg(F.when(F.col("rn") <= max(1, top_m), F.col("score"))) if method == "top_m_mean" else F.sum(1 / (k + F.col("rn")))
        return ranked.groupBy(*key).agg(score.alias("score"), *extra)
    if method == "logsumexp":
        top = hits.withColumn("top", F.max("score").over(W.partitionBy(*key)))
        parts = top.groupBy(*key, "top").agg(F.sum(F.exp((F.col("score") - F.col("top")) / temperature)).alias("z"), F.count("*").alias("hit_count"))
        return parts.select(*key, (F.col("top") + temperature * F.log("z")).alias("score"), "hit_count", F.col("top").alias("best"))
    raise ValueError(f"unknown aggregation method: {method}")


def truth_ranks(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, rank, unique_videos``: 1-based place of each query's true video by score and id, null if it isn't there.

    Counts what stands before the truth instead of ranking all videos, so a query with many videos is never sorted in a task.
    """
    wanted = truth.select("query_id", F.col("video").alias("true_video"))
    mine = scores.select("query_id", F.col("video").alias("true_video"), F.col("score").alias("mine"))
    mine = wanted.hint("merge").join(mine.hint("merge"), ["query_id", "true_video"], "left")
    own = scores.join(small(mine), "query_id")  # a row a query; while they are few, no query's videos meet in one task
    a, b = F.round("score", 9), F.round("mine", 9)
    before = F.sum(((a > b) | ((a == b) & (F.col("video") < F.col("true_video")))).cast("int"))
    found = own.groupBy("query_id").agg(F.count("*").alias("unique_videos"), (F.max(F.when(F.col("mine").isNotNull(), 1)) + before).alias("rank"))
    out = truth.select("query_id").hint("merge").join(found.hint("merge"), "query_id", "left")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), F.coalesce("unique_videos", F.lit(0)).alias("unique_videos"))


def places(rows: DataFrame, by: Sequence[str], score: str, buckets: int = 1024) -> DataFrame:
    """Adds ``rank``, 1 for the best score in [0, 1] of each group, equal scores sharing it.

    Counts of score ranges come first, so a task orders one range of a group and never the whole group.
    """
    b = F.floor(F.col(score) * buckets)
    rows = rows.withColumn("__b", b)
    above = W.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n")).withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0)))
    inner = F.rank().over(W.partitionBy(*by, "__b").orderBy(F.desc(score)))
    out = rows.hint("merge").join(counts.drop("__n").hint("merge"), [*by, "__b"]).withColumn("rank", (F.col("__above") + inner).cast("long"))
    return out.drop("__b", "__above")


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def retrieval_metrics(results: DataFrame, ks: Sequence[int] = (1, 5, 10, 20, 50), by: Sequence[str] = ()) -> DataFrame:
    """Metrics of ``results(status, rank, unique_videos, latency_ms)``: over all rows, where errors are misses, and over
    rows that are ok. The median rank takes a miss of an ok row as the number of unique videos plus one."""
    ok, r = F.col("status") == "ok", F.col("rank")
    rank = F.when(ok, r)
    inverse = F.coalesce(1 / rank, F.lit(0.0))
    parts = [F.count("*").alias("query_count"), F.sum(ok.cast("long")).alias("evaluated_count"), F.sum((~ok).cast("long")).alias("error_count")]
    for k in ks:
        parts += [_share(rank <= k).alias(f"recall_at_{k}"), F.avg(F.when(ok, F.coalesce(r <= k, F.lit(False)).cast("double"))).alias(f"ok_recall_at_{k}")]
    parts += [
        F.avg(inverse).alias("mrr"), F.avg(F.when(ok, inverse)).alias("ok_mrr"), F.median(F.when(ok, F.coalesce(r, F.col("unique_videos") + 1))).alias("median_rank"),
        F.median(rank).alias("median_rank_found"), F.count(rank).alias("found"), F.sum((ok & r.isNull()).cast("long")).alias("missed"),
        F.min(F.when(ok, F.col("unique_videos"))).alias("videos_min"), F.median(F.when(ok, F.col("unique_videos"))).alias("videos_median"),
        F.avg(F.when(ok, F.col("unique_videos"))).alias("videos_mean"), F.max(F.when(ok, F.col("unique_videos"))).alias("videos_max"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_latency_ms"),
    ]
    return results.groupBy(*by).agg(*parts)


def found_metrics(results: DataFrame, ks: Sequence[int] = (1, 5, 10), by: Sequence[str] = ()) -> DataFrame:
    """The variant whose denominators are the found ranks only; 0 where nothing was found."""
    r = F.col("rank")
    parts = [F.coalesce(F.avg(F.when(r.isNotNull(), (r <= k).cast("double"))), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    out = [F.count("*").alias("queries_total"), F.count(r).alias("queries_with_truth"), *parts]
    return results.groupBy(*by).agg(*out, F.coalesce(F.avg(1 / r), F.lit(0.0)).alias("mrr"), F.median(r).alias("median_rank"))


def interval_hits(anchors: DataFrame, answers: DataFrame) -> DataFrame:
    """``video, hits``: events whose anchor lies in the answer's interval, both ends included; anchors without an answer don't count."""
    inside = F.col("anchor").between(F.col("start_seconds"), F.col("end_seconds"))
    return anchors.join(answers, ["video", "event"]).groupBy("video").agg(F.sum(inside.cast("long")).alias("hits"))


def hit_recalls(ks: Sequence[int] = KS) -> list[Column]:
    """Aggregates of ``rank`` and ``hits``: mean hits of rows within each k, and the final score, their mean."""
    at = [F.when(F.col("rank") <= k, F.col("hits")).otherwise(0) for k in ks]
    total = sum(at[1:], at[0]) / len(ks)
    return [*[F.avg(a).alias(f"hit_recall_at_{k}") for a, k in zip(at, ks)], F.avg(total).alias("final_score")]


def sweep_report(rows: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """Per ``config``: recalls, reciprocal rank, found ranks, mean hits and the final score of ``(config, video, rank, hits)``."""
    r = F.col("rank")
    return rows.groupBy("config").agg(
        F.count("*").alias("query_count"), *[_share(r <= k).alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"),
        F.count(r).alias("found"), F.median(r).alias("median_rank_found"), F.avg("hits").alias("mean_hits"), hit_recalls(ks)[-1],
    )


def failure_buckets(results: DataFrame) -> DataFrame:
    """Missed queries by cause: error, empty ranking, other."""
    kind = F.when(F.col("status") != "ok", "error").when(F.coalesce("unique_videos", F.lit(0)) == 0, "empty").otherwise("other")
    return results.where("status <> 'ok' or rank is null").groupBy(kind.alias("bucket")).agg(F.count("*").alias("queries"))


def sort_key_effect(items: DataFrame, truth: DataFrame, first: str, second: str) -> DataFrame:
    """``query_id, rank_a, rank_b, moved``: the truth's rank under two sort keys (both descending, then the video).

    Both ranks count the items twice, for the truth's score and for what is above it; so they are written first, not retrieved four times.
    """
    items = written(items, "items")
    a = truth_ranks(items.withColumn("score", F.col(first)), truth).select("query_id", F.col("rank").alias("rank_a"))
    b = truth_ranks(items.withColumn("score", F.col(second)), truth).select("query_id", F.col("rank").alias("rank_b"))
    both = a.hint("merge").join(b.hint("merge"), "query_id")
    return both.withColumn("moved", ~F.col("rank_a").eqNullSafe(F.col("rank_b")))


def agreement(rows: DataFrame, old: str, new: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of two flags, of their agreement, and of each direction of disagreement."""
    a, b = F.col(old) == 1, F.col(new) == 1
    parts = {"entries": F.count("*"), "old_flagged": F.count_if(a), "new_flagged": F.count_if(b), "agreements": F.count_if(a == b),
             "new_catches": F.count_if(b & ~a), "new_accepts": F.count_if(a & ~b)}
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])


def disagreements(rows: DataFrame, old: str, new: str) -> DataFrame:
    """The rows whose flags differ, with ``direction``: what the new one catches, or accepts."""
    a, b = F.col(old) == 1, F.col(new) == 1
    return rows.where(a != b).withColumn("direction", F.when(b, "new_catches").otherwise("new_accepts"))


def call_times(rows: DataFrame, seconds: str, by: Sequence[str] = ()) -> DataFrame:
    """``calls, min, max, avg, total`` of call times; rows without one don't count."""
    s = F.col(seconds)
    return rows.groupBy(*by).agg(F.count(s).alias("calls"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("avg"), F.sum(s).alias("total"))


def refined_deltas(rows: DataFrame, key: Sequence[str], events: str) -> DataFrame:
    """``key, event_id, anchor_seconds, refined_seconds, delta`` of nested events; missing arrays give nothing."""
    inner = rows.select(*key, F.explode(events).alias("e")).select(*key, "e.event_id", "e.anchor_seconds", "e.refined_seconds")
    return inner.withColumn("delta", F.col("refined_seconds") - F.col("anchor_seconds"))


def audited(queries: DataFrame, expected: DataFrame, missing: str = "error") -> DataFrame:
    """``queries`` after a check of their true ``video`` against ``expected(video)``: ``error`` refuses those it doesn't name,
    ``skip`` leaves them out, ``keep`` keeps them with a column ``expected``."""
    names = expected.select("video").distinct()
    if missing == "skip":
        return queries.hint("merge").join(names.hint("merge"), "video", "left_semi")
    if missing == "keep":
        marked = names.withColumn("expected", F.lit(True)).hint("merge")
        return queries.hint("merge").join(marked, "video", "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
    if missing != "error":
        raise ValueError(f"unknown mode: {missing}")
    lost = [r.video for r in queries.hint("merge").join(names.hint("merge"), "video", "left_anti").select("video").limit(5).collect()]
    if lost:
        raise ValueError(f"videos of queries that the list doesn't name, such as {lost}")
    return queries


def worth_refining(rows: DataFrame, worst: int = 100) -> DataFrame:
    """Rows whose rank may change a score: found, and not beyond the largest k. Goes before the costly stage."""
    return rows.where(F.col("rank") <= worst)


def status_counts(rows: DataFrame, label: str, items: str) -> DataFrame:
    """``label, status, items`` counted over nested arrays of structs with a status."""
    inner = rows.select(label, F.explode(items).alias("x"))
    return inner.groupBy(label, F.col("x.status").alias("status")).agg(F.count("*").alias("items"))


def boundary_errors(rows: DataFrame, tolerances: Sequence[float] = (1.0, 2.0)) -> DataFrame:
    """Recall within tolerances, mean and median error, and tail latencies of ``(error_seconds, latency_ms)`` [from documentation]."""
    rows = rows.withColumn("__off", F.abs("error_seconds"))
    off = F.col("__off")
    means = rows.agg(*[_share(off <= t).alias(f"within_{t:g}s".replace(".", "_")) for t in tolerances], F.avg(off).alias("mean_error"))
    median = quantiles(rows, "__off", {"median_error": 0.5})
    tails = quantiles(rows, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95})
    return means.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(tails))  # a row each


def bootstrap(rows: DataFrame, value: str, group: str, draws: int = 100, seed: int = 7) -> DataFrame:
    """Interval of the mean by drawing groups: each (group, draw) gets a Poisson weight from a hash, so no row is copied to a
    driver and reruns agree [from documentation]. Groups are summed first; only their sums are drawn."""
    sums = rows.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col("draw").cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(key, 1, 7), 16, 10).cast("long") + 0.5) / (1 << 28)
    steps, p, acc = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):  # the inverse of the Poisson distribution with mean 1
        acc += p
        steps = steps + (u > acc).cast("int")
        p /= k + 1
    means = drawn.withColumn("w", steps).groupBy("draw").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(q[0].alias("low"), q[1].alias("high"))


def attach_relations(events: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached relations joined by (video, position); a video whose counts differ gets none."""
    a = events.groupBy("video").agg(F.count("*").alias("a"))
    b = cached.groupBy("video").agg(F.count("*").alias("b"))
    same = a.join(b, "video").where("a = b").select("video")
    return events.join(cached.join(same, "video", "left_semi"), ["video", "pos"], "left")


def map_frames(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Hits with the event at their query's position, and ``seconds`` of their display time; positions out of range are dropped."""
    if "timestamp" in hits.columns:
        hits = hits.withColumn("seconds", timestamp_seconds(F.col("timestamp")))
    return hits.join(small(events.select(F.col("pos").alias("query"), "event")), "query")
