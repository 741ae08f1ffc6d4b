"""Sequence match: one hit a query within a video, in query order or in any, close together scoring higher.

``hits(video, query, frame, score[, satisfied])``; queries are numbered from 0. Distance is summed over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tuples import total


def best_hits(hits: DataFrame, n: int, most: int | None) -> DataFrame:
    """Hits of queries 0 to n-1; where ``most`` is given, that many best a query and video, and ``truncated`` where there were more."""
    some = hits.where((F.col("query") >= 0) & (F.col("query") < n)).repartition("video")
    if most is None:
        return some.withColumn("truncated", F.lit(False))
    group = W.partitionBy("video", "query")
    ranked = some.withColumns({"rn": F.row_number().over(group.orderBy(F.desc("score"), "frame")), "truncated": F.count("*").over(group) > most})
    return ranked.where(F.col("rn") <= most).drop("rn")


def _matches(hits: DataFrame, n: int, most: int | None, ordered: bool, gamma: float, objects: bool, floor: float | None = None) -> DataFrame:
    """All matches, or with ``floor`` those that may score that much: a partial match is dropped once its bound is lower.

    The bound of a partial match takes the best score of each query to come, at no further distance.
    """
    some = best_hits(hits, n, most)
    ok = F.coalesce("satisfied", F.lit(False)) if "satisfied" in hits.columns else F.lit(False)
    one = F.struct(F.col("frame").alias("f"), F.col("score").alias("s"), ok.alias("ok"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("query") == q, one))).alias(f"q_{q}") for q in range(n)]
    tops = [F.max(F.when(F.col("query") == q, F.col("score"))).alias(f"top_{q}") for q in range(n)]
    rows = some.groupBy("video").agg(F.max("truncated").alias("truncated"), *lists, *tops)
    video = ["video", "truncated", *(f"top_{q}" for q in range(n))]
    frames: list[Column] = []
    for q in range(n):
        done = [f"{c}_{j}" for j in range(q) for c in ("f", "s", "ok")]
        rest = [f"q_{j}" for j in range(q + 1, n)]
        own = F.col(f"q_{q}")
        if ordered and q:  # only hits that go on from the one before are unnested
            own = F.filter(own, lambda x: x.f >= F.col(f"f_{q - 1}"))
        if ordered and q + 1 < n:  # and only those after which the next query has one
            own = F.filter(own, lambda x: x.f <= F.array_max(F.col(f"q_{q + 1}")).f)
        if floor is not None:
            later = [F.col(f"top_{j}") for j in range(q + 1, n)]
            sofar = [F.col(f"s_{j}") for j in range(q)]
            apart = [F.abs(frames[j] - frames[i]) for i in range(q) for j in range(i + 1, q)]

            def bound(x: Column) -> Column:
                best = total([*sofar, x.s, *later]) / n
                distance = total([F.lit(0), *apart, *[F.abs(x.f - f) for f in frames]])
                return F.when(best > 0, best / (1 + distance * gamma)).otherwise(0.0) >= floor - 1e-8

            own = F.filter(own, bound)
        rows = rows.select(*video, *done, *rest, F.explode(own).alias("x"))
        rows = rows.select(*video, *done, *rest, F.col("x.f").alias(f"f_{q}"), F.col("x.s").alias(f"s_{q}"), F.col("x.ok").alias(f"ok_{q}"))
        frames.append(F.col(f"f_{q}"))
    apart = [F.abs(frames[j] - frames[i]) for i in range(n) for j in range(i + 1, n)]
    distance = total(apart) if apart else F.lit(0)
    score = total([F.col(f"s_{q}") for q in range(n)]) / n / (1 + distance * gamma)
    if objects:
        any_ok = F.col("ok_0")
        for q in range(1, n):
            any_ok = any_ok | F.col(f"ok_{q}")
        rows = rows.where(any_ok)
    places = F.array(*[F.struct(frames[q].alias("frame"), F.lit(q).alias("query")) for q in range(n)])
    return rows.select("video", score.alias("score"), distance.alias("distance"), (places if ordered else F.array_sort(places)).alias("hits"), "truncated")


def ordered_matches(hits: DataFrame, n: int, most: int | None = None, gamma: float = 0.05, objects: bool = False) -> DataFrame:
    """Frames don't decrease in query order, so one frame may serve several queries; ``objects`` asks for one satisfied hit.

    All hits count unless ``most`` limits them; ``truncated`` tells the videos where that left some out.
    """
    return _matches(hits, n, most, True, gamma, objects)


def unordered_matches(hits: DataFrame, n: int, most: int | None = None, gamma: float = 0.05, objects: bool = False) -> DataFrame:
    """Any order; the hits are given in the order of frame and query."""
    return _matches(hits, n, most, False, gamma, objects)


def top(matches: DataFrame, k: int) -> DataFrame:
    """The best k over all videos; ties by video and frames."""
    return matches.orderBy(F.round("score", 9).desc(), "video", "hits").limit(k)


def top_matches(hits: DataFrame, n: int, k: int, ordered: bool = True, gamma: float = 0.05, objects: bool = False, first: int = 3) -> DataFrame:
    """``top`` of all matches, without making them all: the best few hits of each query give k matches, whose lowest score
    is a floor that the best k of all reach; partial matches that can't reach it are dropped as they are built. Exact."""
    some = top(_matches(hits, n, first, ordered, gamma, objects), k).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
    return top(_matches(hits, n, None, ordered, gamma, objects, some.low if some.n == k else None), k)


def satisfied(hits: DataFrame, keyframes: DataFrame, detections: DataFrame, required: list[str], threshold: float = 0.5) -> DataFrame:
    """Adds ``satisfied``: whether the hit's keyframe shows all required objects; a missing keyframe or detection is false.

    ``keyframes(video, frame, n)``, the first row of a frame counts (by ``seq``); ``detections(video, n, entities, scores)``.
    """
    first = W.partitionBy("video", "frame").orderBy("seq")
    frames = keyframes.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("video", "frame", "n")
    seen = detections.select("video", "n", contains_objects("entities", "scores", required, threshold).alias("satisfied"))
    out = hits.drop("satisfied").join(frames, ["video", "frame"], "left").join(seen, ["video", "n"], "left")
    return out.withColumn("satisfied", F.coalesce("satisfied", F.lit(False))).drop("n")


def contains_objects(entities: str, scores: str, required: list[str], threshold: float) -> Column:
    """Required names, case folded, are all among the entities that score enough; arrays are cut to the shorter."""
    size = F.least(F.size(entities), F.size(scores))
    pairs = F.arrays_zip(F.slice(entities, 1, size).alias("e"), F.slice(scores, 1, size).alias("s"))
    found = F.transform(F.filter(pairs, lambda x: x.s >= threshold), lambda x: F.lower(x.e))
    need = F.array(*[F.lit(r.lower()) for r in required]) if required else F.expr("cast(array() as array<string>)")
    return F.coalesce(F.size(F.array_except(need, found)) == 0, F.lit(False))


def grouped(hits: DataFrame) -> DataFrame:
    """Hits by video, in the order of frame and query."""
    return hits.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", "query", "score"))).alias("hits"))
