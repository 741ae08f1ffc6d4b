"""Tuple assembly: one pooled region an event in the same video, scored on relevance, order and closeness."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import gated, hinge, min_max
from ..tables import written
from .kbest import Pool, winners
from .regions import pooled

#: Regions and videos whose combinations a task makes at once.
REGIONS = 20_000


@dataclass(frozen=True)
class Gap:
    """Rule for two neighbouring events: hard bounds, and a soft penalty only where ``weight`` is set."""

    least: float = 0.0
    most: float | None = None
    tau: float | None = None
    weight: float | None = None


@dataclass(frozen=True)
class Params:
    absolute: float = 0.0
    delta: float = 0.15
    most_regions: int = 100_000
    order_weight: float = 1.2
    gate: str = "threshold"
    gate_threshold: float = 0.5
    pooling: str = "max"
    most_tuples: int = 20
    gap_tau: float = 25.0
    gap_weight: float = 0.05
    span: float | None = None
    #: Rules by the position of a pair's first event.
    gaps: dict[int, Gap] = field(default_factory=dict)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def order_score(times: Sequence[Column], pairs: Sequence[tuple[int, int]] | None) -> Column:
    """(kept - broken) / checked pairs, in [-1, 1]; equal times break a pair, a missing one drops it; no pair is 0.

    ``None`` stands for the chain of neighbours; an empty list means that there are relations, but none with a direction.
    """
    pairs = [(i, i + 1) for i in range(len(times) - 1)] if pairs is None else pairs
    if not pairs:
        return F.lit(0.0)
    checked = [F.when(times[i].isNotNull() & times[j].isNotNull(), 1).otherwise(0) for i, j in pairs]
    kept = [F.when(times[j] > times[i], 1).otherwise(0) for i, j in pairs]
    n = total(checked)
    return F.when(n > 0, (2 * total(kept) - n) / n).otherwise(F.lit(0.0))


def gap_terms(times: Sequence[Column], p: Params) -> tuple[Column, Column]:
    """Whether hard bounds reject a combination, and the mean penalty of the pairs that have one.

    An explicit rule takes the signed gap, so its default lower bound of 0 rejects the backward order; the default
    penalty takes the distance.
    """
    bad, sums, counts = [F.lit(False)], [F.lit(0.0)], [F.lit(0)]
    for i in range(len(times) - 1):
        both = times[i].isNotNull() & times[i + 1].isNotNull()
        gap = times[i + 1] - times[i]
        rule = p.gaps.get(i)
        if rule:
            off = gap < rule.least
            if rule.most is not None:
                off = off | (gap > rule.most)
            bad.append(both & off)
            if rule.weight is None:
                continue
            cost = hinge(gap, rule.tau or 0.0, rule.weight)
        elif p.gap_weight > 0:
            cost = hinge(F.abs(gap), p.gap_tau, p.gap_weight)
        else:
            continue
        sums.append(F.when(both, cost).otherwise(0.0))
        counts.append(F.when(both, 1).otherwise(0))
    n = total(counts)
    return reduce(lambda a, b: a | b, bad), F.when(n > 0, total(sums) / n).otherwise(F.lit(0.0))


def combinations(regions: DataFrame, events: Sequence[str], configs: dict[str, Params], pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The best ``most_tuples`` combinations of each video under each configuration: ``config``, ``rank_in_video`` and ``id_i, s_i, t_i,
    m_i`` of each event, null and 0 where it has no region.

    One exchange for all configurations: pools of a video, at the widest limits of all, meet in one row, an array an event. A
    configuration's pool is the first part of that, as pools are cut by score and place. A search takes the best combinations from
    them in order (``kbest``); it never makes their product. A task takes as many videos at once as have REGIONS regions together, or one.
    """
    many = list(configs.values())
    widest = min(p.absolute for p in many), max(p.delta for p in many), max(p.most_regions for p in many)
    pool = pooled(regions.where(F.col("event_id").isin(list(events))), *widest)
    one = F.struct(F.col("id").alias("id"), F.col("score").alias("s"), F.col("best_seconds").alias("t"), F.col("margin").alias("m"), F.col("rn").alias("rn"))
    pools = [F.collect_list(F.when(F.col("event_id") == e, one)).alias(f"p_{i}") for i, e in enumerate(events)]
    rows = pool.groupBy("session_id", "video_id").agg(*pools)
    n = len(events)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            held = sum((np.diff(big.column(f"p_{i}").offsets.to_numpy()) for i in range(n)), np.ones(big.num_rows, int))
            upto, at = np.cumsum(held), 0
            while at < big.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + REGIONS, "right")))
                yield from some(big.slice(at, to - at))
                at = to

    def some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = [np.diff(b.column(f"p_{i}").offsets.to_numpy()) for i in range(n)]
        flat = [b.column(f"p_{i}").flatten() for i in range(n)]
        held = [Held.of(x, size) for x, size in zip(flat, sizes)]
        for name, p in configs.items():
            own = [x.members(p) for x in held]
            there = np.flatnonzero(np.any([count > 0 for _, count, _ in own], axis=0))  # a video without any region has no combination
            videos, ranks, picked = winners([pool for pool, _, _ in own], [np.maximum(count, 1) for _, count, _ in own], there, p, pairs, p.most_tuples)
            keys = [b.column(c).take(pa.array(videos, pa.int64())) for c in ("session_id", "video_id")]
            found = []
            for x, (pool, _, at), j in zip(flat, own, picked):
                places = pa.array(np.maximum(at[j], 0), pa.int64(), mask=at[j] < 0)
                id_, score, time = (x.field(c).take(places) for c in range(3))
                found += [id_, score.fill_null(0.0), time, pa.array(pool.margin[j], pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(videos), pa.string()), *keys, pa.array(ranks, pa.int32()), *found], names)

    names = ["config", "session_id", "video_id", "rank_in_video", *[f"{c}_{i}" for i in range(n) for c in ("id", "s", "t", "m")]]
    keys = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("session_id", "video_id")]
    found = [f"id_{i} string, s_{i} double, t_{i} double, m_{i} double" for i in range(n)]
    return rows.mapInArrow(each, ", ".join(["config string", *keys, "rank_in_video int", *found]))


@dataclass(frozen=True)
class Held:
    """Regions of an event of many videos, one video after another: of each its video, and its place among its pool's and in the order of ids."""

    videos: int
    video: np.ndarray
    score: np.ndarray
    time: np.ndarray
    margin: np.ndarray
    rank: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(regions: pa.StructArray, sizes: np.ndarray) -> Held:
        score, time, margin, rank = (regions.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
        place = np.empty(len(score), int)
        place[pc.sort_indices(regions.field(0).fill_null("")).to_numpy()] = np.arange(len(score))
        return Held(len(sizes), np.repeat(np.arange(len(sizes)), sizes), np.nan_to_num(score), time, np.nan_to_num(margin), rank, place)

    def members(self, p: Params) -> tuple[Pool, np.ndarray, np.ndarray]:
        """Of a wider pool the pools of ``p`` (see ``regions.pooled``), their sizes, and where their regions stand in the wider one.

        A pool without regions has one that stands nowhere, -1. A region that is left alone has no runner-up: its margin is its score.
        """
        best = np.full(self.videos, -np.inf)
        np.maximum.at(best, self.video, self.score)
        kept = np.flatnonzero((self.score >= p.absolute) & (self.score >= best[self.video] - p.delta) & (self.rank <= p.most_regions))
        video = self.video[kept]
        count = np.bincount(video, minlength=self.videos)
        size = np.maximum(count, 1)
        to = np.arange(len(kept)) + ((np.cumsum(size) - size) - (np.cumsum(count) - count))[video]
        margin = np.where(count[video] == 1, self.score[kept], self.margin[kept])
        own = []
        for values, none in ((self.score[kept], 0.0), (self.time[kept], np.nan), (margin, 0.0), (self.place[kept], 0), (kept, -1)):
            own.append(np.full(size.sum(), none))
            own[-1][to] = values
        return Pool(*own[:4]), count, own[4]


def swept(regions: DataFrame, events: Sequence[str], configs: dict[str, Params], pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """``tuples`` under each of the named configurations, with the name as ``config``, from one pass over the regions."""
    n = len(events)
    rows = combinations(regions, events, configs, pairs)
    s, t, m = ([F.col(f"{c}_{i}") for i in range(n)] for c in "stm")
    mean, margin = total(s) / n, total(m) / n
    order = order_score(t, pairs)
    score = None
    for name, p in configs.items():
        weight = gated(p.gate, p.order_weight, margin if p.gate == "margin" else mean, p.gate_threshold)
        own = mean + weight * order - gap_terms(t, p)[1]
        is_own = F.col("config") == name
        score = F.when(is_own, own) if score is None else score.when(is_own, own)
    return rows.select(
        "config", "session_id", "video_id", score.alias("score"), mean.alias("region_mean_score"), margin.alias("margin_score"), order.alias("order_score"),
        F.array(*[f"id_{i}" for i in range(n)]).alias("region_ids"), F.array(*t).alias("timestamps"), F.array(*s).alias("region_scores"), "rank_in_video",
    )


def tuples(regions: DataFrame, events: Sequence[str], p: Params = Params(), pairs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The best ``most_tuples`` combinations of each video, with index-aligned arrays; order: score, then region ids.

    ``regions`` needs ``best_seconds``. Scores compare at nine decimals, so that equal ones tie on any machine.
    """
    return swept(regions, events, {"": p}, pairs).drop("config")


def ranked_videos(found: DataFrame, pooling: str = "max") -> DataFrame:
    """``session_id, video_id, raw_score`` pooled over kept tuples, with the winner's columns and the min-max priority.

    Of what ``swept`` gives, ``config`` comes too, and each configuration has its own scale.
    """
    by = [*(c for c in ("config",) if c in found.columns), "session_id"]
    if pooling == "max":
        raw = F.max(F.when(F.col("rank_in_video") == 1, F.col("score")))
    elif pooling == "mean":
        raw = F.avg("score")
    else:
        raise ValueError(f"unknown pooling: {pooling}")
    columns = ["region_mean_score", "order_score", "region_ids", "timestamps", "region_scores"]
    first = [F.first(F.when(F.col("rank_in_video") == 1, F.col(c)), ignorenulls=True).alias(c) for c in columns]
    videos = found.groupBy(*by, "video_id").agg(raw.alias("raw_score"), F.count("*").alias("tuples"), *first)
    videos = written(videos, "videos")  # one row a video; the ends of the scale and the scaled rows both read it
    return min_max(videos, by, "raw_score", "priority_score")
