"""Boundary operators, all from documentation.

Samples are ``(group columns, t_ms, ...)`` with whole milliseconds, so window ends are exact. Choices of ours: the centre
belongs to neither side, window ends are inclusive, ties take the shorter left, then the shorter right window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import hinge, robust_sigmoid
from ..tables import written
from .along import along
from .tuples import total

WINDOWS_MS = (500, 1000, 2000, 3000)


def sides(group: Sequence[str], value: str, w: int) -> tuple[Column, Column, Column, Column]:
    """Mean and number of samples within w before and after the centre."""
    by = W.partitionBy(*group).orderBy("t_ms")
    left, right = by.rangeBetween(-w, -1), by.rangeBetween(1, w)
    return F.avg(value).over(left), F.count(value).over(left), F.avg(value).over(right), F.count(value).over(right)


def transition(samples: DataFrame, group: Sequence[str], windows: Sequence[int] = WINDOWS_MS, least: int = 2) -> DataFrame:
    """Adds ``boundary`` from ``p_pre, p_post, motion``: the best contrast over pairs of a left and a right window with
    ``least`` samples a side, less costs of length and asymmetry; null where no pair fits."""
    longest = max(windows)
    rows = samples
    for w in windows:
        for p in ("p_pre", "p_post"):
            la, ln, ra, rn = sides(group, p, w)
            rows = rows.withColumns({f"{p}_l{w}": la, f"n_l{w}": ln, f"{p}_r{w}": ra, f"n_r{w}": rn})
    scores = []
    for a in windows:
        for b in windows:
            post = F.col(f"p_post_r{b}") - F.col(f"p_post_l{a}")
            pre = F.col(f"p_pre_l{a}") - F.col(f"p_pre_r{b}")
            cost = 0.01 * (a + b) / (2 * longest) + 0.01 * abs(a - b) / longest
            fits = (F.col(f"n_l{a}") >= least) & (F.col(f"n_r{b}") >= least)
            scores.append(F.when(fits, 0.5 * post + 0.5 * pre + 0.1 * F.col("motion") - cost))
    return rows.select(*samples.columns, F.greatest(*scores).alias("boundary"))


def persistence(samples: DataFrame, group: Sequence[str], value: str, w: int = max(WINDOWS_MS)) -> DataFrame:
    """Adds ``persistence``: the mean within w of the centre, itself included."""
    by = W.partitionBy(*group).orderBy("t_ms").rangeBetween(-w, w)
    return samples.withColumn("persistence", F.avg(value).over(by))


def prominence(samples: DataFrame, group: Sequence[str], value: str, windows: Sequence[int] = WINDOWS_MS, least: int = 2) -> DataFrame:
    """Adds ``prominence``: the centre over half the sum of its sides' means, in the best window with ``least`` samples a side."""
    scores = []
    for w in windows:
        la, ln, ra, rn = sides(group, value, w)
        scores.append(F.when((ln >= least) & (rn >= least), F.col(value) - (la + ra) / 2))
    return samples.withColumn("prominence", F.greatest(*scores))


def event_blend(semantic: Column, boundary: Column, pre: Column, post: Column, weights: Sequence[float] = (0.4, 0.3, 0.1, 0.2)) -> Column:
    """Weighted blend over the weights' sum."""
    return total([w * c for w, c in zip(weights, (semantic, boundary, pre, post))]) / float(sum(weights))


def suppressed(samples: DataFrame, group: Sequence[str], value: str, radius: int = 500, most: int = 5) -> DataFrame:
    """Greedy suppression in time: the best sample of a group stays and those within the radius go, and so on, ``most`` times.

    Adds ``pick``. Samples stream past from the best to the worst, ties by time, with the kept times as state, ``most`` at most.
    """

    def step(kept: tuple | None, t: int) -> tuple[tuple, int | None]:
        kept = kept or ()
        if len(kept) >= most or any(abs(k - t) <= radius for k in kept):
            return kept, None
        return (*kept, t), len(kept) + 1

    some = samples.where(F.col(value).isNotNull() & F.col("t_ms").isNotNull()).select(*group, "t_ms", value)
    picks = along(some, group, [F.desc(value), "t_ms"], ["t_ms"], step, "pick").where("pick is not null")
    return picks.select(*group, F.col("pick").cast("int").alias("pick"), "t_ms", value)


def peaks(samples: DataFrame, group: Sequence[str], value: str, radius: int = 500) -> DataFrame:
    """The local-maximum form: samples that no sample within the radius exceeds."""
    by = W.partitionBy(*group).orderBy("t_ms").rangeBetween(-radius, radius)
    return samples.withColumn("__top", F.max(value).over(by)).where(F.col(value) == F.col("__top")).drop("__top")


def strict_tuples(proposals: DataFrame, events: Sequence[str], most: int = 8, tau: float = 10.0, weight: float = 0.01, bonus: float = 0.02, k: int = 20) -> DataFrame:
    """Ordered tuples over ``(session_id, video_id, event_id, id, t, score, pinned)``: all events, times strictly up.

    The mean score, less the mean gap penalty, plus a bonus for the share of pinned members; calibrated over a session's
    tuples. A video offers ``most`` proposals an event, a feature of the documented operator.
    """
    n = len(events)
    by = W.partitionBy("session_id", "video_id", "event_id").orderBy(F.desc("score"), "id")
    some = proposals.where(F.col("event_id").isin(list(events))).withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most)
    one = F.struct("t", "id", "score", F.col("pinned").cast("int").alias("pin"))
    lists = [F.collect_list(F.when(F.col("event_id") == e, one)).alias(f"p_{i}") for i, e in enumerate(events)]
    rows = some.groupBy("session_id", "video_id").agg(*lists)
    after = lambda i: F.filter(f"p_{i}", lambda x: x.t > F.col(f"x_{i - 1}").t)
    for i in range(n):
        rest = [f"p_{j}" for j in range(i + 1, n)]
        done = [f"x_{j}" for j in range(i)]
        own = after(i) if i else F.col("p_0")
        rows = rows.select("session_id", "video_id", *done, *rest, F.explode(own).alias(f"x_{i}"))
    x = [F.col(f"x_{i}") for i in range(n)]
    gaps = [hinge(x[i + 1].t - x[i].t, tau, weight) for i in range(n - 1)]
    raw = total([c.score for c in x]) / n - (total(gaps) / (n - 1) if gaps else 0.0) + bonus * total([c.pin for c in x]) / n
    out = rows.select("session_id", "video_id", raw.alias("raw"), F.array(*[c.id for c in x]).alias("ids"), F.array(*[c.t for c in x]).alias("times"))
    out = robust_sigmoid(written(out, "tuples"), ["session_id"], "raw", "score")
    best = W.partitionBy("session_id").orderBy(F.round("raw", 9).desc(), "video_id", "ids")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def frame_budget(regions: DataFrame, budget: int, medium: float = 0.5, dense: float = 0.1, radius: float = 1.0) -> DataFrame:
    """Sample times of each region: every ``medium`` seconds of it, and every ``dense`` within ``radius`` of its ``peak``.

    A session's budget is shared evenly over its regions; a region takes its first share of times, the dense ones first.
    """
    count = regions.groupBy("session_id").agg(F.count("*").alias("n"))
    rows = regions.join(count.hint("merge"), "session_id")
    steps = lambda a, z, by: F.transform(F.sequence(F.lit(0), F.floor((z - a) / by + 1e-9).cast("int")), lambda i: F.round(a + i * by, 3))
    lo, hi = F.greatest("start_seconds", F.col("peak") - radius), F.least("end_seconds", F.col("peak") + radius)
    fine = F.when(F.col("peak").isNotNull() & (hi >= lo), steps(lo, hi, dense)).otherwise(F.expr("cast(array() as array<double>)"))
    wide = steps(F.col("start_seconds"), F.col("end_seconds"), medium)
    times = F.slice(F.array_distinct(F.concat(fine, wide)), 1, F.greatest(F.lit(1), F.floor(budget / F.col("n")).cast("int")))
    return rows.select("session_id", "id", F.explode(F.array_sort(times)).alias("t"))


def sample_times(anchor: Column, fps: Column, radius: int = 10, stride: int = 1, duration_ms: Column | None = None) -> Column:
    """Whole milliseconds of frames around an anchor, ``radius`` steps of ``stride`` frames each way, clipped, distinct, sorted.

    Rounds half to even.
    """
    centre = F.bround(anchor * fps).cast("long")
    ms = lambda i: F.greatest(F.lit(0).cast("long"), F.bround((centre + i * stride) / fps * 1000).cast("long"))
    cut = (lambda x: F.least(x, duration_ms)) if duration_ms is not None else (lambda x: x)
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda i: cut(ms(i)))))


def native_windows(fps: Column, stride: int = 1) -> Column:
    """Window lengths in seconds of 2, 4 and 8 sampled frames."""
    return F.array(*[F.lit(float(stride * n)) / fps for n in (2, 4, 8)])
