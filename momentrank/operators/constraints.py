"""User rules as tables joined into the plan: pins, rejections, allowlists, edits, and reports of broken rules.

``video_rules(session_id, video_id, rule, pos)`` with rule allow, reject or prioritize;
``pins(session_id, event_id, fixed_video_id, fixed_region_id, fixed_frame_id, fixed_timestamp_seconds, rejected_region_ids)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import small, written


def exact_pin() -> Column:
    """The pin names a time, and doesn't mean an existing region."""
    region_only = F.col("fixed_frame_id").isNull() & F.col("fixed_region_id").isNotNull()
    return F.col("fixed_timestamp_seconds").isNotNull() & ~region_only


def covers() -> Column:
    return F.col("fixed_timestamp_seconds").between(F.col("start_seconds"), F.col("end_seconds"))


def pinned_regions(regions: DataFrame, pins: DataFrame) -> DataFrame:
    """A zero-width region of score 1 for every exact pin that no region of its event and video covers."""
    some = pins.where(F.col("fixed_video_id").isNotNull() & exact_pin())
    p, r = some.alias("p"), regions.alias("r")
    inside = F.col("p.fixed_timestamp_seconds").between(F.col("r.start_seconds"), F.col("r.end_seconds"))
    same = [F.col(f"p.{a}") == F.col(f"r.{b}") for a, b in (("session_id", "session_id"), ("event_id", "event_id"), ("fixed_video_id", "video_id"))]
    # the covered pins are few: find them by a join that broadcasts the pins, then drop them
    hit = r.join(small(some).alias("p"), reduce(lambda a, b: a & b, [*same, inside])).select("p.session_id", "p.event_id").distinct()
    bare = p.join(hit, ["session_id", "event_id"], "left_anti")
    name = F.concat_ws(":", F.lit("fixed"), "event_id", "fixed_video_id")
    t = F.col("fixed_timestamp_seconds")
    return bare.select(
        name.alias("id"), "session_id", "event_id", F.col("fixed_video_id").alias("video_id"), t.alias("start_seconds"), t.alias("end_seconds"),
        F.array(name).alias("candidate_ids"), F.lit(1.0).alias("raw_coarse_score"), F.lit(1.0).alias("normalized_coarse_score"),
        F.lit("pending").alias("refinement_status"), F.lit("active").alias("user_status"), F.lit(-1).cast("long").alias("seq"), t.alias("best_seconds"),
    )


def allowed(regions: DataFrame, video_rules: DataFrame, pins: DataFrame) -> DataFrame:
    """The regions that the rules leave. Rejections come first; a pin narrows its own video only, and overrides the
    allowlist; no allowlist allows every video. An exact pin's time replaces ``best_seconds`` of the region that covers it."""
    rules = small(video_rules.groupBy("session_id", "video_id").agg(F.max((F.col("rule") == "allow").cast("int")).alias("allow"), F.max((F.col("rule") == "reject").cast("int")).alias("reject")))
    lists = small(video_rules.where("rule = 'allow'").select("session_id", F.lit(True).alias("listed")).distinct())
    out = regions.join(rules, ["session_id", "video_id"], "left").join(lists, "session_id", "left").join(small(pins), ["session_id", "event_id"], "left")
    here = F.coalesce(F.col("fixed_video_id") == F.col("video_id"), F.lit(False))
    named = F.coalesce(F.col("fixed_region_id") == F.col("id"), F.lit(False))
    region_pin = F.col("fixed_frame_id").isNull() & F.col("fixed_region_id").isNotNull()
    off = (
        (F.col("user_status") == "rejected")
        | (F.coalesce("reject", F.lit(0)) == 1)
        | F.coalesce(F.array_contains("rejected_region_ids", F.col("id")), F.lit(False))
        | (here & exact_pin() & ~covers())
        | (here & region_pin & ~named)
        | (F.coalesce("listed", F.lit(False)) & (F.coalesce("allow", F.lit(0)) == 0) & ~here & ~named)
    )
    moved = F.when(here & exact_pin() & covers(), F.col("fixed_timestamp_seconds")).otherwise(F.col("best_seconds"))
    return out.where(~off).withColumn("best_seconds", moved).select(regions.columns)


def rule_state(edits: DataFrame) -> DataFrame:
    """Current rules from an append-only log ``(session_id, video_id, action, seq)`` of allow, reject, prioritize, clear.

    Three lists, and a video can be on more than one. A rejection takes it off the other two; a priority puts it in front and
    takes back a rejection, and leaves the allowlist alone; clear takes it off all three. Allowing a rejected video is refused, as
    both would hold at once. ``pos`` orders priorities, the latest first.
    """
    line = W.partitionBy("session_id", "video_id").orderBy("seq")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("action") != "allow", F.col("action"))
    # what the edit meets: the last action that put the video on, or took it off, the rejected ones
    before = F.last(mark, ignorenulls=True).over(earlier)
    taken = edits.withColumn("before", before).where((F.col("action") != "allow") | F.coalesce(F.col("before") != "reject", F.lit(True)))
    last = lambda *kinds: F.max(F.when(F.col("action").isin(*kinds), F.col("seq")))
    now = taken.groupBy("session_id", "video_id").agg(
        last("allow").alias("allow"), last("prioritize").alias("prioritize"), last("reject").alias("reject"), last("reject", "clear").alias("off"), last("prioritize", "clear").alias("back")
    )
    later = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    rules = F.array(
        F.when(later("allow", "off"), F.struct(F.lit("allow").alias("rule"), F.lit(None).cast("long").alias("at"))),
        F.when(later("prioritize", "off"), F.struct(F.lit("prioritize").alias("rule"), F.col("prioritize").cast("long").alias("at"))),
        F.when(later("reject", "back"), F.struct(F.lit("reject").alias("rule"), F.lit(None).cast("long").alias("at"))),
    )
    out = now.select("session_id", "video_id", F.inline(F.filter(rules, lambda r: r.isNotNull())))
    order = W.partitionBy("session_id", "rule").orderBy(F.desc("at"), "video_id")
    pos = F.when(F.col("rule") == "prioritize", F.row_number().over(order) - 1)
    return out.select("session_id", "video_id", "rule", pos.cast("long").alias("pos"))


def standing_pins(pins: DataFrame, edits: DataFrame) -> DataFrame:
    """The pins whose video isn't rejected by now: a rejection clears its video's pins, and taking it back later doesn't
    bring them back. ``pins`` has ``seq``, the time it was set; a pin set after the rejection stands."""
    last = edits.where("action = 'reject'").groupBy("session_id", F.col("video_id").alias("fixed_video_id")).agg(F.max("seq").alias("rejected_at"))
    both = pins.hint("merge").join(last.hint("merge"), ["session_id", "fixed_video_id"], "left")
    return both.where(F.col("rejected_at").isNull() | (F.col("seq") > F.col("rejected_at"))).select(pins.columns)


def broken(rule: str, rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"))


def constraint_violations(events: DataFrame, video_rules: DataFrame, pins: DataFrame, gaps: DataFrame) -> DataFrame:
    """``rule, key`` of every broken constraint; none means valid. ``gaps(session_id, before_event_id, after_event_id)``.

    Events and gaps are written, and gaps again with the places of their events, so that no task sorts for more than one join at once.
    """
    known = written(events.select("session_id", "event_id", "event_pos"), "known")
    gaps = written(gaps, "gaps")
    parts = [broken("unknown_event", pins.join(known, ["session_id", "event_id"], "left_anti"), "session_id", "event_id")]
    a = known.select("session_id", F.col("event_id").alias("before_event_id"), F.col("event_pos").alias("a"))
    b = known.select("session_id", F.col("event_id").alias("after_event_id"), F.col("event_pos").alias("b"))
    before = written(gaps.hint("merge").join(a.hint("merge"), ["session_id", "before_event_id"], "left"), "before")
    both = written(before.hint("merge").join(b.hint("merge"), ["session_id", "after_event_id"], "left").where("a is null or b is null or b <> a + 1"), "both")
    key = ("session_id", "before_event_id", "after_event_id")
    parts.append(broken("unknown_gap_event", both.where("a is null or b is null"), *key))
    parts.append(broken("gap_not_adjacent", both.where("b <> a + 1"), *key))
    parts.append(broken("duplicate_gap", gaps.groupBy(*key).count().where("count > 1"), *key))
    lists = {r: video_rules.where(F.col("rule") == r).select("session_id", "video_id") for r in ("allow", "reject", "prioritize")}
    parts.append(broken("allow_and_reject", lists["allow"].intersect(lists["reject"]), "session_id", "video_id"))
    parts.append(broken("prioritize_and_reject", lists["prioritize"].intersect(lists["reject"]), "session_id", "video_id"))
    fixed = pins.where("fixed_video_id is not null").select("session_id", F.col("fixed_video_id").alias("video_id"))
    parts.append(broken("fixed_and_reject", fixed.intersect(lists["reject"]), "session_id", "video_id"))
    parts.append(broken("pin_without_video", pins.where("fixed_video_id is null and (fixed_frame_id is not null or fixed_timestamp_seconds is not null)"), "session_id", "event_id"))
    return reduce(DataFrame.union, parts)


def record_violations(records: DataFrame, key: str, text: str, start: str, end: str) -> DataFrame:
    """``rule, key`` of records with blank text, a range that isn't finite, is negative or backward, or a repeated key."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    bad_range = ~(finite(start) & finite(end)) | (F.col(start) < 0)
    parts = [
        broken("blank_text", records.where(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0), key),
        broken("bad_range", records.where(bad_range), key),
        broken("backward_range", records.where(finite(start) & finite(end) & (F.col(end) < F.col(start))), key),
        broken("duplicate_key", records.groupBy(key).count().where("count > 1"), key),
    ]
    return reduce(DataFrame.union, parts)
