"""Text columns: ids, timestamps, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of video files, by variant. Fixed values.
SUFFIXES = {"upstream": ("mp4",), "benchmark": ("mp4", "webm", "mkv", "avi", "mov", "m4v"), "client": ("mp4", "avi", "mkv", "webm")}


def video_id(c: Column, variant: str = "upstream") -> Column:
    """Base name of a path without its video suffix, case kept; null where nothing is left.

    ``benchmark`` also takes off quotes and trailing slashes.
    """
    path = F.regexp_replace(F.trim(c), r"\\", "/")
    if variant == "benchmark":
        path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", ""), r"\\", "/"), "/+$", "")
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, rf"(?i)\.({'|'.join(SUFFIXES[variant])})$", "")
    return F.when(name != "", name)


def timestamp_seconds(c: Column, strict_parts: bool = False) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS, null where it isn't one; ``strict_parts`` refuses a single part.

    Seconds under 60 are asked for with two parts or more, minutes under 60 with three.
    """
    parts = F.split(F.trim(c), ":")
    nums = F.transform(parts, lambda p: F.when(F.trim(p).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(p).try_cast("double")))
    n = F.size(parts)
    fine = F.forall(nums, lambda x: x.isNotNull() & (x >= 0) & (x < float("inf"))) & (n <= 3) & (F.trim(c) != "")
    at = lambda i: F.coalesce(F.try_element_at(nums, F.lit(-i)), F.lit(0.0))
    fine = fine & ((n < 2) | (at(1) < 60)) & ((n < 3) | (at(2) < 60))
    if strict_parts:
        fine = fine & (n >= 2)
    return F.when(fine, at(3) * 3600 + at(2) * 60 + at(1))


def display_time(seconds: Column) -> Column:
    """M:SS or H:MM:SS of rounded seconds, half to even."""
    s = F.bround(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    tail = two(F.pmod(s, F.lit(60)))
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), tail)).otherwise(F.concat_ws(":", m.cast("string"), tail))


def clock(seconds: Column) -> Column:
    """m:ss.cc: whole seconds cut, hundredths rounded half to even, so 1.999 shows as 0:01.100."""
    whole = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    hundredths = F.bround((seconds - whole) * 100).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), two(F.pmod(whole, F.lit(60))), F.lit("."), two(hundredths))


#: Characters that mark a word of the language that the signature filter looks for. Fixed value.
SIGNATURE = "Ḁ-ỿĂăĐđƠơƯư"


def candidate_id(session: Column, event: Column, video: Column, frame: Column, rank: Column) -> Column:
    """Stable id of a hit: the start of a SHA-256 over five fields joined by the unit separator."""
    text = F.concat_ws("\x1f", *[c.cast("string") for c in (session, event, video, frame, rank)])
    return F.concat(F.lit("candidate_upstream_"), F.substring(F.sha2(text, 256), 1, 20))


def marked_share(c: Column, marks: str) -> Column:
    """Share of words that hold any of the marked characters; 0 without words."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    n = F.size(words)
    return F.when(n > 0, F.size(F.filter(words, lambda w: w.rlike(f"[{marks}]"))) / n).otherwise(F.lit(0.0))


def contains_ignoring_case(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())
