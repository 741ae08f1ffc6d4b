"""Rule edits and snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from momentrank.operators import constraints
from momentrank.sources import sinks
from momentrank.streaming import ingest


def replayed(edits):
    """Lists after a log of edits, one by one."""
    lists = {"allow": set(), "reject": set(), "prioritize": []}
    for video, action in edits:
        if action == "clear":
            lists["allow"].discard(video), lists["reject"].discard(video)
            lists["prioritize"] = [v for v in lists["prioritize"] if v != video]
        elif action == "reject":
            lists["allow"].discard(video), lists["reject"].add(video)
            lists["prioritize"] = [v for v in lists["prioritize"] if v != video]
        elif action == "prioritize":
            lists["reject"].discard(video)
            lists["prioritize"] = [video] + [v for v in lists["prioritize"] if v != video]
        elif video not in lists["reject"]:
            lists["allow"].add(video)
    out = [(v, r, None) for r in ("allow", "reject") for v in lists[r]]
    return sorted(out + [(v, "prioritize", i) for i, v in enumerate(lists["prioritize"])], key=str)


def test_rule_state_replays_edits(spark):
    rng = random.Random(2)
    logs = [[(1, "allow"), (2, "allow"), (1, "prioritize")], [(1, "allow"), (1, "reject"), (1, "prioritize")], [(1, "reject"), (1, "allow"), (1, "prioritize"), (1, "allow")]]
    logs += [[(rng.randint(1, 4), rng.choice(["allow", "reject", "prioritize", "clear"])) for _ in range(rng.randint(1, 25))] for _ in range(30)]
    rows = [(f"s{i}", v, a, k) for i, log in enumerate(logs) for k, (v, a) in enumerate(log)]
    got = {}
    for r in constraints.rule_state(spark.createDataFrame(rows, "session_id string, video_id long, action string, seq long")).collect():
        got.setdefault(r.session_id, []).append((r.video_id, r.rule, r.pos))
    for i, log in enumerate(logs):
        assert sorted(got.get(f"s{i}", []), key=str) == replayed(log), log


def test_a_prioritised_video_stays_allowed(spark):
    log = spark.createDataFrame([("s", 1, "allow", 0), ("s", 2, "allow", 1), ("s", 1, "prioritize", 2)], "session_id string, video_id long, action string, seq long")
    none = "cast(null as {}) as {}"
    regions = spark.createDataFrame([("r1", "s", "e", 1), ("r2", "s", "e", 2), ("r3", "s", "e", 3)], "id string, session_id string, event_id string, video_id long")
    regions = regions.selectExpr("*", "0D as start_seconds", "1D as end_seconds", "0.5D as best_seconds", "'active' as user_status")
    pins = spark.range(0).selectExpr("'s' as session_id", "'e' as event_id", none.format("long", "fixed_video_id"), none.format("string", "fixed_region_id"), none.format("long", "fixed_frame_id"), none.format("double", "fixed_timestamp_seconds"), none.format("array<string>", "rejected_region_ids"))
    kept = constraints.allowed(regions, constraints.rule_state(log), pins)
    assert sorted(r.id for r in kept.collect()) == ["r1", "r2"]


def table(spark, rows):
    return spark.createDataFrame(rows, "session_id string, event_id string, x int")


def seen(spark, path):
    return sorted((r.event_id, r.x) for r in sinks.live(spark, path).collect())


def test_an_event_replaced_by_nothing_is_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_groups(table(spark, [("s", "a", 1), ("s", "b", 2), ("s", None, 4)]), table(spark, [("s", e, 0) for e in ("a", "b", None)]), path)
    before = sinks.live(spark, path)
    sinks.replace_groups(table(spark, []), table(spark, [("s", "a", 0)]), path)
    assert {(r.event_id, r.x) for r in sinks.live(spark, path).collect()} == {("b", 2), (None, 4)}
    assert {(r.event_id, r.x) for r in before.collect()} == {("a", 1), ("b", 2), (None, 4)}  # who read the old list has the old rows
    sinks.replace_groups(table(spark, []), table(spark, [("s", "b", 0), ("s", None, 0)]), path)
    assert sinks.live(spark, path).count() == 0
    assert len(sinks.vacuum(spark, path)) == 3 and len(sinks._versions(spark, path)) == 1


def test_half_a_batch_is_not_seen_and_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_groups(table(spark, [("s", "a", 1)]), table(spark, [("s", "a", 0)]), path, batch="1")
    table(spark, [("s", "a", 9)]).withColumn(sinks.SLOT, F.lit("x")).write.partitionBy(sinks.SLOT).parquet(f"{path}/data/{sinks.BATCH}=2")  # written, not listed
    assert seen(spark, path) == [("a", 1)]
    (tmp_path / "t/live/v=00000000000000000002-2").mkdir()  # begun, not committed
    assert seen(spark, path) == [("a", 1)]
    sinks.replace_groups(table(spark, [("s", "a", 7)]), table(spark, [("s", "a", 0)]), path, batch="1")
    assert seen(spark, path) == [("a", 1)]
    with pytest.raises(ValueError, match="not replaced"):
        sinks.replace_groups(table(spark, [("s", "b", 1)]), table(spark, [("s", "a", 0)]), path)
    assert sinks.live(spark, path, most=0).count() == 1


def test_a_stream_empties_groups(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    table(spark, [("s", "a", 1), ("s", "a", 2), ("s", "b", 3)]).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(table(spark, []).schema).parquet(src)
    ingest.ingest(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert seen(spark, out) == [("a", 1), ("a", 2), ("b", 3)]
    table(spark, [("s", "a", None), ("s", "b", 5)]).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert seen(spark, out) == [("b", 5)]
