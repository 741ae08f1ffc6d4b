"""Sequences, evaluation, files, runs and streams by hand."""

import json

import pytest
from pyspark.sql import functions as F

from momentrank.functions import text
from momentrank.operators import evaluate, retrieve, runs, sequence
from momentrank.sources import readers, sinks
from momentrank.streaming import ingest

HIT = "video string, query int, frame long, score double"


def generated(spark, n, m):
    return spark.createDataFrame([("v", q, q * 1000 + i, 1 - 0.001 * i) for q in range(n) for i in range(m)], HIT)


def test_sequences(spark):
    two = spark.createDataFrame([("v", 0, 120, 0.91), ("v", 1, 180, 0.87)], HIT)
    row = sequence.ordered_matches(two, 2).first()
    assert row.distance == 60 and row.score == pytest.approx(0.2225)
    assert sequence.ordered_matches(generated(spark, 3, 4), 3).count() == 64
    assert sequence.unordered_matches(generated(spark, 3, 4), 3).count() == 64
    assert sequence.ordered_matches(generated(spark, 2, 15).withColumn("satisfied", F.lit(False)), 2, objects=True).count() == 0
    swapped = spark.createDataFrame([("v", 0, 9, 1.0), ("v", 1, 3, 1.0), ("v", 1, 9, 0.5), ("v", 7, 9, 1.0), ("v", None, 9, 1.0)], HIT)
    assert [[h.frame for h in r.hits] for r in sequence.ordered_matches(swapped, 2).collect()] == [[9, 9]]  # one frame may serve two
    assert [r.distance for r in sequence.top(sequence.unordered_matches(swapped, 2), 5).collect()] == [6, 0]  # 1 / 1.3 over 0.75


def test_objects(spark):
    hits = spark.createDataFrame([("v", 0, 90, 1.0), ("v", 0, 91, 1.0), ("v", 0, 92, 1.0)], HIT)
    frames = spark.createDataFrame([("v", 90, 2, 0), ("v", 90, 3, 1), ("v", 91, 9, 2)], "video string, frame long, n int, seq long")
    seen = spark.createDataFrame([("v", 2, ["Lantern", "Cat"], [0.797])], "video string, n int, entities array<string>, scores array<double>")
    flags = lambda *names: [r.satisfied for r in sequence.satisfied(hits, frames, seen, list(names)).orderBy("frame").collect()]
    assert flags("lantern") == [True, False, False] and flags("cat") == [False] * 3 and flags("unknown") == [False] * 3


def test_aggregation(spark):
    hits = spark.createDataFrame([("q", "A", 0.9), ("q", "A", 0.4), ("q", "B", 0.8), ("q", None, 1.0), ("q", "C", None)], "query_id string, video string, score double")
    order = lambda **k: [r.video for r in evaluate.video_scores(hits, **k).orderBy(F.desc("score"), "video").collect()]
    assert order() == ["A", "B", "C"] and order(method="top_m_mean", top_m=2) == ["B", "A", "C"] and order(method="logsumexp", temperature=0.2)[0] == "A"
    assert order(method="rrf")[0] == "A"
    with pytest.raises(ValueError):
        order(method="other")


def test_metrics(spark):
    rows = [("a", "ok", 1, 3, 5.0), ("b", "ok", 3, 4, 7.0), ("c", "ok", None, 4, None), ("d", "error", None, None, None)]
    df = spark.createDataFrame(rows, "query_id string, status string, rank int, unique_videos int, latency_ms double")
    m = evaluate.retrieval_metrics(df, (1, 5)).first()
    assert (m.recall_at_1, m.recall_at_5, m.mrr, m.median_rank, m.found, m.missed) == (0.25, 0.5, pytest.approx((1 + 1 / 3) / 4), 3, 2, 1)
    assert m.ok_recall_at_1 == pytest.approx(1 / 3) and m.ok_recall_at_5 == pytest.approx(2 / 3) and m.mean_latency_ms == 6
    found = evaluate.found_metrics(spark.createDataFrame([(1,), (3,), (5,), (None,)], "rank int")).first()
    assert (found.recall_at_5, found.recall_at_1) == (1, pytest.approx(1 / 3))
    assert evaluate.found_metrics(spark.createDataFrame([(1,), (2,), (None,)], "rank int")).first().mrr == 0.75
    hit = lambda r, h: spark.createDataFrame([(r, h)], "rank int, hits int").agg(*evaluate.hit_recalls()).first().final_score
    assert hit(None, 2) == 0 and hit(101, 2) == 0 and hit(8, 3) == pytest.approx(1.8)


def test_intervals_and_positions(spark):
    answers = spark.createDataFrame([("v", "E1", 10.0, 20.0), ("v", "E2", 30.0, 40.0)], "video string, event string, start_seconds double, end_seconds double")
    for a, b, want in ((15.0, 35.0, 2), (15.0, 999.0, 1), (999.0, 999.0, 0), (10.0, 40.0, 2)):
        anchors = spark.createDataFrame([("v", "E1", a), ("v", "E2", b), ("v", "E9", 1.0)], "video string, event string, anchor double")
        assert evaluate.interval_hits(anchors, answers).first().hits == want
    events = spark.createDataFrame([("v", 0, "a"), ("v", 1, "b"), ("w", 0, "c")], "video string, pos int, event string")
    cached = spark.createDataFrame([("v", 0, "after"), ("v", 1, "before"), ("w", 0, "after"), ("w", 1, "after")], "video string, pos int, rel string")
    got = {(r.video, r.pos): r.rel for r in evaluate.attach_relations(events, cached).collect()}
    assert got == {("v", 0): "after", ("v", 1): "before", ("w", 0): None}
    mapped = evaluate.map_frames(spark.createDataFrame([(0, 1), (5, 1)], "query int, frame int"), events.where("video = 'v'"))
    assert [r.event for r in mapped.collect()] == ["a"]


def test_text_columns(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one("C:\\videos\\Ab_C-1.MP4", lambda c: text.video_id(c, "benchmark")) == "Ab_C-1"
    assert one("  /a/b.mp4 ", text.video_id) == "b" and one("a/b.webm", text.video_id) == "b.webm" and one("'x/y.mkv/'", lambda c: text.video_id(c, "benchmark")) == "y"
    for v, want in (("41", 41), ("0:41", 41), ("1:02:03.5", 3723.5), ("0:60", None), ("1:60:00", None), ("a:b", None), ("", None), ("-1:00", None), ("61:00", 3660), ("1:2:3:4", None)):
        assert one(v, text.timestamp_seconds) == want
    assert one("41", lambda c: text.timestamp_seconds(c, True)) is None
    num = lambda v, f: spark.createDataFrame([(v,)], "x double").select(f(F.col("x")).alias("y")).first().y
    assert num(2.5, text.display_time) == "0:02" and num(3661.0, text.display_time) == "1:01:01" and num(1.999, text.clock) == "0:01.100" and num(75.25, text.clock) == "1:15.25"


def test_query_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Context here\nE1: first thing\ne2:  second\n\n**Answer\nvideo_path: \"/x/Video-A.mp4\"\nE1: 0:41 - 0:53\nE2: 1:00 - 1:05\n")
    (tmp_path / "b.txt").write_text("E1: alone\n**Answer\nE1: 0:10 - 0:05\n")
    (tmp_path / "c.txt").write_text("nothing\n")
    texts = readers.read_query_files(spark, str(tmp_path))
    groups = readers.query_groups(texts)
    q = readers.queries_of(groups.where("video is not null"))
    assert [(r.query_id, r.start_seconds, r.end_seconds) for r in q.orderBy("query_id").collect()] == [("Video-A:E1", 41, 53), ("Video-A:E2", 60, 65)]
    assert readers.queries_of(groups, "file").where("video is not null").first().query_text == "Context here first thing second"
    bad = {(r.rule, r.path[-5:]) for r in readers.query_file_violations(texts, groups).collect()}
    assert bad == {("no_events", "c.txt"), ("no_video", "b.txt"), ("backward_range", "b.txt")}
    out = str(tmp_path / "out")
    sinks.write_rendered(groups.where("video is not null"), out)
    again = readers.query_groups(spark.read.text(f"{out}/moment=first", wholetext=True).selectExpr("'p' AS path", "value"))
    assert [(r.event, r.start_seconds) for r in again.orderBy("pos").collect()] == [("E1", 41), ("E2", 60)]


def test_responses_manifests_and_annotations(spark, tmp_path):
    hit = {"video_name": "d/a.mp4", "frame_index": 3, "timestamp": "1:05", "score": 0.5}
    rows = [{"session_id": "s", "event_id": "e", "query": ["q"], "results": [hit, {**hit, "timestamp_seconds": 9.0}, {**hit, "frame_index": -1}, {**hit, "timestamp": "x"}]},
            {"session_id": "s", "event_id": "f", "query": ["q", "r"], "results": [hit]}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    good, bad = readers.hits_of(readers.read_responses(spark, str(tmp_path / "r.json")))
    assert [(r.video_id, r.timestamp_seconds, r["rank"]) for r in good.orderBy("rank").collect()] == [("a", 65.0, 1), ("a", 9.0, 2)]
    assert sorted((r.event_id, r.why) for r in bad.collect()) == [("e", "bad_frame"), ("e", "bad_time"), ("f", "echoed_query")]
    (tmp_path / "m.csv").write_text("id,query,video\n1,hello,x/y.mp4\n")
    assert readers.read_manifest(spark, str(tmp_path / "m.csv"), "csv").first().video == "y"
    (tmp_path / "m.json").write_text('{"queries": [{"query_id": "1", "text": "hello", "video_id": "z.mov"}]}')
    assert readers.read_manifest(spark, str(tmp_path / "m.json"), "json").first().video == "z"
    data = {"database": {"ValVideo": {"subset": "validation", "recipe_type": "1", "annotations": [{"id": 7, "sentence": "cut", "segment": [1, 2]}]}, "T": {"subset": "training", "annotations": []}}}
    (tmp_path / "a.json").write_text(json.dumps(data))
    assert [r.query_id for r in readers.read_annotations(spark, str(tmp_path / "a.json"), ["Validation"]).collect()] == ["ValVideo:7"]
    (tmp_path / "v.txt").write_text("# list\n\na/b.mp4\nb\n")
    assert [r.video for r in readers.read_expected_videos(spark, str(tmp_path / "v.txt"), "txt").collect()] == ["b"]
    (tmp_path / "cache.jsonl").write_text('{"video": "a", "x": 1}\n{"video": "b", "error": "no"}\n')
    assert [r.video for r in readers.read_cache(spark, str(tmp_path / "cache.jsonl"), "video string, x int").collect()] == ["a"]


def test_keyframes(spark, tmp_path):
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "L21.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,30,0\n2,3.0,30,90\n3,3.1,30,90\n")
    got = readers.read_keyframe_map(spark, str(tmp_path / "map")).orderBy("frame").collect()
    assert [(r.video, r.frame, r.n) for r in got] == [("L21", 0, 1), ("L21", 90, 2)]
    for name, body in (("v/2.json", '{"detection_class_entities": ["Cat"], "detection_scores": ["0.9"]}'), ("v/3.json", "{broken")):
        (tmp_path / "det" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "det" / name).write_text(body)
    got = readers.read_detections(spark, str(tmp_path / "det/*")).orderBy("n").collect()
    assert [(r.video, r.n, r.entities, r.scores) for r in got] == [("v", 2, ["Cat"], [0.9]), ("v", 3, None, None)]
    (tmp_path / "man").mkdir()
    (tmp_path / "man" / "v_keyframes.json").write_text(json.dumps({"keyframes": [{"index": i, "timestamp": t, "file": f"f{t}"} for i, t in enumerate((0, 5, 20))]}))
    (tmp_path / "man" / "w_keyframes.json").write_text("{no")
    k = readers.read_keyframe_manifests(spark, str(tmp_path / "man"))
    p = spark.createDataFrame([(1, "v", 6.0), (2, "v", 20.0), (3, "w", 1.0), (4, "v", 12.5), (5, "v", -3.0)], "probe_id long, video string, t double")
    assert {r.probe_id: r.file for r in retrieve.nearest(p, k).collect()} == {1: "f5", 2: "f20", 3: None, 4: "f5", 5: "f0"}
    for i in range(4):
        (tmp_path / "img" / "v").mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / "v" / f"v_f{i:06d}.jpg").write_text("x")
    assert [r.frame for r in readers.list_keyframe_files(spark, str(tmp_path / "img"), 2).orderBy("frame").collect()] == [0, 1]


def test_runs(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("b", 1, "retry")], "query_id string, attempt int, status string")
    assert {r.query_id: r.status for r in runs.latest(log, ["query_id"], "attempt").collect()} == {"a": "ok", "b": "retry"}
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    assert sorted(r.query_id for r in runs.pending(q, log).collect()) == ["b", "c"]
    diff = spark.createDataFrame([("s", "tuple_ranking.x"), ("t", "event.anchor_query"), ("u", "nothing")], "session_id string, path string")
    got = {}
    for r in runs.stale(diff).collect():
        got.setdefault(r.session_id, []).append(r.stage)
    assert sorted(got["t"]) == sorted(runs.STAGES) and got["s"] == ["tuple"] and got["u"] == ["unknown"]
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    digest = lambda d: runs.fingerprint(d, ["k", "v"]).first().digest
    assert digest(df) == digest(df.orderBy(F.desc("k")).repartition(3)) != digest(df.distinct())
    nested = spark.createDataFrame([("s", (1, ("x", [1, 2])))], "session_id string, cfg struct<a:int,b:struct<c:string,d:array<int>>>")
    assert {r.path: r.value for r in runs.flattened(nested, "session_id").collect()} == {"cfg.a": '{"v":1}', "cfg.b.c": '{"v":"x"}', "cfg.b.d": '{"v":[1,2]}'}
    path = str(tmp_path / "p")
    rows = lambda e, x: spark.createDataFrame([("s", e, x)], "session_id string, event_id string, x int")
    sinks.replace_groups(rows("a", 1).union(rows("b", 2)), rows("a", 0).union(rows("b", 0)), path)
    sinks.replace_groups(rows("b", 3), rows("b", 0), path)
    assert sorted((r.event_id, r.x) for r in sinks.live(spark, path).collect()) == [("a", 1), ("b", 3)]
    bad = runs.replace_violations(rows("a", 1).withColumn("id", F.lit("i")), rows("b", 1).withColumn("id", F.lit("i")), rows("c", 0)).collect()
    assert sorted(r.rule for r in bad) == ["duplicate_id", "foreign_event"]


def test_retrieval(spark):
    frames = spark.createDataFrame([(i, i % 2, [float(i == j) for j in range(4)]) for i in range(4)], "frame_id long, video long, vector array<float>")
    q = spark.createDataFrame([(7, [0.0, 1.0, 0.5, 0.5])], "query_id long, vector array<float>")
    assert [(r.frame_id, r.score) for r in retrieve.top_k(q, frames, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.5), (3, 0.5)]
    assert retrieve.top_k(q.where("false"), frames, 3).count() == 0


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = spark.createDataFrame([("v", "e", f"2024-01-01 {h:02d}:00:00", 1.0 * h) for h in (0, 2, 4, 12, 13)] + [("v", "e", "2024-01-03 00:00:00", 0.0)], "video_id string, event_id string, t string, score double")
    rows = rows.select("video_id", "event_id", F.to_timestamp("t").alias("ts"), "score")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = ingest.hit_sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.hits, r.best) for r in spark.table("closed").collect()) == [(2, 13.0), (3, 4.0)]
    named = stream.select(F.lit("s").alias("session_id"), "event_id", "score")
    ingest.ingest(named, out, str(tmp_path / "ck")).awaitTermination()
    assert sinks.live(spark, out).count() == 6
