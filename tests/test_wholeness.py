"""Nothing is cut silently: long chains, many hits, many frames, whole files and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from momentrank import tables
from momentrank.operators import evaluate, regions, relations, retrieve, sequence
from momentrank.sources import readers, sinks


def test_closure_of_a_long_chain(spark):
    rows = [("s", i, f"e{i}", "after" if i else "unknown", f"e{i - 1}" if i else None) for i in range(60)] + [("t", 0, "a", "during", "b"), ("t", 1, "b", "after", "a")]
    df = spark.createDataFrame(rows, "session_id string, event_pos int, event_id string, temporal_relation string, reference_event_id string")
    got = relations.order_constraints(df).collect()
    assert len(got) == 60 * 59 // 2 + 1 and {(r.i, r.j) for r in got if r.session_id == "s"} == {(i, j) for j in range(60) for i in range(j)}
    assert relations.order_constraints(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="too many"):
        relations.pairs(relations.order_constraints(df), "s")
    assert relations.pairs(relations.order_constraints(df), "t") == [(0, 1)]


def test_matches_are_whole_and_say_when_not(spark):
    hits = spark.range(300).select(F.lit("v").alias("video"), (F.col("id") % 2).cast("int").alias("query"), F.col("id").alias("frame"), F.lit(1.0).alias("score"))
    hits = hits.union(spark.createDataFrame([("w", 0, 1, 0.5), ("w", 1, 2, 0.5)], "video string, query int, frame long, score double"))
    assert sequence.unordered_matches(hits, 2).count() == 150 * 150 + 1
    cut = sequence.unordered_matches(hits, 2, most=100)
    assert {(r.video, r.truncated) for r in cut.select("video", "truncated").distinct().collect()} == {("v", True), ("w", False)}
    assert cut.count() == 100 * 100 + 1


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_top_matches_are_the_top_of_all(spark, ordered, sign):
    i = F.col("id")
    hits = spark.range(240).select(F.concat(F.lit("v"), i % 4).alias("video"), F.pmod(F.xxhash64(i), F.lit(3)).cast("int").alias("query"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(40)).alias("frame"),
                                   (F.round(F.pmod(F.xxhash64(i, F.lit(2)), F.lit(50)) / 50, 2) * sign).alias("score"), (i % 3 == 0).alias("satisfied"))
    every = sequence._matches(hits, 3, None, ordered, 0.05, True)
    for k in (1, 7, 50):
        want = [(r.video, round(r.score, 9), r.hits) for r in sequence.top(every, k).collect()]
        assert [(r.video, round(r.score, 9), r.hits) for r in sequence.top_matches(hits, 3, k, ordered, objects=True).collect()] == want
    assert sequence.top_matches(hits, 3, 100_000, ordered, objects=True).count() == every.count()


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_retrieval_over_many_chunks(spark, chunk):
    i = F.col("id")
    v = F.array(*[F.pmod(F.xxhash64(i, F.lit(j)), F.lit(5)).cast("double") for j in range(3)])
    frames = spark.range(90).select(i.alias("frame_id"), (i % 4).alias("video"), v.alias("vector"))
    queries = spark.range(1000, 1040).select(i.alias("query_id"), v.alias("vector"))
    rows, asks = frames.collect(), queries.collect()
    for k in (1, 10, 200):
        got = {}
        for r in retrieve.top_k(queries, frames, k, chunk=chunk).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.frame_id))
        for q in asks:
            by = sorted(rows, key=lambda f: (-sum(a * b for a, b in zip(q.vector, f.vector)), f.frame_id))
            assert [f for _, f in sorted(got[q.query_id])] == [f.frame_id for f in by[:k]]


def test_folds_are_cut_where_nothing_can_join(spark):
    rows = [("s", "e", "v", "pending", "active", a, z, f"r{i}", [f"c{i}"], 0.5, 0.5) for i, (a, z) in enumerate([(0.0, 9.0), (2.0, 3.0), (3.5, 4.0), (8.0, 12.0), (12.0, 14.0), (15.0, 16.0), (15.5, 30.0)])]
    df = spark.createDataFrame(rows, "session_id string, event_id string, video_id string, refinement_status string, user_status string, start_seconds double, end_seconds double, id string, candidate_ids array<string>, raw_coarse_score double, normalized_coarse_score double")
    got = sorted((r.start_seconds, r.end_seconds, len(r.candidate_ids)) for r in regions.merged(df, 10.0).collect())
    assert got == [(0.0, 9.0, 3), (8.0, 14.0, 2), (15.0, 16.0, 1), (15.5, 30.0, 1)]
    assert sorted((r.start_seconds, r.end_seconds) for r in regions.merged(df).collect()) == [(0.0, 14.0), (15.0, 30.0)]


def test_audit_modes(spark):
    queries = spark.createDataFrame([("a", 1), ("b", 2)], "video string, q int")
    names = spark.createDataFrame([("a",), ("a",), ("c",)], "video string")
    assert [r.video for r in evaluate.audited(queries, names, "skip").collect()] == ["a"]
    assert sorted((r.video, r.expected) for r in evaluate.audited(queries, names, "keep").collect()) == [("a", True), ("b", False)]
    with pytest.raises(ValueError, match="b"):
        evaluate.audited(queries, names)
    assert evaluate.audited(queries.where("q = 1"), names).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        evaluate.audited(queries, names, "other")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, None], 3), (2, None, None)], "query_id int, x array<double>, rank int").withColumn("s", F.struct("rank"))
    sinks.export(rows, f"{tmp_path}/csv", "csv")
    back = {r.query_id: r for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()}
    assert json.loads(back["1"].x) == [0.5, None] and back["2"].x is None and json.loads(back["1"].s) == {"rank": 3}
    sinks.export(rows, f"{tmp_path}/json", "json")
    assert sorted(r.query_id for r in spark.read.json(f"{tmp_path}/json").collect()) == [1, 2]
    metrics = rows.agg(F.avg("rank").alias("mean"), F.lit(None).cast("double").alias("none"))
    sinks.write_results(rows, f"{tmp_path}/run", (1, 5), metrics)
    table = {r.query_id: r for r in spark.read.option("header", True).csv(f"{tmp_path}/run/per_query").collect()}
    assert (table["1"].hit_at_1, table["1"].hit_at_5, table["2"].reciprocal_rank) == ("0", "1", "0.0")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/run/metrics").collect()] == [{"mean": 3.0, "none": None}]
    assert spark.read.json(f"{tmp_path}/run/results").count() == 2


def test_manifest_files(spark, tmp_path):
    lines = [{"id": "a", "query": "x", "video": "v.mp4", "start": 1}, {"query_id": "b", "text": "y"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    (tmp_path / "list.json").write_text(json.dumps(lines, indent=1))
    (tmp_path / "doc.json").write_text(json.dumps({"queries": lines}))
    (tmp_path / "m.csv").write_text("id,query,video,start\na,x,v.mp4,1\nb,y,,\n")
    for name, kind in (("m.jsonl", "jsonl"), ("list.json", "json"), ("doc.json", "json"), ("m.csv", "csv")):
        got = sorted(readers.read_manifest(spark, f"{tmp_path}/{name}", kind).collect())
        assert [(r.query_id, r.query_text, r.video, r.start_seconds) for r in got] == [("a", "x", "v", 1.0), ("b", "y", None, None)], name


class Far:
    class sparkContext:
        master = "spark://host:7077"

    class conf:
        get = staticmethod(lambda key, default=None: default)


class Frame:
    sparkSession = Far


def test_no_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.written(Frame, "x")
