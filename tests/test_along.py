"""Folds over sorted rows against plain loops, and dense groups."""

import random

from pyspark.sql import functions as F

from momentrank.operators import boundary, regions


def hits(spark, times):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "frame_id long, timestamp_seconds double")
    return df.select(F.lit("s").alias("session_id"), F.lit("e").alias("event_id"), F.lit(1).alias("video_id"), "frame_id", F.col("frame_id").cast("string").alias("id"), "timestamp_seconds", (F.col("frame_id") % 7).cast("double").alias("raw_relevance_score"))


def runs(times, gap, core):
    out = []
    for t in sorted(times):
        if out and t - out[-1][-1] <= gap and t - out[-1][0] <= core:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def united(spans, longest):
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] and (longest is None or max(z, out[-1][1]) - min(a, out[-1][0]) <= longest):
            out[-1] = (min(a, out[-1][0]), max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def test_clusters_match_a_loop(spark):
    rng = random.Random(1)
    times = [round(rng.uniform(0, 400), 2) for _ in range(500)] + [7.0] * 5
    got = regions.clusters(hits(spark, times).repartition(7), 3, 2, 14).orderBy("start_seconds", "end_seconds").collect()
    want = [(max(0.0, r[0] - 2), r[-1] + 2, len(r)) for r in runs(times, 3, 10)]
    assert [(r.start_seconds, r.end_seconds, len(r.candidate_ids)) for r in got] == want
    both = regions.clustered(hits(spark, times), 3, 2, 14).orderBy("start_seconds").collect()
    assert [(r.start_seconds, r.end_seconds) for r in both] == united([w[:2] for w in want], 14)


def test_merges_match_a_loop(spark):
    rng = random.Random(2)
    spans = [(float(a), float(a + rng.randint(0, 9))) for a in (rng.randint(0, 300) for _ in range(200))]
    rows = [("s", "e", 1, "pending", "active", f"r{i:03}", a, z, [f"c{i}", "c"], 0.1 * (i % 5), 0.2) for i, (a, z) in enumerate(spans)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, video_id long, refinement_status string, user_status string, id string, start_seconds double, end_seconds double, candidate_ids array<string>, raw_coarse_score double, normalized_coarse_score double")
    for longest in (None, 12.0):
        got = regions.merged(df.repartition(5), longest).orderBy("start_seconds", "end_seconds").collect()
        assert [(r.start_seconds, r.end_seconds) for r in got] == sorted(united(spans, longest))
        assert sum(len(set(r.candidate_ids) - {"c"}) for r in got) == len(spans)


def test_a_dense_group_of_many_hits(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("s").alias("session_id"), F.lit("e").alias("event_id"), F.lit(1).alias("video_id"), F.col("id").alias("frame_id"), F.col("id").cast("string").alias("id"), (F.col("id") / 100).alias("timestamp_seconds"), F.lit(1.0).alias("raw_relevance_score"))
    got = regions.clusters(df, 3, 3, 30).agg(F.count("*"), F.sum(F.size("candidate_ids"))).first()
    assert tuple(got) == (125, n)  # 24 seconds hold 2,401 hits
    samples = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("t_ms"), (F.hash("id") % 1000).cast("double").alias("v"))
    kept = [r.t_ms for r in boundary.suppressed(samples, ["g"], "v").orderBy("pick").collect()]
    rows = sorted(((-r.v, r.t_ms) for r in samples.collect()))
    want = []
    for _, t in rows:
        if len(want) < 5 and all(abs(t - k) > 500 for k in want):
            want.append(t)
    assert kept == want
