"""Work over ranges: exact medians, pages, nearest keyframes; sweeps in one pass; anchors."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from momentrank.functions.medians import medians
from momentrank.functions.scoring import first_anchor, robust_stats
from momentrank.operators import rank, retrieve
from momentrank.operators.tuples import Params, ranked_videos, swept, tuples


def populations(rng: random.Random) -> dict[str, list[float]]:
    return {
        "even": [rng.gauss(0, 1) for _ in range(400)],
        "odd": [rng.lognormvariate(0, 4) for _ in range(401)],
        "two": [0.0] * 150 + [1.0] * 150,
        "heavy": [7.0] * 300 + [rng.random() for _ in range(99)],
        "same": [3.0] * 200,
        "ties": [float(rng.randrange(5)) for _ in range(500)],
        "one": [2.5],
        "few": [1.0, 4.0],
    }


def test_medians_are_exact_however_little_is_held(spark):
    of = populations(random.Random(5))
    rows = [(k, x) for k, xs in of.items() for x in xs] + [("none", None), ("few", None), (None, 1.0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "e string, x double").repartition(3)
    for held in (1, 20, 1000):
        got = {r.e: r["median"] for r in medians(df, ["e"], "x", held).collect()}
        assert got == {**{k: statistics.median(xs) for k, xs in of.items()}, "none": None}, held


def test_robust_stats_do_not_depend_on_what_is_held(spark):
    of = populations(random.Random(6))
    df = spark.createDataFrame([(k, x) for k, xs in of.items() for x in xs], "e string, x double")
    one = {r.e: (r.center, r.mad) for r in robust_stats(df, ["e"], "x").collect()}
    assert one == {r.e: (r.center, r.mad) for r in robust_stats(df, ["e"], "x", held=30).collect()} and len(one) == len(of)


def test_medians_of_no_rows(spark):
    assert medians(spark.createDataFrame([], "e string, x double"), ["e"], "x").collect() == []


def test_pages_by_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(5)
    order = [F.desc_nulls_last("x"), F.asc("id")]
    want = [r.id for r in sorted(df.collect(), key=lambda r: (r.x is None, -(r.x or 0), r.id))]
    for offset, limit in ((0, 10), (45, 80), (290, 50), (299, 1), (300, 5), (1000, 5), (10, 0)):
        got = rank.page(df, order, offset, limit, ranges=7).collect()
        assert [r.id for r in got] == want[offset : offset + limit] and all(r.total == 300 for r in got), (offset, limit)
    assert rank.page(df.limit(0), order, 0, 5).collect() == []
    with pytest.raises(ValueError, match="negative"):
        rank.page(df, order, -1, 5)


def test_a_late_page_sorts_its_own_ranges_only(spark):
    df = spark.range(100_000).withColumn("x", F.xxhash64("id"))
    plan = rank.page(df, ["x"], 99_000, 10, ranges=50)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    skipped = int(text.split("Offset ")[1].split()[0])
    assert skipped < 5000 and "__range" in text


def test_nearest_over_ranges(spark):
    rng = random.Random(3)
    ks = [("a", rng.randrange(0, 200) * 2, f"f{i}", i) for i in range(40)] + [("b", 50, "fb", 1), ("b", None, "no", 2), (None, 3, "no", 3)]
    ps = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randrange(-20, 450)) for i in range(300)]
    ps += [(300 + i, "a", 77) for i in range(60)] + [(900, None, 3), (901, "a", None)]
    k = spark.createDataFrame(ks, "video string, t long, file string, seq long")
    p = spark.createDataFrame(ps, "probe_id long, video string, t long")

    def want(video, t):
        own = [x for x in ks if x[0] == video and x[1] is not None] if video is not None and t is not None else []
        return min(own, key=lambda x: (abs(x[1] - t), x[3]))[2] if own else None

    for ranges in (None, 1, 9, 40):
        got = retrieve.nearest(p, k, ranges).collect()
        assert len(got) == len(ps) and {r.probe_id: r.file for r in got} == {i: want(v, t) for i, v, t in ps}, ranges


def test_a_sweep_gives_what_its_configurations_give_alone(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", "s", rng.choice("abc"), f"v{rng.randrange(12)}", rng.choice([0.2, 0.5, rng.random()]), rng.uniform(0, 90), i) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, session_id string, event_id string, video_id string, normalized_coarse_score double, best_seconds double, seq long")
    configs = {
        "narrow": Params(delta=0.0, gate="margin", gate_threshold=0.1), "wide": Params(delta=0.4, order_weight=0.3), "few": Params(delta=0.9, most_regions=2),
        "high": Params(absolute=0.93, delta=0.2, gap_weight=0.0), "short": Params(delta=0.5, span=20.0, most_tuples=3),
    }
    both = swept(df, ["a", "b", "c"], configs).cache()
    key = lambda r: (r.video_id, r.rank_in_video)
    for name, p in configs.items():
        alone = tuples(df, ["a", "b", "c"], p)
        assert sorted(alone.collect(), key=key) == sorted(both.where(F.col("config") == name).drop("config").collect(), key=key), name
        videos = ranked_videos(alone).select("video_id", "raw_score", "priority_score")
        swept_ = ranked_videos(both).where(F.col("config") == name).select("video_id", "raw_score", "priority_score")
        assert sorted(videos.collect()) == sorted(swept_.collect()), name


def test_first_anchor(spark):
    df = spark.createDataFrame([([2.5, 1.0], 3, "[4.5, 9]"), ([], None, "6.25"), (None, 1, "[]"), ([None], 2, "x")], "a array<double>, n int, s string")
    got = df.select(*[first_anchor(df, c).alias(c) for c in "ans"]).collect()
    assert [tuple(r) for r in got] == [(2.5, 3.0, 4.5), (None, None, 6.25), (None, 1.0, None), (None, 2.0, None)]
    with pytest.raises(TypeError, match="b is neither"):
        first_anchor(df.withColumn("b", F.lit(True)), "b")
