"""Hand vectors of pooling, order, gaps, pins and rankings."""

import pytest
from pyspark.sql import functions as F

from momentrank.functions.scoring import robust_sigmoid, min_max
from momentrank.operators import constraints, rank, regions, relations
from momentrank.operators.tuples import Gap, Params, gap_terms, order_score, ranked_videos, tuples

REGION = "id string, session_id string, event_id string, video_id string, start_seconds double, end_seconds double, candidate_ids array<string>, raw_coarse_score double, normalized_coarse_score double, refinement_status string, user_status string, seq long, best_seconds double"
PIN = "session_id string, event_id string, fixed_video_id string, fixed_region_id string, fixed_frame_id long, fixed_timestamp_seconds double, rejected_region_ids array<string>"
RULE = "session_id string, video_id string, rule string, pos long"


def make(spark, rows):
    """rows: id, event, video, score, time[, start, end]."""
    full = [(i, "s1", e, v, a, z, [f"c_{i}"], float(s), float(s), "pending", "active", k, float(t))
            for k, (i, e, v, s, t, a, z) in enumerate((*r, *(() if len(r) == 7 else (float(r[4]), float(r[4])))) for r in rows)]
    return spark.createDataFrame(full, REGION)


def ids(df):
    return [r.region_ids for r in df.orderBy("video_id", "rank_in_video").collect()]


@pytest.mark.parametrize(
    "scores, params, kept",
    [([0.9, 0.6], dict(delta=0.15), ["r0"]), ([0.2, 0.15], dict(absolute=0.18, delta=0.5), ["r0"]),
     ([1 - i / 100 for i in range(10)], dict(delta=1.0, most=3), ["r0", "r1", "r2"]), ([0.1, 0.2], dict(absolute=0.5), []), ([0.5, 0.5], {}, ["r0", "r1"])],
)
def test_pools(spark, scores, params, kept):
    rows = make(spark, [(f"r{i}", "e1", "v1", s, i) for i, s in enumerate(scores)])
    assert [r.id for r in regions.pooled(rows, **params).orderBy("rn").collect()] == kept


def test_margins_go_by_place_not_by_value(spark):
    rows = make(spark, [("a", "e1", "v1", 0.9, 1), ("b", "e1", "v1", 0.9, 2), ("c", "e1", "v1", 0.8, 3), ("d", "e1", "v2", 0.7, 3)])
    got = {r.id: round(r.margin, 9) for r in regions.pooled(rows, delta=1.0).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": -0.1, "d": 0.7}


@pytest.mark.parametrize(
    "times, pairs, want",
    [([5], None, 0), ([1, 2, 3, 4], None, 1), ([4, 3, 2, 1], None, -1), ([1, 3, 2, 4], None, 1 / 3), ([1, 1], None, -1), ([1, 3, 2], [(0, 1), (1, 2)], 0),
     ([1, 3, 2], [(0, 1)], 1), ([1, 3, 2], [], 0), ([1, 4, 3, 2], [(1, 0)], -1), ([1, None, 2], None, 0), ([1, None, 2], [(0, 2)], 1)],
)
def test_order_score(spark, times, pairs, want):
    row = spark.createDataFrame([tuple(None if t is None else float(t) for t in times)], ", ".join(f"t{i} double" for i in range(len(times))))
    got = row.select(order_score([F.col(c) for c in row.columns], pairs).alias("x")).first().x
    assert got == pytest.approx(want)


def test_late_winner_reaches_past_the_best_region(spark):
    rows = [("r1", "e1", "v", 0.9, 10)] + [(f"x{i}", "e2", "v", s, t) for i, (s, t) in enumerate([(0.95, 1), (0.9, 2), (0.85, 3), (0.8, 4)])] + [("right", "e2", "v", 0.3, 60)]
    got = tuples(make(spark, rows), ["e1", "e2"], Params(delta=1, order_weight=0.8, gate="none", gap_weight=0, most_tuples=1)).collect()
    assert got[0].region_ids == ["r1", "right"] and got[0].score > 1


def test_hard_gap_and_span(spark):
    rows = make(spark, [("far", "e1", "v", 0.9, 10), ("near", "e1", "v", 0.5, 1), ("r2", "e2", "v", 0.9, 12)])
    p = Params(delta=1, order_weight=0, gap_weight=0, gaps={0: Gap(least=5)})
    assert ids(tuples(rows, ["e1", "e2"], p)) == [["near", "r2"]]
    rows = make(spark, [("far", "e1", "v", 0.9, 10), ("close", "e1", "v", 0.5, 7), ("r2", "e2", "v", 0.9, 2)])
    assert ids(tuples(rows, ["e1", "e2"], Params(delta=1, order_weight=0, gap_weight=0, span=5))) == [["close", "r2"]]
    backward = Params(delta=1, order_weight=0, gap_weight=0, gaps={0: Gap()})
    assert ids(tuples(rows, ["e1", "e2"], backward)) == []  # the default lower bound of an explicit rule


def test_default_gap_prefers_the_close_video_and_explicit_rules_replace_it(spark):
    rows = make(spark, [("a", "e1", "tight", 0.8, 100), ("b", "e2", "tight", 0.8, 110), ("c", "e1", "wide", 0.8, 100), ("d", "e2", "wide", 0.8, 400)])
    found = ranked_videos(tuples(rows, ["e1", "e2"], Params(delta=1))).orderBy(F.desc("raw_score")).collect()
    assert [r.video_id for r in found] == ["tight", "wide"] and found[0].priority_score == 1 and found[1].priority_score == 0
    rows = make(spark, [("a", "e1", "v", 0.8, 0), ("b", "e2", "v", 0.8, 100), ("c", "e3", "v", 0.8, 200)])
    p = Params(order_weight=0, gap_tau=20, gap_weight=0.05, gaps={0: Gap(tau=200, weight=1.0)})
    assert tuples(rows, ["e1", "e2", "e3"], p).first().score == pytest.approx(0.8 - (0 + 4.0) / 2)
    rows = make(spark, [("a", "e1", "v", 0.8, 0), ("b", "e2", "v", 0.6, 500)])
    assert tuples(rows, ["e1", "e2"], Params(order_weight=0, gap_weight=0)).first().score == pytest.approx(0.7)


def test_uncovered_events_count_as_zero_and_a_video_without_any_is_absent(spark):
    rows = make(spark, [("a", "e1", "v", 0.8, 5), ("z", "other", "w", 0.9, 5)])
    got = tuples(rows, ["e1", "e2"], Params()).collect()
    assert len(got) == 1 and got[0].region_ids == ["a", None] and got[0].score == pytest.approx(0.4) and got[0].timestamps == [5.0, None]


def test_without_order_and_gaps_it_is_the_independent_ranking(spark):
    rows = make(spark, [("a", "e1", "v1", 0.9, 50), ("b", "e2", "v1", 0.5, 5), ("c", "e1", "v2", 0.7, 50), ("d", "e2", "v2", 0.7, 5), ("e", "e1", "v3", 0.95, 9)])
    a = ranked_videos(tuples(rows, ["e1", "e2"], Params(order_weight=0, gap_weight=0, delta=1)))
    b = rank.independent(rows, ["e1", "e2"])
    left = {r.video_id: round(r.raw_score, 9) for r in a.collect()}
    assert left == {r.video_id: round(r.priority_score, 9) for r in b.collect()} and left["v1"] == left["v2"] == 0.7


def pin(spark, video, t, event="e1", frame=1, region=None):
    return spark.createDataFrame([("s1", event, video, region, frame, t, None)], PIN)


def ranked(spark, rows, pins, rules=()):
    r = spark.createDataFrame(list(rules), RULE)
    some = constraints.allowed(rows.unionByName(constraints.pinned_regions(rows, pins)), r, pins)
    return {x.video_id: x for x in tuples(some, ["e1"], Params(delta=1, most_tuples=1)).collect()}


def test_pins(spark):
    rows = make(spark, [("r1", "e1", "v1", 0.95, 5)])
    assert ranked(spark, rows, pin(spark, "v1", 42.0))["v1"].timestamps == [42.0]
    rows = make(spark, [("r1", "e1", "v1", 0.95, 10, 0.0, 50.0)])
    got = ranked(spark, rows, pin(spark, "v1", 42.0))["v1"]
    assert (got.region_ids, got.timestamps) == (["r1"], [42.0])
    rows = make(spark, [("a", "e1", "v1", 0.5, 1), ("b", "e1", "v2", 0.95, 1)])
    got = ranked(spark, rows, pin(spark, "v1", 42.0))
    assert got["v2"].region_ids == ["b"] and got["v1"].timestamps == [42.0]
    rows = make(spark, [("r1", "e1", "v1", 0.9, 10), ("r2", "e1", "v1", 0.3, 20)])
    assert ranked(spark, rows, pin(spark, "v1", 20.0))["v1"].region_ids == ["r2"]
    assert ranked(spark, rows, pin(spark, "v1", None, frame=None, region="r2"))["v1"].region_ids == ["r2"]


def test_rules(spark):
    rows = make(spark, [("a", "e1", "v1", 0.9, 1), ("b", "e1", "v2", 0.8, 1), ("c", "e1", "v3", 0.7, 1)])
    none = spark.createDataFrame([], PIN)
    assert set(ranked(spark, rows, none, [("s1", "v1", "reject", None)])) == {"v2", "v3"}
    assert set(ranked(spark, rows, none, [("s1", "v2", "allow", None)])) == {"v2"}
    assert set(ranked(spark, rows, pin(spark, "v3", 1.0), [("s1", "v2", "allow", None)])) == {"v2", "v3"}
    assert set(ranked(spark, rows, pin(spark, "v1", 1.0), [("s1", "v1", "reject", None)])) == {"v2", "v3"}
    listed = rank.listed_first(spark.createDataFrame([("s1", "a", 0.9, 0.9, 1), ("s1", "b", 0.3, 0.3, 1)], "session_id string, video_id string, priority_score double, raw_score double, event_coverage int"),
                               spark.createDataFrame([("s1", "b", "prioritize", 0)], RULE))
    assert [r.video_id for r in listed.orderBy(*rank.final_order(listed, listed)).collect()] == ["b", "a"]


EVENT = "session_id string, event_pos int, event_id string, temporal_relation string, reference_event_id string"


def test_relations(spark):
    rows = [("s", 0, "a", "unknown", None), ("s", 1, "b", "after", "a"), ("s", 2, "c", "after", "b"), ("s", 3, "d", "during", "a"), ("s", 4, "e", "before", "gone"),
            ("t", 0, "a", "unknown", None), ("u", 0, "x", "before", "y"), ("u", 1, "y", "before", "x")]
    df = spark.createDataFrame(rows, EVENT)
    closed = relations.order_constraints(df)
    assert relations.pairs(closed, "s") == [(0, 1), (0, 2), (1, 2)] and relations.pairs(closed, "u") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [r.session_id for r in relations.unrelated(df).collect()] == ["t"]
    bad = sorted(map(tuple, relations.relation_violations(df).collect()))
    assert bad == [("cycle", "u", "x"), ("cycle", "u", "y"), ("dangling_reference", "s", "e")]


def test_calibration(spark):
    rows = [("e1", 100.0), ("e1", 101.0), ("e2", 0.0), ("e2", 1.0), ("e3", 5.0), ("e3", 5.0), ("e3", 5.0), ("e3", 9.0)]
    got = robust_sigmoid(spark.createDataFrame(rows, "e string, x double"), ["e"], "x", "y").collect()
    best = {e: max(r.y for r in got if r.e == e) for e in ("e1", "e2", "e3")}
    assert best["e1"] == pytest.approx(best["e2"]) and {r.y for r in got if r.e == "e3" and r.x == 5} == {0.5} and best["e3"] > 0.999
    for values, want in (([3.7], [0.5]), ([2, 2, 2], [0.5] * 3), ([1, 3, 5], [0, 0.5, 1]), ([10, 9.9, 0], [1, 0.99, 0])):
        df = min_max(spark.createDataFrame([("k", float(v)) for v in values], "k string, x double"), ["k"], "x", "y")
        assert sorted(r.y for r in df.collect()) == pytest.approx(sorted(want))


def test_distinctness(spark):
    for times, want in (([9.0, 9.0], 0), ([9.0, 50.0], 1), ([0.0, 1.5], 0.5), ([4.0], 1), ([None, 4.0, 4.3, 100.0], 0.1)):
        df = spark.createDataFrame([(times,)], "t array<double>")
        assert df.select(rank.distinctness(F.col("t")).alias("x")).first().x == pytest.approx(want)


CAND = "id string, session_id string, event_id string, video_id string, frame_id long, timestamp_seconds double, raw_relevance_score double, seq long"


def hits(spark, times):
    return spark.createDataFrame([(f"c{i}", "s", "e", "v", i, float(t), 1.0 + i, i) for i, t in enumerate(times)], CAND)


def test_clusters_merges_and_seeds(spark):
    rows = regions.clusters(hits(spark, [1, 5, 12]), 3, 2, 30)
    got = regions.merged(rows, 30).orderBy("start_seconds").collect()
    assert [(r.start_seconds, r.end_seconds, r.candidate_ids) for r in got] == [(0, 7, ["c0", "c1"]), (10, 14, ["c2"])]
    rows = regions.clusters(hits(spark, range(21)), 2, 1, 10).collect()
    assert len(rows) > 1 and all(r.end_seconds - r.start_seconds <= 10 for r in rows)
    c = spark.createDataFrame([("a", "s", "e", "v", 0, 12.0, 0.8, 0), ("b", "s", "e", "v", 1, 15.0, 0.9, 1)], CAND)
    found = regions.seeds(regions.clusters(c, 3, 3, 30), c)
    assert [r.timestamp_seconds for r in found.orderBy("seed").collect()] == [15.0, 12.0]
    with pytest.raises(ValueError):
        regions.clusters(c, 3, 3, 5)


def test_other_order_and_partitioning_give_the_same(spark):
    rows = make(spark, [(f"r{i}", f"e{i % 3}", f"v{i % 4}", (i * 37 % 11) / 11, i * 13 % 29) for i in range(60)])
    a = sorted(map(str, tuples(rows, ["e0", "e1", "e2"], Params(delta=0.4)).collect()))
    b = sorted(map(str, tuples(rows.orderBy(F.desc("id")).repartition(7), ["e0", "e1", "e2"], Params(delta=0.4)).collect()))
    assert a == b and a


def test_gap_terms_of_one_event():
    assert gap_terms([F.lit(1.0)], Params()) is not None
