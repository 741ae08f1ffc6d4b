"""The k-best search against all combinations."""

import time
import tracemalloc
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentrank.operators import kbest
from momentrank.operators.kbest import Pool, Search
from momentrank.operators.tuples import Gap, Params, tuples


def brute(pools, p, pairs, k):
    """(score, places) of the k best, by scoring each combination from the definition."""
    n = len(pools)
    pairs = [(i, i + 1) for i in range(n - 1)] if pairs is None else pairs
    out = []
    for picked in product(*[range(len(x.score)) for x in pools]):
        t = [x.time[j] for x, j in zip(pools, picked)]
        there = [not np.isnan(v) for v in t]
        bad, costs = False, []
        for i in range(n - 1):
            if not (there[i] and there[i + 1]):
                continue
            gap, g = t[i + 1] - t[i], p.gaps.get(i)
            if g:
                bad |= gap < g.least or (g.most is not None and gap > g.most)
                if g.weight is not None:
                    costs.append(g.weight * max(0.0, gap - (g.tau or 0.0)))
            elif p.gap_weight > 0:
                costs.append(p.gap_weight * max(0.0, abs(gap) - p.gap_tau))
        known = [v for v in t if not np.isnan(v)]
        if bad or p.span is not None and known and max(known) - min(known) > p.span:
            continue
        own = [t[b] > t[a] for a, b in pairs if there[a] and there[b]]
        order = (2 * sum(own) - len(own)) / len(own) if own else 0.0
        mean, margin = (sum(getattr(x, c)[j] for x, j in zip(pools, picked)) / n for c in ("score", "margin"))
        conf = margin if p.gate == "margin" else mean
        weight = {"none": p.order_weight, "linear": p.order_weight * conf}.get(p.gate, p.order_weight if conf >= p.gate_threshold else 0.0)
        score = mean + weight * order - (sum(costs) / len(costs) if costs else 0.0)
        out.append((-round(score, 9), tuple(int(x.place[j]) for x, j in zip(pools, picked)), picked))
    return [x[2] for x in sorted(out)[:k]]


def made(rng, n, most, ties, holes):
    pools = []
    for _ in range(n):
        size = int(rng.integers(0, most + 1))
        score = rng.integers(5, 9, size) / 10 if ties else 0.5 + 0.15 * rng.random(size)
        when = [None if holes and rng.random() < 0.2 else float(v) for v in (rng.integers(0, 6, size) if ties else 100 * rng.random(size))]
        pools.append(Pool.of([f"r{i}" for i in rng.permutation(size)], score.tolist(), when, (rng.random(size) - 0.5).tolist()))
    return pools


@pytest.mark.parametrize("seed", range(12))
def test_random_pools_match_all_combinations(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        n = int(rng.integers(1, 6))
        pools = made(rng, n, 5, rng.random() < 0.4, rng.random() < 0.3)
        gaps = {i: Gap(float(rng.choice([0, 0, 5, -20])), rng.choice([None, 40.0]), rng.choice([None, 10.0]), rng.choice([None, 0.02])) for i in range(n - 1) if rng.random() < 0.3}
        p = Params(gate=str(rng.choice(["none", "linear", "threshold", "margin"])), gate_threshold=float(rng.choice([0.1, 0.55, 0.6])), gaps=gaps,
                   gap_weight=float(rng.choice([0.0, 0.01])), span=rng.choice([None, 60.0]), order_weight=float(rng.choice([0.0, 0.4, 1.2])))
        some = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        pairs = None if rng.random() < 0.5 else some
        k = int(rng.integers(1, 25))
        search, want = Search(pools, p, pairs), brute(pools, p, pairs, k)
        assert list(search.searched(k)) == want and search.all(k) == want


@pytest.mark.parametrize("gate", ["none", "linear", "threshold", "margin"])
@pytest.mark.parametrize("pairs", [None, [(0, 1), (1, 2), (0, 4), (2, 4)]])
def test_five_pools_of_300(gate, pairs):
    """2.4 million million combinations: the search looks at a few prefixes of each length."""
    rng = np.random.default_rng(1)
    pools = [Pool.of([f"r{i:03}" for i in range(300)], (0.6 + 0.15 * rng.random(300)).tolist(), (1000 * rng.random(300)).tolist(), (0.1 * rng.random(300)).tolist()) for _ in range(5)]
    s = Search(pools, Params(gate=gate, gate_threshold=0.66 if gate == "threshold" else 0.05, gap_weight=0.001), pairs)
    looked, plain = 0, s.children

    def children(*a):
        nonlocal looked
        looked += 1
        return plain(*a)

    s.children = children
    began = time.time()
    got = list(s.best(20))
    assert len(set(got)) == 20 and looked < 2000 and time.time() - began < 60
    few = [Pool(x.score[:6], x.time[:6], x.margin[:6], x.place[:6]) for x in pools]
    assert list(Search(few, s.p, pairs).searched(20)) == brute(few, s.p, pairs, 20)


def test_equal_scores_come_by_ids():
    pools = [Pool.of([f"r{i:03}" for i in range(200)], [0.5] * 200, [float(e)] * 200, [0.0] * 200) for e in range(5)]
    assert list(Search(pools, Params(), None).best(20)) == [(0, 0, 0, 0, i) for i in range(20)]


def test_the_plan_has_no_product(spark):
    rows = [("s", "v", e, f"{e}{i:03}", 0.9 - 0.0001 * i, float(60 * k + i)) for k, e in enumerate("abcde") for i in range(300)]
    df = spark.createDataFrame(rows, "session_id string, video_id string, event_id string, id string, normalized_coarse_score double, best_seconds double")
    df = df.withColumn("seq", F.monotonically_increasing_id())
    out = tuples(df, list("abcde"), Params(most_tuples=20))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert [r.rank_in_video for r in out.orderBy("rank_in_video").collect()] == list(range(1, 21))


@pytest.mark.parametrize("p", [Params(delta=0.3, most_tuples=4), Params(gaps={0: Gap(least=1.0, most=600.0, tau=5.0, weight=0.01)}, span=700.0, gate="linear"), Params(gate="margin", gate_threshold=0.05)])
@pytest.mark.parametrize("pairs", [None, [(2, 0), (1, 2)]])
def test_many_videos_at_once(p, pairs, monkeypatch):
    """Videos taken together have the combinations that each has alone, in memory that does not grow with their number."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(kbest, "FEW", 200)
    peaks = []
    for videos in (80, 320):
        sizes = [rng.integers(1, 8, videos) for _ in range(3)]
        pools = [Pool(rng.random(n := int(x.sum())).round(1), np.where(rng.random(n) < 0.1, np.nan, (1000 * rng.random(n)).round()), rng.random(n).round(1), rng.permutation(n)) for x in sizes]
        monkeypatch.setattr(kbest, "BLOCK", 1000)
        some = np.flatnonzero(rng.random(videos) < 0.9)
        tracemalloc.start()
        found, ranks, picked = kbest.winners(pools, sizes, some, p, pairs, p.most_tuples)
        peaks.append(tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in (found, ranks, *picked)) * 2)
        tracemalloc.stop()
        have = sorted(zip(found.tolist(), ranks.tolist(), zip(*(x.tolist() for x in picked))))
        want = []
        for v in some.tolist():
            first = [int(x[:v].sum()) for x in sizes]
            own = [Pool(*(y[a : a + x[v]] for y in (q.score, q.time, q.margin, q.place))) for q, a, x in zip(pools, first, sizes)]
            want += [(v, rank, tuple(a + j for a, j in zip(first, one))) for rank, one in enumerate(Search(own, p, pairs).searched(p.most_tuples), 1)]
        assert have == want
    assert peaks[1] < 2 * peaks[0]
