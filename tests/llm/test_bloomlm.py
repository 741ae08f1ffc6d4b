import math
import zlib
from collections import Counter

import numpy as np
import pytest

from momentrank.llm import bloomlm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def rows():
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    prob = 1 / np.arange(1, 301)
    out = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 150)), p=prob / prob.sum()))) for i in range(150)]
    out += [(1000 + i, out[i % 20][1] + " Extra") for i in range(40)]
    return out + [(2000, None), (2001, " \n"), (2002, "X" * 5000), (2002, "W1 w2\x0bw3"), (None, "w1 w2 unseenword")]


STARTS = sorted({math.ceil(round(2 ** (q / 4), 9)) for q in range(80)})


def level(c):
    """The smallest count of a count's level: 1; 2; 3; ... 8; 10; 12; 14; 16; 20 ..."""
    return max((v for v in STARTS if v <= c), default=0)


class Slow:
    """The model over dictionaries of exact counts."""

    def __init__(self, train, order):
        self.order = order
        self.c = Counter(w for t in train for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.grams = {1: self.c}
        for k in range(2, order + 1):
            self.grams[k] = Counter(tuple(w[i - k + 1 : i + 1]) for t in train for w in [["start", *tokens(t)]] for i in range(k - 1, len(w)))
        self.starts = len(train)
        self.means = {}
        for k, grams in self.grams.items():
            held = {}
            for c in grams.values():
                held.setdefault(level(c), []).append(c)
            self.means[k] = {v: sum(x) / len(x) for v, x in held.items()}

    def read_back(self, k, gram):
        """What the level of an n-gram's count says of it: the mean of the counts there."""
        return self.means[k].get(level(self.grams[k][gram]), 0)

    def base(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def discount(self, k):
        once, twice = (max(sum(1 for c in self.grams[k].values() if c == i), 1) for i in (1, 2))
        return min(once / (once + 2 * twice), 0.95)

    def p(self, w, i):
        p = self.base(w[i])
        for k in range(2, self.order + 1):
            if i < k - 1:
                break
            own, d = self.grams[k], self.discounts[k]
            h = w[i - k + 1 : i]
            count = self.read_back(k, tuple(w[i - k + 1 : i + 1]))
            context = self.starts if h == ["start"] else self.c[h[0]] if k == 2 else self.read_back(k - 1, tuple(h))
            if not context:
                continue
            kinds = len(self.grams[k - 1])
            new = min(max((len(own) - kinds) / (sum(own.values()) - kinds), 0), 1)
            left = min(d * (1 + (context - 1) * new) / context, 1)
            p = (1 - left) * min(count / context, 1) + left * p
        return p

    def score(self, t):
        w = ["start", *tokens(t)]
        return sum(math.log10(self.p(w, i)) for i in range(1, len(w)))


@pytest.mark.parametrize("order, segment", [(3, bloomlm.SEGMENT), (2, 2000), (4, 5000)])
def test_matches_brute_force(spark, order, segment):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, score int")
    got = bloomlm.scored(df, order=order, segment=segment).collect()
    model = Slow([t for d, t in data if zlib.crc32(str("" if d is None else d).encode()) % 10], order)
    model.discounts = {k: model.discount(k) for k in range(2, order + 1)}
    # a null id comes back with a row of its own; all others by their order in the input
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in data)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    same = 0
    for d, t in data:
        w = tokens(t)
        r = next(x for x in by[d] if x.n_tokens == len(w))
        assert r.held_out == (zlib.crc32(str("" if d is None else d).encode()) % 10 == 0)
        assert (r.n_known, r.train_tokens) == (sum(model.c[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(sum(math.log10(model.base(x)) for x in w))
        same += abs(r.score - model.score(t)) < 1e-6
    lookups = (order - 1) * sum(len(tokens(t)) for _, t in data)  # one in 1024 passes a level too many
    assert same >= len(data) - 2 * lookups / 1024
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_of_a_context_sum_to_one():
    train = [t for d, t in rows() if d]
    model = Slow(train, 3)
    model.discounts = {k: model.discount(k) for k in (2, 3)}
    seen = Counter(tuple(w[i - 1 : i + 1]) for t in train for w in [["start", *tokens(t)]] for i in range(1, len(w) - 1))
    mass = {h: sum(model.p([*h, w], 2) for w in [*model.c, "never seen"]) for h in [*seen][::25]}
    off = {h: abs(m - 1) for h, m in mass.items()}
    assert len(off) > 100 and max(off.values()) < 0.1
    total = sum(seen[h] for h in off)
    assert sum(seen[h] * x for h, x in off.items()) / total < 0.01
    assert abs(sum(seen[h] * m for h, m in mass.items()) / total - 1) < 0.005


def test_a_document_that_occurs_twice_stands_apart(spark):
    """The same words at random in all texts; copies gain far more on the base than texts that occur once."""
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(vocab, 200)) for _ in range(120)]
    train = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10][:150]
    data = list(zip(train, texts + texts[:30]))
    got = bloomlm.scored(spark.createDataFrame(data, "doc_id long, text string")).collect()
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in got}
    twice = [gain[d] for d in train[:30] + train[120:]]
    once = [gain[d] for d in train[30:120]]
    assert min(twice) > max(once) + 0.1


def test_a_very_long_text_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(bloomlm, "BLOCK", 500)
    data = [(1, "a b c " * 100_000), (2, "x" * 300_000), *((i, "a b d") for i in range(3, 200))]
    got = {r.doc_id: r for r in bloomlm.scored(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(got) == len(data) and got[1].n_tokens == 300_001 and got[2].n_tokens == 2
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got.values())


def test_filter_never_misses_and_seldom_invents():
    rng = np.random.default_rng(4)
    key = rng.integers(0, 1 << 32, 20_000, dtype=np.uint64)
    count = rng.geometric(0.1, len(key))
    f = bloomlm.Filter(key, count)
    off = f.level(key) - bloomlm.levels(count)
    assert off.min() >= 0 and (off > 0).mean() < 0.01
    other = rng.integers(0, 1 << 32, 20_000, dtype=np.uint64)
    assert (f.level(other) > 0).mean() < 0.005
    assert bloomlm.VALUE[bloomlm.levels(np.arange(13))].tolist() == [level(c) for c in range(13)]


def test_empty_and_no_training_text(spark):
    assert bloomlm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = bloomlm.scored(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one.held_out and (one.n_tokens, one.n_known, one.train_tokens) == (3, 0, 0) and one.base_score == 0
