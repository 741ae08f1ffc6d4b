"""The best combinations of one video's pools, without their product.

A combination's score is the mean of its regions' scores, a gated weight times its order score, minus the mean gap penalty. Scores
and penalties are sums over events and over neighbours, and so is the number of neighbours in order. So a sweep from the last
event to the first gives, for each region and each number of ordered neighbours after it, the most that what follows can
add (``ahead``). A best-first search over prefixes then takes the prefix with the highest bound: what it has, what can follow, and the
best that the gate and the pairs that aren't neighbours could still make of it. Where these two leave nothing open the bound is met, so each
of the k results costs one walk along the events; else it is an upper bound, and the search goes on until no prefix can
beat the k-th result. Equal scores come out by region ids, as prefixes of equal bound are taken in the order of theirs. Pools with up to FEW combinations
are scored at once, and many such videos together (``winners``), as a call of numpy costs more than a small video's rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

#: Cells of the matrices of neighbours that are made at once.
CELLS = 1_000_000
#: Combinations that are made and sorted at once; beyond that the search is the shorter way.
FEW = 20_000
#: Combinations of many videos that are made at once.
BLOCK = 50_000
NEVER = -np.inf


@dataclass(frozen=True)
class Pool:
    """Regions of an event: scores, times, margins, and their places in the order of ids. An event without regions has one, without time."""

    score: np.ndarray
    time: np.ndarray
    margin: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(ids: Sequence[str | None], score: Sequence[float], time: Sequence[float | None], margin: Sequence[float | None]) -> Pool:
        if not len(ids):
            return Pool(np.zeros(1), np.full(1, np.nan), np.zeros(1), np.zeros(1, int))
        real = lambda x: np.nan_to_num(np.asarray(x, float))
        place = np.empty(len(ids), int)
        place[sorted(range(len(ids)), key=lambda i: ids[i] or "")] = np.arange(len(ids))
        return Pool(real(score), np.asarray(time, float), real(margin), place)


def place_in(groups: np.ndarray) -> np.ndarray:
    """Of sorted groups, each row's place in its own, from 0."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, int)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


class State(NamedTuple):
    """What a prefix has come to; of many prefixes, arrays."""

    score: float
    margin: float
    cost: float
    costs: int
    kept: int
    checked: int
    low: float
    high: float


class Children:
    """``key, place, picked, state`` of each next prefix, made when it is looked at."""

    def __init__(self, order: np.ndarray, key: np.ndarray, place: np.ndarray, picked: tuple[int, ...], state: State) -> None:
        self.order, self.key, self.place, self.picked, self.state = order, key, place, picked, state

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, at: int) -> tuple:
        j = int(self.order[at])
        return float(self.key[j]), int(self.place[j]), (*self.picked, j), State(*(x[j].item() for x in self.state))


class Search:
    """``p`` as in ``tuples.Params``; ``pairs`` as in ``tuples.order_score``."""

    def __init__(self, pools: Sequence[Pool], p, pairs: Sequence[tuple[int, int]] | None) -> None:
        self.pools, self.p, self.n = pools, p, len(pools)
        pairs = [(i, i + 1) for i in range(self.n - 1)] if pairs is None else pairs
        self.timed = [bool(np.isfinite(x.time).any()) for x in pools]
        # times are all there or all missing in an event, but for regions without a time: those are checked one by one
        self.whole = all(np.isfinite(x.time).all() or not t for x, t in zip(pools, self.timed))
        self.near = [[(a, b) for a, b in pairs if {a, b} == {i, i + 1}] for i in range(self.n - 1)]
        self.far = [(a, b) for a, b in pairs if abs(a - b) != 1]
        self.checked = sum(self.timed[a] and self.timed[b] for a, b in pairs)
        self.ruled = [i for i in range(self.n - 1) if self.timed[i] and self.timed[i + 1] and self.costs_of(i)]

    def costs_of(self, i: int) -> bool:
        rule = self.p.gaps.get(i)
        return rule.weight is not None if rule else self.p.gap_weight > 0

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and most confidence that the events after each one can add."""
        values = [x.margin if self.p.gate == "margin" else x.score for x in self.pools]
        after = lambda f: np.r_[np.cumsum([f(v) for v in values[::-1]])[::-1][1:], 0.0]
        return after(np.min), after(np.max)

    def step(self, i: int, before: np.ndarray | float, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From event i at ``before`` to the next at ``after``: penalties before the mean, infinite where rejected; pairs in order; both timed."""
        gap = after - before
        both = ~np.isnan(gap)
        rule, p = self.p.gaps.get(i), self.p
        if rule and rule.weight is not None:
            cost = np.where(both, rule.weight * np.maximum(0.0, gap - (rule.tau or 0.0)), 0.0)
        elif not rule and p.gap_weight > 0:
            cost = np.where(both, p.gap_weight * np.maximum(0.0, np.abs(gap) - p.gap_tau), 0.0)
        else:
            cost = np.zeros(gap.shape)
        if rule:
            off = gap < rule.least
            if rule.most is not None:
                off |= gap > rule.most
            cost = np.where(off, np.inf, cost)
        kept = np.zeros(gap.shape, int)
        for a, b in self.near[i]:
            kept += (gap > 0) if a < b else (gap < 0)
        return cost, kept, both

    def swept(self) -> list[np.ndarray]:
        """Of each event: a row a region, a column a number of ordered neighbours, the most that later events can add."""
        ahead = [np.zeros((len(self.pools[-1].score), 1))]
        for i in range(self.n - 2, -1, -1):
            own, later = self.pools[i], ahead[0]
            most = len(self.near[i])
            best = np.full((len(own.score), later.shape[1] + most), NEVER)
            for s in range(0, len(own.score), max(1, CELLS // len(self.pools[i + 1].score))):
                rows = slice(s, s + max(1, CELLS // len(self.pools[i + 1].score)))
                cost, kept, _ = self.step(i, own.time[rows, None], self.pools[i + 1].time[None, :])
                gain = self.pools[i + 1].score[None, :] / self.n - cost / max(len(self.ruled), 1)
                for o in range(most + 1):
                    some = np.where(kept == o, gain, NEVER)
                    if np.isneginf(some).all():
                        continue
                    for k in range(later.shape[1]):
                        best[rows, k + o] = np.maximum(best[rows, k + o], (some + later[None, :, k]).max(1))
            ahead.insert(0, best)
        return ahead

    def weights(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most gated weight while the confidence is between ``low`` and ``high``."""
        w, p = self.p.order_weight, self.p
        if p.gate == "none":
            return np.full(low.shape, w), np.full(low.shape, w)
        if p.gate == "linear":
            return w * low, w * high
        return np.where(low >= p.gate_threshold + 1e-12, w, 0.0), np.where(high >= p.gate_threshold - 1e-12, w, 0.0)

    def bounds(self, i: int, state: State) -> np.ndarray:
        """The most that prefixes which end in each region of event i can come to."""
        n, c = self.n, self.checked
        base = state.score / n - state.cost / max(len(self.ruled), 1)
        conf = state.margin if self.p.gate == "margin" else state.score
        open_ = sum(max(a, b) > i and self.timed[a] and self.timed[b] for a, b in self.far)
        low, high = self.weights((conf + self.low[i]) / n, (conf + self.high[i]) / n)
        out = np.full(len(base), NEVER)
        for k in range(self.ahead[i].shape[1]):
            if not self.whole:
                orders = [np.full(len(base), x) for x in (-1.0, 1.0)]
            elif c:
                orders = [(2 * (state.kept + k + u) - c) / c for u in ((0, open_) if open_ else (0,))]
            else:
                orders = [np.zeros(len(base))]
            bonus = np.max([f * o for f in (low, high) for o in orders], axis=0)
            out = np.maximum(out, base + self.ahead[i][:, k] + bonus)
        return out

    def scores(self, state: State) -> np.ndarray:
        """Of whole combinations, as the plan's columns compute them."""
        p, n = self.p, self.n
        mean, margin = state.score / n, state.margin / n
        conf = margin if p.gate == "margin" else mean
        order = np.where(state.checked > 0, (2 * state.kept - state.checked) / np.maximum(state.checked, 1), 0.0)
        weight = {"none": p.order_weight, "linear": p.order_weight * conf}.get(p.gate, np.where(conf >= p.gate_threshold, p.order_weight, 0.0))
        return mean + weight * order - np.where(state.costs > 0, state.cost / np.maximum(state.costs, 1), 0.0)

    def grown(self, i: int, state: State, times: Sequence, own: Pool) -> tuple[State, np.ndarray | None]:
        """The state after event i, and what is rejected; ``times`` are of the events before."""
        kept, checked, cost, costs, off = state.kept, state.checked, state.cost, state.costs, None
        if i:
            more, order, both = self.step(i - 1, times[i - 1], own.time)
            kept, checked = kept + order, checked + len(self.near[i - 1]) * both
            if self.p.gaps.get(i - 1):
                off = np.isinf(more)
                more = np.where(off, 0.0, more)
            cost, costs = cost + more, costs + both * self.costs_of(i - 1)
            for a, b in self.far:
                if max(a, b) == i:
                    other = times[min(a, b)] if a != b else own.time
                    kept = kept + ((own.time > other) if b == i else (other > own.time))
                    checked = checked + ~np.isnan(own.time - other)
        low, high = state.low, state.high
        if self.p.span is not None:
            low, high = np.fmin(own.time, low), np.fmax(own.time, high)
            wide = high - low > self.p.span
            off = wide if off is None else off | wide
        return State(state.score + own.score, state.margin + own.margin, cost, costs, kept, checked, low, high), off

    def children(self, picked: tuple[int, ...], state: State) -> Children:
        """The prefix with each region of the next event, the best first."""
        i = len(picked)
        own = self.pools[i]
        new, off = self.grown(i, state, [x.time[j] for x, j in zip(self.pools, picked)], own)
        new = State(*(np.broadcast_to(x, own.score.shape) for x in new))
        key = np.round(self.scores(new), 9) if i == self.n - 1 else np.round(self.bounds(i, new) + 1e-12, 9)
        if off is not None:
            key = np.where(off, NEVER, key)
        order = np.lexsort((own.place, -key))
        return Children(order[key[order] > NEVER], key, own.place, picked, new)

    def every(self, sizes: Sequence[np.ndarray], videos: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The first ``k`` of all combinations of each of ``videos``, and their places in the pools; for small pools, whose product is few rows.

        Pools hold those of many videos, one after another; ``sizes`` are, of each event, those of all these videos.
        """
        zero, never = np.zeros(len(videos)), np.full(len(videos), np.nan)
        state, times, picked = State(zero, zero, zero, zero, zero, zero, never, never), [], []
        for i, (pool, size) in enumerate(zip(self.pools, sizes)):
            own = size[videos]
            before = np.repeat(np.arange(len(videos)), own)
            j = np.arange(len(before)) + np.repeat((np.cumsum(size) - size)[videos] - (np.cumsum(own) - own), own)
            videos, times, picked = videos[before], [x[before] for x in times], [x[before] for x in picked]
            own = Pool(pool.score[j], pool.time[j], pool.margin[j], j)
            state, off = self.grown(i, State(*(x[before] for x in state)), times, own)
            times.append(own.time)
            picked.append(j)
            if off is not None:
                stay = np.flatnonzero(~off)
                state, videos, times, picked = State(*(x[stay] for x in state)), videos[stay], [x[stay] for x in times], [x[stay] for x in picked]
        key = np.round(self.scores(state), 9)
        by = np.lexsort((-key, videos))
        last = by[place_in(videos[by]) == k - 1]
        edge = np.full(len(sizes[0]), NEVER)
        edge[videos[last]] = key[last]  # ids decide among what equals the k-th
        some = np.flatnonzero(key >= edge[videos])
        first = some[np.lexsort((*[x.place[j[some]] for x, j in zip(self.pools[::-1], picked[::-1])], -key[some], videos[some]))]
        first = first[place_in(videos[first]) < k]
        return videos[first], [x[first] for x in picked]

    def all(self, k: int) -> list[tuple[int, ...]]:
        """The first ``k`` of all combinations of one video."""
        _, picked = self.every([np.array([len(x.score)]) for x in self.pools], np.zeros(1, int), k)
        return list(zip(*(x.tolist() for x in picked)))

    def best(self, k: int) -> Iterator[tuple[int, ...]]:
        """The first ``k`` combinations, as places in the pools."""
        if math.prod(len(x.score) for x in self.pools) <= FEW:
            yield from self.all(k)
            return
        yield from self.searched(k)

    def searched(self, k: int) -> Iterator[tuple[int, ...]]:
        self.low, self.high = self.ends()
        self.ahead = self.swept()
        first = self.children((), State(0.0, 0.0, 0.0, 0, 0, 0, np.nan, np.nan))
        agenda = [(-first[0][0], (first[0][1],), 0, first)] if len(first) else []
        given = 0
        while agenda and given < k:
            key, places, at, siblings = heapq.heappop(agenda)
            _, _, picked, state = siblings[at]
            if at + 1 < len(siblings):
                other = siblings[at + 1]
                heapq.heappush(agenda, (-other[0], (*places[:-1], other[1]), at + 1, siblings))
            if len(picked) == self.n:
                given += 1
                yield picked
                continue
            below = self.children(picked, state)
            if len(below):
                heapq.heappush(agenda, (-below[0][0], (*places, below[0][1]), 0, below))


def winners(pools: Sequence[Pool], sizes: Sequence[np.ndarray], videos: np.ndarray, p, pairs: Sequence[tuple[int, int]] | None, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each of ``videos``: video, rank from 1, and places in the pools of the first ``k`` combinations; pools as in ``Search.every``.

    Videos with few combinations are taken together, up to BLOCK combinations at once; the others are searched one by one.
    """
    product = np.prod([x[videos].astype(float) for x in sizes], axis=0)
    small, upto = videos[product <= FEW], np.cumsum(product[product <= FEW])
    search = Search(pools, p, pairs)
    found, at = [], 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        found.append(search.every(sizes, small[at:to], k))
        at = to
    ends = [np.cumsum(x) for x in sizes]
    for v in videos[product > FEW].tolist():
        first = [int(e[v] - x[v]) for e, x in zip(ends, sizes)]
        own = [Pool(*(x[a : int(e[v])] for x in (y.score, y.time, y.margin, y.place))) for y, a, e in zip(pools, first, ends)]
        picked = np.array(list(Search(own, p, pairs).searched(k)), int).reshape(-1, len(pools))
        found.append((np.full(len(picked), v), [x + a for x, a in zip(picked.T, first)]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), [np.zeros(0, int) for _ in pools]
    videos = np.concatenate([v for v, _ in found])
    ranks = np.concatenate([place_in(v) for v, _ in found]) + 1
    return videos, ranks, [np.concatenate(x) for x in zip(*(picked for _, picked in found))]
