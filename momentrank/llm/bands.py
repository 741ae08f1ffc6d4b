"""Bands of minima of shingle hashes, and exact similarity of shingle sets.

The smallest of a text's shingle hashes under a permutation is also another text's with a chance of their Jaccard
similarity. A band is ROWS such minima; texts that are alike by 0.8 share one of BANDS bands with a chance of 98.6%, and
texts alike by 0.3 with one of 1%. Sets of shingles are arrays of distinct 32-bit hashes, so that a similarity counted
on them is exact but for equal hashes of different shingles (some 1 in 10 million for texts of hundreds of words).
"""

from __future__ import annotations

import numpy as np
import xxhash

BANDS, ROWS = 14, 6
SIMILAR = 0.8


def multipliers(n: int) -> np.ndarray:
    """Odd numbers, from hashes of 0, 1, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) | 1 for i in range(n)], np.uint64)


FACTORS = multipliers(BANDS * ROWS)


def bands(every: np.ndarray) -> np.ndarray:
    """Keys of a text's bands, from its shingles' 64-bit hashes; a text without shingles has keys of its own kind."""
    low = np.full(len(FACTORS), (1 << 64) - 1, np.uint64)
    for i in range(0, len(every), 4096):
        x = every[i : i + 4096]
        x = (x ^ x >> np.uint64(31)) * FACTORS[:, None]
        np.minimum(low, (x ^ x >> np.uint64(32)).min(1), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def shingle_set(every: np.ndarray) -> np.ndarray:
    """Distinct upper halves of hashes, sorted."""
    return np.unique((every >> np.uint64(32)).astype(np.uint32))


def alike(sets: list[np.ndarray], least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected by similarities of ``least`` or more: each reached set with the one it was reached from.

    A set is compared with all that nothing has reached yet, in one pass over their hashes, and is done then.
    """
    size = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.zeros(0), np.zeros(0, np.int64))
    flat, ends = flat.astype(np.int32), np.cumsum(size)
    hit = np.zeros(len(values), bool)
    open_ = np.ones(len(sets), bool)
    a, b = [], []
    for start in range(len(sets)):
        front = [start] if open_[start] else []
        open_[start] = False
        while front:
            at = front.pop()
            # both at least 0.8 of the other's size, or they can't be alike by 0.8
            rest = np.flatnonzero(open_ & (size >= least * size[at]) & (size * least <= size[at]))
            if not len(rest):
                continue
            own = flat[ends[at] - size[at] : ends[at]]
            hit[own] = True
            if len(rest) > 64:
                upto = np.r_[0, np.cumsum(hit[flat])]
                both = upto[ends[rest]] - upto[ends[rest] - size[rest]]
            else:
                both = np.array([np.count_nonzero(hit[flat[ends[r] - size[r] : ends[r]]]) for r in rest.tolist()], np.int64)
            hit[own] = False
            found = rest[both >= least * (size[at] + size[rest] - both) - 1e-9]
            a.append(found)
            b.append(np.full(len(found), at))
            open_[found] = False
            front.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])
