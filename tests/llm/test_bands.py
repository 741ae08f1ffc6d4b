"""The pipeline's duplicates against all pairs by exact similarity."""

import numpy as np

from momentrank.llm import bands, simhash
from momentrank.llm.common import components
from momentrank.llm.hnsw import smallest

from .test_simhash import slow_print, slow_wide


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar(rows):
    """Smallest id of each row's group, from all pairs: alike by 0.8 or more, or within SURE of 256 bits and NEAR of 64."""
    sets, wide, fp = [shingles(t) for _, t in rows], [slow_wide(t) for _, t in rows], [slow_print(t) for _, t in rows]
    a, b = [], []
    for i in range(len(rows)):
        for j in range(i):
            sure = (wide[i] ^ wide[j]).bit_count() <= simhash.SURE and (fp[i] ^ fp[j]).bit_count() <= simhash.NEAR
            if sure or jaccard(sets[i], sets[j]) >= 0.8:
                a.append(i)
                b.append(j)
    root = smallest(np.array(a, np.int64), np.array(b, np.int64), len(rows))
    return [min(rows[j][0] for j in np.flatnonzero(root == r)) for r in root]


def edited(rng, text, vocab, n):
    w = text.split()
    for at in rng.choice(len(w), n, replace=False):
        w[at] = str(rng.choice(vocab))
    return " ".join(w)


def test_alike_joins_what_is_similar():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 32, 60, dtype=np.uint32)) for _ in range(40)]
    for i in range(160):  # chains of changes around the limit, and two sets of none
        s = sets[int(rng.integers(0, len(sets)))].copy()
        s[rng.choice(len(s), int(rng.integers(1, 12)), replace=False)] = rng.integers(0, 1 << 32, dtype=np.uint32)
        sets.append(np.unique(s))
    sets += [np.zeros(0, np.uint32)] * 2
    own = [set(s.tolist()) for s in sets]
    near = np.array([[jaccard(x, y) >= 0.8 for y in own] for x in own])
    i, j = bands.alike(sets)
    assert near[i, j].all()
    assert (smallest(i, j, len(sets)) == smallest(*np.nonzero(near), len(sets))).all()
    assert [len(x) for x in bands.alike([])] == [0, 0]


def test_similar_texts_share_a_band():
    rng = np.random.default_rng(4)
    shared, n = 0, 400
    for _ in range(n):
        x = rng.integers(0, 1 << 63, 540, dtype=np.uint64)  # 480 of 600 in common: 0.8
        a, b = (bands.bands(np.concatenate([x[:480], y])) for y in (x[480:], rng.integers(0, 1 << 63, 60, dtype=np.uint64)))
        shared += bool((a == b).any())
    assert shared >= 0.97 * n
    assert not (bands.bands(x) == bands.bands(x[:100])).all()
    assert (bands.bands(np.concatenate([x, x])) == bands.bands(x)).all()  # repeats play no part
    assert len(bands.bands(x[:0])) == bands.BANDS


def groups_of_edits(rng, vocab):
    rows = [(i, " ".join(rng.choice(vocab, 250))) for i in range(25)]
    for i in range(25, 130):
        rows.append((i, edited(rng, rows[int(rng.integers(0, 25))][1], vocab, int(rng.integers(1, 12)))))
    return rows


def test_deduplicated_matches_all_pairs(spark):
    """Edits of up to 11 of 250 words: similarities from 0.6 to 1, most too far for 7 bits."""
    rows = groups_of_edits(np.random.default_rng(5), [f"w{i}" for i in range(3000)])
    rows += [(500, None), (501, ""), (502, "One two"), (503, "one  TWO"), (504, "long " * 200_000 + "end")]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], "doc_id long, text string, b0 long, w0 long, mark string, key string")
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(similar(rows)))


def test_a_full_band_is_split(spark):
    rng = np.random.default_rng(6)
    rows = groups_of_edits(rng, [f"w{i}" for i in range(3000)])
    texts = spark.createDataFrame([(i, t) for i, t in rows], "mark long, text string")
    prints = simhash.fingerprints(texts, "mark", "text", wide=4, banded=True)
    classes = prints.selectExpr("doc_id as node", "doc_id as mark", *[c for c in prints.columns if c[0] in "wb"])
    reached = []
    for bucket in (simhash.BAND_BUCKET, 3):
        found = simhash.band_links(classes, texts, bucket=bucket)
        reached.append({r.node: r.root for r in components(found).collect()})
    whole, split = ({frozenset(n for n in r if r[n] == x) for x in r.values()} for r in reached)
    assert all(any(s <= w for w in whole) for s in split)
    assert len(reached[1]) >= 0.9 * len(reached[0])
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(i, j) for i in sets for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 50
    assert all(reached[0].get(i, i) == reached[0].get(j, j) for i, j in pairs)
