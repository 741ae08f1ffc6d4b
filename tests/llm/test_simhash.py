from itertools import combinations

import numpy as np
import xxhash

from momentrank.llm import simhash
from momentrank.llm.hnsw import smallest


def brute(rows, threshold=3, wide=None):
    """component_id by comparing all pairs."""
    prints = [slow_print(t) for _, t in rows]
    others = [slow_wide(t) for _, t in rows] if wide is not None else None
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold and (wide is None or (others[i] ^ others[j]).bit_count() <= wide):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return prints, [least.get(find(i)) for i in range(len(rows))]


def slow_wide(text):
    """256 bits of shingles of five words, hash by hash."""
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([b" ".join(w)] if w else [])
    out = 0
    for k in range(4):
        h = []
        for x in s:
            z = (xxhash.xxh64(x, seed=42).intdigest() + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
            h.append(z ^ z >> 31)
        out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) << 64 * k
    return out


def slow_print(text, shingle=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_anchors_cover():
    rng = np.random.default_rng(1)
    for checks, radius in ((4, 2), (5, 2), (4, 3)):
        bits = 1 << checks
        x = rng.integers(0, 1 << bits, 100, dtype=np.uint64)
        rows, found = simhash.anchors(x, checks, radius)
        assert np.all(np.bitwise_count(x[rows] ^ found) <= radius)
        at = [set(found[rows == i].tolist()) for i in range(len(x))]
        for places in combinations(range(bits), radius - 1):  # whatever differs in so many bits shares an anchor
            r2, f2 = simhash.anchors(x ^ np.uint64(sum(1 << b for b in places)), checks, radius)
            near = [set() for _ in x]
            for i, f in zip(r2.tolist(), f2.tolist()):
                near[i].add(f)
            assert all(a & b for a, b in zip(at, near))


def test_links_join_what_is_connected():
    rng = np.random.default_rng(2)
    for threshold in (3, 7):
        fp = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        for i in range(450, 900):
            fp[i] = fp[rng.integers(0, i)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 12), replace=False)))
        near = np.bitwise_count(fp[:, None] ^ fp) <= threshold
        i, j = simhash.linked(fp, threshold)
        assert near[i, j].all()
        assert (smallest(i, j, len(fp)) == smallest(*np.nonzero(near), len(fp))).all()


def check(spark, rows, bucket, threshold=3, wide=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # fp: a clashing extra column
    got = sorted(map(tuple, simhash.near_duplicates(df, threshold=threshold, words_=4 if wide is not None else 0, wide=wide, bucket=bucket).collect()), key=str)
    prints, comp = brute([(r[0], r[1]) for r in rows], threshold, wide)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert got == sorted(((r[0], f, c) for r, f, c in zip(rows, signed, comp)), key=str)
    return got


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocab, 300)), "x") for i in range(40)]
    for i in range(40, 160):  # chains of edits
        w = rows[int(rng.integers(0, i))][1].split()
        for _ in range(int(rng.integers(1, 3))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
        rows.append((i, " ".join(w), "x"))
    rows += [(200, None, "x"), (201, "", "x"), (202, " \t\n", None), (203, "One two", "x"), (204, "one  TWO", "x")]
    rows += [(200, None, "x"), (None, "one two", "x"), (None, "alone here é", "x"), (300, "a b c", "x")]
    got = check(spark, rows, simhash.BUCKET)
    assert check(spark, rows, 2) == got  # every anchor split
    wide = check(spark, rows, simhash.BUCKET, simhash.NEAR, simhash.WIDE)
    assert check(spark, rows, 2, simhash.NEAR, simhash.WIDE) == wide
    assert len({r[2] for r in wide}) < len({r[2] for r in got})
    assert len({r[2] for r in check(spark, rows, simhash.BUCKET, simhash.NEAR, 0)}) > len({r[2] for r in wide})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.deduplicated(df).count() == 0


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d", "u"), (3, "a b c d", "v"), (3, "a b c d", "v"), (9, "other words stand here", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == [3, 9]


def test_deduplicated_keeps_texts_that_share_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5]), (None, texts[5]), (7, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])], key=str)
    for parts in (1, 4):
        assert sorted(map(tuple, simhash.deduplicated(df.repartition(parts)).collect()), key=str) == want


def test_ids_keep_their_type(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "x"), ("c", "long " * 300_000)], "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == {"a": "a", "b": "a", None: None, "c": "c"}
    assert sorted((r.doc_id for r in simhash.deduplicated(df).collect()), key=str) == [None, "a", "c"]
