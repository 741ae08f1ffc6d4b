import numpy as np
import pytest

from momentrank.llm import hnsw


def made(n=900, d=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    for i in range(n // 3, n // 2):  # pairs and chains
        x[i] = x[int(rng.integers(0, i))] + 0.25 * rng.standard_normal(d)
    x[n // 2 : n // 2 + 150] = x[0] + 0.1 * rng.standard_normal((150, d))  # a dense group
    x[-60:] = x[1]  # copies
    x[-5:] *= 3.0  # the same direction
    return [(i, x[i].tolist(), int(rng.integers(0, 3)) if i % 2 else 0, "z") for i in range(n)]


def brute(rows, threshold=0.93):
    ok = [i for i, (d, v, lab, _) in enumerate(rows) if d is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for size, lab in {(len(rows[i][1]), rows[i][2]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == size and rows[i][2] == lab]
        x = np.array([rows[i][1] for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            i, j = own[a], own[b]
            links[i] += 1
            links[j] += 1
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("shard", [hnsw.SHARD, 100])
def test_matches_brute_force(spark, shard):
    rows = made()
    rows += [(9000, None, 0, ""), (9001, [], 0, ""), (9002, [0.0] * 32, 0, ""), (9003, [float("nan")] * 32, 0, ""), (9004, [None] * 32, 0, ""),
             (9005, [float("inf")] + [1.0] * 31, 0, ""), (9006, rows[1][1], None, ""), (None, rows[1][1], rows[1][2], ""), (9008, [1.0, 2.0], 0, ""),
             (9009, [2.0, 4.0], 0, ""), (5, rows[5][1], rows[5][2], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, mult string")
    got = {}
    for r in hnsw.near_duplicates(df, shard=shard).collect():
        got.setdefault(r.vec_id, []).append(tuple(r))
    want = {}
    for r in brute(rows):
        want.setdefault(r[0], []).append(r)
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) for k in got)
    true, off = sum(r[1] for w in want.values() for r in w), 0
    same = sum(sorted(got[k], key=str) == sorted(want[k], key=str) for k in got)
    for k in got:
        off += abs(sum(r[1] for r in got[k]) - sum(r[1] for r in want[k]))
    assert off <= 0.02 * true and same >= 0.98 * len(want)


def test_rows_that_share_an_id(spark):
    """Two vectors with one id are two rows: they link with each other, or each with its own label's."""
    a, b, c = [1.0, 0.0, 0.02], [1.0, 0.02, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a, 0), (5, b, 0), (1, a, 1), (1, c, 0), (2, a, 1), (1, c, 2), (3, a, 2), (7, c, 3), (7, c, 3)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(5, 1, 5, True), (5, 1, 5, True), (1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (1, 0, 1, True), (3, 0, 3, True), (7, 1, 7, True), (7, 1, 7, True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hnsw.near_duplicates(df).count() == 0


def test_audit_widens_a_beam_that_misses():
    x = hnsw.unit(np.random.default_rng(0).standard_normal((600, 16)))
    g = hnsw.Graph(x)
    assert g.audited(0.93) == hnsw.BEAM
    for links in g.links:
        links[:, 2:] = -1  # a broken graph
    assert g.audited(0.93) > hnsw.BEAM


def test_more_links_than_the_beam_is_wide():
    rng = np.random.default_rng(4)
    d, n = 32, 100
    a, b = np.eye(d)[0], 0.95 * np.eye(d)[0] + np.sqrt(1 - 0.95**2) * np.eye(d)[1]
    x = hnsw.unit(np.concatenate([np.repeat([a], n, 0), np.repeat([b], n, 0)]) + 0.005 * rng.standard_normal((2 * n, d)))
    x = np.concatenate([x, hnsw.unit(rng.standard_normal((400, d)))])
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert (want[: 2 * n] == 2 * n - 1).all()  # each group links with all of the other
    ids = np.arange(len(x)) * 7 + 3
    node, links, root = hnsw.compared(hnsw.Graph(x), hnsw.BEAM, ids, np.ones(len(x), np.int64), x, ids, x, 0.93)
    got, least = dict.fromkeys(ids.tolist(), 0), {}
    for i, k, r in zip(node.tolist(), links.tolist(), root.tolist()):
        got[i] += k
        least[i] = r
    assert list(got.values()) == want.tolist()
    assert {least[i] for i in ids[: 2 * n].tolist()} == {3}


@pytest.mark.parametrize("kind,labels", [("double", (1.2, 1.7, 1.2)), ("string", ("a", "b", "a")), ("decimal(3,1)", ("1.2", "1.7", "1.2")), ("array<int>", ([1], [2], [1]))])
def test_labels_and_ids_of_other_types(spark, kind, labels):
    """Labels that differ don't link, whatever their type; ids keep theirs."""
    rows = [(f"v{i}", [1.0, 0.01 * i], lab if "decimal" not in kind else None, lab if isinstance(lab, str) else None) for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, f"vec_id string, embedding array<double>, label {kind}, told string")
    if "decimal" in kind:
        df = df.withColumn("label", df.told.cast(kind))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    assert got == {"v0": (1, "v0", True), "v1": (0, "v1", True), "v2": (1, "v0", False)}


def test_zeros_of_both_signs_are_one_label(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [1.0, 0.0], -0.0)], "vec_id int, embedding array<double>, label double")
    assert [r.n_links for r in hnsw.near_duplicates(df).collect()] == [1, 1]
