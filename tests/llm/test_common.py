import os

import pytest

from momentrank.llm import common


def by_hand(edges):
    root = {n: n for e in edges for n in e}
    while True:
        low = dict(root)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == root:
            return root
        root = low


@pytest.mark.parametrize("hub", [256, 3])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    edges = [(50, i) for i in range(100, 130)] + [(i, 90) for i in range(60, 80)] + [(3, 50), (90, 129), (1, 2), (8, 8)]
    edges += [(200 + i, 201 + i) for i in range(20)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == by_hand([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_run_folder_is_removed(spark):
    with common.run_folder(spark) as path:
        df = common.stored(spark.range(3), "x")
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
    assert common.stored(spark.range(3), "x").count() == 3


class Far:
    """A session on a cluster without a shared folder."""

    class sparkContext:
        master = "spark://host:7077"

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_no_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_path(Far, "x")
