from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from momentrank.llm import merkle

from .oracle import same


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def shaped(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        run = at - at % 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def expected(rows):
    """Proofs of ``(doc_id, source, lang, n_chars, text)`` rows, by loops."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = shaped([leaf(r) for r in by[s]])
    top = shaped([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            told = r[-1]
            if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and told is not None:
                told = told.replace("\n", "")
            node, path = leaf((*r[:-1], told)), []
            for a, b in [*siblings(trees[s], i), *siblings(top, k)]:
                path += a + b
                node = h(*a, node, *b)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*path), node, node == root))
    return sorted(out, key=str)


ODD = [(i, f"s{i % 3}", "en", i, f"text {i}\nmore é") for i in range(40)]
ODD += [(None, None, None, None, None), (7, "s0", None, 3, "x\n" * 20_000), (7, "s0", None, 3, "x\n" * 20_000), (8, "s0", "", 0, ""), (8, "s0", "de", 0, "")]
ODD += [(100, "", "en", 1, "a"), (101, "alone", "en", 1, "b\n"), (None, "s1", "en", 2, None)]


def query(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumns({"leaf": F.lit("x"), "rank": F.lit(1), "known": F.lit(False)}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op13_merkle(spark, str(folder)).collect()), key=str)


def test_matches_sql(spark, sf):
    same(spark, merkle.op13_merkle, merkle.OP13_SQL, sf)


@pytest.mark.parametrize("generations", [1, 6])
def test_odd_rows_match_loops(spark, tmp_path, monkeypatch, generations):
    """One generation a page makes descents of several steps."""
    monkeypatch.setattr(merkle, "GENERATIONS", generations)
    monkeypatch.setattr(merkle, "PAGE", 3**generations)
    got = query(spark, ODD, tmp_path)
    assert got == expected(ODD)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    one = [(5, "a", "en", 1, "t")]
    got = query(spark, one, tmp_path / "one")
    assert got == expected(one) and got[0][1] == got[0][3] and got[0][4] == h("")
    assert query(spark, [], tmp_path / "none") == []


def test_ids_and_groups_of_other_types(spark):
    rows = [(f"id{i}", i % 2, str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, part int, text string")
    own = merkle.leaf(F.col("id"), F.col("text"))
    got = merkle.proofs(df, "id", "part", own, own).collect()
    assert {r.id for r in got} == {r[0] for r in rows} and all(r.folded == r.root for r in got)
