import pytest

from momentrank.llm import mixing

from .oracle import same


def test_matches_sql(spark, sf):
    same(spark, mixing.op3_mixing, mixing.OP3_SQL, sf)


def test_targets_stop_at_twice_the_size_and_are_met(spark):
    rows = [(i, "w " * (1 + i % 7), None if i % 10 == 9 else "a" if i % 3 else "b") for i in range(300)]
    rows += [(1000, None, "c"), (1001, " \n", "c"), (None, "x y z", "d"), (7, "w w", "a"), (7, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target")
    got = mixing.mix(df, buckets=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        t = by.setdefault(r.source, [r.target, r.source_size, 0, 0])
        t[2] += r.taken
        t[3] += r["size"]
    assert sum(t[0] for t in by.values()) == pytest.approx(1.5 * sum(t[3] for t in by.values()))
    for target, size, taken, own in by.values():
        assert size == own and abs(taken - target) <= 1 and target <= 2 * size


def test_stream_is_sorted_cut_and_repeated(spark):
    rows = [(i, f"d{i} " + "x\ty  z " * 3, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'k' AS position")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got = mixing.mixed(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "position"}
    counts = {}
    for r in got:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert counts == {k: v for k, v in taken.items() if v}


def test_stream_of_repeated_and_missing_ids(spark):
    """Rows that share an id, or the whole row, are taken as ``mix`` says, whatever their other columns are called."""
    rows = [(1, "a b c d e", "s"), (1, "f g h i j", "s"), (None, "k l m", "s"), (None, "n o p", "t"), (2, "q r", "t"), (2, "q r", "t"), (2, "q r", "t"), (3, None, "s"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.selectExpr("*", "'x' AS mixed_position", "1 AS mixed_mark0", "map('a', 1) AS words", "2 AS pass", "3 AS cut")
    want = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got, texts = {}, set()
    stream = mixing.mixed(df)
    assert stream.columns == df.columns
    for r in stream.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        texts.add((r.doc_id, r.text.split()[0]))
    assert got == {k: v for k, v in want.items() if v}
    assert {(1, "a"), (1, "f")} & texts and {(None, "k"), (None, "n")} & texts


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w" * 3_000_000, "a"), (2, "x y " * 300_000, "a"), (3, "z", "b")], "doc_id long, text string, source string")
    want = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    got = {}
    for r in mixing.mixed(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
