import math

import numpy as np
import pytest

from momentrank.llm import toxicity


def made(n=400, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(300)]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocab, int(rng.integers(5, 80))))
        bad = i % 6 == 0
        for _ in range(int(rng.integers(1, 9)) if bad else 0):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["Nasty", "vile,", "rottenest", "rottenly"])))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_order_of_severity():
    rows = made()
    m = toxicity.fit([r[1] for r in rows[:200]], [r[2] for r in rows[:200]])
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 2
    found = [m.severity(t) >= toxicity.REJECT for _, t, _ in rows[200:]]
    truth = [bool(x) for *_, x in rows[200:]]
    assert sum(a != b for a, b in zip(found, truth)) <= 3
    assert m.severity("nasty") < m.severity("nasty vile") < m.severity("nasty vile vile rottenmost nasty") <= 2


def test_query_rows_nulls_and_clashing_columns(spark):
    rows = [(*r[:2], "s") for r in made(200)] + [(900, None, None), (901, "", "s"), (None, "nasty vile nasty", "s"), (0, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in made(200)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    got = docs.select("doc_id", "text", toxicity.severity(spark, model).alias("x")).collect()
    assert len(got) == len(rows)
    clean = model.severity("")
    assert all(r.x == clean for r in got if not r.text) and clean < toxicity.REJECT
    kept = toxicity.tolerable(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 0 and kept.where("doc_id >= 900").count() == 2


def test_no_labels_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.tolerable(docs, none).count() == 1
    assert toxicity.tolerable(docs.where("false"), none).count() == 0


def loss(weights, thresholds, rows, decay=2e-4):
    """Penalised mean of -log P(grade), row by row, as the model is defined."""
    out = 0.0
    for found, grade in rows:
        z = sum(weights[f] * (1 + math.log(c)) for f, c in found.items() if f in weights)
        over = [1.0] + [1 / (1 + math.exp(t - z)) for t in thresholds] + [0.0]
        out -= math.log(max(over[grade] - over[grade + 1], 1e-12))
    return out / len(rows) + decay / 2 * sum(w * w for w in weights.values())


def test_fit_is_at_the_minimum_of_the_loss():
    rows = made(240)
    texts, flags = [r[1] for r in rows], [r[2] for r in rows]
    m = toxicity.fit(texts, flags, rounds=3000)
    kept, marks = toxicity.telling(texts, flags)
    bags = [{f: c for f, c in toxicity.counts(t).items() if f in m.weights} for t in texts]
    hits = [sum(c for f, c in b.items() if f in marks) for b in bags]
    middle = np.median([h for h, t in zip(hits, flags) if t and h])
    graded = [(b, 1 + int(h > middle) if t else 0) for b, h, t in zip(bags, hits, flags)]
    least = loss(m.weights, m.thresholds, graded)
    for f in list(m.weights)[:12]:
        for step in (-0.05, 0.05):
            assert loss({**m.weights, f: m.weights[f] + step}, m.thresholds, graded) > least - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            moved = [t + step * (i == k) for i, t in enumerate(m.thresholds)]
            assert loss(m.weights, moved, graded) > least - 1e-6


def test_severity_is_the_expected_grade():
    m = toxicity.Model({"nasty": 2.0, "nasty-": 0.5, "vile": 1.0}, [1.0, 3.0])
    for text in (None, "", "nasty", "Nasty, nastyish vile vile", "fine words"):
        found = toxicity.counts(text)
        z = sum(w * (1 + math.log(found[f])) for f, w in m.weights.items() if found[f])
        assert m.severity(text) == pytest.approx(sum(1 / (1 + math.exp(t - z)) for t in m.thresholds))
    assert m.severity("nasty " * 2_000_000) <= 2  # a very long text, whole


def test_the_severity_is_chosen_between_the_classes():
    low, high = np.linspace(0.001, 0.01, 50), np.linspace(0.4, 2, 50)
    toxic = np.r_[np.zeros(50, bool), np.ones(50, bool)]
    assert 0.01 < toxicity.rejecting(np.r_[low, high], toxic) < 0.4
    assert toxicity.rejecting(np.r_[low, high], np.zeros(100, bool)) == toxicity.REJECT
    even = np.full(100, 0.5)  # ties of both classes: nothing that is clean may go
    assert toxicity.rejecting(even, toxic) > 0.5


def test_the_sample_has_a_row_an_id_and_bounded_texts(spark):
    rows = [(1, f"text {i}", "x") for i in range(50)] + [(2, "y" * 30_000, "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "toxic", 10, toxicity.LONGEST).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
    assert [r.doc_id for r in toxicity.labelled(docs, labels, "toxic", 10).collect() if r.text and len(r.text) > 20_000] == [2]
    assert toxicity.tolerable(docs, labels).columns == docs.columns


def test_all_labelled_documents_are_fitted(spark):
    """The model of Spark's passes is that of the rows in hand, for more documents than a sample of 6,000, and for very long ones."""
    rows = made(300) + [(1000 + i, f"plain text {i % 7}", 0) for i in range(6500)]
    rows += [(9000 + i, "far " * 6000 + "awful", 1) for i in range(12)]  # the only ones with this word, each of 24,005 characters
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = toxicity.trained(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    want = toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    assert "awful" in got.weights and got.weights == pytest.approx(want.weights, abs=0.02) and got.thresholds == pytest.approx(want.thresholds, abs=0.02)
    assert got.severity(rows[-1][1]) > got.reject > got.severity("plain text 3")


def test_the_severity_is_chosen_from_counts(spark):
    rng = np.random.default_rng(4)
    rows = [([0], [int(rng.integers(1, 200)) if i % 3 else 1], bool(i % 3 == 0) ^ bool(rng.random() < 0.2), True, int(rng.integers(1, 4))) for i in range(400)]
    bags = spark.createDataFrame(rows, "at array<int>, n_at array<int>, toxic boolean, held boolean, n long")
    x = np.array([-0.7, 1.0, 0.2])
    model = toxicity.Model({"w": -0.7}, toxicity.ordered(x).tolist())
    flat = [(model.severity("w " * r[1][0]), r[2]) for r in rows for _ in range(r[4])]
    want = toxicity.rejecting(np.array([s for s, _ in flat]), np.array([t for _, t in flat]))
    assert toxicity.chosen(bags, np.array([0]), x) == pytest.approx(want)


def test_tokens_are_the_patterns():
    rng = np.random.default_rng(5)
    signs = list("aZbY _-9'.\n\t\x1c\x85\xa0é ßİK²½٣’　中ñǅ́ª")
    for _ in range(3000):
        text = "".join(rng.choice(signs[: int(rng.integers(3, len(signs)))], int(rng.integers(0, 14))))
        assert toxicity.tokens(text) == toxicity.TOKEN.findall(text.lower())
    assert toxicity.tokens("a\ud800b c") == ["a", "b", "c"] and toxicity.tokens(None) == []
    at = {f: i for i, f in enumerate(["nasty", "nasty-", "rottene-", "été", "of", "vilest"])}
    text = "Nasty, nastyish of OFF rottenest rottenly été étés vilest vile " * 3
    assert toxicity.Finder(at).counts(text) == {at[f]: n for f, n in toxicity.counts(text).items() if f in at}


def test_texts_without_a_label_do_not_move(spark):
    rows = [(i, f"text {i}") for i in range(20_000)] + [(3, "again"), (3, "again"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 20_000, 100)] + [(3, 1), (3, 0), (None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")
    ids = {*range(0, 20_000, 100), 3}
    for kind in ("long", "string"):
        d, own = (x.withColumn("doc_id", x.doc_id.cast(kind)) for x in (docs, labels))
        some = toxicity.likely(d, own.where("doc_id is not null")).collect()
        assert {str(i) for i in ids} <= {str(r.doc_id) for r in some} and sum(str(r.doc_id) == "3" for r in some) == 3
        assert len(some) < len(rows) / 8  # all 20,003 were shuffled by id before
    for d in (docs, docs.withColumn("doc_id", docs.doc_id.cast("int")), docs.withColumn("doc_id", docs.doc_id.cast("double"))):
        got = toxicity.labelled(d, labels, "toxic").collect()
        assert sorted(int(r.doc_id) for r in got) == sorted(ids)
        assert all(r.label == (1 if r.doc_id == 3 else int(r.doc_id) % 2) and r.text in ("again", f"text {int(r.doc_id)}") for r in got)
    few = toxicity.likely(docs.withColumn("doc_id", docs.doc_id.cast("int")), labels)
    assert few.count() == len(rows)  # hashes of two types differ, so the join alone decides
    assert toxicity.labelled(docs, labels.where("false"), "toxic").count() == 0


def test_fits_share_their_passes():
    rng = np.random.default_rng(6)

    def made_bags(n):
        grade = rng.integers(0, 3, n)
        return toxicity.Bags(np.arange(n), rng.integers(0, 5, n), 1 + np.log(rng.integers(1, 5, n)), grade, np.ones(n))

    bags, calls = [made_bags(80), made_bags(300)], []

    def sums(at):
        calls.append(len(at))
        return {i: bags[i].slope(x) for i, x in at.items()}

    fits = [lambda: toxicity.steps(80, 5, 300, 2e-4), lambda: toxicity.steps(300, 5, 300, 0.1)]
    both = toxicity.descend(sums, [f() for f in fits])
    together, alone = len(calls), []
    for i, f in enumerate(fits):
        calls.clear()
        [x] = toxicity.descend(lambda at: {0: sums({i: at[0]})[i]}, [f()])
        alone.append(len(calls))
        assert (x == both[i]).all()
    assert together == max(alone)


def test_blocks_hold_all_rows(spark, monkeypatch):
    """Packed rows have the sums of all, whatever a block holds; documents with more entries than a block, or none, too."""
    rows = [(list(range(i % 7)), [1 + i % 3] * (i % 7), i % 4 == 0, i % 3 == 0, 1 + i % 2) for i in range(200)]
    bags = spark.createDataFrame(rows, "at array<int>, n_at array<int>, toxic boolean, held boolean, n long")
    place, mark = np.array([2, -1, 0, 1, 3, 4]), np.array([True, False, True, False, False, False])
    x = np.linspace(-0.5, 1, 7)
    found = []
    for block in (4, 250_000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        blocks = toxicity.packed(bags, place, mark).collect()
        each = [[np.frombuffer(c, kind) for c, kind in zip(r, ("<i4", "<i4", "<f8", "<i1", "<f8"))] for r in blocks]
        found.append((len(blocks), sum(toxicity.Bags(*b).slope(x) for b in each)))
        assert sum(b[4].sum() for b in each) == 300 and sum(len(b[0]) for b in each) == sum(i != 1 for r in rows for i in r[0])
    assert found[0][0] > 50 > found[1][0] and found[0][1] == pytest.approx(found[1][1])
