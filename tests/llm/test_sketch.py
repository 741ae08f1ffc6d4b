import hashlib

import numpy as np
import pytest
import xxhash

from momentrank.llm import sketch


def texts():
    rng = np.random.default_rng(6)
    vocab = [f"é{i}" if i % 9 == 0 else f"w{i}" for i in range(500)]
    return [" ".join(rng.choice(vocab, int(rng.integers(0, 400)))) for _ in range(90)]


def plain(t):
    """Digest and retained hashes, from the text's shingles one by one."""
    w = (t or "").encode().lower().split()
    grams = {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())
    every = {xxhash.xxh64_intdigest(g) for g in grams}
    return sum(every) % 2**64, {h >> 16 for h in every if (h >> 16) < 2**48 // 8}


def text_form(s):
    return f"{s[0]:016x}" + "".join(f"{h:012x}" for h in sorted(s[1]))


def like(a, b):
    return 1.0 if a[0] == b[0] else len(a[1] & b[1]) / max(len(a[1] | b[1]), 1)


def brute(rows):
    """All rows in order, each with the next one's text."""
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else sketch.LOWEST))
    out = []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = (plain(x) for x in (t, nxt, e))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text_form(a), text_form(c), like(a, c), like(a, b)))
    return out


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_matches_brute_force(spark, parts):
    rows = [(7 * i - 100, t) for i, t in enumerate(texts())] + [(9000, None), (9001, ""), (None, "null id"), (9100, "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = [tuple(r)[:7] for r in sketch.sketched(df).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_repeated_rows_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "a b c d e f g")] * 30 + [(4, "other words here")], "doc_id long, text string")
    got = sketch.sketched(df).collect()
    assert len(got) == 31 and sum(r.near_next == 1 for r in got) == 29
    one = sketch.sketched(df.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert sketch.sketched(df.where("false")).count() == 0


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_estimates_are_near_the_truth():
    words = " ".join(texts()).split()
    off, off_in = [], []
    for i in range(40):
        a, b = words[i * 100 : i * 100 + 2000], words[i * 100 + 37 * i : i * 100 + 37 * i + 900]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        p, q = sketch.sketch(" ".join(a)), sketch.sketch(" ".join(b))
        off.append(sketch.likeness(p, q) - len(x & y) / len(x | y))
        off_in.append(sketch.containment(q, p) - len(x & y) / len(y))
    assert np.abs(off).mean() < 0.03 and np.abs(off_in).mean() < 0.05


def test_union_of_sketches_is_sketch_of_union_and_text_form_round_trips():
    for n in (1, 2, 20):  # single texts too, of which many retain nothing
        for i in range(0, 80, 2 * n):
            a, b = texts()[i : i + n], texts()[i + n : i + 2 * n]
            p, q = ([sketch.sketch(t) for t in x] for x in (a, b))
            want = set().union(*(plain(t)[1] for t in a + b))
            assert set().union(*(s.hashes.tolist() for s in p + q)) == want
            assert set(sketch.merged(p[0], q[0])) == plain(a[0])[1] | plain(b[0])[1]
            back = sketch.parsed(sketch.fingerprint(p[0]))
            assert back.hashes.tolist() == p[0].hashes.tolist() and back.digest == p[0].digest == plain(a[0])[0]


def test_short_texts():
    short = [f"w{i} x y z end" for i in range(40)]
    long = sketch.sketch(" ".join(short))
    own = [sketch.sketch(t) for t in short]
    assert any(not len(s.hashes) for s in own)  # most of one shingle retain nothing
    for s in own:
        assert sketch.likeness(s, s) == 1.0 and sketch.containment(s, long) == float(len(s.hashes) > 0)
    assert sketch.likeness(own[0], own[1]) == 0.0
    assert sketch.likeness(sketch.sketch(None), sketch.sketch(" \n")) == 1.0 and sketch.likeness(sketch.sketch(""), own[0]) == 0.0
    assert sketch.likeness(sketch.sketch("A b"), sketch.sketch("a  b")) == 1.0


def test_a_very_long_text_and_one_id_for_all(spark):
    rows = [(None, f"t{i} " * 50) for i in range(60)] + [(None, "lorem " * 200_000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketch.sketched(df).collect()
    assert len(got) == 61 and max(r.n_chars for r in got) == 1_200_001
    assert len({r.fingerprint for r in got}) == 61


def test_other_ids_are_refused_by_name(spark):
    df = spark.createDataFrame([("a", "t")], "doc_id string, text string")
    try:
        sketch.sketched(df)
    except TypeError as e:
        assert "doc_id is string" in str(e)
    else:
        raise AssertionError("a string id was taken")
