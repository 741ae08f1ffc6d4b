import math
from collections import Counter

import numpy as np
import pytest

from momentrank.llm import quality


def slow(texts, order):
    """Textbook model over dictionaries; gives log10 of a word."""
    raw = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        for w in quality.split(t):
            s = quality.START + w + quality.STOP
            for k in raw:
                raw[k].update(s[i : i + k] for i in range(len(s) - k + 1))
    a = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in raw[k + 1])
        a[k] = Counter({g: (raw[k][g] if g[0] == quality.START else left[g]) for g in raw[k] if not (k == 1 and g == quality.START)})
    d = {}
    for k in a:
        n = [max(sum(1 for c in a[k].values() if c == i), 1) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(h, c):
        k = len(h) + 1
        own = {g: x for g, x in a[k].items() if g[:-1] == h}
        low = p(h[1:], c) if k > 1 else 1 / (len(a[1]) + 1)
        if not own:
            return low
        total, off = sum(own.values()), lambda x: d[k][min(x, 3) - 1]
        x = own.get(h + c, 0)
        return (x - off(x) if x else 0) / total + sum(map(off, own.values())) / total * low

    def word(w):
        s = quality.START + w + quality.STOP
        return sum(math.log10(p(s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s)))

    return word, p, a


TEXTS = ["the cat sat on the mat", "a cat ate the rat", "tha that hat, the Tat", "éclat à la carte", "aaaa aaa aa a"]


def test_scores_are_the_textbook_ones_both_ways(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    word, p, a = slow(TEXTS, 3)
    assert sum(p("th", c) for c in a[1]) + p("th", "一") == pytest.approx(1)
    table = quality.model(df, 3)
    docs = [(1, "the cat"), (2, "zzz unk q一 the the"), (3, None), (4, " \n"), (5, "thethat\x0bhat"), (6, "a" * 500)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", quality.score(spark, table, "text", 3).alias("s")).collect()}
    joined = {r.id: r for r in quality.score_by_join(rows, table, order=3).collect()}
    for d, t in docs:
        w = quality.split(t)
        assert got[d].log == pytest.approx(sum(map(word, w))) and got[d].chars == sum(len(x) + 1 for x in w)
        if w:
            assert joined[d].log == pytest.approx(got[d].log) and joined[d].chars == got[d].chars
        else:
            assert d not in joined


def test_scores_agree_on_a_large_alphabet(spark):
    """3,000 characters that differ in probability; far beyond what a few bits a character could hold."""
    rng = np.random.default_rng(8)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    share = 1.0 / np.arange(1, 3001)
    texts = [" ".join("".join(rng.choice(letters, 6, p=share / share.sum())) for _ in range(100)) for _ in range(30)] + ["".join(letters)]
    table = quality.model(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = spark.createDataFrame([(i, t[:400]) for i, t in enumerate(texts)] + [(99, letters[0] + letters[2999] + "\U0001f600 ab")], "doc_id long, text string")
    got = {r.doc_id: r.s.log for r in docs.select("doc_id", quality.score(spark, table).alias("s")).collect()}
    joined = {r.id: r.log for r in quality.score_by_join(docs, table).collect()}
    assert got == pytest.approx(joined) and len(set(got.values())) == len(got)
    single = spark.createDataFrame([(i, c) for i, c in enumerate(letters)], "doc_id long, text string")
    assert len({r.s.log for r in single.select(quality.score(spark, table).alias("s")).collect()}) > 100


def test_too_many_ngrams_are_joined(spark):
    rows = [(1, "the cat", "en"), (1, "the hat", "en"), (None, None, "en"), (2, "", None), (3, "the cat", "fr"), (3, "the cat", "fr"), (4, "mat " * 40, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score_one", "2 AS id")
    table = quality.model(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    held = sorted(quality.scored(docs, table, "score").collect(), key=str)
    joined = sorted(quality.scored(docs, table, "score", most=0).collect(), key=str)
    assert len(held) == len(joined) == len(rows) and held[0].asDict().keys() == joined[0].asDict().keys()
    for a, b in zip(held, joined):
        assert a[:-1] == b[:-1] and a.score[1:] == b.score[1:] and a.score.log == pytest.approx(b.score.log)


@pytest.mark.parametrize("enough", [quality.ENOUGH, 20])
def test_fences_and_verdicts_by_hand(spark, enough):
    rng = np.random.default_rng(3)
    rows = [(i, ["en", "fr", None, "xx"][min(i % 16, 3) if i % 16 < 4 else 0], -float(rng.integers(50, 300)), int(rng.integers(50, 200)), 30, int(i % 9 == 0)) for i in range(400)]
    rows += [(7, "fr", -80.0, 90, 20, 0), (None, "en", -80.0, 90, 20, 0), (900, "en", 0.0, 0, 0, 0), (901, "zz", 0.0, 0, 0, 0), (902, "en", -900.0, 100, 20, 0)]
    good, ids = set(range(0, 400, 2)) | {7}, set(range(0, 100, 2))
    frame = lambda x: spark.createDataFrame([(i,) for i in sorted(x)], "doc_id long")
    found = spark.createDataFrame(rows, "doc_id long, lang string, log double, chars long, words long, again long")
    got = quality.judged(found, quality.fences(found, frame(ids), frame(good), enough=enough, least=10)).collect()

    def bits(r, share, prior, middle):
        rep = r[5] * math.log10(share) + (max(r[4] - 1, 0) - r[5]) * math.log10(1 - share)
        return (prior * middle - r[2] - rep) / (prior + r[3])

    def share(x):
        return (sum(r[5] for r in x) + 0.5) / (sum(r[4] - 1 for r in x) + 1)

    def quantile(x, q):
        x = list(x)
        return sorted(x)[max(math.ceil(q * len(x)) - 1, 0)]

    some = [r for r in rows if r[0] in good and r[0] not in ids and r[3]]
    all_share = share(some)
    every = (all_share, quantile([bits(r, all_share, 0, 0) for r in some], 0.5))
    own = {}
    for lang in {r[1] for r in some}:
        x = [r for r in some if r[1] == lang]
        if len(x) >= 10:
            own[lang] = (share(x), quantile([bits(r, share(x), 0, 0) for r in x], 0.5))
    far = lambda r: bits(r, own.get(r[1], every)[0], quality.PRIOR, own.get(r[1], every)[1]) - own.get(r[1], every)[1]

    def distance(x):
        x = sorted(x)
        if len(x) >= 1 / (1 - quality.LEVEL):
            return quantile(x, quality.LEVEL)
        rank = 2 if len(x) >= 100 else 1
        end = max([y for y in x if y < x[-1]], default=x[-1]) if rank == 2 else x[-1]
        return end * max(1, math.log(1 / (1 - quality.LEVEL)) / math.log(max(len(x) / rank, 2)))

    for r in got:
        s, m = own.get(r.lang, every)
        x = [far(y) for y in some if y[1] == r.lang]
        fence = m + distance(x if len(x) >= enough else map(far, some))
        value = bits((r.doc_id, r.lang, r.log, r.chars, r.words, r.again), s, quality.PRIOR, m)
        assert r.fence == pytest.approx(10**fence) and r.perplexity == pytest.approx(10**value)
        assert r.poor == (value > fence + 1e-9)
    assert any(r.poor for r in got) and not any(r.poor for r in got if not r.chars)


def test_junk_goes_and_clean_stays(spark):
    rng = np.random.default_rng(5)
    syllables = ["the", "an", "er", "ing", "tion", "re", "st"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    clean = [" ".join(word() for _ in range(int(rng.integers(3, 120)))) for _ in range(300)]
    junk = [" ".join(word().upper() + "%%%" for _ in range(40)) for _ in range(20)]
    rows = [(i, t, None if i % 7 == 0 else "en", "k") for i, t in enumerate(clean + junk)]
    rows += [(400, None, "en", "k"), (401, "", "xx", "k"), (None, clean[0], "en", "k"), (3, clean[3], "en", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, log string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(300, 0), (None, 1), (7, None)], "doc_id long, quality int")
    kept = quality.trusted(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not set(range(300, 320)) & set(ids)
    assert len(ids) >= len(rows) - 20 - 3 and {400, 401, None} <= set(ids)


def test_words_said_over_and_over_go(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.trusted(docs, labels).select("doc_id").collect()}
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    again = lambda w: sum(map(str.__eq__, w, w[1:])) > 0.3 * len(w)
    bad = {r.doc_id: again(quality.split(r.text)) for r in rows if r.quality == 0}
    good = {r.doc_id for r in rows if r.quality == 1}
    loops = {d for d, x in bad.items() if x}
    assert len(loops) >= 5 and len(loops - kept) >= 0.9 * len(loops)
    assert len(bad.keys() - kept) >= 0.95 * len(bad) and len(good & kept) >= 0.98 * len(good)


def test_repeats_are_counted_both_ways(spark):
    table = quality.model(spark.createDataFrame([(t,) for t in TEXTS], "text string"), 3)
    docs = [(1, "the the  the\ncat cat", 5, 3), (2, "cat", 1, 0), (3, " the cat the ", 3, 0)]
    rows = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {r.doc_id: r.s for r in rows.select("doc_id", quality.score(spark, table, "text", 3).alias("s")).collect()}
    joined = {r.id: r for r in quality.score_by_join(rows, table, order=3).collect()}
    for d, _, size, again in docs:
        assert (got[d].words, got[d].again) == (joined[d].words, joined[d].again) == (size, again)


def test_without_trusted_text_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.trusted(docs, none).count() == 1
    assert quality.trusted(docs.where("false"), none).count() == 0


def test_all_trusted_text_plays_a_part(spark):
    """Each of 6,000 trusted documents has a word of its own; each is in the model, or one of those that tell the fences."""
    n = 6000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', lpad(cast(id AS string), 4, '0')) AS text", "'en' AS lang")
    table, ids, good = quality.taught(docs, docs.selectExpr("doc_id", "1 AS quality"))
    trained = {r.doc_id for r in ids.collect()}
    assert good.count() == n and 0.6 * n < len(trained) < 0.72 * n
    starts = {r.gram[1:] for r in table.where("k = 5 and p is not null").collect() if r.gram[0] == quality.START}
    assert starts == {f"w{i:04}"[:4] for i in trained}
    ends = {r.gram[:-1] for r in table.where("k = 5 and p is not null").collect() if r.gram[-1] == quality.STOP}
    assert ends == {f"{i:04}" for i in trained}
