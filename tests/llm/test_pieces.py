import random
import tracemalloc

import pytest
import sentencepiece

from momentrank.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


ODD = [None, "", " ", "  a  b\n\nc d ", "\t", "a" * 3000, "ha ha haha " * 20, "<s>hi</s> <0x0A>", "你好　x", "ﬁ é", "\x00\x01", "😀👩‍👩‍👧", " lead", "trail ",
       "x" + " " * 40 + "y", "\n \n  \n", "Ünïcödé ßtraße", "0123456789" * 9, "don't stop-it...!!! ???"]


def test_ids_equal_the_library(library):
    rng = random.Random(5)
    letters = "etaoinshrdlu  ETA.,\n\té中ñ-'0"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    codec = pieces.Codec(pieces.read_model(pieces.MODEL))
    ends, ids = codec.encode(texts)
    for t, a, z in zip(texts, ends, ends[1:]):
        assert ids[a:z].tolist() == library.encode(t or "")
        assert codec.decode(ids[a:z].tolist()) == (t or "")


def test_a_very_long_word(library):
    """Memory is a state a letter, and what was coded is not kept."""
    rng = random.Random(9)
    long = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(200_000))
    codec = pieces.Codec(pieces.read_model(pieces.MODEL))
    tracemalloc.start()
    ends, ids = codec.encode([long, long[:5000] + " a"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids[: ends[1]].tolist() == library.encode(long) and ids[ends[1] :].tolist() == library.encode(long[:5000] + " a")
    assert peak < 40 << 20 and all(len(w) <= pieces.LONG for w in codec.known)


def test_documents_equal_the_library(spark, library, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    rows = pieces.encoded(docs.selectExpr("*", "1 AS ids"))
    back = pieces.decoded(rows.drop("text")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(back) == 40 and all(r.text == texts[r.doc_id] and r.ids == library.encode(r.text) for r in back)


def test_query_columns_nulls_repeats_and_empty(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "b " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.coded(df).collect()
    assert len(got) == 5 and all(r.exact for r in got)
    assert [r.n_ids for r in got if r.doc_id in (1, 2)] == [0, 0, 0]
    assert pieces.coded(df.where("false")).count() == 0 and pieces.encoded(df.where("false")).count() == 0


def test_unigram_scores_are_viterbi():
    codec = pieces.Codec(pieces.read_model(pieces.MODEL), "unigram")
    pieces_ = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -2.2, "ba": -1.0, "aba": -3.6}
    codec.pieces, codec.scores, codec.names = {p: i for i, p in enumerate(pieces_)}, pieces_, list(pieces_)

    def best(w):
        if not w:
            return 0.0
        return max(pieces_[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces_)

    words = ["▁" + "".join(random.Random(i).choice("ab") for _ in range(i % 9)) for i in range(60)]
    codec.known = {}
    codec.learn(set(words))
    names = list(pieces_)
    for w in words:
        ids = codec.known[w]
        assert "".join(names[i] for i in ids) == w
        assert sum(pieces_[names[i]] for i in ids) == pytest.approx(best(w))
