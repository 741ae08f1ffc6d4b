from collections import Counter

import sentencepiece

import corpus_pipeline
from momentrank.llm import common, mixing, pieces, toxicity

from .test_bands import similar

INSULTS = {"trash", "clown", "scum", "idiot", "worthless", "pathetic", "moron", "loser", "disgusting", "stupid"}


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {"input": {r.doc_id: r for r in docs.collect()}}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = common.stored(stage(spark, docs, sf), name)
        assert kept.columns == docs.columns
        rows = kept.collect()
        seen[name] = {r.doc_id: r for r in rows}
        assert len(seen[name]) == len(rows)
        before = seen[names[names.index(name) - 1]] if names.index(name) else seen["input"]
        assert all(before[k] == r for k, r in seen[name].items())
        docs = kept
    toxic = lambda t: len(INSULTS & set(toxicity.TOKEN.findall(t.lower())))
    assert sum(toxic(r.text) >= 2 for r in seen["toxicity"].values()) <= 0.1 * sum(toxic(r.text) >= 2 for r in seen["input"].values())
    assert sum(toxic(r.text) == 0 for r in seen["toxicity"].values()) >= 0.95 * sum(toxic(r.text) == 0 for r in seen["input"].values())
    junk = lambda t: sum(m in t for m in ("%%%", "!!", "&&&")) > 0
    assert sum(junk(r.text) for r in seen["quality"].values()) <= 0.1 * sum(junk(r.text) for r in seen["toxicity"].values())
    assert sum(not junk(r.text) for r in seen["quality"].values()) >= 0.95 * sum(not junk(r.text) for r in seen["toxicity"].values())
    own = [(k, r.text) for k, r in sorted(seen["quality"].items())]
    assert set(seen["simhash_dedup"]) == set(similar(own))

    stream = common.stored(corpus_pipeline.mixed(spark, docs, sf), "mixing")
    assert stream.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = {}
    for r in stream.collect():
        assert seen["simhash_dedup"][r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {k: v for k, v in taken.items() if v}

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = corpus_pipeline.encoded(spark, stream, sf)
    want = sorted(sp.encode(r.text) for r in stream.limit(50).collect())
    got = [r.ids for r in out.collect()]
    assert len(got) == stream.count()
    assert all(w in got for w in want)
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id", "n_ids").collect()) == sorted(out.select("doc_id", "n_ids").collect())


def test_stages_with_odd_rows(spark, tmp_path):
    """Null, repeated and clashing ids, empty and very long texts, null languages and sources: no stage loses or repeats a document."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [r.text for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and toxic = 0").orderBy("doc_id").limit(40).collect()]
    rows = [(None, clean[0], "en", "a", 1), (None, clean[1], "en", "a", 1), (7, clean[2], None, None, 1), (7, clean[3], "fr", "b", 1), (7, clean[3], "fr", "b", 1)]
    rows += [(None, None, "en", "a", 0), (None, "", "en", None, 0), (8, None, None, "a", 0), (9, " ".join(clean) * 20, "en", "a", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(odd).selectExpr("*", "1 AS score", "2 AS mark", "'x' AS quality_score", "'y' AS position")
    given = Counter(map(tuple, both.collect()))

    def slow(rows):
        least = {}
        for r, c in zip(rows, brute_groups([r[1] for r in rows])):
            least.setdefault(c, []).append(r)
        return least

    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = common.stored(stage(spark, both, sf), name)
        assert kept.columns == both.columns
        own = Counter(map(tuple, kept.collect()))
        assert own <= given and all(own[r] in (0, given[r]) for r in given)  # equal rows share their fate
        texts = {(r[0], r[1]) for r in own}
        assert {(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (None, None), (8, None)} <= texts
    kept = common.stored(corpus_pipeline.near_duplicates(spark, both, sf), "kept")
    own = [tuple(r) for r in kept.collect()]
    groups = slow([tuple(r) for r in both.collect()])
    assert len(own) == len(groups) and Counter(own) <= given
    assert all(sum(r in own for r in set(g)) == 1 for g in groups.values())
    stream = corpus_pipeline.mixed(spark, both, sf)
    assert stream.columns == both.columns
    words = lambda t: len((t or "").encode().split())
    assert sum(words(r.text) for r in stream.collect()) == sum(r.taken for r in mixing.mix(both).collect())
    out = corpus_pipeline.encoded(spark, both, sf)
    assert "text" not in out.columns and out.count() == both.count() and out.where("ids is null or n_ids < 0").count() == 0


def brute_groups(texts):
    return similar(list(enumerate(texts)))


def test_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
