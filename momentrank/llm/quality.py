"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Words are run on as ``start, characters, end``; an n-gram never leaves its word. Trusted text is what the labels call
good. Count tables of all orders are grouped by n-gram, so Spark shards them by its hash, and joined shard by shard: with
their contexts for totals and discounts, and with the next lower order for the interpolated probability. Lower orders
count distinct left neighbours, except at a word's start. The discounts come from counts of counts, order by order.

All trusted documents play a part: the model is trained on two of three, by the hash of their id, and the others give the
fences. The joined table grows with the distinct n-grams of their words. A table of up to MOST rows goes to the workers, which
look up each distinct word of a block of documents once; a larger one is joined with each text's n-grams, shard by shard
(``score_by_join``). Both give the same sums.

Inside words nothing tells a word said over and over from prose, so each word after the first also has an event: it
equals the word before, or not. The event's probability is its share in the language's trusted documents, and a
repeated word pays for it on top of its characters.

A document is poor if its log perplexity per character, drawn towards its language's median by PRIOR characters, is
above its language's fence: the LEVEL quantile of the trusted documents that the model has not been trained on. That leaves
out one of 500. Of fewer than 500 one is left out too, of fewer than 100 none, and the next one's distance from the median is
stretched. Where a language has fewer than ENOUGH, the distances of all languages' documents from their medians count instead, on
top of its own median; with fewer than LEAST, on top of that of all languages.

Defined results: a null or empty text has no characters, so its language's median, and is kept; with no trusted text
at all, nothing is rejected, and where the hash leaves the model nothing, it is trained on all; where all of it trains the
model, that gives the fences too. Ties with the fence are kept. A null language is a language of its own. Rows that repeat an id are scored each for itself; an id is trusted with all
its rows. Columns that are added take names which the documents don't have, so extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored
from .toxicity import labelled

ORDER = 5
#: Of so many trusted documents all but one train the model, and the other one tells the fences.
PARTS = 3
#: N-grams that a worker may hold.
MOST = 6_000_000
PRIOR = 60
#: Share of trusted documents of a language that its fence leaves alone, how many tell it at least, and tell the median.
LEVEL = 0.998
ENOUGH, LEAST = 100, 10
START, STOP = "\x02", "\x03"
#: Characters of text that a worker takes at once, and words that it remembers.
BLOCK = 1_000_000
CACHE = 120_000


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of a column ``text``, in marked words."""
    own = F.explode(F.split(F.col("text"), r"[\x20\x09-\x0D]+")).alias("w")
    return texts.select(own).where("w <> ''").groupBy(F.concat(F.lit(START), "w", F.lit(STOP)).alias("word")).agg(F.count("*").alias("n"))


def ngrams(word: Column, k: int) -> Column:
    """All n-grams of length k of a marked word; the start mark alone is none."""
    first = 2 if k == 1 else 1
    return F.when(
        F.length(word) >= k + first - 1,
        F.transform(F.sequence(F.lit(first), F.length(word) - k + 1), lambda i: F.substring(word, i, F.lit(k))),
    )


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, k, p, backoff``: the probability of the last character, and the weight left to lower orders after ``gram``.

    ``p`` or ``backoff`` is null where a string is only a context, or only an n-gram. The empty context is ''.
    """
    words = stored(word_counts(texts), "words")
    raw = {k: words.select(F.explode(ngrams(F.col("word"), k)).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("a")) for k in range(2, order + 1)}
    tables, lower = [], None
    longer = {k: stored(t, f"count{k}") for k, t in raw.items()}
    for k in range(1, order + 1):
        if k == order:
            count = longer[k]
        else:
            left = longer[k + 1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("a"))
            count = left.where(~F.col("gram").startswith(START))
            if k > 1:
                count = count.union(longer[k].where(F.col("gram").startswith(START)))
        count = stored(count, f"adjusted{k}")
        n = {r.a: r.n for r in count.where("a <= 4").groupBy("a").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (max(n.get(i, 0), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        off = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        count = count.select("gram", "a", off.alias("off"), F.expr(f"substring(gram, 1, {k - 1})").alias("h"))
        contexts = stored(count.groupBy("h").agg(F.sum("a").alias("total"), (F.sum("off") / F.sum("a")).alias("backoff")), f"context{k}")
        count = count.hint("merge").join(contexts.hint("merge"), "h")
        own = (F.col("a") - F.col("off")) / F.col("total")
        if k == 1:
            size = count.count() + 1  # one more for what is unknown
            grams = count.select("gram", (own + F.col("backoff") / size).alias("p"))
            base = contexts.select(F.lit("").alias("gram"), (F.col("backoff") / size).alias("p"), "backoff")
            tables.append(base.select("gram", F.lit(0).alias("k"), "p", F.lit(None).cast("double").alias("backoff")))
        else:
            lower = lower.select(F.col("gram").alias("short"), F.col("p").alias("q"))
            count = count.withColumn("short", F.expr(f"substring(gram, 2, {k - 1})")).hint("merge").join(lower.hint("merge"), "short")
            grams = count.select("gram", (own + F.col("backoff") * F.col("q")).alias("p"))
        lower = stored(grams, f"p{k}")
        tables.append(lower.select("gram", F.lit(k).alias("k"), "p", F.lit(None).cast("double").alias("backoff")))
        if k > 1:
            tables.append(contexts.select(F.col("h").alias("gram"), F.lit(k - 1).alias("k"), F.lit(None).cast("double").alias("p"), "backoff"))
    all_ = reduce(DataFrame.union, tables)
    return stored(all_.groupBy("gram", "k").agg(F.max("p").alias("p"), F.max("backoff").alias("backoff")), "model")


class Scorer:
    """The joined table as a trie in sorted arrays: an n-gram's key is its first n - 1 characters' place and its last character."""

    def __init__(self, parts: Iterable[pa.Table], order: int = ORDER) -> None:
        """``parts``: ``gram, p, backoff`` of each length from 0; one is held at a time."""
        self.order, self.tables = order, {}
        for n, part in enumerate(parts):
            p, backoff = part["p"].to_numpy(), part["backoff"].to_numpy()
            if not n:
                self.empty = float(p[0]) if len(p) else 1.0
                continue
            c = self.codes("".join(part["gram"].to_pylist())).reshape(-1, n)
            node = np.zeros(len(c), np.int64)
            for j in range(n - 1):
                node = self.find(j + 1, node << 21 | c[:, j])
            key = node << 21 | c[:, n - 1]
            by = np.argsort(key, kind="stable")
            with np.errstate(divide="ignore"):
                logs = np.log10(p[by]), np.where(np.isnan(backoff[by]), 0.0, np.log10(backoff[by]))
            self.tables[n] = (key[by], *logs)

    def codes(self, s: str) -> np.ndarray:
        return np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)

    def find(self, n: int, key: np.ndarray) -> np.ndarray:
        keys = self.tables[n][0]
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def words(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word, its end included."""
        c = self.codes("".join(f"{START}{w}{STOP}" for w in words))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.r_[0, np.cumsum(size)[:-1]]
        place = np.arange(len(c)) - np.repeat(first, size)
        nodes = [np.zeros(0), self.find(1, c)]  # nodes[n]: place of the n characters from here on, or -1
        for n in range(2, self.order + 1):
            node = np.full(len(c), -1)
            some = np.flatnonzero(nodes[-1] >= 0)
            some = some[some < len(c) - n + 1]
            some = some[place[some + n - 1] >= n - 1]
            node[some] = self.find(n, nodes[-1][some] << 21 | c[some + n - 1])
            nodes.append(node)
        out, open_ = np.zeros(len(c)), np.flatnonzero(place)
        for n in range(self.order, 0, -1):
            inside = place[open_] >= n - 1
            now, rest = open_[inside], open_[~inside]
            at = nodes[n][now - n + 1]
            logs = self.tables[n][1][at] if len(self.tables[n][1]) else np.zeros(len(at))
            hit = (at >= 0) & ~np.isnan(logs)
            out[now[hit]] += logs[hit]
            miss = now[~hit]
            if n > 1:
                h = nodes[n - 1][miss - n + 1]
                out[miss[h >= 0]] += self.tables[n - 1][2][h[h >= 0]]
            else:
                out[miss] += np.log10(self.empty)
            open_ = np.concatenate([rest, miss])
        return np.add.reduceat(out, first) if len(words) else np.zeros(0)


def score(spark: SparkSession, table: DataFrame, text: str = "text", order: int = ORDER) -> Column:
    """``struct<log: double, chars: long, words: long, again: long>`` of a text column.

    The log10 probability of its characters, their number, that of its words, and of words equal to the one before. The
    table goes to the driver and the workers, so it must be of bounded size; ``scored`` sees to that.
    """
    parts = (table.where(f"k = {n}").select("gram", "p", "backoff").toArrow() for n in range(order + 1))
    held = spark.sparkContext.broadcast(Scorer(parts, order))

    @F.pandas_udf("log double, chars long, words long, again long")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for texts in batches:
            logs, chars, size, again, at = [], [], [], [], 0
            lengths = texts.str.len().fillna(0).cumsum().to_numpy()
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + BLOCK, "right")))
                docs = [split(t) for t in texts.iloc[at:to]]
                new = list(dict.fromkeys(w for d in docs for w in d if w not in known))
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(dict.fromkeys(w for d in docs for w in d))
                for i in range(0, len(new), 20_000):
                    known.update(zip(new[i : i + 20_000], held.value.words(new[i : i + 20_000]).tolist()))
                for d in docs:
                    logs.append(sum(map(known.__getitem__, d)))
                    chars.append(sum(map(len, d)) + len(d))
                    size.append(len(d))
                    again.append(sum(map(eq, d, islice(d, 1, None))))
                at = to
            counts = {"chars": chars, "words": size, "again": again}
            yield pd.DataFrame({"log": np.array(logs, float), **{k: np.array(v, np.int64) for k, v in counts.items()}})

    return each.asNondeterministic()(text)  # else a filter on its fields would run it once more


SPACE = {ord(c): " " for c in "\t\n\x0b\x0c\r"}


def split(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(SPACE).split(" ") if w]


def score_by_join(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``id, log, chars, words, again`` by joins with the sharded table: for a model that no worker could hold.

    Each predicted character takes the longest n-gram that the table has, and the weights of the contexts above it.
    """
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = some.select("id", every.alias("all"))
    again = F.size(F.filter("all", lambda w, i: w == F.get("all", i - 1)))
    sizes = some.where(F.col("all").isNotNull()).groupBy("id").agg(F.sum(F.size("all")).alias("words"), F.sum(again).alias("again"))
    counts = some.select("id", F.explode("all").alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    word = F.concat(F.lit(START), "w", F.lit(STOP))
    chars = counts.groupBy("id").agg(F.sum(F.col("n") * (F.length("w") + 1)).alias("chars"))
    place = F.explode(F.sequence(F.lit(2), F.length(word))).alias("i")
    end = counts.select("id", "n", word.alias("word"), place)
    gram = lambda k: F.when(F.col("i") >= k, F.substring("word", F.col("i") - k + 1, F.lit(k)))
    at = end.select("n", "id", *[gram(k).alias(f"g{k}") for k in range(1, order + 1)], *[F.substring("word", F.col("i") - k, F.lit(k)).alias(f"h{k}") for k in range(1, order)])
    at = at.groupBy("id", *[c for c in at.columns if c[0] in "gh"]).agg(F.sum("n").alias("n"))
    for k in range(1, order + 1):
        own = table.where(f"k = {k}")
        at = at.hint("merge").join(own.select(F.col("gram").alias(f"g{k}"), F.log10("p").alias(f"p{k}")).hint("merge"), f"g{k}", "left")
        if k < order:
            at = at.hint("merge").join(own.select(F.col("gram").alias(f"h{k}"), F.log10("backoff").alias(f"b{k}")).hint("merge"), f"h{k}", "left")
    base = table.where("k = 0").first()
    log = F.lit(float(np.log10(base.p)) if base else 0.0)
    for k in range(1, order + 1):
        over = F.when(F.col(f"g{k}").isNotNull(), F.coalesce(f"b{k - 1}", F.lit(0.0))).otherwise(0.0) if k > 1 else F.lit(0.0)
        log = F.coalesce(F.col(f"p{k}"), log + over)
    return at.groupBy("id").agg(F.sum(F.col("n") * log).alias("log")).join(chars.hint("merge"), "id").join(sizes.hint("merge"), "id")


def taught(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model's table, the ids that it is trained on, and all trusted ids. Of rows that share an id one trains it."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    good = stored(good.where("doc_id is not null"), "good")
    there = docs.select(F.col("doc_id").alias("id")).distinct()
    found = stored(good.hint("merge").join(there.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi"), "found")
    ids = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < PARTS - 1)
    ids = ids if ids.take(1) else found
    rows = labelled(docs, ids.withColumn("quality", F.lit(1)), "quality")
    return model(rows.select("text")), ids, good


def scored(docs: DataFrame, table: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """``docs`` with a struct column ``name`` of log, chars, words, again."""
    if table.count() <= most:
        return docs.withColumn(name, score(docs.sparkSession, table))
    one, two = fresh(docs, f"{name}_one"), fresh(docs, f"{name}_two")
    docs = docs.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit("again"), "text")})
    key = F.struct(F.col(one).alias("one"), F.col(two).alias("two")).alias("id")
    texts = docs.select(key, "text").where("text is not null").dropDuplicates(["id"])
    found = score_by_join(texts, table, "id")
    found = found.select(F.col("id.one").alias(one), F.col("id.two").alias(two), F.struct("log", "chars", "words", "again").alias("found"))
    both = docs.hint("merge").join(stored(found.withColumnRenamed("found", name), "joined").hint("merge"), [one, two], "left")
    fields = {c: F.col(f"{name}.{c}") for c in ("log", "chars", "words", "again")}
    own = F.struct(*[F.coalesce(v, F.lit(0)).cast("double" if c == "log" else "long").alias(c) for c, v in fields.items()])
    return both.withColumn(name, own).drop(one, two)


def by_language(found: DataFrame, own: DataFrame) -> DataFrame:
    """``found`` with the columns of its language's row in ``own``; broadcast if that has 10,000 rows at most, and else merged."""
    key = fresh(found, "own_lang")
    own = own.withColumnRenamed("lang", key)
    own = F.broadcast(own) if own.count() <= 10_000 else own.hint("merge")
    return found.join(own, F.col("lang").eqNullSafe(F.col(key)), "left").drop(key)


def total(share: Column) -> Column:
    """log10 probability of a row's characters, and of its words' being repeats or not, where ``share`` of words are."""
    others = F.greatest(F.col("words") - 1, F.lit(0)) - F.col("again")
    return F.col("log") + F.col("again") * F.log10(share) + others * F.log10(1 - share)


def smoothed(share: Column, middle: Column) -> Column:
    """Log perplexity per character, drawn towards ``middle``."""
    return (PRIOR * middle - total(share)) / (PRIOR + F.col("chars"))


def fences(found: DataFrame, ids: DataFrame, good: DataFrame, level: float = LEVEL, enough: int = ENOUGH, least: int = LEAST) -> DataFrame:
    """``lang, every, middle, fence, share`` from ``doc_id, lang`` and a score's fields; the row of all languages has ``every`` true."""
    some = found.where("chars > 0").hint("merge").join(good.hint("merge"), "doc_id", "left_semi")
    new = stored(some.hint("merge").join(ids.hint("merge"), "doc_id", "left_anti"), "trusted")
    some = new if new.take(1) else stored(some, "trusted")
    share = ((F.sum("again") + 0.5) / (F.sum(F.col("words") - 1) + 1)).alias("share")
    middle = lambda share: F.percentile_approx(-total(share) / F.col("chars"), 0.5, 10_000).alias("middle")
    all_ = some.agg(share, F.count("*").alias("n")).first()
    all_share = F.lit(all_.share).cast("double")
    all_middle = F.lit(some.agg(middle(all_share)).first().middle).cast("double")
    shares = stored(some.groupBy("lang").agg(share, F.count("*").alias("n")), "shares")
    own = by_language(some, shares.where(F.col("n") >= least)).where("share is not null")
    middles = stored(own.groupBy("lang", "share", "n").agg(middle(F.col("share"))), "middles")
    far = by_language(some, middles).withColumns({"share": F.coalesce("share", all_share), "middle": F.coalesce("middle", all_middle)})
    far = stored(far.select("lang", (smoothed(F.col("share"), F.col("middle")) - F.col("middle")).alias("far")), "far")
    many = 1 / (1 - level)  # documents of which the quantile leaves out just one

    def distance(n: Column, high: Column, second: Column, top: Column) -> Column:
        """The quantile of many; of fewer one of the largest, stretched as extremes of exponential tails grow with them."""
        rank = F.when(n >= 100, 2).otherwise(1)  # one left out is one in a hundred at most
        stretch = F.log(F.lit(many)) / F.log(F.greatest(n / rank, F.lit(2.0)))
        return F.when(n >= many, high).otherwise(F.when(n >= 100, second).otherwise(top) * F.greatest(stretch, F.lit(1.0)))

    high = [F.percentile_approx("far", level, 10_000).alias("high"), F.max("far").alias("top"), F.count("*").alias("n")]
    tops = stored(far.groupBy("lang").agg(*high), "tops")
    second = by_language(far, tops.select("lang", "top")).where("far < top").groupBy("lang").agg(F.max("far").alias("second"))
    tops = by_language(tops, second).select("lang", distance(F.col("n"), F.col("high"), F.coalesce("second", "top"), F.col("top")).alias("own_far"))
    all_high = far.agg(*high).first()
    all_second = far.where(F.col("far") < F.lit(all_high.top)).agg(F.max("far").alias("second")).first().second
    all_second = all_high.top if all_second is None else all_second
    every = distance(F.lit(all_high.n), F.lit(all_high.high), F.lit(all_second), F.lit(all_high.top)).cast("double")
    fence = F.col("middle") + F.when(F.col("n") >= enough, F.col("own_far")).otherwise(every)
    own = by_language(middles, tops)
    own = own.select("lang", F.lit(False).alias("every"), "middle", fence.alias("fence"), "share")
    rest = found.sparkSession.range(1).where(F.lit(all_.n > 0))
    rest = rest.select(F.lit(None).cast("string").alias("lang"), F.lit(True), all_middle, all_middle + every, all_share)
    return stored(own.union(rest), "fences")


def judged(found: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``perplexity``, ``fence`` and ``poor`` to rows with ``lang`` and a score's fields; ``limits`` has a row a language."""
    every = limits.where("every").first()
    own = limits.where("NOT every").select("lang", F.struct("middle", "fence", "share").alias("own_limit"))
    found = by_language(found, own)
    middle = F.coalesce("own_limit.middle", F.lit(every.middle if every else 0.0))
    fence = F.coalesce("own_limit.fence", F.lit(every.fence if every else float("inf")))
    share = F.coalesce("own_limit.share", F.lit(every.share if every else 0.5))
    bits = smoothed(share, middle)
    columns = {"perplexity": F.pow(F.lit(10.0), bits), "fence": F.pow(F.lit(10.0), fence), "poor": bits > fence + 1e-9}
    return found.withColumns(columns).drop("own_limit")


def trusted(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that are not poor. Texts are scored once and written with their scores; fences come from these."""
    table, ids, good = taught(docs, labels)
    name = fresh(docs, "quality_score")
    found = stored(scored(docs, table, name, most), "scored")
    limits = fences(found.select("doc_id", "lang", f"{name}.*"), ids, good)
    packed = found.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "lang", f"{name}.*")
    kept = judged(packed, limits).where(~F.col("poor"))
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    table, ids, good = taught(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = stored(scored(docs, table, "score").select("doc_id", "lang", "score.*"), "scores")
    out = judged(found, fences(found, ids, good))
    return out.select("doc_id", "lang", "chars", F.round("perplexity", 6).alias("perplexity"), F.round("fence", 6).alias("fence"), "poor")
