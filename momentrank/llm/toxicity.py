"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

``P(grade > k) = logistic(w . x - theta_k)``, one weight vector for all ordered thresholds; the score is the expected
grade, the sum of these probabilities. Features are log-scaled counts of words that tell toxic from other labelled
texts, taken over the whole text. Words are runs of letters, so
``idiot,`` counts as ``idiot``; their beginnings are features too, for inflected forms.

Labels say toxic or not. The grades are 0 for a document that is not labelled toxic, and for one that is, 1 or 2: 2
where it has more than the median number of the words that mark toxic texts. A labelled text without any such
word is grade 1 all the same.

The model is fitted on all labelled documents, one row an id, whole. Tasks count features, and Spark sums them; of those that tell,
the clearest ``vocabulary`` are weighed. A document is then the telling features that it holds, and equal ones are one row with a
number. Each step of the fit is a pass over these rows, packed into blocks: a task gives its share of the loss and of its slope, and
the driver holds the weights alone; the two fits take their steps in the same passes. The severity from which a document is rejected is chosen on a quarter of the documents, by the hash of their id, that
a first fit has not seen, from counts by severity. Scoring takes whole texts of any length; it is a row-wise function that keeps the
row where it is.

Defined results: a null or empty text has severity by its thresholds alone, which is that of a clean text; with no
labelled rows, or none toxic, all severities are 0 and nothing is rejected. Rows that repeat an id are scored each for
itself. Features come from the text column only, so extra columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Features that are weighed; the bound of what reaches the driver.
VOCABULARY = 5000
#: Characters beyond which ``labelled`` can leave texts out; no query does.
LONGEST = 20_000
#: The first fit doesn't see one labelled document of so many.
PARTS = 4
#: Features that a task counts before it hands them on.
TALLY = 300_000
#: Documents that must hold a feature for it to tell.
LEAST = 5
#: Entries of a block of rows that are packed for the fit; one document can have more.
BLOCK = 250_000
#: Bits of hashed ids for each labelled row, and at most, that sort out documents before they move to their labels.
BITS, MOST_BITS = 16, 1 << 26
#: Types of ids that hash alike where they are equal.
PLAIN = ("tinyint", "smallint", "int", "bigint", "string")
GRADES = 3
#: Expected severity from which a document is rejected where there are too few labels to choose one.
REJECT = 0.2
#: A clean document that is rejected weighs as much as this many toxic ones that are kept, when the severity is chosen.
CARE = 5
#: Lengths of the word beginnings that are features too.
STEMS = (5, 7)
#: Words whose features a worker remembers.
CACHE = 200_000
TOKEN = re.compile(r"[^\W\d_]+")
#: All of ASCII but letters becomes a blank, in strings that hold nothing else and in UTF-8.
ASCII = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))
UTF8 = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


def tokens(text: str | None) -> list[str]:
    """``TOKEN.findall`` of the lower-cased text; ASCII words are cut by a table of characters, which takes half the time."""
    low = (text or "").lower()
    if low.isascii():
        return low.translate(ASCII).split()
    found: list[str] = []
    for word in low.encode("utf-8", "surrogatepass").translate(UTF8).decode("utf-8", "surrogatepass").split():
        if word.isascii():
            found.append(word)
        else:
            found += TOKEN.findall(word)
    return found


def features(word: str) -> list[str]:
    """The word, and its beginnings, which its inflected forms share."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) >= k)]


def counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(tokens(text)).items():
        for f in features(word):
            found[f] += n
    return found


class Finder:
    """Counts the features of a text that stand in ``at``, each under its value there. Most words share no beginning with any of these."""

    def __init__(self, at: dict) -> None:
        self.at = at
        self.heads = {f.removesuffix("-")[: STEMS[0]] for f in at}
        self.known: dict[str, list] = {}

    def counts(self, text: str | None) -> dict:
        known, heads, found, k = self.known, self.heads, {}, STEMS[0]
        if len(known) > CACHE:
            known.clear()
        for word in tokens(text):
            if word[:k] in heads:
                own = known.get(word)
                if own is None:
                    own = known[word] = [self.at[f] for f in features(word) if f in self.at]
                for f in own:
                    found[f] = found.get(f, 0) + 1
        return found


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    reject: float = REJECT

    def __post_init__(self) -> None:
        self.finder = Finder({f: f for f in self.weights})

    def severity(self, text: str | None) -> float:
        if not self.thresholds:
            return 0.0
        found = self.finder.counts(text)
        z = sum(self.weights[f] * (1 + math.log(c)) for f, c in sorted(found.items()))
        return sum(1 / (1 + math.exp(min(t - z, 700))) for t in self.thresholds)


def telling(texts: list[str | None], toxic: list[int], least: int = LEAST, score: float = 3.5) -> tuple[list[str], set[str]]:
    """Features of at least ``least`` documents whose share of toxic ones is ``score`` standard errors up, clearest
    first, and those among them that hardly ever stand elsewhere.

    Thousands of rare words would otherwise fit the noise in the labels, and common words would excuse a toxic text.
    """
    seen, own = Counter(), Counter()
    for text, t in zip(texts, toxic):
        found = counts(text).keys()
        seen.update(found)
        if t:
            own.update(found)
    p = sum(toxic) / len(toxic)
    up = {f: (own[f] - c * p) / math.sqrt(c * p * (1 - p)) for f, c in seen.items() if c >= least}
    kept = sorted((f for f, z in up.items() if z >= score), key=lambda f: (-up[f], f))
    return kept, {f for f in kept if own[f] >= 0.8 * seen[f]}


def ordered(x: np.ndarray) -> np.ndarray:
    """The thresholds: the first, and the logarithms of their distances."""
    ends = x[1 - GRADES :]
    return np.cumsum(np.r_[ends[:1], np.exp(ends[1:])])


@dataclass
class Bags:
    """Rows of features: of each entry its row, its feature and its log-scaled count; of each row its grade and how many it stands for."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    grade: np.ndarray
    n: np.ndarray

    def slope(self, x: np.ndarray) -> np.ndarray:
        """Sums over the rows: the loss, and its derivatives by weights and thresholds."""
        d, k = len(x) - GRADES + 1, GRADES - 1
        z = np.bincount(self.row, x[self.col] * self.val, len(self.n))
        over = 1 / (1 + np.exp(-np.clip(z[:, None] - ordered(x), -40, 40)))
        over = np.concatenate([np.ones((len(z), 1)), over, np.zeros((len(z), 1))], axis=1)
        rows = np.arange(len(z))
        at_top, at_low = over[rows, self.grade], over[rows, self.grade + 1]
        each = np.maximum(at_top - at_low, 1e-12)
        top, low = self.n * at_top * (1 - at_top) / each, self.n * at_low * (1 - at_low) / each
        ends = [((self.grade == j + 1) * top - (self.grade == j) * low).sum() for j in range(k)]
        return np.concatenate([[-(self.n * np.log(each)).sum()], np.bincount(self.col, (low - top)[self.row] * self.val, d), ends])


def steps(n: int, d: int, rounds: int, decay: float, enough: float = 1e-5, memory: int = 10) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and thresholds of the least penalised mean loss, by quasi-Newton steps (L-BFGS).

    Yields where it wants to know the sums of ``Bags.slope`` over all ``n`` rows, is sent them, and returns the minimum.
    """

    def slope(x: np.ndarray) -> Generator[np.ndarray, np.ndarray, tuple[float, np.ndarray]]:
        all_ = (yield x) / n
        tail = np.cumsum(all_[:d:-1])[::-1]
        ends = np.r_[tail[:1], tail[1:] * np.exp(x[d + 1 :])]
        return float(all_[0] + decay / 2 * (x[:d] @ x[:d])), np.r_[all_[1 : d + 1] + decay * x[:d], ends]

    x = np.concatenate([np.zeros(d), [2.0], np.log(np.full(GRADES - 2, 2.0))])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    value, g = yield from slope(x)
    for _ in range(rounds):
        if np.abs(g).max() < enough:
            break
        q, parts = g.copy(), []
        for s, y in reversed(pairs):
            parts.append((s @ q) / (s @ y))
            q -= parts[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.sqrt(g @ g)))
        for (s, y), part in zip(pairs, reversed(parts)):
            q += s * (part - (y @ q) / (s @ y))
        step = 1.0
        while True:
            new = x - step * q
            found, h = yield from slope(new)
            if found <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
            if step < 1e-6:
                return x
        if (new - x) @ (h - g) > 1e-12:
            pairs = [*pairs, (new - x, h - g)][-memory:]
        x, value, g = new, found, h
    return x


def descend(all_sums: Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]], fits: list[Generator[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Ends of all ``fits``, which are ``steps``; each call of ``all_sums`` serves one step of every fit that goes on."""
    at, ends = {i: next(fit) for i, fit in enumerate(fits)}, {}
    while at:
        sums = all_sums(at)
        for i in list(at):
            try:
                at[i] = fits[i].send(sums[i])
            except StopIteration as e:
                ends[i] = e.value
                del at[i]
    return [ends[i] for i in range(len(fits))]


def fit(texts: list[str | None], toxic: list[int], vocabulary: int = VOCABULARY, rounds: int = 300, decay: float = 2e-4) -> Model:
    """The model of rows in hand: maximum likelihood with an L2 penalty; the thresholds stay in order. See ``fitted``."""
    if not sum(toxic) or sum(toxic) == len(toxic):
        return Model({}, [])
    kept, marks = telling(texts, toxic)
    at = {f: i for i, f in enumerate(kept[:vocabulary])}
    bags = [[(at[f], c) for f, c in counts(t).items() if f in at] for t in texts]
    hits = np.array([sum(c for i, c in b if kept[i] in marks) for b in bags])
    flags = np.array(toxic, bool)
    middle = np.median(hits[flags & (hits > 0)]) if (flags & (hits > 0)).any() else 0
    row = np.array([r for r, b in enumerate(bags) for _ in b], np.int64)
    col = np.array([i for b in bags for i, _ in b], np.int64)
    val = np.array([1 + math.log(c) for b in bags for _, c in b])
    rows = Bags(row, col, val, np.where(flags, 1 + (hits > middle), 0), np.ones(len(bags)))
    [x] = descend(lambda at: {0: rows.slope(at[0])}, [steps(len(bags), len(at), rounds, decay)])
    return Model({f: float(x[i]) for f, i in at.items()}, [float(t) for t in ordered(x)])


def rejecting(severities: np.ndarray, toxic: np.ndarray) -> float:
    """The severity with the least weighed errors; of a range without any in it, the middle by ratio."""
    if toxic.sum() < 10 or (~toxic).sum() < 10:
        return REJECT
    at = np.unique(severities)
    kept_toxic = np.searchsorted(np.sort(severities[toxic]), at, "left")
    lost_clean = (~toxic).sum() - np.searchsorted(np.sort(severities[~toxic]), at, "left")
    cost = np.append(kept_toxic + CARE * lost_clean, toxic.sum())
    best = int(cost.argmin())
    low = at[best - 1] if best else at[0] / 2
    high = at[best] if best < len(at) else GRADES - 1.0
    return float(np.sqrt(max(low, 1e-6) * max(high, 1e-6)))


def likely(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` whose id may be among those of ``labels``: all that are, and one in 16 of the others or fewer, up to 4 million labels.

    The bits of hashed ids have 2**20 rows at most, to broadcast; where more ids set them all, it is no filter. Ids of two types stay as they are.
    """
    kinds = {dict(df.dtypes)["doc_id"] for df in (docs, labels)}
    if len(kinds) > 1 or not kinds <= set(PLAIN):
        return docs
    size = min(MOST_BITS, 1 << max(6, (BITS * labels.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    slot, place = F.shiftright(bit, 6), bit.bitwiseAND(63).cast("int")
    bits = labels.select(slot.alias("slot"), place.alias("place")).distinct().groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    some = docs.select(*docs.columns, slot.alias("slot"), place.alias("place")).join(F.broadcast(bits), "slot")
    return some.where(F.expr("shiftright(bits, place) & 1") == 1).select(docs.columns)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int | None = None, longest: int | None = None) -> DataFrame:
    """``doc_id, text, label`` of all labelled documents, one row an id: of rows that share one, that with the smallest hash of its text.

    Rows meet by id, without a broadcast; texts that no label can be of don't move. ``sample`` takes so many at most, those with the smallest hash of their id, and
    ``longest`` leaves out texts of more characters; no query sets them.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).alias("label"))
    docs = docs.select("doc_id", "text") if longest is None else docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    texts = likely(docs, labels).hint("merge").join(ids.hint("merge"), F.col("doc_id") == F.col("id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    rows = texts.groupBy("doc_id", "label").agg(one).select("doc_id", F.col("one.text").alias("text"), "label")
    return rows if sample is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def tallied(rows: DataFrame) -> DataFrame:
    """``feature, seen, own, seen_first, own_first``: documents that hold it, toxic ones, and of each those that the first fit sees."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = {(t, h): Counter() for t in (False, True) for h in (False, True)}

        def handed() -> Iterator[pa.RecordBatch]:
            for (t, h), own in found.items():
                columns = [pa.array(list(own), pa.string()), pa.array([t] * len(own), pa.bool_()), pa.array([h] * len(own), pa.bool_()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "held", "n"])
                own.clear()

        for b in batches:
            for text, t, h in zip(b.column("text"), b.column("toxic"), b.column("held")):
                words, own = set(tokens(text.as_py())), found[t.as_py(), h.as_py()]
                own.update(words)
                for k in STEMS:
                    own.update({w[:k] + "-" for w in words if len(w) >= k})
                if sum(map(len, found.values())) > TALLY:
                    yield from handed()
        yield from handed()

    some = rows.select("text", "toxic", "held").mapInArrow(each, "feature string, toxic boolean, held boolean, n long")
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    return some.groupBy("feature").agg(F.sum("n").alias("seen"), total(F.col("toxic"), "own"), total(~F.col("held"), "seen_first"), total(F.col("toxic") & ~F.col("held"), "own_first"))


def told(tally: DataFrame, seen: str, own: str, n: int, toxic: int, vocabulary: int, least: int = LEAST, score: float = 3.5) -> dict[str, bool]:
    """``telling`` from counts: the clearest features, and whether they hardly ever stand elsewhere."""
    p = toxic / n
    up = (F.col(own) - F.col(seen) * p) / F.sqrt(F.col(seen) * p * (1 - p))
    kept = tally.where(F.col(seen) >= least).withColumn("up", up).where(F.col("up") >= score).orderBy(F.desc("up"), "feature").limit(vocabulary)
    return {r.feature: r.mark for r in kept.select("feature", (F.col(own) >= 0.8 * F.col(seen)).alias("mark")).collect()}


def bagged(rows: DataFrame, at: dict[str, int]) -> DataFrame:
    """``at, n_at, toxic, held, n``: the features in ``at`` that documents hold, how often, and how many documents are equal in all of it."""
    held = rows.sparkSession.sparkContext.broadcast(at)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        for b in batches:
            places, numbers = [], []
            for text in b.column("text"):
                found = finder.counts(text.as_py())
                places.append(sorted(found))
                numbers.append([found[i] for i in places[-1]])
            columns = [pa.array(places, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32())), b.column("toxic"), b.column("held")]
            yield pa.RecordBatch.from_arrays(columns, ["at", "n_at", "toxic", "held"])

    some = rows.select("text", "toxic", "held").mapInArrow(each, "at array<int>, n_at array<int>, toxic boolean, held boolean")
    return some.groupBy(*some.columns).agg(F.count("*").alias("n"))


def unpacked(b: pa.RecordBatch, place: np.ndarray, mark: np.ndarray) -> tuple[Bags, np.ndarray]:
    """Rows of a batch, with the features that have a place; grades are 1 for toxic ones, and ``mark`` features are counted."""
    sizes = np.diff(b.column("at").offsets.to_numpy())
    col, c = (b.column(x).flatten().to_numpy() for x in ("at", "n_at"))
    row, toxic = np.repeat(np.arange(b.num_rows), sizes), b.column("toxic").to_numpy(zero_copy_only=False)
    own = place[col] >= 0
    hits = np.bincount(row, mark[col] * c, b.num_rows)
    return Bags(row[own], place[col[own]], 1 + np.log(c[own]), toxic.astype(int), b.column("n").to_numpy().astype(float)), hits


def packed(bags: DataFrame, place: np.ndarray, mark: np.ndarray) -> DataFrame:
    """Rows for the fit, with their grades: ``row, col, val, grade, n``, the arrays of ``Bags`` as bytes, of some BLOCK entries and a batch at most."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = unpacked(b, place, mark)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(int), pa.int64()), pa.array(rows.n.astype(int), pa.int64())], ["hits", "n"])

    some = bags.where("toxic").mapInArrow(hits, "hits long, n long").where("hits > 0").groupBy("hits").agg(F.sum("n").alias("n"))
    middle = some.agg(F.percentile("hits", 0.5, F.col("n"))).first()[0] or 0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, start = b.column("at").offsets.to_numpy(), 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK, "right")) - 1)
                rows, found = unpacked(b.slice(start, end - start), place, mark)
                grade = np.where(rows.grade, 1 + (found > middle), 0)
                arrays = rows.row.astype("<i4"), rows.col.astype("<i4"), rows.val.astype("<f8"), grade.astype("<i1"), rows.n.astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["row", "col", "val", "grade", "n"])
                start = end

    return bags.mapInArrow(each, "row binary, col binary, val binary, grade binary, n binary")


def fitted(bags: DataFrame, fits: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 300, decay: float = 2e-4) -> list[np.ndarray]:
    """``fit`` of all rows of ``bags`` that meet a condition, for each of ``fits``, with its features' places and marks: weights by place, and thresholds.

    A step of all fits is a pass, of which a task gives one row a fit.
    """
    rows = [packed(bags.where(which), place, mark).withColumn("fit", F.lit(i)) for i, (which, place, mark) in enumerate(fits)]
    rows = stored(reduce(DataFrame.union, rows), "packed", compression="zstd")

    def sums(at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {i: np.zeros(len(x) + 1) for i, x in at.items()}
            for b in batches:
                for i, *arrays in zip(*map(b.column, ("fit", "row", "col", "val", "grade", "n"))):
                    row, col, val, grade, n = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(arrays, ("<i4", "<i4", "<f8", "<i1", "<f8")))
                    total[i.as_py()] += Bags(row, col, val, grade, n).slope(at[i.as_py()])
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["fit", "sums"])

        found = rows.where(F.col("fit").isin(list(at))).mapInArrow(each, "fit int, sums array<double>").collect()
        return {i: np.sum([np.zeros(len(x) + 1), *(r.sums for r in found if r.fit == i)], axis=0) for i, x in at.items()}

    sizes = [bags.where(which).agg(F.sum("n")).first()[0] for which, *_ in fits]
    return descend(sums, [steps(n, int(place.max(initial=-1)) + 1, rounds, decay) for n, (_, place, _) in zip(sizes, fits)])


def chosen(bags: DataFrame, place: np.ndarray, x: np.ndarray) -> float:
    """``rejecting`` of the severities of all rows of ``bags``, from counts by severity in written ranges of it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, _ = unpacked(b, place, np.zeros(len(place), bool))
            z = np.bincount(rows.row, x[rows.col] * rows.val, b.num_rows)
            found = (1 / (1 + np.exp(np.minimum(ordered(x) - z[:, None], 700)))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(found), b.column("toxic"), b.column("n")], ["severity", "toxic", "n"])

    some = bags.mapInArrow(each, "severity double, toxic boolean, n long").groupBy("severity")
    some = some.agg(*[F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)).alias(name) for t, name in ((True, "bad"), (False, "clean"))])
    some = stored(some.repartitionByRange("severity").withColumn("part", F.spark_partition_id()), "severities")
    ends = some.groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")).orderBy("part").collect()  # a row a partition
    bad, clean = sum(r.bad for r in ends), sum(r.clean for r in ends)
    if bad < 10 or clean < 10:
        return REJECT
    firsts, seen = [], (0, 0)
    for r in ends:
        firsts.append((r.part, *seen))
        seen = seen[0] + r.bad, seen[1] + r.clean
    firsts = F.broadcast(some.sparkSession.createDataFrame(firsts, "part int, bad_first long, clean_first long"))
    before = W.partitionBy("part").orderBy("severity").rowsBetween(W.unboundedPreceding, -1)
    under = lambda c: F.col(f"{c}_first") + F.coalesce(F.sum(c).over(before), F.lit(0))
    cost = some.join(firsts, "part").select("severity", (under("bad") + CARE * (clean - under("clean"))).alias("cost"))
    best = cost.agg(F.min(F.struct("cost", "severity")).alias("b")).first().b
    high = best.severity if best.cost <= bad else GRADES - 1.0
    low = some.where(F.col("severity") < high).agg(F.max("severity")).first()[0]
    low = high / 2 if low is None else low
    return float(np.sqrt(max(low, 1e-6) * max(high, 1e-6)))


def trained(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    """The model of all labelled documents, with the severity that a model of three quarters of them chooses on the fourth."""
    rows = labelled(docs, labels, "toxic").select("text", (F.col("label") > 0).alias("toxic"), (F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == PARTS - 1).alias("held"))
    rows = stored(rows, "labelled", compression="zstd")
    tally = stored(tallied(rows).where(F.col("seen") >= LEAST), "tally")
    sizes = {(r.toxic, r.held): r["count"] for r in rows.groupBy("toxic", "held").count().collect()}
    own, own_first = sizes.get((True, True), 0) + sizes.get((True, False), 0), sizes.get((True, False), 0)
    n, n_first = sum(sizes.values()), own_first + sizes.get((False, False), 0)
    if not own or own == n:
        return Model({}, [])
    kept = told(tally, "seen", "own", n, own, vocabulary)
    first = told(tally, "seen_first", "own_first", n_first, own_first, vocabulary) if 0 < own_first < n_first else {}
    at = {f: i for i, f in enumerate(dict.fromkeys([*kept, *first]))}
    bags = stored(bagged(rows, at), "bags")

    def placed(some: dict[str, bool]) -> tuple[np.ndarray, np.ndarray]:
        place, mark = np.full(len(at), -1), np.zeros(len(at), bool)
        for i, (f, own) in enumerate(some.items()):
            place[at[f]], mark[at[f]] = i, own
        return place, mark

    fits = [("true", *placed(kept))] + [("NOT held", *placed(first))] * (0 < own_first < n_first)
    x, *x_first = fitted(bags, fits)
    model = Model(dict(zip(kept, x.tolist())), ordered(x).tolist())
    if x_first:
        model.reject = chosen(bags.where("held"), placed(first)[0], x_first[0])
    return model


def severity(spark: SparkSession, model: Model, text: str | Column = "text") -> Column:
    """Expected severity, from 0 to 2, of a text column; the model has at most VOCABULARY weights."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.severity(t) for t in texts], dtype="float64")

    return score(text)


def tolerable(docs: DataFrame, labels: DataFrame, reject: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose expected severity is under ``reject``, by default the model's own."""
    spark = docs.sparkSession
    model = trained(docs, labels)
    return docs.where(severity(spark, model) < (model.reject if reject is None else reject))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", F.round(severity(spark, model), 6).alias("severity"))
    return rows.withColumn("toxic", F.col("severity") >= model.reject)
