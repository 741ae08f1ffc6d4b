"""SimHash near-duplicates by anchor points of a covering code.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 values have it. Two fingerprints link when
they differ in at most ``threshold`` bits. Cut in parts, one part then differs in few: a half in at most one bit for
thresholds up to 3, a quarter for thresholds up to 7. On a part, the anchors are the words of a Hamming code with one free
bit: every value is within distance 1 (the covering radius) of one anchor, so a value copied to all anchors within 1 + 1 of
it meets each of its partners at the partner's own anchor. Values are compared only within an anchor, and an anchor gives
links that join its members, never all pairs. An anchor with more members than fit a task is split by anchors on the other
quarters; nothing is dropped.

The query takes shingles of 3 words and 3 bits. Few texts that are alike by 0.8 differ so little, and 64 bits tell likeness
only roughly. So the pipeline's stage compares at anchors at 7 bits, and there by a second fingerprint of 256 bits, of shingles
of 5 words, which travels with the first one, so no text is read again. On average the angle of a Jaccard similarity of 0.8
makes WIDE bits of it differ; pairs that differ in at most SURE bits link. Texts with both fingerprints equal are one class.

A pair alike by 0.8 differs in some 10 of the 64 bits, so 7 bits miss most pairs near that similarity. The stage therefore takes
candidates from bands of minima of the same shingles too (``bands``). Members of a band that differ in at most SURE of the 256
bits link; those that differ in more, up to LOOSE bits, and are not linked by others, are compared by their whole sets of
shingles and link at a Jaccard similarity of 0.8 or more. Only rows in such doubt have their sets moved. 98.6% of pairs alike by
0.8 share a band, and more of those that are more alike. A band of over BAND_BUCKET texts is split by pairs of bands, which
nine in ten of its pairs alike by 0.8 share.

Defined results: a null or empty text has fingerprint zero and links like any other; equal texts have equal
fingerprints and are one class before any comparison; ids have any type that can be sorted, and keep it; a null id never becomes a component's id unless its
component has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bands import BANDS, alike, bands, shingle_set
from .common import components, fresh, partitions, row_marks, runs, salted_join, stored, words
from .hnsw import smallest

SHINGLE = 3
SEED = 42
THRESHOLD = 3
#: Of the pipeline's stage: bits of the first fingerprint, shingle and 64-bit words of the second, and its bits.
NEAR, NEAR_SHINGLE, NEAR_WORDS = 7, 5, 4
WIDE = int(64 * NEAR_WORDS * math.acos(2 * 0.8 / 1.8) / math.pi)
#: Of a band's members: 1.5 deviations fewer bits than that average, and 3 more (rounded down).
_SPREAD = math.sqrt(WIDE * (1 - WIDE / (64 * NEAR_WORDS)))
SURE, LOOSE = int(WIDE - 1.5 * _SPREAD), int(WIDE + 3 * _SPREAD)
#: Members of an anchor that one task compares; a larger anchor is split. Members of a band, likewise.
BUCKET, BAND_BUCKET = 50_000, 20_000
#: Rows in doubt whose marks are broadcast to the texts, at most (8 bytes each); more are joined.
FEW = 500_000


def shingle_hashes(w: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included; of all words where there are fewer."""
    digest, data = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) < shingle:
        return np.array([digest(data, SEED)], "<u8")
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(w) - shingle + 1].tolist()
    return np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")


def majority(every: np.ndarray) -> int:
    """64 bits, each as in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(every), 1 << 15):
        bits = np.unpackbits(every[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; the majority of the shingles' hashes, bit by bit."""
    w = words(text)
    return majority(shingle_hashes(w, shingle)) if w else 0


def again(x: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits from hashes."""
    x = x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def near_shingles(text: str | None) -> np.ndarray:
    """Hashes of shingles of five words, repeats included."""
    w = words(text)
    return shingle_hashes(w, NEAR_SHINGLE) if w else np.zeros(0, np.uint64)


def wide_fingerprint(every: np.ndarray, n: int = NEAR_WORDS) -> list[int]:
    """n times 64 bits from hashes of shingles."""
    return [majority(again(every, k)) if len(every) else 0 for k in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column, wide: int = 0, banded: bool = False) -> DataFrame:
    """``(doc_id, fp)`` of each row, longs ``more`` beside, ``wide`` words of a second fingerprint, ``w0`` and so on, and if
    ``banded`` the keys of bands, ``b0`` and so on; each is a signed long of 64 bits."""

    def further(text: str | None) -> np.ndarray:
        every = near_shingles(text)
        own = np.array(wide_fingerprint(every, wide), np.uint64).view(np.int64)
        return np.concatenate([own, bands(every)]) if banded else own

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            others = np.array([further(t) for t in texts] if added else [], np.int64).reshape(len(texts), len(added))
            columns = [b.column(0), pa.array(fp), *b.columns[2:], *(pa.array(others[:, k].copy()) for k in range(len(added)))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
    added = [*(f"w{k}" for k in range(wide)), *(f"b{k}" for k in range(BANDS if banded else 0))]
    names = ["doc_id", "fp", *rows.columns[2:], *added]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in names[1:])]))


@lru_cache
def flips(checks: int, radius: int) -> list[np.ndarray]:
    """For each syndrome, all changes of at most ``radius`` bits that have it, so that they lead from a value to an anchor.

    The code is Hamming's with ``checks`` check bits, in 2**checks bits of which the top one is free.
    """
    bits = 1 << checks
    found: list[list[int]] = [[] for _ in range(bits)]
    for k in range(radius + 1):
        for places in combinations(range(bits), k):
            syndrome = reduce(xor, ((i + 1) % bits for i in places), 0)
            found[syndrome].append(sum(1 << i for i in places))
    return [np.array(f, np.uint64) for f in found]


def anchors(x: np.ndarray, checks: int, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within ``radius`` of each x of 2**checks bits, as (row of x, anchor). The code's covering radius is 1."""
    bits = 1 << checks
    syndrome = np.zeros(len(x), np.int64)
    for k in range(checks):
        mask = sum(1 << i for i in range(bits - 1) if (i + 1) >> k & 1)
        syndrome |= (np.bitwise_count(x & np.uint64(mask)).astype(np.int64) & 1) << k
    rows, found = [], []
    for s, change in enumerate(flips(checks, radius)):
        own = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(own, len(change)))
        found.append((x[own, None] ^ change).ravel())
    return np.concatenate(rows), np.concatenate(found)


def near(fp: np.ndarray, rows: np.ndarray, others: np.ndarray, threshold: int, wide: int) -> np.ndarray:
    """Which of ``others`` each of ``rows`` links with; a row of ``fp`` is one or more words."""
    found = np.bitwise_count(fp[rows, :1] ^ fp[others, 0]) <= threshold
    if fp.shape[1] > 1:
        i, j = np.nonzero(found)
        found[i, j] = np.bitwise_count(fp[rows[i], 1:] ^ fp[others[j], 1:]).sum(1, dtype=np.int64) <= wide
    return found


def linked(fp: np.ndarray, threshold: int = THRESHOLD, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected within ``fp``: each reached row with the one it was reached from."""
    fp = fp.reshape(len(fp), -1)
    a, b, alive = [], [], np.ones(len(fp), bool)
    for s in range(0, len(fp), 256):
        rows = s + np.flatnonzero(alive[s : s + 256])
        if not len(rows):
            continue
        rest = s + np.flatnonzero(alive[s:])
        close = near(fp, rows, rest, threshold, wide)
        some = close.sum(1) > 1
        alive[rows[~some]] = False  # those alone are done, all at once
        for r in np.flatnonzero(some):
            start = rows[r]
            if not alive[start]:
                continue
            alive[start] = False
            front = rest[close[r]]
            front = front[alive[front]]
            a.append(front)
            b.append(np.full(len(front), start))
            alive[front] = False
            while len(front):
                left = np.flatnonzero(alive)
                if not len(left):
                    break
                by = np.full(len(left), -1)
                for k in range(0, len(front), 64):
                    open_ = np.flatnonzero(by < 0)
                    own = near(fp, front[k : k + 64], left[open_], threshold, wide)
                    hit = own.any(0)
                    by[open_[hit]] = front[k : k + 64][own.argmax(0)[hit]]
                new = by >= 0
                a.append(left[new])
                b.append(by[new])
                front = left[new]
                alive[front] = False
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def parts_of(threshold: int) -> int:
    """Parts of a fingerprint of which one differs in at most one bit."""
    if threshold > 7:
        raise ValueError("of quarters that differ in one bit at most one is sure for thresholds up to 7")
    return 2 if threshold <= 3 else 4


def spread(fp: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of each fingerprint's anchors on each part."""
    size, found = 64 // parts, []
    for part in range(parts):
        x = fp >> np.uint64(size * part) & np.uint64((1 << size) - 1)
        rows, key = anchors(x, size.bit_length() - 1)
        found.append((rows, key | np.uint64(part << 32)))
    return tuple(np.concatenate(c) for c in zip(*found))


def spread_further(fp: np.ndarray, key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of fingerprints at an anchor of ``spread``, by anchors on the quarters that it doesn't speak of.

    With halves, one of the two other quarters differs in at most one bit of three; with quarters, one of three in at most two of seven.
    """
    part, found = (key >> np.uint64(32)).astype(np.int64), []
    for quarter in range(4):
        own = np.flatnonzero(part != quarter * parts // 4)
        rows, other = anchors(fp[own] >> np.uint64(16 * quarter) & np.uint64(0xFFFF), 4, 2 if parts == 2 else 3)
        rows = own[rows]
        found.append((rows, (key[rows] * np.uint64(4) + np.uint64(quarter)) << np.uint64(16) | other))
    return tuple(np.concatenate(c) for c in zip(*found))


def links(classes: DataFrame, threshold: int = THRESHOLD, wide: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``node, fp`` and words of a second fingerprint, if any, that connect all pairs that link."""
    parts, n = parts_of(threshold), partitions(classes.sparkSession)
    names = [c for c in classes.columns if c != "node"]

    def dealt(further: bool):
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, 20_000):
                    b = big.slice(at, 20_000)
                    fp = b.column("fp").to_numpy().view(np.uint64)
                    rows, key = spread_further(fp, b.column("key").to_numpy().view(np.uint64), parts) if further else spread(fp, parts)
                    yield b.select(["node", *names]).take(pa.array(rows)).append_column("key", pa.array(key.view(np.int64)))

        return each

    def compare(most: int | None):
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, "key"):
                key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
                fp = np.stack([t.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                size = np.diff(np.r_[start, len(key)])
                a, b, over = [], [], []
                for s, k in zip(start[size > 1].tolist(), size[size > 1].tolist()):
                    if most and k > most:
                        over.append(np.arange(s, s + k))
                    elif k == 2 and int(fp[s, 0] ^ fp[s + 1, 0]).bit_count() > threshold:
                        continue
                    else:
                        i, j = linked(fp[s : s + k], threshold, wide)
                        a.append(s + i)
                        b.append(s + j)
                a, b, over = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, over))
                at = np.concatenate([a, over])
                columns = [node[at], np.concatenate([node[b], node[over]]), np.repeat([-1, 0], [len(a), len(over)]), key[at], *(fp[at, k].view(np.int64) for k in range(len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "over", "key", *names])

        return each

    def at_anchors(rows: DataFrame, further: bool) -> DataFrame:
        longs = ", ".join(f"{c} long" for c in ("node", *names, "key"))
        keyed = rows.mapInArrow(dealt(further), longs).repartition(n, "key").sortWithinPartitions("key")
        found = ", ".join(f"{c} long" for c in ("a", "b", "over", "key", *names))
        return keyed.mapInArrow(compare(None if further else bucket), found)

    found = at_anchors(classes, False)
    # a link needs its nodes only; the members of a split anchor come whole
    found = stored(found.select("a", "b", "over", *[F.when(F.col("over") == 0, F.col(c)).alias(c) for c in ("key", *names)]), "links")
    out = found.where("over < 0").select("a", "b")
    over = found.where("over = 0").select(F.col("a").alias("node"), "key", *names)
    return out.union(stored(at_anchors(over, True).select("a", "b"), "links")) if over.take(1) else out


def members(w: np.ndarray, sure: int, loose: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a band's members: links at ``sure`` bits, and those in doubt, within ``loose`` bits of one that these don't join them with."""
    i, j = linked(np.c_[np.zeros(len(w), np.uint64), w], 0, sure)
    group = smallest(i, j, len(w))
    doubt = np.zeros(len(w), bool)
    if (group != group[0]).any():
        for s in range(0, len(w), 256):
            bits = sum(np.bitwise_count(w[s : s + 256, None, k] ^ w[None, :, k]).astype(np.int32) for k in range(w.shape[1]))
            doubt[s : s + 256] = ((bits <= loose) & (group[s : s + 256, None] != group)).any(1)
    return i, j, np.flatnonzero(doubt)


def band_links(classes: DataFrame, texts: DataFrame, sure: int = SURE, loose: int = LOOSE, bucket: int = BAND_BUCKET) -> DataFrame:
    """Links ``(a, b)`` between nodes of ``node, mark, w0, ..., b0, ...`` that share a band; ``texts`` has ``mark, text``.

    A band of more than ``bucket`` members is split by its members' other bands, so that those that share two meet again.
    """
    n = partitions(classes.sparkSession)
    names, keys = ([c for c in classes.columns if c[0] == k and c[1:].isdigit()] for k in "wb")
    longs = ", ".join(f"{c} long" for c in ("node", *names, "key"))

    def compare(most: int | None):
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, "key"):
                key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
                w = np.stack([t.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                size = np.diff(np.r_[start, len(key)])
                found: list[tuple] = []
                for s, k in zip(start[size > 1].tolist(), size[size > 1].tolist()):
                    own = node[s : s + k]
                    if most and k > most:
                        found.append((own, own, np.full(k, key[s]), np.ones(k, np.int64)))
                        continue
                    i, j, doubt = members(w[s : s + k], sure, loose)
                    found.append((own[i], own[j], np.full(len(i), key[s]), np.full(len(i), -1)))
                    found.append((own[doubt], own[doubt], np.full(len(doubt), key[s]), np.zeros(len(doubt), np.int64)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "key", "kind"])

        return each

    def met(rows: DataFrame, most: int | None) -> DataFrame:
        sorted_ = rows.selectExpr("node", *names, "key").repartition(n, "key").sortWithinPartitions("key")
        return stored(sorted_.mapInArrow(compare(most), "a long, b long, key long, kind long"), "bands")

    found = met(classes.select("node", *names, F.explode(F.array(*keys)).alias("key")), bucket)
    over = found.where("kind = 1").select(F.col("a").alias("node"), "key")
    if over.take(1):
        pairs = classes.select("node", *names, F.explode(F.array(*keys)).alias("other")).hint("merge").join(over.hint("merge"), "node")
        split = pairs.where("key != other").withColumn("key", F.xxhash64(F.least("key", "other"), F.greatest("key", "other")))
        found = found.union(met(split.dropDuplicates(["node", "key"]), None))
    sure_ = found.where("kind = -1").select("a", "b")
    doubt = found.where("kind = 0").select(F.col("a").alias("node"), "key")
    if not doubt.take(1):
        return sure_

    def as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(near_shingles(t.as_py())).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["mark", "shingles"])

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "key"):
            key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            cuts = [*np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                i, j = alike([np.frombuffer(x.as_py(), np.uint32) for x in t.column("shingles").slice(s, e - s)])
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e][i]), pa.array(node[s:e][j])], ["a", "b"])

    need = stored(classes.select("node", "mark").hint("merge").join(doubt.select("node").distinct().hint("merge"), "node", "left_semi"), "doubt")
    marks = need.select("mark").distinct()
    marks = F.broadcast(marks) if need.count() <= FEW else marks.hint("merge")
    own = texts.join(marks, "mark", "left_semi").mapInArrow(as_sets, "mark long, shingles binary")
    own = stored(own, "shingles").dropDuplicates(["mark"])
    sets = need.hint("merge").join(own.hint("merge"), "mark").select("node", "shingles")
    rows = doubt.hint("merge").join(sets.hint("merge"), "node").select("key", "node", "shingles")
    rows = rows.repartition(n, "key").sortWithinPartitions("key")
    return sure_.union(stored(rows.mapInArrow(exact, "a long, b long"), "alike"))


def rooted(prints: DataFrame, threshold: int = THRESHOLD, wide: int = WIDE, bucket: int = BUCKET, texts: DataFrame | None = None) -> DataFrame:
    """``fp, ..., first, node, root`` of each class of equal fingerprints: its smallest id, a number, and the smallest number reachable.

    With ``texts`` (``mark, text``), links by bands count too; ``prints`` has marks and bands then.
    """
    own = [c for c in prints.columns if c == "fp" or c[0] == "w"]
    keys = [c for c in prints.columns if c[0] == "b"] if texts is not None else []
    row = [F.min("mark").alias("mark"), *(F.min(c).alias(c) for c in keys)] if keys else []
    classes = prints.groupBy(*own).agg(F.min("doc_id").alias("first"), *row)
    node = F.col("fp") if own == ["fp"] else F.monotonically_increasing_id()
    classes = stored(classes.withColumn("node", node), "classes")  # numbers are fixed once written
    found = links(classes.select("node", *own), threshold, wide, bucket)
    if keys:
        found = found.union(band_links(classes, texts))
        classes = classes.drop("mark", *keys)
    reach = components(found)
    named = classes.hint("merge").join(reach.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return stored(named, "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words_: int = 0, wide: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``: component_id is the smallest id reachable by links.

    With ``words_``, a second fingerprint of so many words must differ in at most ``wide`` bits too.
    """
    prints = stored(fingerprints(docs, id_col, text_col, wide=words_), "prints")
    own = prints.columns[1:]
    named = rooted(prints, threshold, wide, bucket)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = salted_join(named.select(*own, "root", "node"), least, "root", "node", named.count()).select(*own, "component_id")
    return prints.hint("merge").join(of.hint("merge"), own).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = NEAR, words_: int = NEAR_WORDS, wide: int = SURE) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, nulls last, and of these the smallest hash of the row.

    Components are kept by row, so those with equal or null ids keep a row each. Rows that are equal count once.
    """
    mark = row_marks(docs)[0]
    prints = stored(fingerprints(docs, id_col, text_col, mark.alias("mark"), wide=words_, banded=True), "prints")
    classes = [c for c in prints.columns if c == "fp" or c[0] == "w"]
    root = rooted(prints, threshold, wide, texts=docs.select(mark.alias("mark"), F.col(text_col).alias("text"))).select(*classes, "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("row")
    of = prints.groupBy(*classes).agg(first).hint("merge").join(root.hint("merge"), classes).groupBy("root").agg(F.min("row").alias("row"))
    kept = stored(of.select(F.col("row.doc_id").alias("kept_id"), F.col("row.mark").alias("kept_mark")), "kept")
    own, kept_id, kept_mark = (fresh(docs, f"simhash_{n}") for n in ("mark", "id", "kept"))
    heads = kept.withColumnsRenamed({"kept_id": kept_id, "kept_mark": kept_mark}).hint("merge")
    same = (F.col(own) == F.col(kept_mark)) & F.col(id_col).eqNullSafe(F.col(kept_id))
    one = docs.withColumn(own, mark).hint("merge").join(heads, same, "left_semi")
    copies = prints.hint("merge").join(kept.hint("merge"), (F.col("mark") == F.col("kept_mark")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    copies = copies.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    return (one.dropDuplicates([id_col, own]) if copies.take(1) else one).drop(own)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
