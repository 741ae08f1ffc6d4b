"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Documents are cut into blocks of some million tokens, which are written once as word hashes and word numbers. A block's
distinct n-grams, each with its count in the block's training documents, go to the owner of their part of the hash space.
An owner sums the counts and builds its segment: exact counts of its words, and for each order a Bloom filter that holds
(n-gram, 1) ... (n-gram, q) for a count of quantised level q, levels being the distinct ceilings of powers of BASE. It answers every n-gram that
came by probing levels until one is missing; the answers go back to the blocks, which add up their documents' scores. So the
filter grows with the text, in segments of bounded size that never leave their owners: neither the driver nor a worker
holds all of it, and each n-gram of a block moves once each way.

A level is read back as the mean of the counts that the order has at it, so that counts are right in total. Orders are interpolated:
p(w | h) = (1 - g(h)) c(hw) / c(h) + g(h) p(w | shorter h), and a context that training has not seen leaves p(w | shorter h) as it is.
g depends on the context alone, and each occurrence of a context is followed by one token, so a context's probabilities sum to
1 but for what quantisation does. g(h) = D (1 + (c(h) - 1) s) / c(h): D is the order's n1 / (n1 + 2 n2), from the
numbers of its n-grams that occur once and twice, and s how many new n-grams a further occurrence of a context brings on average. The
lowest order is the base's, which leaves one unknown token the rest.

Defined results: a null text is empty, and an empty text has one token, its end. A null id counts as ''. Rows that
repeat an id are scored each for itself. With no training text, all counts are 0 and the base is log10(1) a token.
Only the id and text columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, runs, stored, words

ORDER = 3
#: Probes an entry; each entry has PROBES / ln 2 bits, so a missing n-gram passes once in 2**PROBES.
PROBES = 10
#: Levels start at the distinct ceilings of its powers: 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, ...
BASE = 2**0.25
#: Tokens of a block, and bytes of text that a segment is for.
BLOCK = 1_000_000
SEGMENT = 16 << 20

U = np.uint64
LOW = U((1 << 32) - 1)
FIRST, LAST = (U(xxhash.xxh64_intdigest(x)) for x in (b"\t", b"\n"))  # no words
#: The smallest count of each level.
VALUE = np.array([0.0, *sorted({math.ceil(round(BASE**q, 9)) for q in range(160)})])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x moves every bit."""
    x = (x ^ x >> U(33)) * U(0xFF51AFD7ED558CCD)
    x = (x ^ x >> U(33)) * U(0xC4CEB9FE1A85EC53)
    return x ^ x >> U(33)


def bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Which of n parts of the hash space a 64-bit key is in."""
    return (key >> U(32)) * U(n) >> U(32)


def deflated(values: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes, which are alike."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def inflated(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Block:
    """Tokens of some texts in one array: a start mark, the words and the end of each."""

    def __init__(self, types: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.types, self.ids, self.size = types, ids, size
        self.first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        self.place = np.arange(len(ids)) - np.repeat(self.first, size)

    @staticmethod
    def of(texts: list[str | None]) -> Block:
        at: dict[bytes, int] = {}
        hashes, ids, size = [FIRST, LAST], [], []
        for t in texts:
            w = words(t)
            own = [at.get(x, 0) for x in w]
            if 0 in own:
                for i, x in enumerate(w):
                    if not own[i]:
                        if x not in at:
                            at[x] = len(hashes)
                            hashes.append(U(xxhash.xxh64_intdigest(x)))
                        own[i] = at[x]
            ids.append(np.array([0, *own, 1], np.uint32))
            size.append(len(w) + 2)
        return Block(np.array(hashes, U), np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(size, np.int64))

    def grams(self, n: int, order: int) -> dict[int, np.ndarray]:
        """For each order, each token's key: its bucket, and 32 bits; meant where a context of that length is inside the text."""
        word = self.types[self.ids]
        out, key = {}, word
        for k in range(2, order + 1):
            key = mixed(np.r_[U(0), key[:-1]] * U(0x9E3779B97F4A7C15) + word + U(k))
            out[k] = bucket(key, n) << U(32) | key & LOW
        return out

    def inside(self, k: int) -> np.ndarray:
        return self.place >= k - 1


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches with about BLOCK tokens each, by their characters."""
    for b in batches:
        texts, start, held = b.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t or "") // 6 + 2
            if held >= BLOCK or i == len(texts) - 1:
                yield b.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(key)
    key, count = key[by], count[by]
    first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first) if len(first) else count[:0]


def levels(count: np.ndarray) -> np.ndarray:
    """The last level whose smallest count is not above the count; 0 for 0."""
    return np.searchsorted(VALUE, count, "right") - 1


class Filter:
    """(key, 1) ... (key, level) of each key, in one bit array."""

    def __init__(self, key: np.ndarray, count: np.ndarray) -> None:
        level = levels(count)
        self.bits = max(64, math.ceil(int(level.sum()) * PROBES / math.log(2)))
        flags = np.zeros(self.bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            a, step = self.start(key[level >= q], q)
            for i in range(PROBES):
                flags[(a + U(i) * step) % U(self.bits)] = True
        self.data = np.packbits(flags, bitorder="little")

    def start(self, key: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        a = mixed(key * U(256) + U(q))
        return a, mixed(a + U(1)) | U(1)

    def level(self, key: np.ndarray) -> np.ndarray:
        """The quantised level of each key's count; 0 for what isn't there."""
        out, some, q = np.zeros(len(key), np.uint8), np.arange(len(key)), 0
        while len(some):
            q += 1
            a, step = self.start(key[some], q)
            alive = np.arange(len(some))
            for i in range(PROBES):
                at = (a[alive] + U(i) * step[alive]) % U(self.bits)
                alive = alive[(self.data[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)]
            some = some[alive]
            out[some] = q
        return out


def written(rows: DataFrame) -> DataFrame:
    """``block, doc_id, held_out, size, types, ids``: arrays over a block's documents, and its words."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b, texts in blocks(batches):
            block = Block.of(texts)
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c))
            columns = [pa.array([number]), whole("doc_id"), whole("held_out"), *([deflated(x)] for x in (block.size, block.types, block.ids))]
            yield pa.RecordBatch.from_arrays([*columns[:3], *(pa.array(c, pa.binary()) for c in columns[3:])], ["block", "doc_id", "held_out", "size", "types", "ids"])
            number += 1

    return stored(rows.mapInArrow(each, f"block long, doc_id array<{kind}>, held_out array<boolean>, size binary, types binary, ids binary"), "blocks")


def read(b: pa.RecordBatch, r: int) -> Block:
    return Block(*(inflated(b.column(c)[r].as_py(), kind) for c, kind in (("types", "<u8"), ("ids", "<u4"), ("size", "<i8"))))


def asked(table: DataFrame, n: int, order: int) -> DataFrame:
    """``slot, block, keys, counts``: a block's distinct words and n-grams of each bucket and order; slot is 8 bucket + order."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                block, number = read(b, r), b.column("block")[r].as_py()
                train = np.repeat(~np.array(b.column("held_out")[r].as_py(), bool), block.size)
                counts = np.bincount(block.ids[train], minlength=len(block.types))
                found = [(1, *(x[1:] for x in (block.types, counts)))]
                found += [(k, key[block.inside(k)], train[block.inside(k)].astype(np.int64)) for k, key in block.grams(n, order).items()]
                for k, key, count in found:
                    key, count = summed(key, count)
                    part = bucket(key, n) if k == 1 else key >> U(32)
                    edges = np.searchsorted(part, np.arange(n + 1, dtype=U))
                    some = np.flatnonzero(edges[:-1] < edges[1:])
                    cut = [slice(edges[i], edges[i + 1]) for i in some]
                    steps = [np.diff(key[c] if k == 1 else (key[c] & LOW).astype("<u4"), prepend=key.dtype.type(0) if k == 1 else np.uint32(0)) for c in cut]
                    columns = [pa.array(some * 8 + k), pa.array(np.full(len(some), number)), pa.array([deflated(x) for x in steps], pa.binary()), pa.array([deflated(count[c].astype("<u4")) for c in cut], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "block", "keys", "counts"])

    return table.select("block", "held_out", "size", "types", "ids").mapInArrow(each, "slot long, block long, keys binary, counts binary")


def answered(rows: DataFrame, n: int) -> DataFrame:
    """``slot, block, answer``, and a row of each slot with block -1 and ``sums``: tokens, distinct ones, those that occur once and twice, and for each level of counts their sum and number."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "slot"):
            slots = t.column("slot").to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]), len(slots)]
            for a, z in zip(edges, edges[1:]):
                slot, part = int(slots[a]), t.slice(a, z - a)
                kind = "<u8" if slot % 8 == 1 else "<u4"
                keys = [np.cumsum(inflated(x, kind), dtype=kind) for x in part.column("keys").to_pylist()]
                counts = [inflated(x, "<u4").astype(np.int64) for x in part.column("counts").to_pylist()]
                wanted, at = np.unique(np.concatenate(keys), return_inverse=True)
                held = np.bincount(at, np.concatenate(counts), len(wanted)).astype(np.int64)
                key, count = wanted[held > 0], held[held > 0]
                level = levels(count)
                each_level = np.stack([np.bincount(level, count), np.bincount(level)], 1).astype(np.int64)
                sums = [int(count.sum()), len(key), *(int((count == i).sum()) for i in (1, 2)), *each_level.ravel().tolist()]
                # what many blocks ask is probed once
                answer = held if slot % 8 == 1 else Filter(key.astype(U), count).level(wanted.astype(U))
                out = np.split(answer[at], np.cumsum([len(x) for x in keys])[:-1])
                columns = [pa.array([slot] * (z - a + 1), pa.int64()), pa.array([*part.column("block").to_pylist(), -1], pa.int64()),
                           pa.array([*map(deflated, out), None], pa.binary()), pa.array([None] * (z - a) + [sums], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "block", "answer", "sums"])

    dealt = rows.repartition(n, "slot").sortWithinPartitions("slot")
    return stored(dealt.mapInArrow(each, "slot long, block long, answer binary, sums array<long>"), "answers")


@dataclass
class Totals:
    """Of one order, in the training text: tokens, distinct n-grams, those that occur once and twice, and the mean count of each level."""

    tokens: int = 0
    kinds: int = 0
    once: int = 0
    twice: int = 0
    mean: np.ndarray = field(default_factory=VALUE.copy)

    @staticmethod
    def of(sums: dict[int, int]) -> Totals:
        """From what ``answered`` sums up, by place."""
        out = Totals(*(sums.get(i, 0) for i in range(4)))
        for q in range(len(VALUE)):
            if sums.get(5 + 2 * q):
                out.mean[q] = sums[4 + 2 * q] / sums[5 + 2 * q]
        return out

    def discount(self) -> float:
        return min(max(self.once, 1) / (max(self.once, 1) + 2 * max(self.twice, 1)), 0.95)


def finished(block: Block, answers: dict[int, np.ndarray], totals: dict[int, Totals], n: int, order: int) -> tuple[np.ndarray, ...]:
    """Known tokens, base score and score of each text of a block."""
    counts = np.zeros(len(block.types), np.int64)
    counts[1 + np.argsort(block.types[1:])] = answers[1]
    real = block.place > 0
    c = counts[block.ids]
    base = np.where(real, (c + 0.1) / (totals[1].tokens + 0.1 * (totals[1].kinds + 1)), 1.0)
    context = np.where(block.place == 0, counts[1], c).astype(float)  # a start is as frequent as an end
    p = base
    for k, key in block.grams(n, order).items():
        inside = block.inside(k)
        found, at = np.unique(key[inside], return_inverse=True)
        own, lower = totals[k], totals[k - 1]
        count = np.zeros(len(key))
        count[inside] = own.mean[answers[k]][at] if len(found) else 0.0
        d = own.discount()
        new = min(max((own.kinds - lower.kinds) / max(own.tokens - lower.kinds, 1), 0.0), 1.0)
        h = np.r_[0.0, context[:-1]]
        some = np.maximum(h, 1.0)
        left = np.minimum(d * (1 + (some - 1) * new) / some, 1.0)
        p = np.where(inside & (h > 0), (1 - left) * np.minimum(count / some, 1.0) + left * p, p)
        context = count
    total = lambda x: np.add.reduceat(x, block.first)
    return total((real & (c > 0)).astype(np.int64)), total(np.log10(base)), total(np.log10(p))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``; up to order 7."""
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    n = max(partitions(spark), -(-size // segment))
    table = written(rows)
    answers = answered(asked(table, n, order), n)
    sums = answers.where("block < 0").select((F.col("slot") % 8).alias("k"), F.posexplode("sums").alias("i", "x"))
    sums = {(r.k, r.i): r.x for r in sums.groupBy("k", "i").agg(F.sum("x").alias("x")).collect()}  # two numbers a level and order
    totals = {k: Totals.of({i: x for (j, i), x in sums.items() if j == k}) for k in range(1, order + 1)}
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done() -> pa.RecordBatch:
            block, ids, flags, parts = held
            found = {k: np.concatenate([np.zeros(0, np.int64 if k == 1 else np.uint8), *x]) for k, x in parts.items()}
            known, base, score = finished(block, found, totals, n, order)
            columns = [block.size - 1, known, np.full(len(known), totals[1].tokens), base, score]
            return pa.RecordBatch.from_arrays([ids, flags, *map(pa.array, columns)], names)

        for b in batches:
            for r in range(b.num_rows):
                slot = b.column("slot")[r].as_py()
                if slot < 0:
                    if held:
                        yield done()
                    ids, flags = b.column("doc_id").slice(r, 1).flatten(), b.column("held_out").slice(r, 1).flatten()
                    held = read(b, r), ids, flags, {k: [] for k in range(1, order + 1)}
                else:
                    held[3][slot % 8].append(inflated(b.column("answer")[r].as_py(), "<i8" if slot % 8 == 1 else "<u1"))
        if held:
            yield done()

    both = table.withColumn("slot", F.lit(-1).cast("long")).unionByName(answers.where("block >= 0").drop("sums"), allowMissingColumns=True)
    both = both.repartition(partitions(spark), "block").sortWithinPartitions("block", "slot")
    return both.mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_bloomlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
